"""One query per index: status and value of every visit."""

from __future__ import annotations

from pyspark.sql import functions as F

from glucoframe.operators.calculate import calculate_wide
from glucoframe.plans.index_sql import decimals, index_query
from glucoframe.plans.source import Query, Source, rounded

ORDER = (
    "homa_ir quicki firi raynaud isi_basal ig_ratio_basal belfiore_basal avignon_si0 "
    "isi_120 ig_ratio_120 gutt matsuda_3pt matsuda_auc_3pt matsuda_5pt stumvoll_mod stumvoll_dem bigtt_si "
    "avignon_si120 avignon_sim belfiore_isi_gly hiri ifc "
    "revised_quicki mcauley tyg tg_hdl vai lap adipo_ir belfiore_isi_ffa liri lipo atiri "
    "homa_beta cir30 stumvoll_first_phase insulinogenic_dg30 insulinogenic_g30 di_madsen_table di_xinsg30_matsuda "
    "bigtt_air di_bigtt glucagon_fasting glucagon_auc glucagon_ratio_120_0 glucagon_suppression_pct_60 "
    "glucagon_insulin_ratio"
).split()


def _run(id_: str):
    def run(src: Source):
        wide = calculate_wide(src.cohort(), ids=[id_], keep=["visit_id"], status_columns=True)
        return wide.select("visit_id", F.col(f"{id_}_status").alias("status"), rounded(id_, decimals(id_)).alias("value"))

    return run


QUERIES = {f"I{n:02d}_{id_}": Query(_run(id_), index_query(id_)) for n, id_ in enumerate(ORDER, start=1)}
