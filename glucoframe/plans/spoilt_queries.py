"""Queries over a cohort with every kind of invalid input, and with FFA samples that reach all forms of the FFA index."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoframe.operators.calculate import calculate_long, calculate_wide
from glucoframe.operators.tally import reason_counts
from glucoframe.plans.cohort_sql import with_prepared
from glucoframe.plans.index_sql import PLAIN, decimals, long_status_cte, rounded_value_sql, status_sql
from glucoframe.plans.source import Query, Source, rounded, rounded_sql

FFA = "belfiore_isi_ffa"
# column -> (what it becomes, for visits with this remainder of visit_id by a prime)
SPOILT = {
    "g0": ((41, "NaN"), (43, "Infinity")), "i0": ((47, "-1"), (53, "0")), "weight": ((59, "-Infinity"),), "tg": ((61, "NaN"),), "g30": ((67, "-3.5"),),
    "ffa0": ((71, "-0.2"),), "i120": ((73, "Infinity"),), "gl0": ((79, "0"),), "bmi": ((83, "NaN"),), "hdl": ((89, "-Infinity"),),
}


def spoilt(src: Source) -> DataFrame:
    cohort = src.cohort().withColumns({
        "ffa60": F.expr("CASE WHEN visit_id % 4 <> 0 THEN CASE WHEN visit_id % 101 = 1 THEN double('NaN') ELSE 0.3D + g60 / 50D END END"),
        "ffa120": F.expr("CASE WHEN visit_id % 5 <> 0 THEN CASE WHEN visit_id % 103 = 1 THEN -1D ELSE 0.2D + g120 / 60D END END"),
    })
    for column, changes in SPOILT.items():
        for prime, value in changes:
            cohort = cohort.withColumn(column, F.expr(f"CASE WHEN visit_id % {prime} = 1 THEN double('{value}') ELSE {column} END"))
    return cohort


def _spoilt_sql(query: str, *ctes: str) -> str:
    """The query over the spoilt cohort. DuckDB takes NaN for the largest number, so a valid input is also below infinity."""
    cells = []
    for column, changes in SPOILT.items():
        whens = " ".join(f"WHEN visit_id % {prime} = 1 THEN '{value}'::DOUBLE" for prime, value in reversed(changes))
        cells.append(f"CASE {whens} ELSE {column} END AS {column}")
    more = (
        "CASE WHEN visit_id % 4 <> 0 THEN CASE WHEN visit_id % 101 = 1 THEN 'NaN'::DOUBLE ELSE 3E-1 + g60 / 50E0 END END AS ffa60, "
        "CASE WHEN visit_id % 5 <> 0 THEN CASE WHEN visit_id % 103 = 1 THEN -1E0 ELSE 2E-1 + g120 / 60E0 END END AS ffa120"
    )
    text = with_prepared(query, *ctes).replace("prepared AS (", f"spoilt AS (SELECT * REPLACE ({', '.join(cells)}), {more} FROM cohort),\nprepared AS (", 1)
    text = text.replace("AS hdlmg FROM cohort)", "AS hdlmg FROM spoilt)", 1)
    return re.sub(r"NOT (\w+) > 0", r"NOT (\1 > 0 AND \1 < 'Infinity'::DOUBLE)", text)


def invalid_kinds(src: Source) -> DataFrame:
    """Reasons where inputs are NaN, infinite, negative or zero."""
    return reason_counts(spoilt(src), ids=list(PLAIN)).where("status = 'error'").drop("status")


INVALID_KINDS_SQL = _spoilt_sql(
    "SELECT method_id, reason, count(*) AS rows FROM statuses WHERE status = 'error' GROUP BY 1, 2", long_status_cte(list(PLAIN), reasons=True)
)


def invalid_values(src: Source) -> DataFrame:
    """Status and value of every index but the composed ones where inputs are of any kind."""
    wide = calculate_wide(spoilt(src), ids=list(PLAIN), keep=["visit_id"], status_columns=True)
    return wide.select("visit_id", *[rounded(i, decimals(i)).alias(i) for i in PLAIN], *[f"{i}_status" for i in PLAIN])


INVALID_VALUES_SQL = _spoilt_sql(
    "SELECT visit_id, " + ", ".join(f"{rounded_value_sql(i)} AS {i}, {status_sql(i)} AS {i}_status" for i in PLAIN) + " FROM prepared"
)


def ffa_forms(src: Source) -> DataFrame:
    """The FFA index in its two area forms and the basal one."""
    long = calculate_long(spoilt(src), ids=[FFA], keep=["visit_id"], details=True)
    ok = F.col("status") == "ok"
    return long.select(
        "visit_id", "status", rounded("value").alias("value"), F.when(ok, F.col("details")["form"]).alias("form"),
        F.when(ok, F.col("details")["variant"]).alias("variant"), F.size("warnings").alias("warnings"),
    )


_USED = {"0_1_2h": ("i0", "i60", "i120", "ffa0", "ffa60", "ffa120"), "0_2h": ("i0", "i120", "ffa0", "ffa120"), "basal": ("i0", "ffa0")}
_VALUES = {
    "0_1_2h": "2E0 / (((5E-1*i0 + i60 + 5E-1*i120) / 638E0) * ((5E-1*ffa0 + ffa60 + 5E-1*ffa120) / 29625E-5) + 1E0)",
    "0_2h": "2E0 / (((i0 + i120) / 36304E-2) * ((ffa0 + ffa120) / 478E-3) + 1E0)",
    "basal": "2E0 / ((i0 / 6571E-2) * (ffa0 / 39888E-5) + 1E0)",
}
FFA_FORMS_SQL = _spoilt_sql(
    f"SELECT visit_id, status, CASE WHEN status = 'ok' THEN {rounded_sql('value')} END AS value, "
    "CASE WHEN status = 'ok' THEN CASE WHEN used = 'basal' THEN 'basal' ELSE 'area' END END AS form, "
    "CASE WHEN status = 'ok' AND used <> 'basal' THEN used END AS variant, CAST(CASE WHEN status = 'ok' AND used = 'basal' THEN 1 ELSE 0 END AS INTEGER) AS warnings "
    "FROM (SELECT visit_id, used, CASE WHEN i0 IS NULL OR ffa0 IS NULL THEN 'unavailable' "
    + " ".join(f"WHEN used = '{form}' AND ({' OR '.join(f'NOT {n} > 0' for n in names)}) THEN 'error'" for form, names in _USED.items())
    + " ELSE 'ok' END AS status, CASE used " + " ".join(f"WHEN '{form}' THEN {value}" for form, value in _VALUES.items()) + " END AS value FROM formed)",
    "formed AS (SELECT *, CASE WHEN i120 IS NULL OR ffa120 IS NULL THEN 'basal' WHEN i60 IS NULL OR ffa60 IS NULL THEN '0_2h' ELSE '0_1_2h' END AS used FROM prepared)",
)

QUERIES = {
    "A02_invalid_kinds": Query(invalid_kinds, INVALID_KINDS_SQL),
    "A02_invalid_values": Query(invalid_values, INVALID_VALUES_SQL),
    "I30_belfiore_ffa_forms": Query(ffa_forms, FFA_FORMS_SQL),
}
