"""Comparing results with values computed elsewhere."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOLERANCE = 1e-9
TINY = 1e-300


@dataclass(frozen=True)
class Counterpart:
    """How a column of another implementation relates to an index: equal, negated, different or none."""

    index_id: str
    relation: str
    column: str | None = None
    column_male: str | None = None
    column_female: str | None = None
    scale: float | None = None


GUTT_SCALE = 18 * math.log(10)
# Columns of an earlier R implementation and how they relate.
EARLIER_COLUMNS = (
    Counterpart("homa_ir", "negated", "Homa_IR_inv"),
    Counterpart("quicki", "different", "Quicki"),
    Counterpart("firi", "different", "Firi"),
    Counterpart("raynaud", "equal", "Raynaud"),
    Counterpart("isi_basal", "equal", "Isi_basal"),
    Counterpart("ig_ratio_basal", "negated", "Ig_ratio_basal"),
    Counterpart("belfiore_basal", "different", "Belfiore_basal"),
    Counterpart("isi_120", "equal", "Isi_120"),
    Counterpart("ig_ratio_120", "negated", "Ig_ratio_120"),
    Counterpart("gutt", "different", "Gutt_index", scale=GUTT_SCALE),
    Counterpart("matsuda_3pt", "equal", "Matsuda_ISI"),
    Counterpart("matsuda_auc_3pt", "equal", "Matsuda_Auc"),
    Counterpart("stumvoll_mod", "equal", "Modified_stumvoll"),
    Counterpart("stumvoll_dem", "equal", "Stumvoll_Demographics"),
    Counterpart("bigtt_si", "equal", "BigttSi"),
    Counterpart("avignon_si0", "equal", "Avignon_Si0"),
    Counterpart("avignon_si120", "equal", "Avignon_Si120"),
    Counterpart("belfiore_isi_gly", "different", "Belfiore_isi_gly"),
    Counterpart("revised_quicki", "equal", "Revised_QUICKI"),
    Counterpart("mcauley", "equal", "McAuley_index"),
    Counterpart("tyg", "negated", "TyG_inv"),
    Counterpart("tg_hdl", "negated", "TG_HDL_C_inv"),
    Counterpart("adipo_ir", "negated", "Adipo_inv"),
    Counterpart("belfiore_isi_ffa", "different", "Belfiore_inv_FFA"),
    Counterpart("hiri", "negated", "HIRI_inv"),
    Counterpart("avignon_sim", "equal", "Avignon_Sim"),
    Counterpart("ifc", "negated", "Ifc_inv"),
    Counterpart("liri", "negated", "LIRI_inv"),
    Counterpart("lipo", "negated", "Lipo_inv"),
    Counterpart("atiri", "negated", "ATIRI_inv"),
    Counterpart("vai", "negated", column_male="VAI_Men_inv", column_female="VAI_Women_inv"),
    Counterpart("lap", "negated", column_male="LAP_Men_inv", column_female="LAP_Women_inv"),
)

# Columns of an islet-hormone R implementation, all equal at its insulin factor.
ISLET_INSULIN_FACTOR = 1 / 0.1667
ISLET_COLUMNS = (
    Counterpart("homa_beta", "equal", "Homa_beta"),
    Counterpart("cir30", "equal", "Cir"),
    Counterpart("stumvoll_first_phase", "equal", "Stumvoll"),
    Counterpart("insulinogenic_dg30", "equal", "Xinsdg30"),
    Counterpart("insulinogenic_g30", "equal", "Xinsg30"),
    Counterpart("di_madsen_table", "equal", "Di"),
    Counterpart("bigtt_air", "equal", "Bigtt_air"),
    Counterpart("di_bigtt", "equal", "Dibig"),
    Counterpart("glucagon_fasting", "equal", "Fasting_glucagon"),
    Counterpart("glucagon_auc", "equal", "Glucagon_auc"),
    Counterpart("glucagon_ratio_120_0", "equal", "Glucagon_suppression_ratio"),
    Counterpart("glucagon_insulin_ratio", "equal", "Glucagon_insulin_ratio"),
)

MAP_SCHEMA = "index_id string, relation string, sex string, column string, scale double"


def counterpart_map(spark: SparkSession, counterparts: tuple[Counterpart, ...]) -> DataFrame:
    """One row per (index, other column); sex is NULL unless the column holds one sex only."""
    rows = []
    for c in counterparts:
        if c.column is not None:
            rows.append((c.index_id, c.relation, None, c.column, c.scale))
        else:
            rows.append((c.index_id, c.relation, "male", c.column_male, c.scale))
            rows.append((c.index_id, c.relation, "female", c.column_female, c.scale))
    return spark.createDataFrame(rows, MAP_SCHEMA)


def _other_value(c: Counterpart, columns: set[str], sex: str) -> Column | None:
    """The other table's value for an index; sex-specific columns follow its row's sex. None if it has no such column."""
    if c.column is not None:
        return F.col(c.column) if c.column in columns else None
    if {c.column_male, c.column_female} <= columns:
        return F.when(F.col(sex) == "male", F.col(c.column_male)).when(F.col(sex) == "female", F.col(c.column_female))
    return None


def relative_difference(a, b):
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(TINY))


def _refuse_repeats(df: DataFrame, key: str, name: str) -> None:
    found = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if found:
        raise ValueError(f"{name}: ids on several rows: {', '.join(str(r[key]) for r in found)}")


def compare_results(
    results: DataFrame, other: DataFrame, counterparts: tuple[Counterpart, ...], key: str, sex: str = "sex", tolerance: float = TOLERANCE
) -> DataFrame:
    """Calculated results against another implementation's table, one row per id of either and counterpart they both have.

    `results` is wide with status columns, `other` is wide in its own columns. Returns key, index_id, relation, value,
    other, relative_difference and verdict: match, mismatch, unavailable_both, unavailable_here, missing_there,
    missing_here (the id is on the other side only), known_scale, known_difference. Ids may not repeat on either side.
    The two tables meet in one full outer join; the verdicts are worked out inside its rows.
    """
    _refuse_repeats(results, key, "results")
    _refuse_repeats(other, key, "other table")
    there = set(other.columns)
    used = [(c, value) for c in counterparts if c.index_id in results.columns and (value := _other_value(c, there, sex)) is not None]
    ours = results.select(
        F.col(key).alias("_here"), *[F.col(c.index_id).alias(f"v_{c.index_id}") for c, _ in used],
        *[F.col(f"{c.index_id}_status").alias(f"s_{c.index_id}") for c, _ in used],
    )
    theirs = other.select(F.col(key).alias("_there"), *[value.cast("double").alias(f"o_{c.index_id}") for c, value in used])
    joined = ours.join(theirs, F.col("_here") == F.col("_there"), "full_outer")
    cells = []
    for c, _ in used:
        value, status, found = F.col(f"v_{c.index_id}"), F.col(f"s_{c.index_id}"), F.col(f"o_{c.index_id}")
        expected = -found if c.relation == "negated" else found
        if c.scale is not None:
            expected = expected * F.lit(c.scale)
        diff = relative_difference(value, expected)
        close = diff < tolerance
        if c.relation != "different":
            judged = F.when(close, "match").otherwise("mismatch")
        elif c.scale is not None:
            judged = F.when(close, "known_scale").otherwise("mismatch")
        else:
            judged = F.when(close, "mismatch").otherwise("known_difference")
        verdict = (
            F.when(F.col("_here").isNull(), "missing_here")
            .when(F.col("_there").isNull(), "missing_there")
            .when((status != "ok") & found.isNull(), "unavailable_both")
            .when(status != "ok", "unavailable_here")
            .when(found.isNull(), "missing_there")
            .otherwise(judged)
        )
        cells.append(F.struct(
            F.lit(c.index_id).alias("index_id"), F.lit(c.relation).alias("relation"), value.alias("value"), found.alias("other"),
            diff.alias("relative_difference"), verdict.alias("verdict"),
        ))
    return joined.select(F.coalesce("_here", "_there").alias(key), F.inline(F.array(*cells)))


def verdict_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("index_id", "verdict").agg(F.count(F.lit(1)).alias("rows"))
