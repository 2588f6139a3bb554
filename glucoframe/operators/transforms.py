"""Transforms of result columns: natural log, z-score, rank-based inverse normal; optionally within sex."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glucoframe.functions.normal import qnorm, qnorm_array
from glucoframe.operators.calculate import to_long
from glucoframe.operators.catalog import INDEX_IDS
from glucoframe.operators.ranking import LIMITS, ROW_BITS, Limits, column_ranks, mean_rank, range_ranks, read_ranks
from glucoframe.session import broadcast_if_small, cut_lineage

KINDS = ("none", "log", "z", "rint")
BLOM_OFFSET = 0.375
MAX_GROUPS_BROADCAST = 100_000


@dataclass(frozen=True)
class Transform:
    kind: str = "none"
    within: str | None = None  # group column, e.g. "sex"

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"transform {self.kind!r} is not valid (use {', '.join(KINDS)})")

    @property
    def suffix(self) -> str:
        """Column suffix, e.g. _rint_bysex; empty without a transform."""
        if self.kind == "none":
            return ""
        return f"_{self.kind}" + (f"_by{self.within}" if self.within else "")


def log_transform(value: Column) -> Column:
    """ln of positive values; the others become missing."""
    return F.when(value > 0, F.ln(value))


def _grouped(long: DataFrame, t: Transform) -> tuple[DataFrame, list[str]]:
    """Rows that can be transformed (a missing group label makes a value missing) and the keys."""
    if t.within is None:
        return long, ["index_id"]
    labelled = long.where(F.col(t.within).isNotNull() & (F.col(t.within) != ""))
    return labelled, ["index_id", t.within]


def group_moments(long: DataFrame, t: Transform) -> DataFrame:
    """Per index (and group): n, mean, sd (n - 1), lowest and highest value, values <= 0."""
    labelled, keys = _grouped(long, t)
    return labelled.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.count_if(F.col("value") <= 0).alias("non_positive"),
    )


def z_possible() -> Column:
    return (F.col("n") >= 2) & (F.col("low") < F.col("high")) & (F.col("sd") > 0)


def transform_long(long: DataFrame, t: Transform, limits: Limits = LIMITS) -> DataFrame:
    """Adds `transformed` to long values (index_id, value, and the group column when t.within is set).

    Rows without a group label are dropped by a within-group transform: their value is missing.
    """
    labelled, keys = _grouped(long, t)
    if t.kind == "none":
        return labelled.withColumn("transformed", F.col("value"))
    if t.kind == "log":
        return labelled.withColumn("transformed", log_transform(F.col("value")))
    if t.kind == "z":
        moments = cut_lineage(group_moments(long, t)).where(z_possible()).select(*keys, "mean", "sd")
        scaled = labelled.join(broadcast_if_small(moments, MAX_GROUPS_BROADCAST), keys, "left")
        return scaled.withColumn("transformed", (F.col("value") - F.col("mean")) / F.col("sd")).drop("mean", "sd")
    ranked = _with_ranks(labelled, keys, limits)
    return ranked.withColumn("transformed", blom(mean_rank(), F.col("total"))).select(*labelled.columns, "transformed")


def _with_ranks(long: DataFrame, keys: list[str], limits: Limits) -> DataFrame:
    return range_ranks(long, keys, "value", limits=limits)


def blom(rank: Column, n: Column) -> Column:
    return qnorm((rank - BLOM_OFFSET) / (n + 1 - 2 * BLOM_OFFSET))


def rank_long(long: DataFrame, t: Transform = Transform(), limits: Limits = LIMITS) -> DataFrame:
    """Adds `rank`: 1-based, ties share their mean rank."""
    labelled, keys = _grouped(long, t)
    return _with_ranks(labelled, keys, limits).withColumn("rank", mean_rank()).select(*labelled.columns, "rank")


def index_columns(df: DataFrame) -> list[str]:
    """The index columns of a results table, in its order."""
    known = set(INDEX_IDS) | {f"{i}_inv" for i in INDEX_IDS}
    return [c for c in df.columns if c in known]


def transform_results(
    results: DataFrame,
    t: Transform,
    *,
    key: str = "participant_id",
    columns: list[str] | None = None,
    keep_only: bool = False,
) -> DataFrame:
    """Results table with `<column><suffix>` directly after each transformed column.

    keep_only keeps the `key` and the transformed columns. The key may repeat or be missing: rows are told apart by
    a number of their own.
    """
    available = index_columns(results)
    if not available:
        raise ValueError("no index columns found; this is not a results table")
    columns = available if columns is None else [c for c in available if c in set(columns)]
    if not columns:
        raise ValueError(f"no columns selected (available: {', '.join(available)})")
    if t.kind == "none":
        return results
    if t.kind == "log" or (t.kind == "z"):
        added = _narrow(results, t, columns)
    else:
        added = _ranked(results, t, columns, [key] if keep_only else results.columns)
    names = []
    for c in ([key, *columns] if keep_only else results.columns):
        if not (keep_only and c in columns):
            names.append(c)
        if c in columns:
            names.append(c + t.suffix)
    return added.select(*[F.col(n) for n in names])


def _narrow(results: DataFrame, t: Transform, columns: list[str]) -> DataFrame:
    """log and z need no row to move: z takes the few means and SDs as one broadcast row per group."""
    labelled = F.lit(True) if t.within is None else F.col(t.within).isNotNull() & (F.col(t.within) != "")
    if t.kind == "log":
        return results.select(
            "*", *[F.when(labelled, log_transform(F.col(c))).alias(c + t.suffix) for c in columns]
        )
    keep = [t.within] if t.within else []
    moments = cut_lineage(group_moments(to_long(results, columns, keep), t)).where(z_possible())
    group = t.within or "_all"
    scales = (
        (moments if t.within else moments.withColumn("_all", F.lit(1)))
        .groupBy(group)
        .agg(F.map_from_entries(F.collect_list(F.struct("index_id", F.struct("mean", "sd")))).alias("_scales"))
    )
    rows = results if t.within else results.withColumn("_all", F.lit(1))
    joined = rows.join(broadcast_if_small(scales, MAX_GROUPS_BROADCAST), group, "left")
    scaled = []
    for c in columns:
        scale = F.try_element_at("_scales", F.lit(c))
        value = F.when(~F.isnan(c), F.col(c))
        scaled.append((((value - scale["mean"]) / scale["sd"])).alias(c + t.suffix))
    return joined.select(*results.columns, *scaled)


def _ranked(results: DataFrame, t: Transform, columns: list[str], keep: list[str]) -> DataFrame:
    """One shuffle of packed values out to their order, one back to their rows.

    Rows are numbered and written first. A value goes out with its row's number; its rank comes back to
    the block of neighbouring row numbers it belongs to, where a task fills the block's columns. `keep` are the columns that
    stay beside them.
    """
    group = [] if t.within is None else [t.within]
    names = [c for c in results.columns if c in {*keep, *columns, *group}]
    numbered = cut_lineage(results.select(*[F.col(f"`{c}`") for c in names], F.monotonically_increasing_id().alias("_row")))
    back = column_ranks(numbered, columns, group, "_row").select("_block", "_column", "_rows", "_base", "_total")
    kept = numbered.select(F.shiftright("_row", ROW_BITS).alias("_block"), "_row", F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"))
    shape = T.StructType([kept.schema["kept"], *[T.StructField(f"c{k}", T.DoubleType()) for k in range(len(columns))]])

    def fill(rows: pa.Table, pieces: pa.Table) -> pa.Table:
        numbers = rows.column("_row").to_numpy() & ((1 << ROW_BITS) - 1)
        order = np.argsort(numbers)
        made = np.full((len(columns), len(numbers)), np.nan)
        for column, piece, base, total in zip(*(pieces.column(n) for n in ("_column", "_rows", "_base", "_total"))):
            places, twice, _ = read_ranks(piece)
            at = order[np.searchsorted(numbers, places, sorter=order)]
            rank = (twice + base[0].as_py()) / 2.0
            made[column.as_py(), at] = (rank - BLOM_OFFSET) / (total[0].as_py() + 1 - 2 * BLOM_OFFSET)
        filled = []
        for line in made:
            present = ~np.isnan(line)
            line[present] = qnorm_array(line[present])
            filled.append(pa.array(line, mask=~present))
        return pa.table([rows.column("kept"), *filled], names=["kept", *[f"c{k}" for k in range(len(columns))]])

    joined = kept.groupBy("_block").cogroup(back.groupBy("_block")).applyInArrow(fill, shape)
    return joined.select("kept.*", *[F.col(f"c{k}").alias(c + t.suffix) for k, c in enumerate(columns)])


def attach_sex(results: DataFrame, source: DataFrame, key: str = "participant_id") -> DataFrame:
    """Sex from the original table by id. Duplicate ids on either side and ids not found are errors.

    Both sides meet once, in one table grouped by id: a group holds how often the id stands on either side, the row and the sex.
    A row without an id has no partner and is an error too. Up to five ids of the first kind of error are named.
    """
    names = results.drop("sex").columns
    kept = F.struct(*[F.col(f"`{c}`") for c in names])
    left = results.select(F.col(f"`{key}`").alias("_id"), F.lit(1).alias("_here"), F.lit(0).alias("_there"), kept.alias("_kept"), F.lit(None).cast("string").alias("_sex"))
    nothing = F.lit(None).cast(left.schema["_kept"].dataType)
    right = source.select(F.col(f"`{key}`").alias("_id"), F.lit(0).alias("_here"), F.lit(1).alias("_there"), nothing.alias("_kept"), F.col("sex").alias("_sex"))
    met = left.union(right).groupBy("_id").agg(
        F.sum("_here").alias("_here"), F.sum("_there").alias("_there"), F.first("_kept", ignorenulls=True).alias("_kept"), F.max("_sex").alias("_sex")
    )
    unknown = (F.col("_here") > 0) & ((F.col("_there") == 0) | F.col("_id").isNull())
    problem = F.when(F.col("_id").isNotNull() & (F.col("_here") > 1), 1).when(F.col("_id").isNotNull() & (F.col("_there") > 1), 2).when(unknown, 3)
    met = cut_lineage(met.withColumn("_problem", problem))
    found = {}
    for number in (1, 2, 3):
        rows = met.where(F.col("_problem") == number).select(F.coalesce(F.col("_id").cast("string"), F.lit("(none)")).alias("id")).limit(5).collect()
        if rows:
            found[number] = ", ".join(sorted(r.id for r in rows))
            break
    for number, side in ((1, "results"), (2, "source")):
        if number in found:
            raise ValueError(f"{side}: duplicate participant IDs: {found[number]}; within-sex needs unique IDs")
    if 3 in found:
        raise ValueError(f"participant IDs not found in the source: {found[3]}")
    return met.where("_here = 1").select("_kept.*", F.col("_sex").alias("sex"))


def transform_report(results: DataFrame, t: Transform, columns: list[str] | None = None) -> DataFrame:
    """Per column (and group): n, values <= 0 set to missing (log), values without a group, why not transformed."""
    columns = columns or index_columns(results)
    keep = [t.within] if t.within else []
    long = to_long(results, columns, keep)
    moments = group_moments(long, t)
    reason = F.lit(None).cast("string")
    if t.kind == "z":
        reason = F.when(F.col("n") < 2, "fewer than 2 non-missing values").when(~z_possible(), "SD is 0")
    keys = ["index_id"] + keep
    report = moments.select(
        *keys, "n", (F.col("non_positive") if t.kind == "log" else F.lit(0).cast("bigint")).alias("non_positive"),
        reason.alias("not_transformed"),
    )
    if not t.within:
        return report.withColumn("no_group", F.lit(0).cast("bigint"))
    lacking = long.groupBy("index_id").agg(
        F.count_if(F.col(t.within).isNull() | (F.col(t.within) == "")).alias("no_group")
    )
    return report.join(lacking, "index_id", "left")
