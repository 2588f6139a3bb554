"""Kernel densities and histograms per index and group."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucoframe.operators.ranking import exact_quantiles
from glucoframe.session import broadcast_if_small, cut_lineage

# Grid and binning of the density estimate.
GRID_POINTS = 256
GRID_MARGIN_BANDWIDTHS = 3
MIN_BINS, BINS_PER_BANDWIDTH = 2048, 32
# Beyond this many bandwidths a kernel is 0 as a double, so leaving out farther points changes nothing.
KERNEL_REACH_BANDWIDTHS = 39
# Values within a 32nd of a bandwidth are summed up as powers of their distance from its middle. What the eleventh power and those
# after it would add is below 1e-10 of the sum at every grid point that a kernel reaches, and below 1e-20 of a kernel's peak.
CELLS_PER_BANDWIDTH, POWERS = 32, 10
MOST_CELLS = float(1 << 30)  # beyond, a value is a cell of its own
# Kernel centres a task holds back, and those it multiplies out at once.
BUFFERED, PIECE = 1 << 18, 1 << 11
# The usual least and greatest number of histogram bars.
USUAL_BINS = (10, 60)
MAX_GROUPS_BROADCAST = 100_000


def with_pooled(long: DataFrame, sex: str = "sex") -> DataFrame:
    """Every value under group 'all', and again under its sex when that is male or female."""
    groups = F.when(F.col(sex).isin("male", "female"), F.array(F.lit("all"), F.col(sex))).otherwise(
        F.array(F.lit("all"))
    )
    return long.select("index_id", "value", F.explode(groups).alias("group"))


def group_stats(long: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: n, sd, quartiles, median, range (materialised: one row per index and group)."""
    moments = [
        F.stddev_samp("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"),
    ]
    stats = exact_quantiles(long, keys, [0.25, 0.5, 0.75], also=moments)
    return cut_lineage(stats.select(
        *keys, "n", "sd", "low", "high", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    ))


def nrd0_bandwidth() -> Column:
    """0.9 * min(sd, IQR / 1.34) * n^(-1/5) over the columns of group_stats; falls back to the sd, then to the
    size of the (then constant) value, then to 1. NULL below 2 values."""
    varies = F.col("low") < F.col("high")
    sd = F.when(varies, F.col("sd")).otherwise(0.0)
    spread = F.least(sd, (F.col("q3") - F.col("q1")) / 1.34)
    size = F.abs(F.col("low"))
    scale = F.when(spread > 0, spread).when(sd > 0, sd).when(size > 0, size).otherwise(1.0)
    return F.when(F.col("n") >= 2, scale * 0.9 * F.pow(F.col("n").cast("double"), F.lit(-0.2)))


def bandwidths(long: DataFrame, keys: list[str]) -> DataFrame:
    return group_stats(long, keys).withColumn("bandwidth", nrd0_bandwidth())


def _grid_point() -> Column:
    """The x of each `point` (0 to 255) of a key, three bandwidths beyond its lowest and highest value."""
    margin = F.col("bandwidth") * GRID_MARGIN_BANDWIDTHS
    first, last = F.col("low") - margin, F.col("high") + margin
    return first + F.col("point") * (last - first) / (GRID_POINTS - 1)


def _add_kernels(centre: np.ndarray, weight: np.ndarray, low: float, high: float, bw: float, total: np.ndarray) -> None:
    """Add the kernels of sorted centres to the grid sums they reach, a few thousand centres at a time."""
    margin = GRID_MARGIN_BANDWIDTHS * bw
    grid = np.linspace(low - margin, high + margin, GRID_POINTS)
    reach = KERNEL_REACH_BANDWIDTHS * bw
    for at in range(0, len(centre), PIECE):
        c, w = centre[at : at + PIECE], weight[at : at + PIECE]
        a, b = np.searchsorted(grid, [c[0] - reach, c[-1] + reach])
        if a < b:
            u = (grid[a:b, None] - c) / bw
            total[a:b] += np.exp(-0.5 * u * u) @ w


def _add_cells(centre: np.ndarray, powers: np.ndarray, low: float, high: float, bw: float, total: np.ndarray) -> None:
    """The same for cells: row j of `powers` is the sum of the j-th powers of their values' distance from the centre, in bandwidths.

    exp(-(u - t)^2 / 2) is exp(-u^2 / 2) times the sum of He_j(u) t^j / j!, so one kernel serves all values of a cell.
    """
    margin = GRID_MARGIN_BANDWIDTHS * bw
    grid = np.linspace(low - margin, high + margin, GRID_POINTS)
    reach = KERNEL_REACH_BANDWIDTHS * bw
    for at in range(0, len(centre), PIECE):
        c, p = centre[at : at + PIECE], powers[:, at : at + PIECE]
        a, b = np.searchsorted(grid, [c[0] - reach, c[-1] + reach])
        if a < b:
            u = (grid[a:b, None] - c) / bw
            before, now, summed, factor = np.ones_like(u), u, p[0] + p[1] * u, 1.0
            for j in range(2, len(p)):
                before, now, factor = now, u * now - (j - 1) * before, factor * j
                summed += now * (p[j] / factor)
            total[a:b] += np.einsum("ij,ij->i", np.exp(-0.5 * u * u), summed)


def _kernel_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (number of the key, centre, weight, low, high, bandwidth, sums of powers) -> 256 sums for each key a task meets.

    Centres wait until there are BUFFERED of them, so that a task's memory does not depend on its rows.
    """
    totals: dict[int, np.ndarray] = {}
    waiting: list[pa.RecordBatch] = []

    def settle() -> None:
        columns = [np.concatenate([b.column(k).to_numpy() for b in waiting]) for k in range(6 + POWERS)]
        alone = columns[2] == 1.0  # a single value is its own centre
        columns[1] = np.where(alone, columns[1] + columns[6] * columns[5], columns[1])
        order = np.lexsort((columns[1], columns[0]))
        number, centre, weight, low, high, bw, *sums = (c[order] for c in columns)
        powers = np.stack([weight, *sums])
        cell = ~alone[order] & powers[1:].any(axis=0)
        starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        for a, b in zip(starts, np.append(starts[1:], len(number)), strict=True):
            total = totals.setdefault(int(number[a]), np.zeros(GRID_POINTS))
            here, own = cell[a:b], ~cell[a:b]
            _add_kernels(centre[a:b][own], weight[a:b][own], low[a], high[a], bw[a], total)
            _add_cells(centre[a:b][here], powers[:, a:b][:, here], low[a], high[a], bw[a], total)
        waiting.clear()

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= BUFFERED:
            settle()
    if waiting:
        settle()
    for number, total in totals.items():
        yield pa.RecordBatch.from_pydict({
            "number": pa.array([number] * GRID_POINTS, pa.int64()), "point": pa.array(range(GRID_POINTS), pa.int32()), "total": total,
        })


def _cells(placed: DataFrame) -> DataFrame:
    """The values of each 32nd of a bandwidth as their number and the sums of powers of their distance from its middle."""
    at = (F.col("centre") - F.col("low")) / F.col("bandwidth") * CELLS_PER_BANDWIDTH
    near = at < MOST_CELLS
    cell = F.when(near, F.floor(at))
    middle = (cell + 0.5) / CELLS_PER_BANDWIDTH
    t = F.when(near, (F.col("centre") - F.col("low")) / F.col("bandwidth") - middle).otherwise(0.0)
    key = ["number", "low", "high", "bandwidth"]
    placed = placed.select(*key, cell.alias("cell"), F.when(~near, F.col("centre")).alias("far"), t.alias("t"))
    powers = [F.sum(reduce(mul, [F.col("t")] * j)).alias(f"t{j}") for j in range(1, POWERS + 1)]
    summed = placed.groupBy(*key, "cell", "far").agg(F.count(F.lit(1)).cast("double").alias("weight"), *powers)
    middle = F.col("low") + (F.col("cell") + 0.5) / CELLS_PER_BANDWIDTH * F.col("bandwidth")
    return summed.select("number", F.coalesce("far", middle).alias("centre"), "weight", "low", "high", "bandwidth", *[f"t{j}" for j in range(1, POWERS + 1)])


def _binned(placed: DataFrame) -> DataFrame:
    """Each value split between its two neighbouring of evenly spaced bins; only bins that hold something exist."""
    wanted = F.ceil((F.col("high") - F.col("low")) * BINS_PER_BANDWIDTH / F.col("bandwidth"))
    bins = F.greatest(F.lit(MIN_BINS), wanted).cast("double")
    step = (F.col("high") - F.col("low")) / (bins - 1)
    at = F.try_divide(F.col("centre") - F.col("low"), step)
    left = F.least(bins - 2, F.floor(at))
    share = F.coalesce(at - left, F.lit(0.0))  # a key with a single value has no step
    split = placed.withColumn("left", F.coalesce(left, F.lit(0.0))).withColumn("share", share).withColumn("step", F.coalesce(step, F.lit(0.0)))
    ends = F.array(
        F.struct(F.col("left").alias("bin"), (1 - F.col("share")).alias("part")), F.struct((F.col("left") + 1).alias("bin"), F.col("share").alias("part"))
    )
    key = ["number", "low", "high", "bandwidth", "step"]
    summed = split.select(*key, F.inline(ends)).groupBy(*key, "bin").agg(F.sum("part").alias("weight"))
    return summed.select("number", (F.col("low") + F.col("bin") * F.col("step")).alias("centre"), "weight", "low", "high", "bandwidth", *[F.lit(0.0).alias(f"t{j}") for j in range(1, POWERS + 1)])


def density(long: DataFrame, keys: list[str], method: str = "exact") -> DataFrame:
    """(keys, n, bandwidth, x, density) on 256 points per key.

    Every task adds the kernels of its own rows to the 256 sums of their key and only those sums are shuffled, so a
    key with all the rows is spread over all tasks. `exact` adds the kernel of every value at its own place, to a relative 1e-10:
    values that lie close together are summed up by powers first (see _cells). `binned` first sums the values into evenly
    spaced bins (32 per bandwidth, 2,048 at least, as many as the range needs; relative difference below 1e-3 on the grid). Which one runs never depends on the number of values.
    """
    if method not in ("exact", "binned"):
        raise ValueError(f"method {method!r} is not valid (use exact or binned)")
    stats = bandwidths(long, keys).where(F.col("bandwidth") > 0).select(*keys, "n", "low", "high", "bandwidth")
    stats = cut_lineage(stats.withColumn("number", F.monotonically_increasing_id()))
    same = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys]
    known = stats.select(*[F.col(k).alias(f"_{k}") for k in keys], "number", "low", "high", "bandwidth")
    placed = long.join(broadcast_if_small(known, MAX_GROUPS_BROADCAST), same).select(
        "number", (F.col("value") + 0.0).alias("centre"), "low", "high", "bandwidth"
    )
    centres = _cells(placed) if method == "exact" else _binned(placed)
    sums = centres.mapInArrow(_kernel_sums, "number long, point int, total double").groupBy("number", "point").agg(F.sum("total").alias("total"))
    scale = F.sqrt(F.lit(2 * np.pi)) * F.col("bandwidth") * F.col("n")
    return sums.join(broadcast_if_small(stats, MAX_GROUPS_BROADCAST), "number").select(
        *keys, "n", "bandwidth", _grid_point().alias("x"), (F.col("total") / scale).alias("density")
    )


def group_densities(long: DataFrame, scale: str = "none", sex: str = "sex") -> DataFrame:
    """Density curves of everybody and of each sex: index_id, scale, group, n, bandwidth, x, density."""
    curves = density(with_pooled(long, sex), ["index_id", "group"])
    return curves.select("index_id", F.lit(scale).alias("scale"), "group", "n", "bandwidth", "x", "density")


def histogram_bins(long: DataFrame, keys: list[str], least: int | None, most: int | None) -> DataFrame:
    """Per key: lo, hi, bins, wanted, n, median, q1, q3. Freedman-Diaconis, Sturges when the IQR is 0.

    `wanted` is the number of bins by that rule, `bins` the same held between `least` and `most` where they are given.
    """
    stats = group_stats(long, keys)
    iqr = F.col("q3") - F.col("q1")
    n = F.col("n").cast("double")
    varies = F.col("high") > F.col("low")
    freedman = F.try_divide(F.col("high") - F.col("low"), iqr * 2 * F.pow(n, F.lit(-1.0 / 3.0)))
    wanted = F.ceil(F.when((iqr > 0) & varies, freedman).otherwise(F.log2(n) + 1)).cast("long")
    held = wanted if least is None else F.greatest(F.lit(least).cast("long"), wanted)
    held = held if most is None else F.least(F.lit(most).cast("long"), held)
    return stats.select(
        *keys,
        F.when(varies, F.col("low")).otherwise(F.col("low") - 0.5).alias("lo"),
        F.when(varies, F.col("high")).otherwise(F.col("high") + 0.5).alias("hi"),
        held.cast("int").alias("bins"), wanted.alias("wanted"),
        "n", "median", "q1", "q3",
    )


def histogram(long: DataFrame, keys: list[str], *, least: int | None, most: int | None, split_by: str | None = None) -> DataFrame:
    """(keys, [split_by], bin, lo, hi, count, wanted) with every bin listed; the last bin includes its upper end.

    The number of bins is that of the rule, `wanted`, held between `least` and `most` (None: no bound). With
    `split_by` the bins come from all values together and are counted per label.
    """
    bins = cut_lineage(histogram_bins(long, keys, least, most).select(*keys, "lo", "hi", "bins", "wanted"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    labels = [split_by] if split_by else []
    small = broadcast_if_small(bins, MAX_GROUPS_BROADCAST)  # one row per key
    counted = (
        long.join(small, keys)
        .withColumn("bin", F.least(F.col("bins") - 1, F.floor((F.col("value") - F.col("lo")) / width)).cast("int"))
        .groupBy(*keys, *labels, "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    listed = bins
    if split_by:
        counted = cut_lineage(counted)  # the labels are those that were counted, without another pass
        listed = listed.join(counted.select(*keys, split_by).distinct(), keys)
    listed = listed.select(
        *keys, *labels, (F.col("lo")).alias("start"), width.alias("width"), "wanted",
        F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"),
    )
    return listed.join(counted, [*keys, *labels, "bin"], "left").select(
        *keys, *labels, "bin",
        (F.col("start") + F.col("bin") * F.col("width")).alias("lo"),
        (F.col("start") + (F.col("bin") + 1) * F.col("width")).alias("hi"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"), "wanted",
    )


def histogram_by_sex(long: DataFrame, sex: str = "sex", *, least: int | None, most: int | None) -> DataFrame:
    """Bins of the men's and women's values together, counted per sex."""
    return histogram(long.where(F.col(sex).isin("male", "female")), ["index_id"], least=least, most=most, split_by=sex)
