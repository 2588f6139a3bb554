"""Pairwise-complete Pearson and Spearman correlations.

Matrices are computed in one pass over the rows: each task turns its batches into a value matrix X and a
presence matrix M and adds up M'M, X'M, (X^2)'M and X'X, so what is shuffled is one k x k table per task,
never pairs of rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucoframe.operators.ranking import LIMITS, LOCAL_POSITION_BITS, MAX_OFFSETS_BROADCAST, ROW_BITS, Limits, column_ranks, mean_rank, range_ranks, read_places, read_ranks, set_ranks
from glucoframe.operators.transforms import Transform, transform_results
from glucoframe.session import broadcast_if_small, cut_lineage, discard_scratch, noted_scratch

MIN_PAIRS = 3
MASK_BITS = 62  # columns whose presence fits into one number
MOST_MASKS = 50_000  # different patterns of missing columns that the driver compares
MOST_RANKS = 48 << 20  # ranks that a block of rows may have in all sets
SUMS_SCHEMA = (
    "i int, j int, n bigint, si double, sj double, sii double, sjj double, sij double, "
    "lo_i double, hi_i double, lo_j double, hi_j double"
)


def is_finite(column: str) -> Column:
    """Neither missing nor NaN nor infinite."""
    return F.coalesce(F.abs(F.col(column).cast("double")) < float("inf"), F.lit(False))


def pair_sums(wide: DataFrame, columns: list[str], centre: list[float]) -> DataFrame:
    """Per pair i <= j: sums over the rows where both are finite, of values shifted by `centre`."""
    k = len(columns)
    upper_i, upper_j = np.triu_indices(k)
    shift = np.asarray(centre)

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((k, k))
        s, ss, cross = np.zeros((k, k)), np.zeros((k, k)), np.zeros((k, k))
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan) - shift
            present = np.isfinite(x)
            m, x0 = present.astype(float), np.where(present, x, 0.0)
            n += m.T @ m
            s += x0.T @ m  # s[i, j]: sum of i where j is present too
            ss += (x0 * x0).T @ m
            cross += x0.T @ x0
            for j in range(k):
                rows = x[present[:, j]]
                if len(rows):
                    low[:, j] = np.fmin(low[:, j], np.fmin.reduce(rows, axis=0))
                    high[:, j] = np.fmax(high[:, j], np.fmax.reduce(rows, axis=0))
        i, j = upper_i, upper_j
        yield pd.DataFrame({
            "i": i.astype("int32"), "j": j.astype("int32"), "n": n[i, j].astype("int64"),
            "si": s[i, j], "sj": s[j, i], "sii": ss[i, j], "sjj": ss[j, i], "sij": cross[i, j],
            "lo_i": low[i, j], "hi_i": high[i, j], "lo_j": low[j, i], "hi_j": high[j, i],
        })

    partial = wide.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(gram, SUMS_SCHEMA)
    return partial.groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "si", "sj", "sii", "sjj", "sij")],
        *[F.min(c).alias(c) for c in ("lo_i", "lo_j")],
        *[F.max(c).alias(c) for c in ("hi_i", "hi_j")],
    )


def _both_triangles(upper: DataFrame, columns: list[str]) -> DataFrame:
    """(i <= j) -> (row, col) both ways round; exploded rather than unioned, so the pass over the data runs once."""
    names = F.array(*[F.lit(c) for c in columns])
    a, b = F.element_at(names, F.col("i") + 1), F.element_at(names, F.col("j") + 1)
    one_way = F.struct(a.alias("row"), b.alias("col"))
    other_way = F.struct(b.alias("row"), a.alias("col"))
    both = F.when(F.col("i") == F.col("j"), F.array(one_way)).otherwise(F.array(one_way, other_way))
    return upper.select(F.inline(both), "value", "n")


def _clamped(r):
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))


def pearson_matrix(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Long matrix (row, col, value, n): NULL below 3 complete pairs or when either side is constant on them.

    Missing, NaN and infinite values do not count.
    """
    means = wide.agg(*[F.avg(F.when(is_finite(c), F.col(c))).alias(c) for c in columns]).head()
    centre = [means[c] or 0.0 for c in columns]
    sums = pair_sums(wide, columns, centre)
    n = F.col("n")
    varies = (F.col("lo_i") < F.col("hi_i")) & (F.col("lo_j") < F.col("hi_j"))
    sxy = F.col("sij") - F.col("si") * F.col("sj") / n
    sxx = F.col("sii") - F.col("si") * F.col("si") / n
    syy = F.col("sjj") - F.col("sj") * F.col("sj") / n
    r = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(_clamped(F.try_divide(sxy, F.sqrt(sxx * syy))))
    upper = sums.select("i", "j", F.when((n >= MIN_PAIRS) & varies, r).alias("value"), "n")
    return _both_triangles(upper, columns)


def pair_counts(wide: DataFrame, columns: list[str]) -> dict[tuple[int, int], int]:
    """Rows where both columns of a pair are finite; k x k numbers on the driver."""
    k = len(columns)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((k, k))
        for batch in batches:
            present = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype("float32")
            n += present.T @ present  # exact below 2^24 rows, far more than a batch has
        i, j = np.indices((k, k)).reshape(2, -1).astype("int32")
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "n": n.reshape(-1).astype("int64")})

    flags = wide.select(*[is_finite(c).alias(f"c{i}") for i, c in enumerate(columns)])
    sums = flags.mapInArrow(together, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    found = {(r.i, r.j): r.n for r in sums}
    return {(i, j): found.get((i, j), 0) for i in range(k) for j in range(k)}


def _masks(columns: list[str]) -> list[Column]:
    """The finite columns of a row as bits, MASK_BITS to a number."""
    masks = []
    for start in range(0, len(columns), MASK_BITS):
        bits = [F.when(is_finite(c), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(columns[start : start + MASK_BITS])]
        masks.append(functools.reduce(lambda a, b: a.bitwiseOR(b), bits).cast("bigint").alias(f"_mask{len(masks)}"))
    return masks


def _present(masks: list[np.ndarray], column: int) -> np.ndarray:
    return (masks[column // MASK_BITS] >> (column % MASK_BITS)) & 1


def rank_sets(wide: DataFrame, columns: list[str], most_masks: int = MOST_MASKS) -> tuple[np.ndarray, np.ndarray]:
    """Rows where both columns of a pair are finite (k x k), and which pairs have the same such rows: a number per pair.

    A dictionary of the patterns of missing columns, with the number of rows of each, tells it exactly: the rows of a pair are those
    of the patterns that hold both. With more than `most_masks` patterns the numbers of rows decide: pairs with a column share their rows
    if the other columns are missing on the same rows or hold all of the first one's. That finds fewer equal sets, never wrong ones.
    """
    k = len(columns)
    names = [f"_mask{m}" for m in range(-(-k // MASK_BITS))]
    patterns = wide.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).limit(most_masks + 1).toArrow()
    if patterns.num_rows > most_masks:
        n = pair_counts(wide, columns)
        counts = np.array([[n[i, j] for j in range(k)] for i in range(k)])
        own = np.diag(counts)
        twin = [min(i for i in range(j + 1) if counts[i, j] == own[i] == own[j]) for j in range(k)]

        def label(i: int, j: int) -> tuple[int, int]:
            if counts[i, j] == own[i]:
                return twin[i], twin[i]
            if counts[i, j] == own[j]:
                return twin[j], twin[j]
            return min(twin[i], twin[j]), max(twin[i], twin[j])
    else:
        masks = [patterns.column(name).to_numpy() for name in names]
        held = np.array([_present(masks, j) for j in range(k)], bool).reshape(k, -1)
        rows = patterns.column("n").to_numpy()
        counts = (held * rows) @ held.T

        def label(i: int, j: int) -> bytes:
            return np.packbits(held[i] & held[j]).tobytes()

    numbers: dict[object, int] = {}
    sets = np.array([[numbers.setdefault(label(min(i, j), max(i, j)), len(numbers)) for j in range(k)] for i in range(k)])
    return counts, sets


def spearman_matrix(
    wide: DataFrame, columns: list[str], limits: Limits = LIMITS, most_masks: int = MOST_MASKS, spent: list[str] | None = None
) -> DataFrame:
    """Long matrix (row, col, value, n): Pearson on average ranks over the complete pairs.

    Rows are told apart by a number of their own, so participant ids may repeat or be missing. Each column is ordered once:
    every value goes out with the sets its row is in, of those that a pair of the column needs (see rank_sets), and comes back with
    its rank in each of these sets, packed. Blocks of rows then multiply, per set, the ranks of all columns that need it; what is
    shuffled after that is k x k sums per block. `spent` are scratch paths that `wide` reads and nothing else needs.
    """
    k = len(columns)
    wide = cut_lineage(wide.select(F.monotonically_increasing_id().alias("_row"), *columns, *_masks(columns)))
    discard_scratch(wide.sparkSession, spent or [])
    counts, sets = rank_sets(wide, columns, most_masks)
    needed = [[sets[i, i], *sorted(set(sets[i]) - {sets[i, i]})] for i in range(k)]  # the sets of a column, in the order of its ranks
    partners = [[int(np.flatnonzero(sets[i] == g)[0]) for g in needed[i][1:]] for i in range(k)]
    bits = min(ROW_BITS, max(MOST_RANKS // sum(map(len, needed)), 1024).bit_length() - 1)
    names = [f"_mask{m}" for m in range(-(-k // MASK_BITS))]

    def flags(key: tuple, rows: pa.Table) -> np.ndarray:
        masks = [rows.column(name).to_numpy() for name in names]
        return np.array([_present(masks, j) for j in partners[key[0]]], bool).reshape(-1, rows.num_rows).T

    ranked = column_ranks(wide, columns, [], "_row", names, flags, finite=True, limits=limits, bits=bits)
    users = {int(g): [i for i in range(k) if g in needed[i]] for g in np.unique(sets)}
    pairs = {g: [(a, b) for a, i in enumerate(members) for b, j in enumerate(members) if i <= j and sets[i, j] == g] for g, members in users.items()}

    def products(pieces: pa.Table) -> pa.Table:
        """Per pair the sums of products of the two columns' ranks, taken around their mean over the set's rows."""
        cells, numbers = pieces.column("_rows"), pieces.column("_column").to_pylist()
        held = [read_places(cell) for cell in cells]
        wide_as = max(int(at.max()) for at in held) + 1
        present = np.zeros((k, wide_as), bool)
        for column, at in zip(numbers, held):
            present[column, at] = True
        parts: list[list[tuple]] = [[] for _ in range(k)]
        for column, cell, base, count in zip(numbers, cells, pieces.column("_base").to_pylist(), pieces.column("_count").to_pylist()):
            at, own, rest = read_ranks(cell)
            member = present[partners[column]][:, at]
            ranks = [t.astype(np.int32) for t in set_ranks(own, rest, member, np.array(count))]
            parts[column].append((at, own.astype(np.int32), member, ranks, base))
        out: list[tuple] = []
        for g, members in users.items():
            if not pairs[g]:
                continue
            a, b = (members[x] for x in pairs[g][0])
            x = np.zeros((len(members), wide_as))
            for line, i in zip(x, members):
                s = needed[i].index(g)
                for at, own, member, ranks, base in parts[i]:
                    line[at if s == 0 else at[member[s - 1]]] = (own if s == 0 else ranks[s - 1]) + float(base[s])
            x = x[:, present[a] & present[b]]
            x /= 2
            x -= (counts[a, b] + 1) / 2
            sums = x @ x.T
            out += [(members[a], members[b], sums[a, b], sums[a, a], sums[b, b]) for a, b in pairs[g]]
        return pa.table([pa.array(values, kind) for values, kind in zip(zip(*out), (pa.int32(), pa.int32(), *[pa.float64()] * 3))], names=["i", "j", "sxy", "sxx", "syy"])

    blocks = ranked.select("_block", "_column", "_rows", "_base", "_count").groupBy("_block")
    crossed = blocks.applyInArrow(products, "i int, j int, sxy double, sxx double, syy double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("sxy", "sxx", "syy")])
    sizes = wide.sparkSession.createDataFrame([(i, j, int(counts[i, j])) for i in range(k) for j in range(i, k)], "i int, j int, n bigint")
    rho = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(_clamped(F.try_divide("sxy", F.sqrt("sxx") * F.sqrt("syy"))))
    usable = (F.col("n") >= MIN_PAIRS) & (F.col("sxx") > 0) & (F.col("syy") > 0)
    upper = sizes.join(F.broadcast(crossed), ["i", "j"], "left").select("i", "j", F.when(usable, rho).alias("value"), "n")  # k x k rows
    return _both_triangles(upper, columns)


def correlation_matrix(
    wide: DataFrame, columns: list[str], key: str, method: str = "spearman", transform: Transform = Transform()
) -> DataFrame:
    """Matrix of raw or transformed values.

    Ranks do not change under z or RINT over everybody, so their Spearman matrix is the raw one; the log
    drops values <= 0 and within-sex transforms reorder, so those are computed.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError(f"method {method!r} is not valid (use pearson or spearman)")
    same_ranks = method == "spearman" and transform.within is None and transform.kind in ("z", "rint")
    spent: list[str] = []
    if transform.kind != "none" and not same_ranks:
        with noted_scratch() as spent:
            changed = transform_results(wide, transform, key=key, columns=columns, keep_only=True)
        wide = changed.select(*[F.col(c + transform.suffix).alias(c) for c in columns])
    if method == "pearson":
        return pearson_matrix(wide, columns)
    return spearman_matrix(wide, columns, spent=spent)


def pearson(wide: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, r)."""
    both = complete_pairs(wide, x, y)
    varies = (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    measured = both.agg(
        F.count(F.lit(1)).alias("n"), varies.alias("varies"), F.covar_samp("x", "y").alias("c"),
        F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"),
    )
    r = _clamped(F.try_divide(F.col("c"), F.col("sx") * F.col("sy")))
    return measured.select("n", F.when((F.col("n") >= MIN_PAIRS) & F.col("varies"), r).alias("r"))


def spearman(wide: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, rho), ranks taken over the complete pairs. Pairs are told apart by a number of their own, never by an id."""
    both = cut_lineage(complete_pairs(wide, x, y).withColumn("_row", F.monotonically_increasing_id()))
    sides = F.inline(F.array(*[F.struct(F.lit(s).alias("_side"), F.col(s).alias("value")) for s in ("x", "y")]))
    ranked = range_ranks(both.select("_row", sides), ["_side"], "value").withColumn("rank", mean_rank())
    pairs = ranked.groupBy("_row").agg(*[F.max(F.when(F.col("_side") == s, F.col("rank"))).alias(s) for s in ("x", "y")])
    return pearson(pairs, "x", "y").select("n", F.col("r").alias("rho"))


def complete_pairs(wide: DataFrame, x: str, y: str, *keep: str) -> DataFrame:
    both = wide.select(*keep, (F.col(x) + 0.0).alias("x"), (F.col(y) + 0.0).alias("y"))
    return both.where("x IS NOT NULL AND y IS NOT NULL AND abs(x) < double('Infinity') AND abs(y) < double('Infinity')")


def matrix_members(long: DataFrame, order: list[str]) -> list[str]:
    """Columns with at least 3 values, in the given order."""
    enough = long.groupBy("index_id").count().where(f"count >= {MIN_PAIRS}").select("index_id").collect()
    found = {r.index_id for r in enough}
    return [c for c in order if c in found]


def compare_matrices(raw: DataFrame, transformed: DataFrame) -> DataFrame:
    """(row, col, raw, transformed, difference, n_raw, n_transformed) over the columns both matrices have."""
    a = raw.select("row", "col", F.col("value").alias("raw"), F.col("n").alias("n_raw"))
    b = transformed.select("row", "col", F.col("value").alias("transformed"), F.col("n").alias("n_transformed"))
    return a.join(b, ["row", "col"]).select(
        "row", "col", "raw", "transformed", (F.col("transformed") - F.col("raw")).alias("difference"),
        "n_raw", "n_transformed",
    )


def matrix_table(matrix: DataFrame, columns: list[str], what: str = "value") -> DataFrame:
    """k x k layout: first column `index`, then one column per index."""
    return matrix.groupBy(F.col("row").alias("index")).pivot("col", columns).agg(F.first(what))


def scatter_sample(wide: DataFrame, x: str, y: str, key: str, at_most: int | None) -> DataFrame:
    """(key, x, y, total): complete pairs in row order; above `at_most` of them (None: no bound), pair
    floor(k * total / at_most) for k = 0, 1, ... `total` is the number of all complete pairs.

    Row order is that of the table as it is read. Pairs are kept with their partition and their place in it, one count per
    partition gives their place among all, and the sample is picked where the pairs lie: nothing is sorted or shuffled.
    """
    pairs = cut_lineage(complete_pairs(wide, x, y, key).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", LOCAL_POSITION_BITS).alias("_part")
    sizes = pairs.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    ahead = cut_lineage(sizes.select("_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead")))
    total = ahead.agg(F.sum("_n")).head()[0] or 0
    placed = pairs.select("*", part, F.col("_at").bitwiseAND(F.lit((1 << LOCAL_POSITION_BITS) - 1)).alias("_in"))
    shown = placed.join(broadcast_if_small(ahead, MAX_OFFSETS_BROADCAST), "_part").withColumn("_row", F.col("_ahead") + F.col("_in"))
    if at_most is not None and total > at_most:
        # row p (0-based) is drawn when it is floor(k * total / at_most) for the first k with k * total >= p * at_most
        k = f"((_row * {at_most} + {total} - 1) div {total})"
        shown = shown.where(f"{k} < {at_most} AND {k} * {total} div {at_most} = _row")
    return shown.select(key, "x", "y", F.lit(total).cast("bigint").alias("total"))
