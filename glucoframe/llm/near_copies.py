"""Near copies by shingle similarity: segment popcounts of SimHash fingerprints find close texts, MinHash bands those that are
farther apart, and exact Jaccard verifies every pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucoframe.llm.common import BROADCAST_ROWS, few_rows, utf8
from glucoframe.llm.components import roots
from glucoframe.llm.simhash import SEED, classes, fingerprint_of_hashes, keep_one, named, shingle_hashes
from glucoframe.session import broadcast_if_small, cut_lineage

SHINGLE_WORDS = 5
# Least similarity that links, as a fraction of whole numbers: 4/5.
ABOVE, BELOW = 4, 5
# Texts as similar as that agree in a band with 0.8^4, so all bands miss such a pair with less than 5 in 100 million.
BANDS, BAND_ROWS = 32, 4
# Shingles of the texts that are compared at once; each text counts as so many more, which bounds their number.
BLOCK, EACH = 1 << 20, 1 << 10
_COLUMNS, _ROWS = 1 << 12, 1 << 12
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(data: bytes, words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingles of a text in UTF-8 as sorted 64-bit hashes; none for a text without words."""
    return np.unique(shingle_hashes(data, words_each))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _node(found: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(found.tobytes(), SEED))


def bands(found: np.ndarray) -> list[int]:
    """One value per band: the hash of the least of BAND_ROWS orders of the shingles; none for an empty set."""
    if not len(found):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _ROWS):
        mixed = found[at : at + _ROWS, None] * _FACTORS
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, (mixed * _FACTORS).min(axis=0), out=least)
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), band)) for band, row in enumerate(least.reshape(BANDS, BAND_ROWS))]


def set_hash(text: Column, words_each: int = SHINGLE_WORDS) -> Column:
    """The hash of a text's shingle set; texts without words share one."""

    @F.arrow_udf("bigint")
    def hashed(values: pa.Array) -> pa.Array:
        return pa.array([_node(shingle_set(data, words_each)) for data in utf8(values)], pa.int64())

    return hashed(text)


def _marks(text: Column, words_each: int) -> Column:
    kind = pa.struct([("node", pa.int64()), ("n", pa.int64()), ("print", pa.int64()), ("cells", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<node:bigint,n:bigint,print:bigint,cells:array<bigint>>")
    def marked(values: pa.Array) -> pa.Array:
        rows = []
        for data in utf8(values):
            hashes = shingle_hashes(data, words_each)
            found = np.unique(hashes)
            rows.append({"node": _node(found), "n": len(found), "print": fingerprint_of_hashes(hashes), "cells": bands(found)})
        return pa.array(rows, kind)

    return marked(text)


def _linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets of two lists have a Jaccard similarity of ABOVE / BELOW or more, as a matrix of truth values."""
    sets = [*left, *right]
    values, codes, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[codes]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    owner, shared = owner[shared >= 0], shared[shared >= 0]
    order = np.argsort(shared, kind="stable")
    owner, shared = owner[order], shared[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(times.size and (times > 1).sum()), _COLUMNS):
        at, end = np.searchsorted(shared, [first, first + _COLUMNS])
        held = np.zeros((len(sets), _COLUMNS), np.float32)
        held[owner[at:end], shared[at:end] - first] = 1
        both += held[: len(left)] @ held[len(left) :].T
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    return both.astype(np.int64) * (ABOVE + BELOW) >= sizes * ABOVE


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect what a symmetric matrix connects, one fewer than members per component."""
    left, pairs = np.ones(len(near), bool), []
    for root in range(len(near)):
        if not left[root]:
            continue
        left[root] = False
        edge = np.array([root])
        while len(edge):
            edge = np.flatnonzero(near[edge].any(axis=0) & left)
            left[edge] = False
            pairs += [(root, int(k)) for k in edge]
    return pairs


def _compare(group: pa.Table) -> pa.Table:
    """Edges (u, v) that connect the members of two blocks as their links do. Links inside a block come from its own group."""
    nodes, own = group.column("node").to_numpy(), group.column("block").to_numpy() == group.column("i").to_numpy()
    sets = [np.frombuffer(data, "<u8") for data in group.column("found").to_pylist()]
    if group.column("i")[0].as_py() == group.column("j")[0].as_py():
        near = _linked(sets, sets)
    else:
        near = np.zeros((len(sets), len(sets)), bool)
        some = _linked([sets[k] for k in np.flatnonzero(own)], [sets[k] for k in np.flatnonzero(~own)])
        near[np.ix_(own, ~own)], near[np.ix_(~own, own)] = some, some.T
    pairs = np.array(_forest(near), np.int64).reshape(-1, 2)
    return pa.table({"u": pa.array(nodes[pairs[:, 0]], pa.int64()), "v": pa.array(nodes[pairs[:, 1]], pa.int64())})


def _verified(met: DataFrame, keys: DataFrame, texts: DataFrame, words_each: int, block: int) -> DataFrame:
    """Edges (u, v) that connect what a similarity of 0.8 connects inside the cells of a written table (cell, node, n).

    `keys` (node, key) and `texts` (key, text) lead to a text of each set. Cells with the same members count once. The members of a
    cell are dealt to blocks, and every two blocks are compared in a task of their own through a matrix of shared shingles,
    so no pair of texts is ever a row, and no set is sent once per pair. Only sets that share a cell are made again.
    """
    alike = met.groupBy("cell").agg(F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("t"))
    once = cut_lineage(alike.groupBy("members", "s", "t").agg(F.min("cell").alias("cell")).select("cell"))
    ordered = Window.partitionBy("cell").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = met.join(once, "cell").withColumn("block", F.floor(F.sum(F.col("n") + EACH).over(ordered) / block).cast("int"))
    dealt = dealt.withColumn("last", F.max("block").over(Window.partitionBy("cell")))
    other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    work = dealt.select("cell", "node", "block", other).select("cell", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    work = cut_lineage(work)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            found = [shingle_set(data, words_each) for data in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, found), pa.int64()), pa.array([f.astype("<u8").tobytes() for f in found], pa.binary())], names=["node", "found"])

    wanted = cut_lineage(keys.join(work.select("node").distinct(), "node").select("key").distinct())
    needed = texts.join(wanted, "key", "left_semi").select("text").distinct()
    sets = cut_lineage(needed.mapInArrow(made, "node long, found binary").groupBy("node").agg(F.first("found").alias("found")))
    edges = work.join(sets, "node").groupBy("cell", "i", "j").applyInArrow(_compare, "u long, v long")
    return cut_lineage(edges.distinct())


def links(marked: DataFrame, texts: DataFrame, words_each: int = SHINGLE_WORDS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between distinct shingle sets that connect exactly what a similarity of 0.8 connects among sets that meet.

    `marked` holds key, node, n, print and cells of every text, `texts` holds key and text. Sets meet first in the classes that
    segment popcounts find for their fingerprints (simhash.classes), which are compared exactly, then in the cells of their bands: similar
    texts often differ in more bits than a grid of popcounts selects. A band's cell is only compared if it joins sets that
    are not connected already.
    """
    distinct = cut_lineage(marked.groupBy("node").agg(F.min(F.struct("key", "n", "print", "cells")).alias("m")).select("node", "m.*"))
    some = distinct.where("n > 0")  # a text without words is like no other
    found = classes(some.select(F.col("node").alias("doc_id"), F.col("print").alias("fp")))
    close = cut_lineage(some.join(found, some.print == found.fp).select(F.col("component_id").alias("cell"), "node", "n"))
    many = cut_lineage(close.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("cell"))
    near = _verified(cut_lineage(close.join(many, "cell")), distinct.select("node", "key"), texts, words_each, block)
    known = broadcast_if_small(cut_lineage(roots(near).withColumnRenamed("node", "of")), BROADCAST_ROWS)
    placed = distinct.join(known, F.col("node") == F.col("of"), "left").select("node", "n", "cells", F.coalesce("root", "node").alias("root"))
    cell = Window.partitionBy("cell")
    met = placed.select("node", "n", "root", F.explode("cells").alias("cell")).repartition("cell")
    met = met.withColumn("least", F.min("root").over(cell)).withColumn("most", F.max("root").over(cell)).where("least != most")
    met = cut_lineage(met.select("cell", "node", "n"))
    far = _verified(met, distinct.select("node", "key"), texts, words_each, block)
    return near.union(far)


def one_per_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words_each: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of which one stays in each group of near copies: the smallest id; columns are unchanged.

    Texts link if the Jaccard similarity of their sets of `words_each` lower-case words is 0.8 or more, links are
    transitive, and every link is verified. Texts without words are one group. Null or repeated ids as in `simhash.one_per_group`.
    """
    text = F.col(f"`{text_column}`")
    texts = docs.select(F.xxhash64(text).alias("key"), text.alias("text"))
    chosen = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.xxhash64(text).alias("key"), _marks(text, words_each).alias("m"))
    marked = cut_lineage(chosen.select("doc_id", "key", "m.*"))
    prints = marked.select("doc_id", F.col("node").alias("fp"))
    found = named(prints, lambda _: links(marked, texts, words_each))
    near = prints.join(cut_lineage(found), "fp").select("doc_id", "fp", "root", "component_id")
    return keep_one(docs, near, id_column, text_column, lambda column: set_hash(column, words_each))
