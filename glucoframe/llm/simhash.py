"""SimHash near-duplicates: popcounts per segment as grid coordinates, then exact verification."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucoframe.llm.common import ASCII_LOWER, BROADCAST_ROWS, packed, utf8
from glucoframe.llm.components import roots
from glucoframe.session import broadcast_if_small, cut_lineage

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2  # differing bits that still link
_CHUNK = 1 << 14  # shingles whose bits are counted at once


def _shingles(data: bytes, words_each: int) -> list[bytes]:
    words = data.translate(ASCII_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= words_each:
        return [joined]
    ends = list(accumulate(map(len, words)))
    starts = [0, *[end + k for k, end in enumerate(ends[:-words_each], 1)]]
    stops = [end + k for k, end in enumerate(ends[words_each - 1 :], words_each - 1)]
    return list(map(joined.__getitem__, map(slice, starts, stops)))


def shingle_hashes(data: bytes, words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """The 64-bit hashes of a text's shingles in order."""
    return np.fromiter(map(xxhash.xxh64_intdigest, _shingles(data, words_each), repeat(SEED)), np.uint64)


def _count_bits(digests: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, count: int) -> int:
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big", signed=True)


def fingerprint_of(data: bytes, words_each: int = SHINGLE_WORDS) -> int:
    """64 bits of one text in UTF-8: bit i is set if it is set in over half of the shingles' hashes."""
    shingles = _shingles(data, words_each)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), _CHUNK):
        ones += _count_bits(b"".join(map(xxhash.xxh64_digest, shingles[at : at + _CHUNK], repeat(SEED))))
    return _majority(ones, len(shingles))


def fingerprint_of_hashes(hashes: np.ndarray) -> int:
    """The same from the hashes of the shingles."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += _count_bits(hashes[at : at + _CHUNK].astype(">u8").tobytes())
    return _majority(ones, len(hashes))


def fingerprint(text: Column, words_each: int = SHINGLE_WORDS) -> Column:
    """The fingerprint of a text as a long; 0 for a null text or one without words."""

    @F.arrow_udf("bigint")
    def hashed(values: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(data, words_each) for data in utf8(values)], pa.int64())

    return hashed(text)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _moves(width: int) -> list[tuple[int, int, bool]]:
    """All steps from one vector of segment counts: (bits to flip, bits to test, whether these must be zero).

    Segments of two bits hold 0, 1 or 2 of their bits set, written as 00, 01 and 10: flipping the low bit steps
    between 0 and 1, flipping both between 1 and 2. Segments of one bit hold that bit.
    """
    steps = [(0, 0, True)]
    for at in range(0, 64, width):
        if width == 1:
            steps.append((1 << at, 0, True))
        else:
            steps += [(1 << at, 2 << at, True), (3 << at, 3 << at, False)]
    return [(_signed(flip), _signed(test), zero) for flip, test, zero in steps]


def popcounts(fp: str, width: int) -> str:
    """SQL for the bit counts of all segments of one or two bits, each written into its own segment of a long."""
    if width == 1:
        return fp
    low = _signed(int("01" * 32, 2))
    high = f"shiftrightunsigned({fp}, 1)"
    return f"((({fp} ^ {high}) & {low}L) | shiftleft({fp} & {high} & {low}L, 1))"


def cells(prints: DataFrame, width: int) -> DataFrame:
    """The grid cells within Manhattan distance 1 of each print's vector of segment counts: (fp, cell).

    Two vectors at distance 2 or less have a vector between them that is at most one step from both, so they meet in
    a cell. That distance never exceeds the number of differing bits, so no link is lost.
    """
    steps = F.array(*[F.struct(F.lit(f).alias("flip"), F.lit(t).alias("test"), F.lit(z).alias("zero")) for f, t, z in _moves(width)])
    vectors = prints.select("fp", F.expr(popcounts("fp", width)).alias("vector"), F.explode(steps).alias("step"))
    allowed = (F.col("vector").bitwiseAND(F.col("step.test")) == 0) == F.col("step.zero")
    return vectors.where(allowed).select("fp", F.col("vector").bitwiseXOR(F.col("step.flip")).alias("cell"))


def links(prints: DataFrame, width: int = 2) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that connect exactly what RADIUS differing bits connect.

    The grid has segments of `width` bits (1 or 2). A cell with two prints gives one candidate pair, which is verified. The
    prints of a fuller cell are embedded again with segments of a single bit: there a cell is a 64-bit value, it holds
    at most 65 distinct prints, all of them within two bits of each other, and any two linked prints share one. They
    are tied to the least print of that cell, so no group of near copies is ever expanded into its pairs.
    """
    met = cells(prints, width).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    met = cut_lineage(met.where("n >= 2"))
    pairs = met.where("n = 2").select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    full = broadcast_if_small(met.where("n > 2").select("cell"), BROADCAST_ROWS)
    crowded = cells(prints, width).join(full, "cell", "left_semi").select("fp").distinct()
    shared = cells(crowded, 1).groupBy("cell").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = shared.select("u", F.explode("all").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS
    return pairs.union(stars).where((F.col("u") != F.col("v")) & near).distinct()


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of a written table (doc_id, fp); a root stands for its component."""
    return named(prints, links)


def named(prints: DataFrame, edges: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(fp, root, component_id) as in `classes`, where `edges` makes the links (u, v) between distinct values of fp."""
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    rooted = cut_lineage(roots(edges(distinct.select("fp"))))
    named = rooted.join(distinct, rooted.node == distinct.fp).select("fp", "root", "doc_id")
    named = named.join(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select(F.col("fp").alias("linked"), "root", "component_id")
    joined = distinct.join(named, distinct.fp == F.col("linked"), "left")
    # A component without any id (all null) has no smallest id: component_id stays null.
    component = F.when(F.col("linked").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("fp", F.coalesce("root", "fp").alias("root"), component.alias("component_id"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp, root, component_id) per row: the fingerprint, one of its component that stands for it, and the smallest id reachable over links of RADIUS bits.

    Links are transitive. Null and empty texts have fingerprint 0 and link like any other. Repeated ids and rows are
    judged row by row; null ids never become a component's name unless the component has no other (then it is null).
    Further columns are ignored; an empty table gives no rows. Copies collapse into one fingerprint (combined before
    the shuffle), so groups of copies cost nothing beyond their own rows.
    """
    chosen = docs.select(F.col(f"`{id_column}`").alias("doc_id"), fingerprint(F.col(f"`{text_column}`")).alias("fp"))
    prints = cut_lineage(chosen)
    # The classes are written first, so that both sides of the join are plain tables and Spark can split a hot fingerprint.
    return prints.join(cut_lineage(classes(prints)), "fp").select("doc_id", "fp", "root", "component_id")


def one_per_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of which one stays in each group of near-duplicates: the smallest id; columns are unchanged.

    Where ids are null or repeat, one row stays as well: of several candidates that with the least text hash.
    """
    return keep_one(docs, near_duplicates(docs, id_column, text_column), id_column, text_column, fingerprint)


def keep_one(docs: DataFrame, near: DataFrame, id_column: str, text_column: str, print_of: Callable[[Column], Column]) -> DataFrame:
    """One row of each group of `near` (doc_id, fp, root, component_id), where print_of makes fp from a text."""
    marked = cut_lineage(near)
    ids = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    unsure = broadcast_if_small(cut_lineage(ids.where("n > 1 OR doc_id IS NULL").select("doc_id")), BROADCAST_ROWS)
    losers = marked.where("doc_id != component_id").select("doc_id").distinct()
    losers = broadcast_if_small(cut_lineage(losers), BROADCAST_ROWS)
    rows = packed(docs, doc_id=F.col(f"`{id_column}`"), text=F.col(f"`{text_column}`"))
    sure = rows.join(unsure.where("doc_id IS NOT NULL"), "doc_id", "left_anti").where("doc_id IS NOT NULL").join(losers, "doc_id", "left_anti")
    if not unsure.limit(1).count():
        return sure.select("row.*")
    known = marked.select("fp", "root", "component_id").distinct()
    again = rows.join(unsure.withColumnRenamed("doc_id", "again"), F.col("doc_id").eqNullSafe(F.col("again")), "left_semi")
    again = again.select("row", "doc_id", "text", print_of(F.col("text")).alias("fp")).join(known, "fp")
    again = again.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = again.groupBy("root").agg(F.min_by("row", F.xxhash64("text")).alias("row"))
    return sure.select("row.*").unionByName(kept.select("row.*"))
