"""Lempel-Ziv fingerprints: the phrases of a text's dictionary parse, and their smallest hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT = 128  # smallest hashes in a fingerprint
MOST_BUCKETS = 10_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Parse:
    """The dictionary parse of a text: each phrase is the longest known phrase at its place and one more code point.

    Every beginning of a phrase is a phrase. So whether a stretch is known falls with its length, and the longest known
    one is found by steps from the length of the phrase before. `cuts` are the places where phrases begin and end.
    """

    def __init__(self, known: set[str] | None = None, cuts: list[int] | None = None) -> None:
        self.known: set[str] = known or set()
        self.cuts: list[int] = cuts or [0]

    def run(self, text: str, until: int | None = None) -> None:
        """Parse on from the last cut while phrases end at `until` or before it (default: the end of the text).

        Only with the default does the last phrase, which may be a known one cut off by the end, count.
        """
        known, size = self.known, len(text)
        last, at, n = size if until is None else until, self.cuts[-1], 4
        add, cut = known.add, self.cuts.append
        while at < last:
            phrase = text[at : at + n]
            if phrase in known:
                while at + n < size:
                    n += 1
                    phrase = text[at : at + n]
                    if phrase not in known:
                        break
            else:
                shorter = text[at : at + n - 1]
                while shorter and shorter not in known:
                    phrase = shorter
                    n -= 1
                    shorter = text[at : at + n - 1]
            stop = at + n if at + n < size else size
            if stop > last:
                return
            add(phrase)
            cut(stop)
            at = stop

    def copy(self) -> Parse:
        return Parse(set(self.known), list(self.cuts))


def _power(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to size of the hash's base and of its inverse modulo 2**64; the longest tables so far are kept."""
    if len(_powers[0]) <= size:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(size, 1 << 14) + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def signature(text: str, cuts: list[int]) -> np.ndarray:
    """The KEPT smallest distinct 32-bit hashes of the phrases between the cuts, ascending.

    A phrase's hash comes from running sums over the code points: the difference of two sums, shifted back to place 0.
    """
    if len(cuts) < 2:
        return np.empty(0, np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    power, inverse = _power(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[: len(codes)], out=sums[1:])
    places = np.array(cuts)
    a, b = places[:-1], places[1:]
    mixed = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    hashes = ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)
    if len(hashes) > 4 * KEPT:  # phrases are distinct but for the last, hashes nearly so
        hashes = np.partition(hashes, 2 * KEPT)[: 2 * KEPT]
    return _distinct(hashes)[:KEPT]


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted values, each once."""
    values = np.sort(values)
    return values[np.flatnonzero(np.append(True, values[1:] != values[:-1]))] if len(values) else values


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of phrases that two texts have in common: exact while both have at most KEPT. Empty equals empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    merged = np.sort(np.concatenate((a, b)))
    twice = merged[1:] == merged[:-1]
    both = merged[1:][twice]
    union = merged[np.flatnonzero(np.append(True, ~twice))][:KEPT]
    return float(np.searchsorted(both, union[-1], side="right") / len(union))


def fingerprint_of(text: str) -> np.ndarray:
    parse = Parse()
    parse.run(text)
    return signature(text, parse.cuts)


def edit_pair(text: str, following: str) -> tuple[np.ndarray, str, np.ndarray]:
    """The text's signature, its edited text (last half replaced by the beginning of the next) and that one's signature.

    Both texts begin alike, and so do their parses: that part is parsed once.
    """
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    parse = Parse()
    parse.run(text, len(text) - half)
    other = parse.copy()
    parse.run(text)
    other.run(edited)
    return signature(text, parse.cuts), edited, signature(edited, other.cuts)


def as_hex(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def from_hex(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint) per row; a null text is empty and has an empty fingerprint. No shuffle."""

    @F.arrow_udf("string")
    def hashed(values: pa.Array) -> pa.Array:
        return pa.array([as_hex(fingerprint_of(v.as_py() or "")) for v in values], pa.string())

    return docs.select(F.col(f"`{id_column}`").alias("doc_id"), hashed(F.col(f"`{text_column}`")).alias("fingerprint"))


def _cuts(ids: DataFrame, bucket_rows: int) -> list[int]:
    """Ids that cut all ids into at most MOST_BUCKETS runs of about bucket_rows rows, the smallest id first."""
    found = ids.agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("least")).first()
    if not found.n:
        return []
    runs = min(MOST_BUCKETS, max(1, round(found.n / bucket_rows)))
    inner = ids.agg(F.percentile_approx("doc_id", [k / runs for k in range(1, runs)] or [1.0], MOST_BUCKETS).alias("cuts")).first().cuts
    return sorted({found.least, *(inner if runs > 1 else [])})


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str, bool]]:
    """(id, text, next text, whether the next item is that next document) from rows sorted by bucket, guests last."""
    bucket, opening, held = None, "", None
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for row in batch.slice(at, 64).to_pylist():
                if row["bucket"] != bucket:
                    if held is not None:  # a bucket without a guest: its first document follows its last
                        yield (*held, opening, False)
                    bucket, opening, held = row["bucket"], row["text"], None
                elif held is not None:
                    yield (*held, row["text"], not row["guest"])
                held = None if row["guest"] else (row["doc_id"], row["text"])
    if held is not None:
        yield (*held, opening, False)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    rows: list[tuple] = []
    before, following, chained = None, "", False

    def finish(after: np.ndarray) -> None:
        doc_id, size, sha, own, edited = before
        rows.append((doc_id, size, sha, as_hex(own), as_hex(edited), likeness(own, edited), likeness(own, after)))

    for doc_id, text, next_text, goes_on in _neighbours(batches):
        own, edited, edited_own = edit_pair(text, next_text)
        if before is not None:
            finish(own if chained else fingerprint_of(following))
        before = (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, edited_own)
        following, chained = next_text, goes_on
        if len(rows) >= 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            rows.clear()
    if before is not None:
        finish(fingerprint_of(following))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def beside_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bucket_rows: int = 2_000) -> DataFrame:
    """Each document with its edited text and the next document by ascending id (after the last comes the first).

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Ids are cut into buckets of consecutive ids at ids that occur (quantiles from a sketch: one number per bucket on
    the driver). The first document of a bucket also goes, as a guest, to the bucket before it, whose last document it
    follows. Texts are shuffled once, by bucket, sorted there, and compared as a stream of neighbours; a task holds a
    few texts at a time.

    Null text: empty. Equal ids are ordered by a hash of the text; null ids come after all others in a bucket of their
    own. One row alone follows itself. Further columns are ignored; an empty table gives no rows. Ids are whole numbers.
    """
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    cuts = _cuts(rows.select("doc_id"), bucket_rows)
    find, last = np.array([*cuts], np.int64), len(cuts)
    nameless = rows.where("doc_id IS NULL").agg(F.min(F.xxhash64("text")).alias("least")).first().least
    buckets = max(1, last + (nameless is not None))

    @F.arrow_udf("struct<bucket int, first boolean>")
    def bucket_of(ids: pa.Array) -> pa.Array:
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        if not last:
            return pa.StructArray.from_arrays([pa.array(np.zeros(len(ids), np.int32)), pa.array(np.zeros(len(ids), bool))], names=["bucket", "first"])
        at = np.maximum(np.searchsorted(find, values, side="right") - 1, 0)
        first = (find[at] == values) & ~missing
        return pa.StructArray.from_arrays([pa.array(np.where(missing, last, at).astype(np.int32)), pa.array(first)], names=["bucket", "first"])

    hashed = rows.withColumn("hash", F.xxhash64("text")).withColumn("at", bucket_of("doc_id"))
    opens = F.col("at.first") if nameless is None else F.col("at.first") | (F.col("doc_id").isNull() & (F.col("hash") == nameless))
    home = F.struct(F.col("at.bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(((F.col("at.bucket") + (buckets - 1)) % buckets).alias("bucket"), F.lit(True).alias("guest"))
    dealt = hashed.withColumn("to", F.explode(F.when(opens, F.array(home, guest)).otherwise(F.array(home))))
    dealt = dealt.select("doc_id", "text", "hash", F.col("to.bucket").alias("bucket"), F.col("to.guest").alias("guest"))
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", "doc_id", "hash", "text").select("doc_id", "text", "bucket", "guest")
    shape = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(_compared, shape)
