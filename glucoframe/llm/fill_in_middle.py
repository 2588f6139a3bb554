"""Fill-in-middle transformation: cuts at token counts found through memoized chunks of the text."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucoframe.llm.common import small_batches, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
# Chunks end where the rolling hash has CHUNK_BITS zero bits, about every 1,024 bytes, and at LONGEST bytes in any case.
CHUNK_BITS = 10
LONGEST = 8 * 1024
# Bytes of a text that are hashed at once, and bytes of chunks a Python worker remembers.
BLOCK = 1 << 20
REMEMBERED = 32 << 20
_WINDOW = 32
_MIX = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17)
_GEAR = (_MIX & np.uint64(0xFFFFFFFF)).astype(np.uint32)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def rolling(data: np.ndarray) -> np.ndarray:
    """At every byte the hash of the 32 bytes that end there (fewer at the start): each byte's number, shifted by its age."""
    sums = _GEAR[data]
    width = 1
    while width < _WINDOW:
        older = sums.copy()
        older[width:] += sums[:-width] << np.uint32(width)
        sums, width = older, width * 2
    return sums


def chunk_ends(data: bytes) -> Iterator[int]:
    """Where the chunks of a text end. An end depends on the 32 bytes before it, so passages that documents share are
    cut alike wherever they stand; only the cut at LONGEST depends on the chunk's start. Characters stay whole."""
    size, start = len(data), 0
    mask = np.uint32((1 << CHUNK_BITS) - 1)
    whole = np.frombuffer(data, np.uint8)

    def ends() -> Iterator[int]:
        for at in range(0, size, BLOCK):
            before = max(0, at - _WINDOW + 1)
            hashes = rolling(whole[before : at + BLOCK])[at - before :]
            yield from (np.flatnonzero((hashes >> np.uint32(32 - CHUNK_BITS)) & mask == 0) + at + 1).tolist()
        yield size

    for end in ends():
        while end - start > LONGEST:
            forced = start + LONGEST
            while whole[forced] & 0xC0 == 0x80:
                forced -= 1
            yield forced
            start = forced
        while end < size and whole[end] & 0xC0 == 0x80:
            end += 1
        if end > start:
            yield end
            start = end


@dataclass(frozen=True, slots=True)
class Summary:
    """What a chunk adds to a text: its tokens and code points, and whether letters touch its borders."""

    tokens: int
    chars: int
    starts_inside: bool
    ends_inside: bool


def _token_starts(chunk: bytes) -> np.ndarray:
    """First bytes of the chunk's tokens, as if it stood alone."""
    data = np.frombuffer(chunk, np.uint8)
    letter = _LETTER[data]
    first = (data & 0xC0) != 0x80
    first[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(first)


def summarize(chunk: bytes) -> Summary:
    chars = int(np.count_nonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80))
    return Summary(len(_token_starts(chunk)), chars, bool(_LETTER[chunk[0]]), bool(_LETTER[chunk[-1]]))


class Memory:
    """Summaries of the chunks seen lately. A hit counts only if the remembered bytes equal the chunk's; the least
    recently used go when REMEMBERED bytes are held. Forgetting costs time and changes no result."""

    def __init__(self, most: int = REMEMBERED):
        self._most, self._held = most, 0
        self._known: OrderedDict[int, tuple[bytes, Summary]] = OrderedDict()
        self.hits = self.misses = 0

    def __call__(self, chunk: bytes) -> Summary:
        key = xxhash.xxh3_64_intdigest(chunk)
        known = self._known.get(key)
        if known is not None and known[0] == chunk:
            self._known.move_to_end(key)
            self.hits += 1
            return known[1]
        self.misses += 1
        made = summarize(chunk)
        if known is not None:
            self._held -= len(known[0])
        self._known[key] = chunk, made
        self._held += len(chunk)
        while self._held > self._most:
            self._held -= len(self._known.popitem(last=False)[1][0])
        return made


class Text:
    """A text as combined chunk summaries: n tokens, and the place at which any number of them ends."""

    def __init__(self, data: bytes, memory: Memory):
        self._data, self._ends = data, list(chunk_ends(data))
        parts, at = [], 0
        for end in self._ends:
            parts.append(memory(data[at:end]))
            at = end
        # letters on both sides of a border are one token, counted with the chunk in which it starts
        self._joined = [k > 0 and part.starts_inside and parts[k - 1].ends_inside for k, part in enumerate(parts)]
        self._tokens = np.cumsum([0, *(part.tokens - joined for part, joined in zip(parts, self._joined))])
        self._chars = np.cumsum([0, *(part.chars for part in parts)])
        self.n = int(self._tokens[-1])

    def chars_before(self, tokens: int) -> int:
        """Code points of the first `tokens` tokens."""
        if tokens >= self.n:
            return int(self._chars[-1])
        k = int(np.searchsorted(self._tokens, tokens, side="right")) - 1
        start = self._ends[k - 1] if k else 0
        chunk = self._data[start : self._ends[k]]
        place = int(_token_starts(chunk)[tokens - int(self._tokens[k]) + self._joined[k]])
        return int(self._chars[k]) + len(chunk[:place].decode())


_memory = Memory()


def cuts(text: Column, first: Column, second: Column) -> Column:
    """Struct (n, prefix_chars, middle_chars): the tokens of a text (null counts as empty), and its code points before
    the smaller of first % (n + 1) and second % (n + 1) tokens and from there to the larger."""

    @F.arrow_udf("struct<n:bigint,prefix_chars:bigint,middle_chars:bigint>")
    def located(texts: pa.Array, ones: pa.Array, others: pa.Array) -> pa.Array:
        rows = np.zeros((len(texts), 3), np.int64)
        for at, (data, one, other) in enumerate(zip(utf8(texts), ones.to_pylist(), others.to_pylist())):
            known = Text(data, _memory)
            low, high = sorted((one % (known.n + 1), other % (known.n + 1)))
            begin = known.chars_before(low)
            rows[at] = known.n, begin, known.chars_before(high) - begin
        return pa.StructArray.from_arrays([pa.array(c) for c in rows.T.copy()], names=["n", "prefix_chars", "middle_chars"])

    return located(text, first, second)


def _draw(digest: Column, group: int) -> Column:
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 1) -> DataFrame:
    """One row per document: doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars, output.

    Tokens are runs of ASCII letters and single other code points. Content-defined chunks are summarised once per
    worker and content; the summaries are added up and the cuts located inside two chunks, so a text is never split into its
    tokens. No shuffle. The draws come from the SHA-256 of the seed and the id, so repeated ids are cut at the same
    shares of their texts; a null id draws like an empty one. A null or empty text, or one that holds a sentinel, stays
    plain, with null prefix_chars and middle_chars. Further columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), text.alias("text"), digest.alias("digest"))
    held = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | held | (_draw(F.col("digest"), 2) % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(_draw(F.col("digest"), 3) % 100 < SPM_BELOW, "spm").otherwise("psm")
    cut = rows.select("doc_id", "text", form.alias("form"), cuts(F.col("text"), _draw(F.col("digest"), 0), _draw(F.col("digest"), 1)).alias("c"))
    begin, middle = F.col("c.prefix_chars").cast("int"), F.col("c.middle_chars").cast("int")
    size = F.char_length("text")
    parts = [F.substring("text", F.lit(1), begin), F.substring("text", begin + 1, middle), F.substring("text", begin + middle + 1, size)]
    psm = F.concat(F.lit(PREFIX), parts[0], F.lit(SUFFIX), parts[2], F.lit(MIDDLE), parts[1])
    spm = F.concat(F.lit(SUFFIX), parts[2], F.lit(PREFIX), parts[0], F.lit(MIDDLE), parts[1])
    moved = F.col("form") != "plain"
    return cut.select(
        "doc_id", F.col("c.n").alias("n"), "form", F.when(moved, F.col("c.prefix_chars")).alias("prefix_chars"),
        F.when(moved, F.col("c.middle_chars")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The original text of an output. Sentinels cannot overlap, and a text that holds one is plain."""
    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(output, start, -1), end, 1)

    tail = F.substring_index(output, MIDDLE, -1)
    return (
        F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), tail, between(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), tail, between(SUFFIX, PREFIX)))
        .otherwise(output)
    )
