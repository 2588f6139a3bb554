"""Repetition rules: how much of a text lies inside repeated word sequences and repeated lines."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucoframe.llm.common import packed, utf8

SYMBOLS = b"#*$%&|<>"
WINDOW = 3  # words of the windows behind n_repeat_words
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """Largest allowed share of word characters inside repeated sequences, and of repeated lines and their characters.

    What stands first is no repetition: characters count from the second occurrence on. The shares are those usual for web
    text and fall with the length, as long sequences repeat by chance less often. A text may always hold one repeated line
    and `free_chars` repeated characters, so that a short text which opens and closes with the same line stays.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    ngram_chars: tuple[tuple[int, float], ...] = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))
    line_share: float = 0.30
    line_chars: float = 0.20
    free_chars: int = 60


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(hashes: np.ndarray, starts: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Those starts whose n words occur at another start too, in order, and for each whether they occurred before.

    Equal hashes are compared word by word.
    """
    order = np.argsort(hashes, kind="stable")
    sorted_hashes, at = hashes[order], starts[order]
    same = sorted_hashes[1:] == sorted_hashes[:-1]
    left, right = at[:-1][same], at[1:][same]
    twice, later = np.zeros(len(at), bool), np.zeros(len(at), bool)
    if any((ids[left + j] != ids[right + j]).any() for j in range(n)):  # a collision: group by the words themselves
        _, first, group, size = np.unique(ids[starts[:, None] + np.arange(n)], axis=0, return_index=True, return_inverse=True, return_counts=True)
        group = group.reshape(-1)
        twice = size[group] > 1
        later = twice & (first[group] != np.arange(len(starts)))
        return starts[twice], later[twice]
    later[1:] = same
    twice[:-1] = same
    twice |= later
    kept = np.argsort(at[twice], kind="stable")
    return at[twice][kept], later[twice][kept]


def coverage(ids: np.ndarray, sizes: Iterable[int]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Per length, which words lie inside a sequence of that many words found at two or more places, and which inside one that
    occurred before.

    A sequence can only repeat where its first words do, so each length looks at the starts left by the one before.
    The hash of n + 1 words rolls on from that of n.
    """
    total, wanted = len(ids), set(sizes)
    every, again = ({n: np.zeros(total, bool) for n in wanted} for _ in range(2))
    codes = (ids.astype(np.uint64) + np.uint64(1)) * _FACTOR
    codes ^= codes >> np.uint64(29)
    codes *= np.uint64(0xBF58476D1CE4E5B9)
    starts, hashes = np.arange(total), codes.copy()
    for n in range(1, max(wanted, default=0) + 1):
        if n > 1:
            inside = starts + n <= total
            starts = starts[inside]
            hashes = hashes[starts] * _FACTOR + codes[starts + n - 1]
        if len(starts) < 2:
            break
        kept, later = _repeated(hashes, starts, ids, n)
        rolled = np.zeros(total, np.uint64)
        rolled[starts] = hashes
        starts, hashes = kept, rolled
        if n in wanted and len(starts):
            for out, which in ((every, starts), (again, starts[later])):
                steps = np.zeros(total + 1, np.int64)
                steps[which] += 1
                steps[which + n] -= 1
                out[n] = np.cumsum(steps[:-1]) > 0
    return every, again


def _lines(data: bytes) -> tuple[int, int, int, int]:
    """Lines with a word, their characters, and the same for those equal to an earlier line."""
    seen: set[bytes] = set()
    lines = chars = repeats = repeat_chars = 0
    for line in data.split(b"\n"):
        if line.strip():
            size = len(line) if line.isascii() else len(line.decode())
            lines, chars = lines + 1, chars + size
            if line in seen:
                repeats, repeat_chars = repeats + 1, repeat_chars + size
            else:
                seen.add(line)
    return lines, chars, repeats, repeat_chars


def measure(data: bytes, sizes: tuple[int, ...]) -> tuple:
    """The counts of one text: COUNTS, characters inside sequences that occurred before by length, then the four line counts."""
    words = data.split()
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    lengths = np.array(list(map(len, words if data.isascii() else map(bytes.decode, words))), np.int64)
    every, again = coverage(ids, {WINDOW, *sizes})
    lines = _lines(data)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    counts = (len(words), int(lengths.sum()), symbols, lines[2], int(every[WINDOW].sum()))
    return counts, [int(lengths[again[n]].sum()) for n in sizes], lines


def _shape(sizes: tuple[int, ...]) -> list[str]:
    return [*COUNTS, *[f"repeat_chars_{n}" for n in sizes], "n_lines", "line_chars", "dup_line_chars"]


def repetition(text: Column, sizes: tuple[int, ...] = (5, 6, 7, 8, 9, 10)) -> Column:
    """Struct of longs with the counts of a text (null counts as empty), from one pass per Arrow batch."""
    names = _shape(sizes)

    @F.arrow_udf("struct<" + ",".join(f"{n}:bigint" for n in names) + ">")
    def counted(values: pa.Array) -> pa.Array:
        rows = np.zeros((len(values), len(names)), np.int64)
        for at, data in enumerate(utf8(values)):
            counts, ngrams, (n_lines, line_chars, _, dup_chars) = measure(data, sizes)
            rows[at] = (*counts, *ngrams, n_lines, line_chars, dup_chars)
        return pa.StructArray.from_arrays([pa.array(c) for c in rows.T.copy()], names=names)

    return counted(text)


def base_failed(counts: str, limits: Limits) -> Column:
    words, repeats = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (words < limits.min_words) | (repeats * 100 > words * limits.max_repeat_percent)


def passes(counts: str, limits: Limits) -> Column:
    """The method's verdict: no share of repeated characters or lines is above its limit.

    Shares are compared as products, so an empty text passes here; it fails on its number of words.
    """
    of = lambda name: F.col(f"{counts}.{name}").cast("double")
    free = float(limits.free_chars)
    rules = [of(f"repeat_chars_{n}") <= F.greatest(of("word_chars") * most, F.lit(free)) for n, most in limits.ngram_chars]
    rules.append(of("n_dup_lines") <= F.greatest(of("n_lines") * limits.line_share, F.lit(1.0)))
    rules.append(of("dup_line_chars") <= F.greatest(of("line_chars") * limits.line_chars, F.lit(free)))
    verdict = rules[0]
    for rule in rules[1:]:
        verdict = verdict & rule
    return verdict


def assess(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per document: its id as doc_id, the counts, base_failed and kept.

    A null or empty text has no words and fails. Ids may be null or repeat, every row is judged by itself, further
    columns are ignored. No shuffle; the work grows with the text (n log n for one text), nothing is cut short.
    """
    sizes = tuple(n for n, _ in limits.ngram_chars)
    judged = docs.select(F.col(f"`{id_column}`").alias("doc_id"), repetition(F.col(f"`{text_column}`"), sizes).alias("c"))
    failed = base_failed("c", limits)
    return judged.select("doc_id", *[F.col(f"c.{n}").alias(n) for n in _shape(sizes)], failed.alias("base_failed"), (~failed & passes("c", limits)).alias("kept"))


def keep_good(docs: DataFrame, text_column: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows that pass, with their columns unchanged."""
    sizes = tuple(n for n, _ in limits.ngram_chars)
    judged = packed(docs, text=F.col(f"`{text_column}`")).select("row", repetition(F.col("text"), sizes).alias("c"))
    return judged.where(~base_failed("c", limits) & passes("c", limits)).select("row.*")
