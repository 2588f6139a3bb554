"""Cuts at token counts from chunk summaries against splitting the whole text."""

from __future__ import annotations

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from glucoframe.llm import fill_in_middle

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def by_tokens(doc_id, text):
    """Output, form and sizes by the definition."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(h[k] % (len(tokens) + 1) for k in (0, 1))
    p, m, s = ("".join(part) for part in (tokens[:low], tokens[low:high], tokens[high:]))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_counts_and_cuts_of_any_text():
    rng = random.Random(5)
    shared = " ".join(rng.choice(["alpha", "beta", "é", "42", "γ-ray", "x"]) for _ in range(20_000))
    texts = ["", "a", "é", "aé😀b", "x" * 30_000, "é" * 30_000, "😀" * 9_000, "a b" * 9_000, "\n\0\n", shared, "start " + shared, shared[5_000:] + shared]
    texts += ["".join(rng.choice("abcXYZ  é😀\n.") for _ in range(rng.randrange(60_000))) for _ in range(20)]
    memory = fill_in_middle.Memory(most=200_000)
    for text in texts:
        known, tokens = fill_in_middle.Text(text.encode(), memory), TOKEN.findall(text)
        assert known.n == len(tokens)
        for count in {0, len(tokens), *(rng.randrange(len(tokens) + 1) for _ in range(5))}:
            assert known.chars_before(count) == sum(map(len, tokens[:count]))


def test_shared_passages_are_summarised_once():
    rng = random.Random(6)
    shared = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(30_000)).encode()
    memory = fill_in_middle.Memory()
    fill_in_middle.Text(shared, memory)
    first = memory.misses
    fill_in_middle.Text(b"other words before it " + shared, memory)
    assert first > 100 and memory.hits >= first - 2 and memory.misses <= first + 3


def test_a_hit_needs_the_same_content(monkeypatch):
    monkeypatch.setattr(fill_in_middle.xxhash, "xxh3_64_intdigest", lambda chunk: 7)
    memory = fill_in_middle.Memory()
    for chunk in (b"one two", b"x", b"one two", b"one two", "é é".encode()):
        assert memory(chunk) == fill_in_middle.summarize(chunk)
    assert memory.hits == 1


def test_chunks_cover_the_text_and_stay_short():
    data = ("é" * 50_000 + "word " * 400_000).encode()
    ends = list(fill_in_middle.chunk_ends(data))
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    assert all(b - a <= fill_in_middle.LONGEST + 3 for a, b in zip([0, *ends], ends))
    for a, b in zip([0, *ends], ends):
        data[a:b].decode()


def test_one_long_text_takes_little_time():
    started = time.time()
    assert fill_in_middle.Text(b"ab cd. " * 1_000_000, fill_in_middle.Memory()).n == 5_000_000
    assert time.time() - started < 20


def test_odd_rows(spark, odd_docs, no_docs):
    marked = odd_docs.union(odd_docs.where("doc_id = 1").withColumn("text", F.lit("has <S> inside")).withColumn("doc_id", F.lit(77).cast("long")))
    made = fill_in_middle.transform(marked)
    found = sorted(map(repr, made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()))
    rows = [(r.doc_id, *by_tokens(r.doc_id, r.text)) for r in marked.select("doc_id", "text").collect()]
    assert found == sorted(_row(row) for row in rows)
    again = made.select(F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("h")).collect()
    assert sorted(r.h for r in again) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in marked.select("text").collect())
    assert fill_in_middle.transform(no_docs).count() == 0


def _row(values):
    from pyspark.sql import Row

    return repr(Row(**dict(zip(("doc_id", "n", "form", "prefix_chars", "middle_chars", "output"), values))))
