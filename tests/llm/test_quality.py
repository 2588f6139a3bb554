from __future__ import annotations

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from glucoframe.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str, n: int, later: bool = False) -> list[bool]:
    """Words inside n-word sequences found twice, or that occurred before."""
    words = WORD.findall(text)
    grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
    counts = Counter(grams)
    hit = [g in grams[:k] if later else counts[g] > 1 for k, g in enumerate(grams)]
    return [any(hit[s] for s in range(max(0, p - n + 1), min(p, len(grams) - 1) + 1)) for p in range(len(words))]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\té", max_size=60))
def test_measure_equals_brute_force(text):
    counts, chars, lines = quality.measure(text.encode(), (2, 5))
    words = WORD.findall(text)
    own = [line for line in text.split("\n") if WORD.search(line)]
    assert counts == (len(words), sum(map(len, words)), 0, len(own) - len(set(own)), sum(brute(text, 3)))
    assert chars == [sum(len(w) for w, hit in zip(words, brute(text, n, later=True)) if hit) for n in (2, 5)]
    assert lines[0] == len(own) and lines[1] == sum(map(len, own))


def test_equal_hashes_of_different_words_are_told_apart():
    ids, starts = np.array([0, 1, 2, 0, 3]), np.arange(4)
    assert quality._repeated(np.zeros(4, np.uint64), starts, ids, 2)[0].tolist() == []
    ids = np.array([0, 1, 2, 0, 1])
    found, later = quality._repeated(np.zeros(4, np.uint64), starts, ids, 2)
    assert found.tolist() == [0, 3] and later.tolist() == [False, True]


def test_odd_rows(odd_docs, no_docs):
    rows = quality.assess(odd_docs).collect()
    assert len(rows) == 12
    long_rows = [r for r in rows if r.doc_id in (6, 7)]
    assert all(r.n_words == 120_000 and r.base_failed for r in long_rows)
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in rows if r.doc_id in (2, 3, 5))
    assert quality.assess(no_docs).count() == 0
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 0


def test_good_text_stays_and_repetition_goes(spark):
    good = " ".join(f"w{k * 7919 % 1009}x{k}" for k in range(200))
    # The base rule holds neither of these back: their windows of three differ, but not their lines or long sequences.
    lines = "\n".join(["just this one line again"] * 40 + [f"line number {k} is new here now and then {k * k}" for k in range(80)])
    frame = spark.createDataFrame([(1, good), (2, good + "\n" + " ".join(["a b c d e f g h i j"] * 60)), (3, lines)], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality.assess(frame).collect()}
    assert kept[1] and not kept[2]
    assert [r.doc_id for r in quality.keep_good(frame).select("doc_id").where("doc_id < 3").collect()] == [1]


def test_documents_that_only_the_method_rejects(spark):
    """Texts that pass the base rule: a third of one from one sentence, short menu lines between long ones, a copied part."""
    fresh = iter(range(100_000))
    new = lambda n: " ".join(f"w{next(fresh)}" for _ in range(n))
    sentence = "the same nine words stand here again and again"
    rows = {
        1: " ".join(f"{new(18)} {sentence}" for _ in range(20)),
        2: "\n".join(f"{new(6)}\nread more about this" for _ in range(40)),
        3: (part := new(40)) + " " + new(120) + " " + part,
        4: "\n".join(f"{new(3)}\nmenu" for _ in range(40)),
        5: "Our motto stands here\n" + new(60) + "\nOur motto stands here",
        6: "\n".join(new(12) for _ in range(20)) + "\n" + "\n".join(f"{new(9)}\n***" for _ in range(3)),
    }
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    found = {r.doc_id: (r.base_failed, r.kept) for r in quality.assess(frame).collect()}
    assert found == {1: (False, False), 2: (False, False), 3: (False, False), 4: (False, False), 5: (False, True), 6: (False, True)}
