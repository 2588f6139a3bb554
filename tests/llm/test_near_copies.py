from __future__ import annotations

import itertools
import random

import pytest

import corpus_pipeline
from glucoframe.llm import near_copies, simhash

DOCS = "doc_id long, text string"


def shingles(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def survivors(rows: list[tuple]) -> set[int]:
    """The smallest id of each group over all pairs."""
    sets = {doc: shingles(text) for doc, text in rows}
    parent = {doc: doc for doc in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {find(doc) for doc in sets}


@pytest.fixture(scope="module")
def planted():
    """Copies with a growing number of changed words on both sides of the limit, chains, a shared passage, short and empty texts."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for size in (60, 150, 400, 3000):
        base = [word() for _ in range(size)]
        texts.append(base)
        for changes in range(0, size // 20, max(1, size // 400)):
            copy = list(base)
            for at in rng.sample(range(size), changes):
                copy[at] = word()
            texts.append(copy)
        chain = base
        for _ in range(6):
            chain = chain[size // 30 :] + [word() for _ in range(size // 30)]
            texts.append(chain)
    passage = [word() for _ in range(80)]
    texts += [passage + [word() for _ in range(30)] for _ in range(40)]
    rows = [" ".join(t) for t in texts]
    rows += ["A b\tc d E f g", "a B c  d e f G", "one two", "One  two", "three", "", None, " \n"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [near_copies.BLOCK, 8_000])
def test_stage_against_all_pairs(spark, planted, block, monkeypatch):
    monkeypatch.setattr(near_copies.links, "__defaults__", (near_copies.SHINGLE_WORDS, block))
    docs = spark.createDataFrame(planted, DOCS).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == survivors(planted)
    assert kept.count() == len(survivors(planted))


def test_documents_against_all_pairs(spark, docs_folder):
    docs = spark.read.parquet(f"{docs_folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in near_copies.one_per_group(docs).collect()) == sorted(survivors(rows))


def test_odd_rows(odd_docs, no_docs):
    kept = near_copies.one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns and near_copies.one_per_group(no_docs).count() == 0
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.where("doc_id < 6 OR doc_id > 7 OR doc_id IS NULL").select("doc_id", "text").collect()) == [
        (-1, "no id at all here"), (1, "one two three four five"), (2, ""), (8, "Ünï cödé 😀 text ÄÖ"), (9, "other text under the same id"), (9, "x"),
    ]
    assert kept.where("doc_id IN (6, 7)").count() == 1


def test_segment_popcounts_come_first(spark, monkeypatch):
    """Copies that differ in one of many words are found by their fingerprints' segment popcounts alone, with every band off; pairs
    whose fingerprints agree though most words differ are not linked."""
    monkeypatch.setattr(near_copies, "bands", lambda found: [])
    rng = random.Random(5)
    rows = []
    for _ in range(20):
        base = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
        rows += [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(["Other", *base[1:]])]
    rows += ["a b c d e", "f g h i j", "", None]
    rows = list(enumerate(rows))
    prints = {k: near_copies.fingerprint_of_hashes(near_copies.shingle_hashes((text or "").encode(), 5)) for k, text in rows}
    assert prints == {k: simhash.fingerprint_of((text or "").encode(), 5) for k, text in rows}
    close = {k for k in range(60) if k % 3 and any((prints[k] ^ prints[m]).bit_count() <= simhash.RADIUS for m in range(k - k % 3, k))}
    assert len(close) > 30
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert kept == set(range(63)) - close


def test_close_fingerprints_are_compared(spark):
    """A class of fingerprints holds texts that are not alike."""
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, "a b c d e f g"), (4, "g h i j k l m")], "key long, text string")
    sets = {k: near_copies.shingle_set(text.encode()) for k, text in texts.collect()}
    marked = spark.createDataFrame([(k, near_copies._node(s), len(s), 5 if k < 3 else 4, []) for k, s in sets.items()], "key long, node long, n long, print long, cells array<long>")
    assert near_copies.links(marked, texts).count() == 0
