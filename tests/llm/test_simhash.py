from __future__ import annotations

import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from glucoframe.llm import components as component_steps
from glucoframe.llm import simhash
from glucoframe.llm.components import roots


def brute_print(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict) -> dict:
    parent = {k: k for k in prints}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {k: find(k) for k in prints}


def test_documents_against_brute_force(spark, docs_folder):
    docs = spark.read.parquet(f"{docs_folder}/documents.parquet")
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    found = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in found} == prints
    assert {r.doc_id: r.component_id for r in found} == components(prints)
    kept = simhash.one_per_group(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(components(prints).values()))


@pytest.mark.parametrize("width", [1, 2])
def test_links_connect_what_two_bits_connect(spark, width):
    """Chains, dense groups around one print, and the sign bit."""
    rng = random.Random(3)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64) if rng.random() < 0.3 else range(55, 64), rng.randint(0, 4))))
    values |= {rng.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1, 1 << 63, 3, 15}
    prints = {k: v for k, v in enumerate(sorted(values))}
    signed = {v - (1 << 64) if v >> 63 else v: k for k, v in prints.items()}
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    rooted = {r.node: r.root for r in roots(simhash.links(frame, width)).collect()}
    groups: dict = {}
    for value, k in signed.items():
        groups.setdefault(rooted.get(value, value), set()).add(k)
    expected: dict = {}
    for k, root in components(prints).items():
        expected.setdefault(root, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_long_chain(spark):
    chain = spark.range(200).select((F.col("id") * 7 % 201).alias("u"), ((F.col("id") + 1) * 7 % 201).alias("v"))
    assert {r.root for r in roots(chain).collect()} == {0}


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 12
    empty = {r.component_id for r in rows if r.fp == 0}
    assert empty == {2}  # null, empty and blank texts link; the smallest id among them
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_per_group(no_docs).count() == 0
    kept = simhash.one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.where("doc_id < 6 OR doc_id > 7 OR doc_id IS NULL").select("doc_id", "text").collect()) == [
        (-1, "no id at all here"), (1, "one two three four five"), (2, ""), (8, "Ünï cödé 😀 text ÄÖ"), (9, "other text under the same id"), (9, "x"),
    ]
    assert kept.where("doc_id IN (6, 7)").count() == 1


@pytest.mark.parametrize("broadcast_rows", [0, 200_000])
def test_components_of_hot_nodes(spark, monkeypatch, broadcast_rows):
    """A star, a chain and random edges by the plan with a broadcast and by that for very many nodes."""
    monkeypatch.setattr(component_steps, "HEAVY", 50)
    rng = random.Random(2)
    edges = [(0, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(5000, 5300)] + [(rng.randrange(10_000, 10_400), rng.randrange(10_000, 10_400)) for _ in range(250)]
    edges += [(7, 7), (5000, 5001)]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(edges, "u long, v long").repartition(4)
    found = {r.node: r.root for r in roots(frame, broadcast_rows).collect()}
    assert found == {x: root(x) for u, v in edges if u != v for x in (u, v)}
