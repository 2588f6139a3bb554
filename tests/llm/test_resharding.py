from __future__ import annotations

import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from glucoframe.llm import resharding
from glucoframe.session import scratch_path


def cheapest(supply, capacity, cost):
    """Least cost over all whole-number flows, by trying them."""
    best = np.inf
    rows = [[c for c in itertools.product(range(s + 1), repeat=len(capacity)) if sum(c) == s] for s in supply]
    for flows in itertools.product(*rows):
        if all(sum(f[j] for f in flows) <= capacity[j] for j in range(len(capacity))):
            best = min(best, sum(cost[i][j] * f[j] for i, f in enumerate(flows) for j in range(len(capacity))))
    return best


def test_flow_is_the_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(40):
        supply, cost = rng.integers(0, 5, 3), rng.integers(0, 6, (3, 3)).astype(float)
        capacity = rng.integers(0, 5, 3)
        capacity[0] += max(0, supply.sum() - capacity.sum())
        flow = resharding.cheapest_flow(supply, capacity, cost)
        assert (flow.sum(1) == supply).all() and (flow.sum(0) <= capacity).all() and (flow >= 0).all()
        assert (flow * cost).sum() == cheapest(supply, capacity, cost)


def placed(spark, docs, shards=8, old=6, **more):
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    layout = resharding.store(docs, F.pmod(F.xxhash64("source"), F.lit(old)), size, scratch_path(spark, "old"))
    moves = resharding.plan(layout, shards=shards, **more)
    return moves, resharding.reshard(layout, moves, scratch_path(spark, "new")).select("row.*", F.col("size").alias("bytes"), F.col("shard").alias("to"), F.col("slot").alias("place"))


def test_documents(spark, docs_folder):
    docs = spark.read.parquet(f"{docs_folder}/documents.parquet")
    moves, rows = placed(spark, docs.repartition(3))
    rows = rows.collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in docs.collect())
    sizes = np.zeros(8)
    for shard in range(8):
        own = [r for r in rows if r.to == shard]
        assert sorted(r.place for r in own) == list(range(len(own)))
        sizes[shard] = sum(len(r.text.encode()) + 1 for r in own)
    longest = max(r.bytes for r in rows)
    assert sizes.max() - sizes.min() <= 2 * longest
    # The fewest bytes: what exceeds an old shard's new capacity, plus all of the shards that go.
    supply = moves.flow.sum(1)
    assert moves.moved_bytes == sum(max(0, int(s) - int(c)) for s, c in zip(supply, resharding.even_capacities(int(supply.sum()), 8)))
    assert zlib.crc32(b"") == 0


def test_fewer_shards_and_odd_rows(spark, odd_docs, no_docs):
    _, rows = placed(spark, odd_docs, shards=2, old=4)
    assert rows.columns[: len(odd_docs.columns)] == odd_docs.columns
    found = [(r.to, r.place) for r in rows.select("to", "place").collect()]
    assert len(found) == 12 and all(sorted(p for s, p in found if s == shard) == list(range(sum(s == shard for s, _ in found))) for shard in (0, 1))
    assert placed(spark, no_docs)[1].count() == 0
