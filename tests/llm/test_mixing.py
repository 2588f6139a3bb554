from __future__ import annotations

from collections import Counter

from glucoframe.llm import mixing


def test_targets_share_out_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 300, "d": 0}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    target = {r.source: r.target for r in rows}
    weights = dict(zip(sorted(k for k in sizes if k) + [None], (5, 2, 1, 5, 2)))
    want = {k: 0.0 for k in sizes}
    free, left = set(sizes), 1.5 * sum(sizes.values())
    while left > 1e-9 and free:
        total = sum(weights[k] for k in free)
        over = {k for k in free if want[k] + left * weights[k] / total >= 2 * sizes[k]}
        share, left = left / total, 0.0
        for k in list(free):
            want[k] += share * weights[k]
            if want[k] > 2 * sizes[k]:
                left, want[k] = left + want[k] - 2 * sizes[k], 2.0 * sizes[k]
        free -= over
    assert all(abs(target[k] - want[k]) < 1e-6 for k in sizes)


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.sample(odd_docs).collect()
    assert len(rows) == 12 and all(0 <= r.copies <= 2 and r.taken == r.size * r.copies for r in rows)
    assert mixing.sample(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
    mixed = mixing.mixed(odd_docs)
    assert mixed.columns == odd_docs.columns
    want = Counter()
    for r in rows:
        want[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in mixed.select("doc_id", "source").collect()) == +want


def test_near_targets_and_reruns_agree(spark, docs_folder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.sample(docs).collect()
    again = mixing.sample(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in again)
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] for s in target)


def test_larger_odds_are_drawn_more_often(spark):
    rows = [(k, "b", "w " * (50 if k % 2 else 150)) for k in range(2000)] + [(k, "a", "w " * 200) for k in range(2000, 4000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mean = {}
    for r in mixing.sample(frame).where("source = 'b' OR source = 'a'").collect():
        mean.setdefault((r.source, r.size), []).append(r.copies)
    assert sum(mean["b", 50]) / 1000 < sum(mean["b", 150]) / 1000


def test_running_sums_over_many_partitions(spark):
    """Longs and doubles, ties broken by the order's last column, nulls where the order puts them."""
    from pyspark.sql import functions as F

    from glucoframe.llm.common import running_sum

    rows = [(None if k % 9 == 0 else f"s{k * 7919 % 1000:04}", k, k % 13, (k % 5) / 2) for k in range(5000)]
    frame = spark.createDataFrame(rows, "name string, k long, n long, w double").repartition(7)
    wanted = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1]))
    for value, at, broadcast_rows in (("n", 2, 0), ("w", 3, 100)):
        found = {r.k: r.before for r in running_sum(frame, [F.col("name").asc_nulls_last(), "k"], value, "before", broadcast_rows).collect()}
        upto = 0
        for row in wanted:
            assert found[row[1]] == upto
            upto += row[at]
    assert running_sum(frame.limit(0), ["k"], "n", "before").count() == 0
