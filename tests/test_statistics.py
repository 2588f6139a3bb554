"""Ranks, quantiles, transforms, correlation and density against plain Python on seeded data."""

import math
import os
import random
import time
from concurrent.futures import ThreadPoolExecutor
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glucoframe.functions.normal import qnorm, qnorm_array
from glucoframe.operators import correlation, density, descriptives, ranking, transforms, unit_check
from glucoframe.operators.curve import curve_summary, curve_summary_long, series_map
from glucoframe.operators.transforms import Transform
from glucoframe.session import SHUFFLE_CLEANUP, cut_lineage
from glucoframe.settings import UnitChoice


def average_ranks(values):
    order = sorted(values)
    first, last = {}, {}
    for k, v in enumerate(order, start=1):
        first.setdefault(v, k)
        last[v] = k
    return {v: (first[v] + last[v]) / 2 for v in first}


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        a = round(rng.gauss(5, 2), 1)
        b = a * 0.5 + rng.gauss(0, 1)
        c = math.exp(rng.gauss(0, 1))
        rows.append((
            i, ("male", "female", None)[rng.choices((0, 1, 2), (5, 4, 1))[0]],
            None if i % 9 == 4 else a, None if i % 7 == 3 else b, None if i % 9 == 4 else round(c, 1), 3.0,
        ))
    return spark.createDataFrame(rows, "k int, sex string, a double, b double, c double, same double"), rows


def long_of(df, *columns):
    return transforms.to_long(df, list(columns), ["k", "sex"])


def test_ranks_with_ties(table):
    df, rows = table
    expected = average_ranks([r[2] for r in rows if r[2] is not None])
    got = transforms.rank_long(long_of(df, "a")).collect()
    assert len(got) == sum(r[2] is not None for r in rows)
    assert all(r["rank"] == expected[r["value"]] for r in got)


def test_negative_zero_is_zero(spark):
    df = spark.createDataFrame([(1, -0.0), (2, 0.0), (3, -1.0)], "k int, a double")
    ranks = {r.k: r["rank"] for r in transforms.rank_long(transforms.to_long(df, ["a"], ["k"])).collect()}
    assert ranks == {1: 2.5, 2: 2.5, 3: 1.0}


@pytest.mark.parametrize("held, broadcast_rows, batch", [(200_000, 1_000_000, 10_000), (50, 0, 97), (1, 1_000_000, 1), (10_000, 0, 1000)])
def test_ranks_across_partitions_and_hot_values(spark, held, broadcast_rows, batch):
    """One value on a third of the rows and whole keys of one value lie across borders of tasks and batches."""
    rng = random.Random(3)
    size = 300 if batch == 1 else 4000
    rows = [("x", 0.0)] * size + [("x", float(rng.randrange(3000))) for _ in range(2 * size)] + [("y", 5.0)] * size + [("z", 1.0), ("w", 2.0), ("w", -0.0)]
    rows += [("v", float(k // 7)) for k in range(size // 2)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], "k int, index_id string, value double").repartition(6)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch), "spark.sql.shuffle.partitions": "13"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        got = transforms.rank_long(df, limits=ranking.Limits(held=held, broadcast_rows=broadcast_rows)).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    expected = {key: average_ranks([v for i, v in rows if i == key]) for key in "vwxyz"}
    assert len(got) == len(rows) == len({r.k for r in got}) and all(r["rank"] == expected[r.index_id][r.value] for r in got)


def test_ranks_in_sets(spark):
    """Ranks among the rows of every set, from one ordering."""
    rng = random.Random(4)
    rows = [(k, rng.choice("ab"), float(rng.randrange(40)), rng.randrange(8)) for k in range(3000)]
    df = spark.createDataFrame(rows, "row long, key string, value double, mask int").repartition(5)

    def flags(batch):
        mask = batch.column("mask").to_numpy()
        return np.column_stack([(mask >> bit) & 1 for bit in range(3)]).astype(np.int64)

    found = ranking.range_ranks(df, ["key"], "value", "row", flags, ranking.Limits(held=10)).collect()
    for bit in range(3):
        for key in "ab":
            inside = [v for _, k, v, m in rows if k == key and m >> bit & 1]
            expected = average_ranks(inside)
            for r in found:
                if r.key == key and r["mask"] >> bit & 1:
                    assert r.twice[bit] / 2 == expected[r.value] and r.total[bit] == len(inside)


def test_repeated_and_missing_ids_keep_their_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0), ("b", 3.0, 5.0), ("c", 4.0, 3.0), (None, 5.0, 9.0)], "id string, x double, y double")
    row = correlation.spearman(df, "x", "y").head()
    matrix = correlation.spearman_matrix(df, ["x", "y"]).where("row = 'x' AND col = 'y'").head()
    assert row.n == matrix.n == 5 and row.rho == pytest.approx(0.8, abs=1e-12) and matrix.value == pytest.approx(0.8, abs=1e-12)


def test_row_numbers(spark):
    df = spark.range(0, 5000).withColumn("v", F.col("id") * 7919 % 5000).repartition(7)
    numbered = ranking.add_row_numbers(df, ["v"], "row")
    assert numbered.where("row <> v + 1").count() == 0 and numbered.count() == 5000


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 10, 101])
def test_small_quantiles(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.gauss(0, 1), 1.0]) for _ in range(n)]
    df = spark.createDataFrame([("x", v) for v in values], "index_id string, value double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    row = ranking.exact_quantiles(df, ["index_id"], probabilities).head()
    for k, p in enumerate(probabilities):
        assert row[f"q{k}"] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_bracketed_quantiles(spark):
    """Beyond 40,000 values only a bracket around each quantile is ordered; half of the values are equal."""
    n = 120_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "h").otherwise("u").alias("index_id"),
        F.when((F.col("id") % 3 == 0) & (F.col("id") % 2 == 0), 0.25)
        .otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0).alias("value"),
    )
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    local = {"h": [], "u": []}
    for r in df.collect():
        local[r.index_id].append(r.value)
    for row in ranking.exact_quantiles(df, ["index_id"], probabilities).collect():
        for k, p in enumerate(probabilities):
            assert row[f"q{k}"] == pytest.approx(np.quantile(local[row.index_id], p), rel=1e-12)


def test_qnorm(spark):
    ps = [1e-300, 1e-20, 1e-5, 0.0241, 0.025, 0.0749, 0.075, 0.3, 0.5, 0.6, 0.925, 0.9999, 1 - 1e-12]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for r in df.select("p", qnorm(F.col("p")).alias("z")).collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-13, abs=1e-15)
    edge = spark.createDataFrame([(0.0,), (1.0,), (-0.1,), (1.1,), (float("nan"),), (None,)], "p double")
    got = [r.z for r in edge.select(qnorm(F.col("p")).alias("z")).collect()]
    assert got[:2] == [-math.inf, math.inf] and all(math.isnan(x) for x in got[2:5]) and got[5] is None


def test_transforms(table):
    df, rows = table
    out = {r.k: r for r in transforms.transform_results(
        df.withColumnRenamed("a", "homa_ir").withColumnRenamed("b", "lap"), Transform("rint", "sex"), key="k"
    ).collect()}
    columns = list(next(iter(out.values())).asDict())
    assert columns == ["k", "sex", "homa_ir", "homa_ir_rint_bysex", "lap", "lap_rint_bysex", "c", "same"]
    for sex in ("male", "female"):
        values = [r[2] for r in rows if r[1] == sex and r[2] is not None]
        rank = average_ranks(values)
        for r in rows:
            if r[1] == sex and r[2] is not None:
                z = NormalDist().inv_cdf((rank[r[2]] - 0.375) / (len(values) + 0.25))
                assert out[r[0]].homa_ir_rint_bysex == pytest.approx(z, abs=1e-12)
    assert all(out[r[0]].homa_ir_rint_bysex is None for r in rows if r[1] is None or r[2] is None)


def test_z_and_log(table):
    df, rows = table
    named = df.withColumnRenamed("b", "lap").withColumnRenamed("same", "homa_ir").select("k", "sex", "lap", "homa_ir")
    values = [r[3] for r in rows if r[3] is not None]
    mean, sd = np.mean(values), np.std(values, ddof=1)
    for r in transforms.transform_results(named, Transform("z"), key="k").collect():
        assert r.homa_ir_z is None  # constant
        assert (r.lap_z is None) == (r.lap is None)
        if r.lap is not None:
            assert r.lap_z == pytest.approx((r.lap - mean) / sd, abs=1e-10)
    for r in transforms.transform_results(named, Transform("log"), key="k", keep_only=True, columns=["lap"]).collect():
        source = rows[r.k][3]
        assert r.lap_log == (pytest.approx(math.log(source)) if source is not None and source > 0 else None)
    reasons = {(r.index_id, r.not_transformed) for r in transforms.transform_report(named, Transform("z")).collect()}
    assert ("homa_ir", "SD is 0") in reasons and ("lap", None) in reasons
    with pytest.raises(ValueError):
        Transform("cube")


def test_attach_sex_checks(spark):
    results = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "participant_id string, homa_ir double")
    source = spark.createDataFrame([("a", "male"), ("b", None), ("c", "female")], "participant_id string, sex string")
    assert {r.participant_id: r.sex for r in transforms.attach_sex(results, source).collect()} == {"a": "male", "b": None}
    with pytest.raises(ValueError, match="not found"):
        transforms.attach_sex(results, source.where("sex = 'male'"))
    with pytest.raises(ValueError, match="duplicate"):
        transforms.attach_sex(results, source.unionByName(source))


def test_describe(table):
    df, rows = table
    stats = {r.index_id: r for r in descriptives.describe(long_of(df, "a", "c", "same"), len(rows)).collect()}
    c = np.array([r[4] for r in rows if r[4] is not None])
    got = stats["c"]
    assert got.n == len(c) and got.missing == len(rows) - len(c)
    assert (got.q1, got.median, got.q3) == pytest.approx(tuple(np.quantile(c, [0.25, 0.5, 0.75])))
    d = c - c.mean()
    n = len(c)
    g1 = (d**3).mean() / (d**2).mean() ** 1.5 * math.sqrt(n * (n - 1)) / (n - 2)
    assert got.skewness == pytest.approx(g1, rel=1e-9) and got.sd == pytest.approx(c.std(ddof=1))
    assert stats["same"].skewness is None and stats["same"].sd == 0
    none = long_of(df, "a", "c").where("index_id <> 'c'")
    listed = {r.index_id: r for r in descriptives.describe(none, len(rows), ids=["a", "c"]).collect()}
    assert listed["c"].n == 0 and listed["c"].missing == len(rows) and listed["c"].median is None


def plain_pearson(x, y):
    return float(np.corrcoef(x, y)[0, 1])


def test_correlation_matrices(table):
    df, rows = table
    columns = ["a", "b", "c", "same"]
    pearson = {(r.row, r.col): r for r in correlation.pearson_matrix(df, columns).collect()}
    spearman = {(r.row, r.col): r for r in correlation.spearman_matrix(df, columns).collect()}
    assert len(pearson) == len(spearman) == 16
    for i, x in enumerate(columns):
        for j, y in enumerate(columns):
            pairs = [(r[2 + i], r[2 + j]) for r in rows if r[2 + i] is not None and r[2 + j] is not None]
            xs, ys = [p[0] for p in pairs], [p[1] for p in pairs]
            assert pearson[x, y].n == spearman[x, y].n == len(pairs)
            if "same" in (x, y):
                assert pearson[x, y].value is None and spearman[x, y].value is None
                continue
            rx, ry = average_ranks(xs), average_ranks(ys)
            assert pearson[x, y].value == pytest.approx(plain_pearson(xs, ys), abs=1e-12)
            assert spearman[x, y].value == pytest.approx(plain_pearson([rx[v] for v in xs], [ry[v] for v in ys]), abs=1e-12)
    pair = correlation.spearman(df, "a", "b").head()
    assert pair.rho == pytest.approx(spearman["a", "b"].value, abs=1e-12)
    assert correlation.pearson(df, "a", "same").head().r is None


def patterned(spark, count=3000):
    """Columns that are missing on the same rows, never, in ten patterns, or at random; ties and infinities."""
    rng = random.Random(8)
    rows = []
    for k in range(count):
        lacking = k % 10
        row = [float(rng.randrange(50)), rng.gauss(0, 1), float(k % 7), rng.gauss(0, 1), float(rng.randrange(4)), rng.gauss(0, 1)]
        row = [None if lacking in gone else v for v, gone in zip(row, ((1, 2), (1, 2), (), (2, 3, 4), (5,), ()))]
        if rng.random() < 0.3:
            row[5] = float("inf") if rng.random() < 0.5 else None
        rows.append(tuple(row))
    return spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(6))), rows


@pytest.mark.parametrize("most_masks", [0, 50_000])
def test_rank_sets(spark, most_masks):
    """Pairs with the same number have the same rows, by the dictionary of patterns exactly then; the counts are those of the pairs."""
    df, rows = patterned(spark)
    columns = [f"c{k}" for k in range(6)]
    masked = df.select("*", *correlation._masks(columns))
    counts, sets = correlation.rank_sets(masked, columns, most_masks)
    finite = np.array([[v is not None and math.isfinite(v) for v in row] for row in rows])
    for i in range(6):
        for j in range(6):
            inside = finite[:, i] & finite[:, j]
            assert counts[i, j] == inside.sum()
            for a in range(6):
                for b in range(6):
                    same = (inside == (finite[:, a] & finite[:, b])).all()
                    assert same if sets[i, j] == sets[a, b] else not same or most_masks == 0
    assert sets[0, 0] == sets[1, 1] == sets[0, 1] == sets[0, 2]


@pytest.mark.parametrize("most_masks, limits", [(0, ranking.Limits(held=1, broadcast_rows=0)), (50_000, ranking.LIMITS)])
def test_spearman_over_patterns_of_missing_values(spark, most_masks, limits):
    df, rows = patterned(spark)
    columns = [f"c{k}" for k in range(6)]
    found = {(r.row, r.col): r for r in correlation.spearman_matrix(df, columns, limits, most_masks).collect()}
    table = pd.DataFrame(rows, columns=columns).replace([np.inf], np.nan)
    for x in columns:
        for y in columns:
            both = table[[x, y]].dropna() if x != y else table[[x]].dropna()
            assert found[x, y].n == len(both)
            assert found[x, y].value == pytest.approx(1.0 if x == y else both[x].rank().corr(both[y].rank()), abs=1e-12)


def test_more_columns_than_bits(spark):
    df = spark.range(50).select(*[((F.col("id") * (k + 3)) % 53 + 0.0).alias(f"c{k}") for k in range(70)])
    columns = df.columns
    found = {(r.row, r.col): r.value for r in correlation.spearman_matrix(df, columns).collect()}
    table = df.toPandas()
    assert found["c1", "c68"] == pytest.approx(table["c1"].rank().corr(table["c68"].rank()), abs=1e-12) and len(found) == 4900


def test_too_few_pairs(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 1.0), (3, None, 3.0)], "k int, a double, b double")
    matrix = {(r.row, r.col): r for r in correlation.pearson_matrix(df, ["a", "b"]).collect()}
    assert matrix["a", "b"].value is None and matrix["a", "b"].n == 2 and matrix["b", "b"].value == 1
    matrix = {(r.row, r.col): r for r in correlation.spearman_matrix(df, ["a", "b"]).collect()}
    assert matrix["a", "b"].value is None and matrix["a", "a"].value is None and matrix["b", "b"].value == 1


def test_scatter_sample(spark):
    df = spark.createDataFrame([(k, float(k), None if k % 5 == 0 else 1.0) for k in range(1000)], "k int, a double, b double")
    present = [k for k in range(1000) if k % 5]
    got = sorted(r.k for r in correlation.scatter_sample(df, "a", "b", "k", 300).collect() if r.total == len(present))
    assert got == [present[k * len(present) // 300] for k in range(300)]
    assert correlation.scatter_sample(df, "a", "b", "k", None).count() == len(present)


def test_binned_density_is_close(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1, 3000), rng.normal(6, 0.5, 2000)])
    df = spark.createDataFrame([("x", float(v)) for v in values], "index_id string, value double")
    exact = {r.x: r.density for r in density.density(df, ["index_id"]).collect()}
    binned = {r.x: r.density for r in density.density(df, ["index_id"], method="binned").collect()}
    assert len(exact) == 256 and exact.keys() == binned.keys()
    peak = max(exact.values())
    for x, y in exact.items():
        assert binned[x] == pytest.approx(y, rel=1e-3, abs=1e-9 * peak)
    bw = 0.9 * min(values.std(ddof=1), (np.quantile(values, 0.75) - np.quantile(values, 0.25)) / 1.34) * 5000**-0.2
    assert density.bandwidths(df, ["index_id"]).head().bandwidth == pytest.approx(bw, rel=1e-9)


def test_density_sums_close_values_first(spark):
    """Many values, in two clusters far apart: as many kernels as cells, the same sums at every point down to the smallest."""
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(0, 1, 20_000), rng.normal(90, 0.01, 3), [90.0] * 5]).round(7)
    df = spark.createDataFrame([("x", float(v)) for v in values], "index_id string, value double").repartition(4)
    stats = density.bandwidths(df, ["index_id"]).head()
    known = [F.lit(stats[c]).alias(c) for c in ("low", "high", "bandwidth")]
    cells = density._cells(df.select(F.lit(0).cast("long").alias("number"), F.col("value").alias("centre"), *known))
    assert cells.agg(F.sum("weight")).head()[0] == len(values) and cells.count() < len(values) / 8
    for r in density.density(df, ["index_id"]).collect():
        exact = np.exp(-0.5 * ((r.x - values) / r.bandwidth) ** 2).sum() / (np.sqrt(2 * np.pi) * r.bandwidth * r.n)
        assert r.density == pytest.approx(exact, rel=1e-9, abs=1e-300)


def test_density_of_a_long_tail_is_exact(spark):
    """Two million values whose range is many thousand bandwidths: neither bins nor a bound blur the sum."""
    values = np.random.default_rng(8).lognormal(0, 2, 2_000_000)
    path_rows = spark.createDataFrame(pd.DataFrame({"value": values})).selectExpr("'x' AS index_id", "value")
    found = density.density(path_rows.repartition(8), ["index_id"]).orderBy("x").collect()
    bw = found[0].bandwidth
    for r in found[:4] + found[100:102] + found[-2:]:
        u = (r.x - values) / bw
        exact = np.exp(-0.5 * u * u).sum() / (np.sqrt(2 * np.pi) * bw * len(values))
        assert r.density == pytest.approx(exact, rel=1e-9, abs=1e-300)
    tail = density.density(path_rows.repartition(8), ["index_id"], method="binned").orderBy("x").collect()
    assert tail[0].density == pytest.approx(found[0].density, rel=1e-3)


def test_repeated_keys_stay_apart(spark):
    rows = [("a", 1.0), ("a", 5.0), ("b", 2.0), ("c", 3.0), ("d", 4.0)]
    df = spark.createDataFrame(rows, "participant_id string, homa_ir double")
    out = {r.homa_ir: r.homa_ir_rint for r in transforms.transform_results(df, Transform("rint")).collect()}
    assert out[1.0] == pytest.approx(-out[5.0]) and out[1.0] < out[2.0] < out[3.0] < out[4.0] < out[5.0]


def test_infinite_values_are_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, 5.0), (float("inf"), 1.0), (5.0, float("nan")), (4.0, 9.0)], "x double, y double")
    found = {(r.row, r.col): (r.value, r.n) for r in correlation.pearson_matrix(df, ["x", "y"]).collect()}
    assert found["x", "x"] == (1.0, 5) and found["x", "y"][1] == 4
    assert found["x", "y"][0] == pytest.approx(plain_pearson([1, 2, 3, 4], [2, 4.5, 5, 9]))


def test_bandwidth_fallbacks(spark):
    rows = [("zero", 0.0)] * 3 + [("same", -2.0)] * 3 + [("iqr", 1.0)] * 9 + [("iqr", 4.0)] + [("one", 1.0)]
    df = spark.createDataFrame(rows, "index_id string, value double")
    got = {r.index_id: r.bandwidth for r in density.bandwidths(df, ["index_id"]).collect()}
    assert got["zero"] == pytest.approx(0.9 * 3**-0.2) and got["same"] == pytest.approx(1.8 * 3**-0.2)
    assert got["iqr"] == pytest.approx(0.9 * np.std([1.0] * 9 + [4.0], ddof=1) * 10**-0.2) and got["one"] is None


def test_histograms(spark):
    rows = [("c", 2.0)] * 4 + [("v", float(k)) for k in range(100)]
    df = spark.createDataFrame(rows, "index_id string, value double")
    found = density.histogram(df, ["index_id"], least=10, most=60).collect()
    constant = [r for r in found if r.index_id == "c"]
    assert len(constant) == 10 and min(r.lo for r in constant) == 1.5
    assert sum(r["count"] for r in constant) == 4
    spread = sorted((r for r in found if r.index_id == "v"), key=lambda r: r.bin)
    assert sum(r["count"] for r in spread) == 100 and spread[-1].hi == pytest.approx(99)


def test_unit_check(spark):
    df = spark.createDataFrame([(90.0 + i, 5.0, None, 60.0) for i in range(5)], "g120 double, g30 double, g0 double, hdl double")
    got = {r.quantity: r for r in unit_check.check_units(df).collect()}
    assert got["glucose"].column == "G120" and got["glucose"].median == 92 and got["glucose"].suggested == "mg/dL"
    assert got["hdl"].suggested == "mg/dL"
    texts = [r.warning for r in unit_check.unit_warnings(unit_check.check_units(df)).collect()]
    assert any("92" in t and "mg/dL, but mmol/L is selected" in t for t in texts)
    few = spark.createDataFrame([(90.0,)] * 4, "g0 double")
    assert unit_check.check_units(few).count() == 0
    low = spark.createDataFrame([(8.0,)] * 6, "i0 double")
    assert unit_check.check_units(low, UnitChoice(insulin="mU/L")).head().suggested is None
    assert unit_check.check_units(low).head().suggested == "uU/mL"


def test_curves(spark):
    df = spark.createDataFrame([(5.0, 8.0, None, 6.0), (5.0, None, None, None), (5.0, float("inf"), 7.0, None)],
                               "g0 double, g30 double, g60 double, g120 double")
    got = [r.s for r in df.select(curve_summary(series_map(df, "g", (0, 30, 60, 120)), "glucose").alias("s")).collect()]
    assert got[0].auc == pytest.approx(6.5 * 30 + 7 * 90) and got[0].time_points == [0, 30, 120]
    assert got[0].time_weighted_mean == pytest.approx((6.5 * 30 + 7 * 90) / 120)
    assert got[1].auc is None and got[1].reason == "requires at least two glucose time points"
    assert got[2].time_points == [0, 60] and got[2].auc == 360
    samples = [("a", 0, 4.0), ("a", 0, 6.0), ("a", 60, 7.0), ("a", 90, None), ("b", 0, 1.0)]
    long = spark.createDataFrame(samples, "id string, minute int, value double")
    rows = {r.id: r for r in curve_summary_long(long, "id").collect()}
    assert rows["a"].auc == 360 and rows["a"].points == 2 and rows["b"].auc is None


def tables_written(monkeypatch, module):
    """Collects the tables a module writes to the shared folder."""
    found, write = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: found.append(write(df)) or found[-1])
    return found


def test_rows_travel_in_pieces(spark, monkeypatch):
    """Rows of many equal values are ranked without a written row for each, whatever the limits."""
    df = spark.range(40_000).selectExpr("id", "concat('k', id % 2) index_id", "CAST(if(id % 3 = 0, 7, id % 1000) AS DOUBLE) value").repartition(5)
    for limits in (ranking.LIMITS, ranking.Limits(held=2, broadcast_rows=0)):
        found = tables_written(monkeypatch, ranking)
        got = {r.id: r["rank"] for r in transforms.rank_long(df, limits=limits).collect()}
        assert max(t.count() for t in found) < 4_000
        table = df.toPandas()
        expected = table.groupby("index_id").value.rank()
        assert got == dict(zip(table.id, expected))


def test_a_value_that_fills_groups_is_dealt(spark):
    df = spark.range(9_000).selectExpr("id", "'k' key", "CAST(if(id % 3 = 0, 7, id) AS DOUBLE) value")
    cuts = ranking.find_cuts(df, ["key"], "value", 1.0, ranking.Limits(held=2))
    values, spread = cuts["k",]
    assert spread[values == 7.0][0] > 10 and (spread[values != 7.0] == 0).all() and 40 < len(values) < 64
    assert ranking.find_cuts(df, ["key"], "value", 1.0, ranking.LIMITS) == {}


def test_matrix_ranks_travel_in_pieces(spark, monkeypatch):
    """The ranks of 24,000 values in their sets come back in a few packed cells."""
    df = spark.range(6_000).selectExpr(*[f"if(id % 5 = {k}, NULL, CAST(id * {k + 3} % 4001 AS DOUBLE)) c{k}" for k in range(5)]).repartition(4)
    found = tables_written(monkeypatch, ranking)
    matrix = {(r.row, r.col): r.value for r in correlation.spearman_matrix(df, df.columns, ranking.Limits(held=500, broadcast_rows=0)).collect()}
    assert found and max(t.count() for t in found) < 2_400
    both = df.toPandas()[["c1", "c4"]].dropna()
    assert matrix["c1", "c4"] == pytest.approx(both.c1.rank().corr(both.c4.rank()), abs=1e-12)


def test_matrix_ranks_are_few_bytes(spark, monkeypatch):
    """A rank in six sets takes less than a number of 64 bits and the place of its row."""
    rng = random.Random(5)
    rows = [tuple(None if rng.random() < 0.2 else rng.gauss(0, 1) for _ in range(6)) for _ in range(8_000)]
    df = spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(6))).coalesce(1)
    found, ranks = [], correlation.column_ranks
    monkeypatch.setattr(correlation, "column_ranks", lambda *a, **b: found.append(ranks(*a, **b)) or found[-1])
    matrix = {(r.row, r.col): r.value for r in correlation.spearman_matrix(df, df.columns).collect()}
    both = pd.DataFrame(rows, columns=df.columns)[["c1", "c4"]].dropna()
    assert matrix["c1", "c4"] == pytest.approx(both.c1.rank().corr(both.c4.rank()), abs=1e-12)
    size = found[0].agg(F.sum(F.octet_length("_rows"))).head()[0]
    assert size < 10 * sum(v is not None for row in rows for v in row)


def test_ranks_over_several_blocks(spark):
    """More rows in a partition than a block has, values of every size, ties, and a value that fills groups."""
    rng = np.random.default_rng(6)
    table = pd.DataFrame({
        "homa_ir": np.where(rng.random(150_000) < 0.3, 7.0, rng.normal(0, 1, 150_000) * 10.0 ** rng.integers(-300, 300, 150_000)),
        "lap": np.where(rng.random(150_000) < 0.1, np.nan, rng.integers(-900, 900, 150_000) / 7),
        "sex": np.where(rng.random(150_000) < 0.5, "f", "m"), "participant_id": np.arange(150_000),
    })
    df = spark.createDataFrame(table).coalesce(2)
    for limits in (ranking.LIMITS, ranking.Limits(held=1, broadcast_rows=0)):
        matrix = {(r.row, r.col): r for r in correlation.spearman_matrix(df, ["homa_ir", "lap"], limits).collect()}
        both = table[["homa_ir", "lap"]].dropna()
        assert matrix["homa_ir", "lap"].n == len(both)
        assert matrix["homa_ir", "lap"].value == pytest.approx(both.homa_ir.rank().corr(both["lap"].rank()), abs=1e-12)
    got = transforms.transform_results(df, Transform("rint", "sex"), keep_only=True).toPandas().sort_values("participant_id")
    for c in ("homa_ir", "lap"):
        place = table.groupby("sex")[c].rank()
        total = table.groupby("sex")[c].transform("count")
        np.testing.assert_allclose(got[c + "_rint_bysex"], qnorm_array(((place - 0.375) / (total + 0.25)).to_numpy()), rtol=1e-12)


def test_numbers_keep_their_value_when_squeezed():
    arrays = [np.array(x, kind) for x, kind in (([], np.uint64), ([0, 0], np.uint8), ([0, 1, 2**64 - 1], np.uint64), (range(65_536), np.uint16))]
    back = ranking.expanded(pa.scalar(ranking.squeezed(*arrays)))
    assert [b.tolist() for b in back] == [a.tolist() for a in arrays]


def test_shuffles_go_when_a_table_is_written(spark):
    def shuffles():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    before = shuffles()
    written = cut_lineage(spark.range(10_000).groupBy((F.col("id") % 997).alias("key")).count())
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert written.count() == 997 and spark.conf.get(SHUFFLE_CLEANUP) == "false"
    with ThreadPoolExecutor(4) as side_by_side:
        counts = list(side_by_side.map(lambda k: cut_lineage(spark.range(k).groupBy("id").count()).count(), (5, 6000, 70, 8)))
    assert counts == [5, 6000, 70, 8] and spark.conf.get(SHUFFLE_CLEANUP) == "false"


def test_ranks_of_no_values(spark):
    df = spark.createDataFrame([("a", "m", None, 2.0), ("b", "", None, 1.0), ("c", None, None, 3.0)], "participant_id string, sex string, homa_ir double, lap double")
    for rows, n in ((df, 3), (df.limit(0), 0)):
        matrix = {(r.row, r.col): r for r in correlation.spearman_matrix(rows, ["homa_ir", "lap"]).collect()}
        assert matrix["lap", "lap"].n == n and matrix["lap", "lap"].value == (1.0 if n else None)
        assert matrix["homa_ir", "lap"].n == matrix["homa_ir", "homa_ir"].n == 0 and matrix["homa_ir", "lap"].value is None
    got = {r.participant_id: r for r in transforms.transform_results(df, Transform("rint", "sex")).collect()}
    assert got["a"].lap_rint_bysex == 0 and got["b"].lap_rint_bysex is got["c"].lap_rint_bysex is got["a"].homa_ir_rint_bysex is None


def test_transformed_values_do_not_stay_behind_their_matrix(spark, monkeypatch):
    """The tables behind a transform go once the matrix has its own rows; others stay."""
    df = spark.range(600).selectExpr("id participant_id", "concat('s', id % 2) sex", "CAST(id * 7 % 601 AS DOUBLE) homa_ir", "CAST(id * id % 83 AS DOUBLE) lap")
    df = cut_lineage(df)
    found = tables_written(monkeypatch, transforms)
    matrix = correlation.correlation_matrix(df, ["homa_ir", "lap"], "participant_id", "spearman", Transform("rint", "sex"))
    left = [os.path.exists(f.removeprefix("file://")) for t in (df, *found) for f in t.inputFiles()[:1]]
    assert len(found) == 1 and left == [True, False]
    table = df.toPandas()
    normal = [qnorm_array(((table.groupby("sex")[c].rank() - 0.375) / 300.25).to_numpy()) for c in ("homa_ir", "lap")]
    expected = pd.Series(normal[0].round(12)).rank().corr(pd.Series(normal[1].round(12)).rank())
    assert {(r.row, r.col): r.value for r in matrix.collect()}["homa_ir", "lap"] == pytest.approx(expected, abs=1e-12)


def test_transformed_ranks_travel_in_pieces(spark, monkeypatch):
    df = spark.range(20_000).selectExpr("id participant_id", "if(id % 10 = 0, '', concat('s', id % 2)) sex", "CAST(id * 7 % 20011 AS DOUBLE) homa_ir", "if(id % 4 = 0, NULL, CAST(id % 50 AS DOUBLE)) lap").repartition(5)
    found = tables_written(monkeypatch, ranking)
    got = transforms.transform_results(df, Transform("rint", "sex")).toPandas().sort_values("participant_id")
    assert found and max(t.count() for t in found) < 2_000
    shown = got[got.sex != ""]
    assert got[got.sex == ""].lap_rint_bysex.isna().all() and shown.lap_rint_bysex.isna().equals(shown.lap.isna())
    for c in ("homa_ir", "lap"):
        place = shown.groupby("sex")[c].rank()
        total = shown.groupby("sex")[c].transform("count")
        expected = [np.nan if math.isnan(p) else NormalDist().inv_cdf(p) for p in (place - 0.375) / (total + 0.25)]
        np.testing.assert_allclose(shown[c + "_rint_bysex"], expected, atol=1e-9)


def test_normal_quantile_of_arrays(spark):
    p = np.concatenate([np.linspace(1e-6, 1 - 1e-6, 997), [0.5, 1e-15, 0.075, 0.925, 1e-300]])
    rows = spark.createDataFrame([(float(x),) for x in p], "p double").select("p", qnorm(F.col("p")).alias("z")).collect()
    np.testing.assert_allclose(qnorm_array(np.array([r.p for r in rows])), [r.z for r in rows], rtol=1e-14, atol=0)


def test_dropped_columns_are_not_moved(spark, monkeypatch):
    """With keep_only the untransformed columns stay where they are."""
    df = spark.createDataFrame([(f"p{k}", "m", float(k), float(-k)) for k in range(20)], "participant_id string, sex string, homa_ir double, lap double")
    found = tables_written(monkeypatch, transforms)
    got = transforms.transform_results(df, Transform("rint", "sex"), columns=["lap"], keep_only=True)
    assert set(found[0].columns) == {"participant_id", "sex", "lap", "_row"}
    assert got.columns == ["participant_id", "lap_rint_bysex"] and got.count() == 20


def test_missing_values_have_no_rank(spark):
    df = spark.range(12).selectExpr("id", "'v' index_id", "if(id % 5 = 0, NULL, CAST(id AS DOUBLE)) value")
    with pytest.raises(Exception, match="no rank without index_id and value"):
        transforms.rank_long(df).collect()
