"""Summary statistics per index and per sex."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucoframe.operators.ranking import exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]


def adjusted_skewness(value: str = "value") -> Column:
    """Adjusted Fisher-Pearson G1 from n = 3; NULL for constant values."""
    n = F.count(value)
    factor = F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return F.when((n >= 3) & (F.min(value) < F.max(value)), F.skewness(value) * factor)


def describe(
    long: DataFrame, rows: int | None = None, by: list[str] | None = None, ids: list[str] | None = None
) -> DataFrame:
    """Per index: n, missing, mean, sd, median, q1, q3, min, max, skewness; undefined statistics are NULL.

    `long` has index_id and value, without missing values; `rows` is the number of participants. With `ids`
    every listed index gets a row, also one without any value (n = 0).
    """
    keys = by or ["index_id"]
    moments = [
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        adjusted_skewness().alias("skewness"),
        F.count_if(F.col("value") <= 0).alias("non_positive"),
    ]
    stats = exact_quantiles(long, keys, QUARTILES, also=moments)
    if ids is not None:
        listed = long.sparkSession.createDataFrame([(i,) for i in ids], "index_id string")
        stats = listed.join(stats, "index_id", "left").na.fill(0, ["n", "non_positive"])
    missing = F.lit(None).cast("bigint") if rows is None else F.lit(rows) - F.col("n")
    return stats.select(
        *keys, "n", missing.alias("missing"), "mean", "sd", F.col("q1").alias("median"), F.col("q0").alias("q1"),
        F.col("q2").alias("q3"), "min", "max", "skewness", "non_positive",
    )


def medians(long: DataFrame, keys: list[str]) -> DataFrame:
    return exact_quantiles(long, keys, [0.5]).select(*keys, "n", F.col("q0").alias("median"))


def sex_medians(long: DataFrame, sex: str = "sex") -> DataFrame:
    """n and median per index in men and women."""
    return medians(long.where(F.col(sex).isin("male", "female")), ["index_id", sex])


def sex_split(long: DataFrame, sex: str = "sex") -> DataFrame:
    """Values per index by sex, and values on rows without a recognised sex."""
    return long.groupBy("index_id").agg(
        F.count_if(F.col(sex) == "male").alias("male"),
        F.count_if(F.col(sex) == "female").alias("female"),
        F.count_if(F.coalesce(~F.col(sex).isin("male", "female"), F.lit(True))).alias("no_sex"),
    )


def non_positive(long: DataFrame) -> DataFrame:
    """Values <= 0 per index: what a log transform would set to missing."""
    return long.groupBy("index_id").agg(F.count_if(F.col("value") <= 0).alias("non_positive"))


def summary_table(long: DataFrame, counts: DataFrame, top: DataFrame, catalog: DataFrame, sex: str = "sex") -> DataFrame:
    """Per index in group order: n ok, n missing, why, median, quartiles, skewness, medians by sex.

    `counts` is status_counts, `top` is top_reasons, `catalog` the method list; each has one row per index
    (top: a few), so these joins are small whatever the cohort.
    """
    stats = describe(long).select("index_id", "median", "q1", "q3", "skewness")
    by_sex = sex_medians(long, sex).groupBy("index_id").agg(
        F.max(F.when(F.col(sex) == "male", F.col("median"))).alias("median_male"),
        F.max(F.when(F.col(sex) == "female", F.col("median"))).alias("median_female"),
    )
    text = F.concat(
        F.when(F.col("status") == "error", "error: ").otherwise(""), F.col("reason"), F.lit(" ("),
        F.col("rows").cast("string"), F.lit(")"),
    )
    rank = F.when(F.col("status") == "error", 1).otherwise(0)
    why = top.groupBy("method_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("place"), text.alias("text")))),
            lambda x: x["text"],
        ).alias("why")
    )
    return (
        catalog.where("included").select("position", "method_id", "name", "category")
        .join(counts, "method_id")
        .join(why, "method_id", "left")
        .join(stats.withColumnRenamed("index_id", "method_id"), "method_id", "left")
        .join(by_sex.withColumnRenamed("index_id", "method_id"), "method_id", "left")
        .select(
            "position", "method_id", "name", "category", F.col("ok").alias("n_ok"),
            (F.col("unavailable") + F.col("error")).alias("n_missing"), "why", "median", "q1", "q3", "skewness",
            "median_male", "median_female",
        )
    )
