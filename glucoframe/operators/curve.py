"""Summaries of sampled curves: trapezoid area over every supplied time point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series_map(df: DataFrame, prefix: str, minutes: tuple[int, ...]) -> Column:
    """minute -> value map of the flat columns (e.g. g0, g30, ...); missing samples are left out."""
    pairs = F.array(*[
        F.struct(F.lit(t).alias("key"), F.col(f"{prefix}{t}").cast("double").alias("value"))
        for t in minutes if f"{prefix}{t}" in df.columns
    ])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def curve_summary(series: Column, label: str) -> Column:
    """Struct (time_points, auc, time_weighted_mean, reason) of a minute -> value map.

    Non-finite values are not used; below two points there is no area.
    """
    finite = F.filter(
        F.map_entries(series), lambda e: e["value"].isNotNull() & (F.abs(e["value"]) < float("inf"))
    )
    points = F.array_sort(F.transform(finite, lambda e: F.struct(e["key"].alias("t"), e["value"].alias("v"))))
    enough = F.size(points) >= 2
    steps = F.zip_with(
        F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))),
        F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))),
        lambda b, a: (b["v"] + a["v"]) / 2 * (b["t"] - a["t"]),
    )
    area = F.when(enough, F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x))
    span = F.when(enough, F.element_at(points, -1)["t"] - F.element_at(points, 1)["t"])
    return F.struct(
        F.transform(points, lambda p: p["t"]).alias("time_points"),
        area.alias("auc"),
        F.try_divide(area, span.cast("double")).alias("time_weighted_mean"),
        F.when(~enough, F.lit(f"requires at least two {label} time points")).alias("reason"),
    )


def curve_summary_long(samples: DataFrame, id_column: str, minute: str = "minute", value: str = "value") -> DataFrame:
    """The same from one row per sample: id, points, auc, time_weighted_mean.

    Repeated samples of a minute are averaged first (with map-side combine), so what is ordered per
    participant is one row per minute, however many samples there are.
    """
    order = Window.partitionBy(id_column).orderBy(minute)
    used = (
        samples.where(F.col(value).isNotNull() & (F.abs(value) < float("inf")))
        .groupBy(id_column, minute).agg(F.avg(value).alias(value))
    )
    step = (F.col(value) + F.lag(value).over(order)) / 2 * (F.col(minute) - F.lag(minute).over(order))
    areas = used.withColumn("step", step).groupBy(id_column).agg(
        F.count(F.lit(1)).alias("points"), F.sum("step").alias("auc"), (F.max(minute) - F.min(minute)).alias("span")
    )
    return areas.select(
        id_column, "points", "auc", F.try_divide(F.col("auc"), F.col("span").cast("double")).alias("time_weighted_mean")
    )
