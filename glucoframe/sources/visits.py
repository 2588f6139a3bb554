"""A visit-level cohort derived from order tables (customer, orders, lineitem).

One visit is a customer in a calendar year; the line number is the sampling slot (1..5 = 0, 30, 60, 90,
120 minutes, 6 = fasting FFA). Slot sums are integers, so the result does not depend on the order of
addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOT_MINUTES = {1: 0, 2: 30, 3: 60, 4: 90, 5: 120}
GLUCAGON_SLOTS = {1: 0, 2: 30, 3: 60, 5: 120}
FFA_SLOT = 6

SERIES_COLUMNS = (
    [f"g{t}" for t in SLOT_MINUTES.values()]
    + [f"i{t}" for t in SLOT_MINUTES.values()]
    + [f"gl{t}" for t in GLUCAGON_SLOTS.values()]
    + ["ffa0"]
)
SCALAR_COLUMNS = [
    "sex", "age", "weight", "bmi", "waist", "tg", "hdl", "fat_mass", "rate_glycerol", "rate_palmitate",
]
COHORT_COLUMNS = ["visit_id", *SERIES_COLUMNS, *SCALAR_COLUMNS]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def slot_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Per visit: count and integer sums of every slot.

    Lines are first summed per order (with map-side combine), so the join to orders is one row to one row
    and no order or customer, however large, reaches a single task row by row.
    """
    lines = table(spark, folder, "lineitem")
    measures = {
        "k": F.lit(1),
        "q": F.round("l_quantity").cast("bigint"),
        "e": _cents("l_extendedprice"),
        "d": _cents("l_discount"),
        "t": _cents("l_tax"),
    }
    wanted = {
        n: ["k", "q", "e"] + (["d"] if n in GLUCAGON_SLOTS else []) for n in SLOT_MINUTES
    } | {FFA_SLOT: ["k", "t"]}
    names = [(n, m) for n, ms in wanted.items() for m in ms]
    per_order = (
        lines.groupBy("l_orderkey")
        .agg(*[F.sum(F.when(F.col("l_linenumber") == n, measures[m])).alias(f"{m}{n}") for n, m in names])
    )
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").cast("bigint").alias("year")
    )
    return (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "year")
        .agg(*[F.sum(f"{m}{n}").alias(f"{m}{n}") for n, m in names])
    )


def cohort(spark: SparkSession, folder: str) -> DataFrame:
    """Wide canonical cohort: visit_id, sampling slots, person measures."""
    c, y = F.col("o_custkey"), F.col("year")
    sums = slot_sums(spark, folder)
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    cols = [(c * 10000 + y).alias("visit_id")]
    for n, minute in SLOT_MINUTES.items():
        glucose = F.lit(3.2) + F.col(f"q{n}") / F.col(f"k{n}") / 5
        if n == 1:
            glucose = F.when((c % 97 == 0) & F.col("k1").isNotNull(), F.lit(0.0)).otherwise(glucose)
        cols.append(glucose.alias(f"g{minute}"))
    for n, minute in SLOT_MINUTES.items():
        cols.append((F.lit(10.0) + F.col(f"e{n}") / F.col(f"k{n}") / 20000).alias(f"i{minute}"))
    for n, minute in GLUCAGON_SLOTS.items():
        cols.append((F.lit(3.0) + F.col(f"d{n}") / F.col(f"k{n}")).alias(f"gl{minute}"))
    cols.append((F.lit(0.2) + F.col(f"t{FFA_SLOT}") / F.col(f"k{FFA_SLOT}") / 10).alias("ffa0"))
    cols += [
        F.when(c % 20 == 0, F.lit(None).cast("string")).when(c % 2 == 1, "male").otherwise("female").alias("sex"),
        ((c + y) % 50 + 20).cast("double").alias("age"),
        (F.lit(50.0) + (F.col("c_acctbal") + 1000) / 200).alias("weight"),
        ((c * 7) % 20 + 18).cast("double").alias("bmi"),
        ((c * 13) % 55 + 60).cast("double").alias("waist"),
        (F.lit(0.5) + ((c * 31 + y) % 300) / F.lit(100.0)).alias("tg"),
        F.when(c % 11 == 0, F.lit(None).cast("double"))
        .otherwise(F.lit(0.8) + ((c * 17) % 130) / F.lit(100.0)).alias("hdl"),
        ((c * 5) % 25 + 12).cast("double").alias("fat_mass"),
        (F.lit(1.0) + (c % 40) / F.lit(10.0)).alias("rate_glycerol"),
        (F.lit(1.0) + (c % 30) / F.lit(10.0)).alias("rate_palmitate"),
    ]
    return sums.join(customers, c == F.col("c_custkey")).select(*cols)
