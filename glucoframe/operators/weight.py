"""The cohort-derived Avignon weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoframe.operators.calculate import DEFAULTS, calculate_wide
from glucoframe.settings import (
    PUBLISHED_AVIGNON_WEIGHT,
    SAMPLE_WEIGHT_WARNING,
    TOO_FEW_PAIRS_WARNING,
    AvignonWeight,
    ConversionSettings,
)

COMPONENTS = ["avignon_si0", "avignon_si120"]


def weight_sums(df: DataFrame, settings: ConversionSettings = DEFAULTS) -> DataFrame:
    """One row (s0, s120, pairs) over the rows where both Si0 and Si120 could be calculated.

    Sums merge, so parts of a cohort can be added up before weight_from_sums.
    """
    both = calculate_wide(df, ids=COMPONENTS, keep=[], settings=settings).where(
        "avignon_si0 IS NOT NULL AND avignon_si120 IS NOT NULL"
    )
    return both.agg(
        F.sum("avignon_si0").alias("s0"), F.sum("avignon_si120").alias("s120"), F.count(F.lit(1)).alias("pairs")
    )


def weight_from_sums(sums: DataFrame) -> DataFrame:
    """Sums -> one row (weight, source, pairs): mean(Si120) / mean(Si0), or the published weight below 2 pairs."""
    enough = F.col("pairs") >= 2
    return sums.select(
        F.when(enough, F.try_divide(F.col("s120"), F.col("s0")))
        .otherwise(F.lit(PUBLISHED_AVIGNON_WEIGHT)).alias("weight"),
        F.when(enough, "sample").otherwise("avignon_1999").alias("source"),
        F.col("pairs"),
    )


def cohort_weight(df: DataFrame, settings: ConversionSettings = DEFAULTS) -> AvignonWeight:
    """The weight of this cohort (canonical units), ready to pass to calculate_wide / calculate_long.

    The one-row result is read to the driver and enters the projection as a literal, so the second pass
    needs no join.
    """
    row = weight_from_sums(weight_sums(df, settings)).head()
    warning = SAMPLE_WEIGHT_WARNING if row.source == "sample" else TOO_FEW_PAIRS_WARNING
    return AvignonWeight(row.weight, row.source, row.pairs, (warning,))
