"""Every registered query by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoframe.operators.calculate import calculate_wide, to_long
from glucoframe.operators.catalog import INDEX_IDS
from glucoframe.plans import batch_queries, index_queries, ingest_queries, output_queries, spoilt_queries, statistics_queries
from glucoframe.plans.index_sql import long_values_cte
from glucoframe.plans.cohort_sql import with_prepared
from glucoframe.plans.source import Query, Source, rounded, rounded_sql


def flagship(src: Source) -> DataFrame:
    """All indices of all visits, then count and mean per index and sex."""
    wide = calculate_wide(src.cohort(), keep=["sex"])
    means = to_long(wide, INDEX_IDS, ["sex"]).groupBy("index_id", "sex").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")
    )
    return means.select("index_id", "sex", "n", rounded("mean", 4).alias("mean"))


FLAGSHIP_SQL = with_prepared(
    f"SELECT index_id, sex, count(*) AS n, {rounded_sql('avg(value)', 4)} AS mean FROM vals GROUP BY index_id, sex",
    long_values_cte(INDEX_IDS),
)

QUERIES: dict[str, Query] = {
    "E01_index_means_by_sex": Query(flagship, FLAGSHIP_SQL),
    **index_queries.QUERIES,
    **ingest_queries.QUERIES,
    **batch_queries.QUERIES,
    **statistics_queries.QUERIES,
    **output_queries.QUERIES,
    **spoilt_queries.QUERIES,
}
