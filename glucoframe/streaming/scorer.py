"""Streaming forms: rows are scored as they arrive, and what every batch adds to counts and sums goes into a ledger.

Scoring is stateless and uses a fixed Avignon weight; a cohort weight needs the whole cohort, so the stream
only keeps its sums (weight_sums) for a later batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from glucoframe.operators.calculate import calculate_wide
from glucoframe.operators.tally import reason_counts, status_counts, status_long
from glucoframe.settings import AvignonWeight, ConversionSettings
from glucoframe.session import scratch_path
from glucoframe.sources.cohort_files import DELIMITERS, parse_table
from glucoframe.sources.columns import SourceColumn


def stream_cohort(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Canonical rows from parquet files as they appear in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_score(
    stream: DataFrame, *, keep: list[str], ids: list[str] | None = None, weight: AvignonWeight = AvignonWeight(),
    settings: ConversionSettings = ConversionSettings(), orientation: str = "published", status_columns: bool = True,
) -> DataFrame:
    """The projection of calculate_wide on a stream."""
    if weight.source == "sample":
        raise ValueError("a cohort weight needs the whole cohort; pass a fixed weight to a stream")
    return calculate_wide(
        stream, ids=ids, keep=keep, weight=weight, settings=settings, orientation=orientation,
        status_columns=status_columns,
    )


def write_scores(scored: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append scored rows to parquet; everything available is processed, then the query ends."""
    spark = scored.sparkSession
    return (
        scored.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start(path)
    )


# ---------- a ledger of what every batch adds ----------

def write_ledger(rows: DataFrame, delta: Callable[[DataFrame], DataFrame], path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Per batch of a stream of rows, write what it adds (`delta`: a small table of sums) below path/deltas/batch=<n>.

    Nothing that was written is read or rewritten. A batch that is repeated after a failure overwrites its own entry, and
    one that was compacted already is left out, so every batch counts once.
    """
    spark = rows.sparkSession
    return (
        rows.writeStream.option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, number: add_to_ledger(delta(batch), number, path))
        .start()
    )


def add_to_ledger(entry: DataFrame, batch: int, path: str) -> None:
    upto = _compacted(entry.sparkSession, path)
    if upto is None or batch > upto:
        entry.write.mode("overwrite").parquet(f"{path}/deltas/batch={batch}")


def _numbers(spark: SparkSession, folder: str, label: str) -> list[int]:
    """The numbers n of the finished entries folder/<label>=n."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{label}=*/_SUCCESS"))
    return sorted(int(status.getPath().getParent().getName().split("=")[1]) for status in found or [])


def _compacted(spark: SparkSession, path: str) -> int | None:
    """The last batch that is part of the newest base; None if there is no base."""
    return max(_numbers(spark, f"{path}/base", "upto"), default=None)


def read_ledger(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The ledger's entries added up: all columns but the keys are sums."""
    upto = _compacted(spark, path)
    late = [n for n in _numbers(spark, f"{path}/deltas", "batch") if upto is None or n > upto]
    places = ([] if upto is None else [f"{path}/base/upto={upto}"]) + [f"{path}/deltas/batch={n}" for n in late]
    if not places:
        raise ValueError(f"{path}: nothing was written yet")
    entries = spark.read.parquet(*places)
    return entries.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in entries.columns if c not in keys])


def compact_ledger(spark: SparkSession, path: str, keys: list[str], keep: int = 2) -> int | None:
    """Add all but the newest `keep` entries to a new base, so that reading stays cheap; returns the last batch in it.

    A base is complete before it is used, and the entries in it are deleted afterwards only. Readers that listed them
    before must list again.
    """
    upto = _compacted(spark, path)
    late = [n for n in _numbers(spark, f"{path}/deltas", "batch") if upto is None or n > upto]
    old = late[: max(0, len(late) - keep)]
    if not old:
        return upto
    places = ([] if upto is None else [f"{path}/base/upto={upto}"]) + [f"{path}/deltas/batch={n}" for n in old]
    entries = spark.read.parquet(*places)
    summed = entries.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in entries.columns if c not in keys])
    summed.coalesce(1).write.mode("overwrite").parquet(f"{path}/base/upto={old[-1]}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for place in places:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(place), True)
    return old[-1]


def count_delta(ids: list[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """ok / unavailable / error counts per index of a batch of canonical rows."""
    return lambda batch: status_counts(status_long(stream_score(batch, keep=[], ids=ids), ids))


def reason_delta(ids: list[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Counted reasons of a batch; they add up over batches and parts alike."""
    return lambda batch: reason_counts(batch, ids=ids)


COUNT_KEYS, REASON_KEYS, SUM_KEYS = ["method_id"], ["method_id", "status", "reason"], []


# ---------- text cells as they arrive ----------

def stream_cells(spark: SparkSession, folder: str, header: list[str], delimiter: str = "comma", files_per_batch: int | None = None) -> tuple[DataFrame, list[SourceColumn]]:
    """Parsed rows (participant_id, input_problems and the recognised columns in file units) from delimited files as they
    appear in a folder, and what the columns of `header` mean. Ids are not generated: an empty one is a problem.

    Rows of a stream have no number; otherwise cells are parsed as in a file, and a cell with a problem is missing.
    """
    reader = spark.readStream.schema(StructType([StructField(name, StringType()) for name in header]))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    text = reader.csv(folder, sep=DELIMITERS[delimiter], header=True, enforceSchema=False, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    cohort = parse_table(text)
    return cohort.rows.drop("row"), cohort.columns


def write_cells(scored: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Write scored rows with their problems below path/rows/batch=<n>, and add their number and that of the rows with problems
    to the ledger path/totals. Both come from the one pass that writes the rows; a repeated batch overwrites itself."""
    spark = scored.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        counted = Observation()
        seen = batch.observe(counted, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("input_problems") != "").alias("rows_with_problems"))
        seen.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        totals = counted.get
        entry = batch.sparkSession.createDataFrame([(totals["rows"], totals["rows_with_problems"])], "rows bigint, rows_with_problems bigint")
        add_to_ledger(entry, number, f"{path}/totals")

    return (
        scored.writeStream.option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def scored_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What write_cells wrote: all rows, and one row (rows, rows_with_problems)."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").drop("batch")
    return rows, read_ledger(spark, f"{path}/totals", SUM_KEYS)
