"""Small helpers the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from glucoframe.session import broadcast_if_small, cut_lineage

# A word is a run of anything but ASCII white space. Over UTF-8, bytes.split() cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
# Rows up to which a computed table is broadcast; a plain join takes over beyond it.
BROADCAST_ROWS = 200_000
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def utf8(values: pa.Array, step: int = 256) -> Iterator[bytes]:
    """The strings of an Arrow array as UTF-8, null as empty; few at a time, so that long texts do not pile up."""
    raw = values.cast(pa.binary())
    for at in range(0, len(raw), step):
        for value in raw.slice(at, step).to_pylist():
            yield value or b""


def strings(values: pa.Array, step: int = 256) -> Iterator[str]:
    """The strings of an Arrow array, null as empty; few at a time."""
    for at in range(0, len(values), step):
        for value in values.slice(at, step).to_pylist():
            yield value or ""


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let the session hand at most so many rows at once to Python, where rows are whole texts or their ids.

    Both sides hold a batch, and the buffers outside the heap grow by doubling. The setting stays; it changes no result.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def few_rows(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most `step` rows, for results that are as large as the texts they come from."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """The whole row as one struct beside named keys, so that input columns can have any names."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in keys.items()])


def running_sum(df: DataFrame, order: list, value: str, name: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds `name`: the sum of `value` (a long or double, not null) over the rows before each row in a total order, without one
    task for all.

    Rows are range-partitioned and summed inside their partition; a running sum over one row per partition gives the rest.
    """
    kind = df.schema[value].dataType
    number = np.float64 if isinstance(kind, DoubleType) else np.int64
    added = StructType([*df.schema.fields, StructField("_in", IntegerType()), StructField("_upto", kind)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carried = TaskContext.get().partitionId(), number(0)
        for batch in batches:
            upto = np.cumsum(batch.column(value).to_numpy(), dtype=number) + carried
            carried = upto[-1] if len(upto) else carried
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(upto), part, np.int32)), pa.array(upto)], names=added.names)

    held = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(sums, added))
    parts = held.groupBy(F.col("_in").alias("_of")).agg(F.max("_upto").alias("_sum"))
    above = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    ahead = cut_lineage(parts.select("_of", F.coalesce(F.sum("_sum").over(above), F.lit(0)).cast(kind).alias("_ahead")))
    joined = held.join(broadcast_if_small(ahead, broadcast_rows), F.col("_in") == F.col("_of"))
    return joined.select(*df.columns, (F.col("_ahead") + F.col("_upto") - F.col(value)).alias(name))
