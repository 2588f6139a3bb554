"""Session helpers: settings, the shared folder for cut lineage, and broadcasts with a checked size."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# HotSpot never compiles methods above 8,000 bytes of bytecode. A projection of all indices is larger than
# that as one whole-stage method; below this limit Spark splits it into small compiled ones (about 3x faster).
HOTSPOT_METHOD_LIMIT = "8000"
# Quantile sketches are kept per index and group. Above 128 groups per task Spark would sort the rows instead.
SKETCH_GROUPS = "4096"
# Spark keeps the shuffles of a finished write until the driver happens to collect its garbage, unless this is set while it runs.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scratch: list[str] = []
_noting = threading.local()
_writes: dict[str, list] = {}  # by session: the writes under way, the setting before them
_writes_lock = threading.Lock()


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the wide projections profit from; safe to call on any session."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", HOTSPOT_METHOD_LIMIT)
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", SKETCH_GROUPS)
    return spark


def local_session(cores: str = "*", app: str = "glucoframe", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in spark.checkpoint.dir.

    Only a local[...] session, where one machine is the whole cluster, may fall back to a
    temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or current
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if current is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder. What is written there is deleted when the session's JVM ends, or by
    discard_scratch."""
    holder = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(holder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    _scratch.append(holder)
    if getattr(_noting, "paths", None) is not None:
        _noting.paths.append(holder)
    return f"{holder}/data"


@contextmanager
def noted_scratch() -> Iterator[list[str]]:
    """Collects the scratch paths that this thread takes, for discard_scratch."""
    outer, noted = getattr(_noting, "paths", None), []
    _noting.paths = noted
    try:
        yield noted
    finally:
        _noting.paths = outer
        if outer is not None:
            outer += noted


def discard_scratch(spark: SparkSession, noted: list[str] | None = None) -> None:
    """Delete the noted scratch paths, or everything this process wrote to such paths. Results that still read it can't be used
    afterwards."""
    for holder in _scratch[:] if noted is None else noted:
        if holder in _scratch:
            _scratch.remove(holder)
            path = spark._jvm.org.apache.hadoop.fs.Path(holder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Sets SHUFFLE_CLEANUP; the last of several writes that run side by side puts the setting back."""
    session = spark._jsparkSession.sessionUUID()
    with _writes_lock:
        if session not in _writes:
            _writes[session] = [0, spark.conf.get(SHUFFLE_CLEANUP, None)]
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        _writes[session][0] += 1
    try:
        yield
    finally:
        with _writes_lock:
            _writes[session][0] -= 1
            if not _writes[session][0]:
                before = _writes.pop(session)[1]
                if before is None:
                    spark.conf.unset(SHUFFLE_CLEANUP)
                else:
                    spark.conf.set(SHUFFLE_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them from there.

    Partition numbers and sampled range bounds that were stored as columns stay fixed when an executor is
    lost, columns that are not read are skipped, and the size of small tables is known to the planner. The shuffles that made
    the rows are deleted when they are written.
    """
    path = scratch_path(df.sparkSession, "table")
    with _shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when the (already materialised) side is at most max_rows long.

    Beyond that the plain join is left to Catalyst and adaptive execution.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
