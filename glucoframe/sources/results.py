"""Writing results, settings documents and tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from glucoframe.operators.calculate import calculate_wide
from glucoframe.operators.parts import Run, checked_parts, manifest, manifest_frame, part_of, part_rows, transform_settings
from glucoframe.operators.transforms import Transform, index_columns, transform_report, transform_results
from glucoframe.session import cut_lineage
from glucoframe.sources.cohort_files import entries_of


def results_table(df: DataFrame, run: Run, keep: list[str] | None = None) -> DataFrame:
    """participant_id, input_problems, values, statuses: the layout of a results file. `df` is canonical."""
    return calculate_wide(
        df, ids=run.selection, keep=keep or ["participant_id", "input_problems"], settings=run.settings,
        weight=run.weight, orientation=run.orientation, status_columns=run.status_columns,
    )


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV with a header; a missing value is an empty cell. An existing target is an error unless overwrite."""
    df.write.mode("overwrite" if overwrite else "errorifexists").csv(
        path, header=True, nullValue="", emptyValue="", quote='"', escape='"'
    )


def write_parquet(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_manifest(spark: SparkSession, doc: dict, path: str, overwrite: bool = False) -> None:
    """One JSON document."""
    manifest_frame(spark, doc).coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def settings_path(path: str) -> str:
    """Where the settings of a results file go."""
    base = path.rstrip("/")
    return (base[: -len(".csv")] if base.endswith(".csv") else base) + ".settings.json"


def unit_check_entries(checked: DataFrame) -> list[dict]:
    """The rows of check_units (one per quantity) for the settings document."""
    return [row.asDict() for row in checked.orderBy("quantity").collect()]


def write_results(
    df: DataFrame, path: str, run: Run, *, version: str, timestamp: str, source: str | None = None,
    overwrite: bool = False, header: list[str] | None = None, size_bytes: int | None = None,
    unit_check: list[dict] | None = None, part: tuple[int, int, int] | None = None, keep: list[str] | None = None,
) -> dict:
    """Calculate, write the results CSV and the settings document beside it; returns the document.

    `header` and `size_bytes` describe the input file, `unit_check` is unit_check_entries of its values, and `part` is
    (i, n, rows of the whole input) where `df` is only the i-th of n parts.
    """
    if source is not None and source.rstrip("/") == path.rstrip("/"):
        raise ValueError("the output is the input")
    spark = df.sparkSession
    counted = Observation("rows written")
    seen = df.observe(counted, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("input_problems") != "").alias("bad"))
    table = results_table(seen, run, keep)
    write_csv(table, path, overwrite)
    totals = counted.get  # of the rows as they were written, without a second pass
    doc = manifest(
        run, version=version, timestamp=timestamp, rows=totals["rows"], rows_with_problems=totals["bad"], unit_check=unit_check,
        header=header, size_bytes=size_bytes, part=part, columns=table.columns,
    )
    write_manifest(spark, doc, settings_path(path), overwrite)
    return doc


def write_parts(
    numbered: DataFrame, folder: str, run: Run, parts: int, *, version: str, timestamp: str, header: list[str] | None = None,
    size_bytes: int | None = None, keep: list[str] | None = None, row: str = "row",
) -> None:
    """Calculate all parts of a numbered table (1-based `row`) in one partitioned write: folder/rows/part=i and the settings of
    each below folder/settings/part=i. Parts without rows have settings only."""
    spark = numbered.sparkSession
    counts = numbered.agg(F.max(row)).head()[0] or 0
    placed = numbered.withColumn("part", part_of(row, parts, counts).cast("int")) if counts else numbered.withColumn("part", F.lit(1))
    bad = {r.part: r.bad for r in placed.groupBy("part").agg(F.count_if(F.col("input_problems") != "").alias("bad")).collect()}  # one row a part
    table = results_table(placed, run, [*(keep or ["participant_id", "input_problems"]), "part"])
    table.write.partitionBy("part").csv(f"{folder}/rows", header=True, nullValue="", emptyValue="", quote='"', escape='"')
    docs = []
    for part in range(1, parts + 1):
        first, last = part_rows(part, parts, counts)
        doc = manifest(
            run, version=version, timestamp=timestamp, rows=last - first + 1, rows_with_problems=bad.get(part, 0), header=header,
            size_bytes=size_bytes, part=(part, parts, counts), columns=[c for c in table.columns if c != "part"],
        )
        docs.append((part, json.dumps(doc, ensure_ascii=False)))
    spark.createDataFrame(docs, "part int, value string").repartition("part").write.partitionBy("part").text(f"{folder}/settings")


def merge_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """The joined rows and settings of what write_parts wrote: one scan, whatever the number of parts."""
    def name() -> Column:
        return F.format_string("part %d", F.col("part").cast("int")).alias("name")

    texts = spark.read.text(f"{folder}/settings", wholetext=True).select(name(), "value")
    rows = read_results(spark, f"{folder}/rows")
    return rows.drop("part"), checked_parts(texts, rows.groupBy(name()).agg(F.count(F.lit(1)).alias("found")))


def merge_part_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, dict]:
    """The joined rows and settings of results files that are the parts of one input, in any order.

    All settings are read as one table and all results as another, whose rows belong to a part by the file they lie in.
    """
    names = spark.createDataFrame(list(enumerate(paths)), "_entry int, name string")

    def named(table: DataFrame, places: list[str]) -> DataFrame:
        entries = entries_of(table.select("_file").distinct(), places)
        return table.join(F.broadcast(entries.join(names, "_entry").select("_file", "name")), "_file")  # one row per file

    settings = [settings_path(path) for path in paths]
    texts = named(cut_lineage(spark.read.text(settings, wholetext=True).select(F.input_file_name().alias("_file"), "value")), settings).select("name", "value")
    rows = read_results(spark, paths)
    sizes = cut_lineage(rows.select(F.input_file_name().alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("n")))
    found = named(sizes, paths).groupBy("name").agg(F.sum("n").alias("found"))
    return rows, checked_parts(texts, found)


def write_transformed(
    spark: SparkSession, source: str, path: str, t: Transform, *, version: str, timestamp: str, key: str = "participant_id",
    keep_only: bool = False, overwrite: bool = False,
) -> dict:
    """Transform a results file into another one, with a settings document that says how and what became missing.

    A single part is refused: ranks, means and deviations need every row. Join the parts first.
    """
    settings = read_manifest(spark, settings_path(source))
    if "chunk" in settings:
        raise ValueError(f"{source} is part {settings['chunk']['index']} of {settings['chunk']['of']}; a transform needs all rows, so merge the parts first")
    results = read_results(spark, source)
    write_csv(transform_results(results, t, key=key, keep_only=keep_only), path, overwrite)
    report = [row.asDict() for row in transform_report(results, t).orderBy("index_id").collect()]
    doc = settings | {
        "engine_version": version, "timestamp": timestamp, "source_results": source, "transform": transform_settings(t),
        "transform_report": report,
    }
    write_manifest(spark, doc, settings_path(path), overwrite)
    return doc


def read_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A results CSV, or several with the same header, back as a table: index columns are doubles, everything else text."""
    text = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False, quote='"', escape='"')
    numeric = set(index_columns(text))

    def typed(name: str) -> Column:
        column = F.col("`" + name.replace("`", "``") + "`")
        return column.try_cast("double").alias(name) if name in numeric else column

    return text.select(*[typed(c) for c in text.columns])

