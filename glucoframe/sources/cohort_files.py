"""Reading cohort files: text cells -> canonical cohort, with every problem reported per row."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glucoframe.functions import cells
from glucoframe.functions.units import to_canonical
from glucoframe.operators.ranking import add_row_numbers
from glucoframe.session import broadcast_if_small, cut_lineage
from glucoframe.settings import ConversionSettings, UnitChoice
from glucoframe.sources.columns import SourceColumn, classify_all, conflicts

DELIMITERS = {"comma": ",", "semicolon": ";", "tab": "\t"}
PROBLEM_SEPARATOR = " | "
MAX_BLOCKS_BROADCAST = 500_000


class CohortError(ValueError):
    """The file cannot be used as a cohort (column conflicts, missing header, ...)."""


def detect_delimiter(header: str) -> str:
    """Most frequent of comma, semicolon, tab outside quotes; ties go to the earlier one."""
    outside = "".join(header.split('"')[::2])
    counts = {name: outside.count(mark) for name, mark in DELIMITERS.items()}
    return max(counts, key=lambda name: counts[name])


def _plain_uri(uri: str) -> str:
    """A file's address with one slash behind the scheme, so that file:/x and file:///x are the same."""
    return re.sub(r"^([^:/]+):/+", r"\1:/", uri)


def _readable(spark: SparkSession, uri: str) -> str:
    """The path that the readers take for a file's address: decoded, with the characters of patterns escaped."""
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri)).toString()
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _addresses(spark: SparkSession, path: str) -> list[str]:
    """The addresses of the files or folders that a path, perhaps a pattern, stands for."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return [] if found is None else [_plain_uri(status.getPath().toUri().toString()) for status in found]


def read_text_table(
    spark: SparkSession, path: str | list[str], delimiter: str = "auto", multi_line: bool | None = None
) -> DataFrame:
    """Delimited text with a header row, every cell a string, blank rows dropped.

    Line breaks inside quotes need a file to be read by one task (multi_line=True). By default the lines are looked
    through first, split over all tasks: only a file where one has an odd number of quotes can have a cell that goes on in the
    next line, and only such files are read whole.
    """
    if delimiter not in ("auto", *DELIMITERS):
        raise ValueError(f"delimiter {delimiter!r} is not valid (use auto, {', '.join(DELIMITERS)})")
    if delimiter == "auto":
        first = spark.read.text(path).select("value").head()
        delimiter = detect_delimiter(first[0] if first else "")

    def read(paths: str | list[str], whole: bool) -> DataFrame:
        return spark.read.csv(
            paths, sep=DELIMITERS[delimiter], header=True, quote='"', escape='"', multiLine=whole,
            inferSchema=False, enforceSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )

    if multi_line is not None:
        return read(path, multi_line)
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    odd = {_plain_uri(r[0]) for r in lines.where(quotes % 2 == 1).select(F.input_file_name()).distinct().collect()}
    if not odd:
        return read(path, False)
    files = lines.inputFiles()
    clean = [_readable(spark, uri) for uri in files if _plain_uri(uri) not in odd]
    if not clean:
        return read(path, True)
    split, whole = read(clean, False), read([_readable(spark, uri) for uri in files if _plain_uri(uri) in odd], True)
    if split.columns != whole.columns:
        raise CohortError(f"the files have different headers: {', '.join(split.columns)} and {', '.join(whole.columns)}")
    return split.union(whole)


def number_file_rows(df: DataFrame, paths: list[str] | None = None, name: str = "row") -> DataFrame:
    """1-based row numbers in file order: place in `paths` if several are given, then file name, then position.

    A file belongs to the first entry that is the file itself or a folder around it; whole addresses are compared.
    The rows are read once and kept in the shared folder with their place in the scan, so the counts and the rows come
    from the same reading. One count per file split goes into a running sum; the rows are not shuffled.
    """
    marked = cut_lineage(df.select(
        "*",
        F.input_file_name().alias("_file"),
        F.input_file_block_start().alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    ))
    blocks = marked.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    blocks = blocks.join(entries_of(blocks.select("_file").distinct(), paths or []), "_file", "left")
    running = Window.orderBy("_entry", "_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_ahead", F.coalesce(F.sum("_rows").over(running), F.lit(0))).drop("_rows", "_entry")
    # one row per file split (metadata of the scan)
    return (
        marked.join(broadcast_if_small(cut_lineage(offsets), MAX_BLOCKS_BROADCAST), ["_file", "_start"])
        .withColumn(name, F.col("_ahead") + F.col("_at") - F.col("_first") + 1)
        .drop("_file", "_start", "_at", "_first", "_ahead")
    )


def entries_of(files: DataFrame, paths: list[str]) -> DataFrame:
    """(_file, _entry): for files (column _file, as input_file_name gives it) the first entry of `paths`, from 0, that is the file
    itself or a folder around it. Whole addresses are compared, so names that begin alike stay apart."""
    spark = files.sparkSession
    places = [(address, k) for k, path in enumerate(paths) for address in _addresses(spark, path)]
    listed = spark.createDataFrame(places, "_around string, _entry int").groupBy("_around").agg(F.min("_entry").alias("_entry"))
    steps = F.split(F.regexp_replace("_file", r"^([^:/]+):/+", "$1:/"), "/")
    around = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    return files.select("_file", F.explode(around).alias("_around")).join(listed, "_around").groupBy("_file").agg(F.min("_entry").alias("_entry"))


@dataclass(frozen=True)
class Cohort:
    """A parsed table: `rows` has row, participant_id, input_problems and the recognised columns in file units."""

    rows: DataFrame
    columns: list[SourceColumn]
    generated_ids: bool

    @property
    def conflicts(self) -> list[str]:
        return conflicts(self.columns)

    def require_usable(self) -> "Cohort":
        if self.conflicts:
            raise CohortError("; ".join(self.conflicts))
        if not any(c.kind == "variable" for c in self.columns):
            raise CohortError("no recognised data columns in the header")
        return self


def read_cohort(
    spark: SparkSession, path: str | list[str], delimiter: str = "auto", multi_line: bool | None = None
) -> Cohort:
    table = read_text_table(spark, path, delimiter, multi_line)
    if not table.columns:
        raise CohortError(f"{path}: the file is empty (no header row)")
    return parse_table(number_file_rows(table, path if isinstance(path, list) else None), row="row")


def parse_table(table: DataFrame, row: str | None = None, order_by: list[str] | None = None) -> Cohort:
    """Parse a table of text cells.

    `row` names an existing column with 1-based row numbers; otherwise rows are numbered by `order_by`,
    which is needed only when participant ids have to be generated. Without either nothing is numbered or sorted.
    """
    columns = classify_all([c for c in table.columns if c != row])
    if conflicts(columns):
        raise CohortError("; ".join(conflicts(columns)))
    id_column = next((c for c in columns if c.kind == "id"), None)
    if row is None and order_by:
        table, row = add_row_numbers(table, order_by, "row"), "row"
    if id_column is None and row is None:
        raise CohortError("ids must be generated: give a row number column or an order")
    return Cohort(_parsed(table, columns, id_column, row), columns, id_column is None)


def _parsed(table: DataFrame, columns: list[SourceColumn], id_column: SourceColumn | None, row: str | None) -> DataFrame:
    number = F.col(_q(row)) if row else F.lit(None).cast("bigint")
    generated = F.concat(F.lit("row_"), number.cast("string"))
    # decimal commas are noticed while cells are taken over, other problems while they are parsed
    commas: list[Column] = []
    others: list[Column] = []
    values: list[Column] = []
    if id_column is None:
        participant = generated
        empty_id = F.lit(None).cast("string")
    else:
        text = F.col(_q(id_column.name))
        is_blank = F.coalesce(text, F.lit("")) == ""
        participant = F.when(is_blank, generated).otherwise(text) if row else text
        named = F.concat(F.lit("participant ID is empty; generated "), generated) if row else F.lit("participant ID is empty")
        empty_id = F.when(is_blank, named)
    for c in columns:
        if c.kind != "variable":
            continue
        cell = F.col(_q(c.name))
        if c.column == "sex":
            values.append(cells.sex(cell).alias("sex"))
            others.append(cells.sex_problem(cell))
            continue
        values.append(cells.number(cell).alias(c.column))
        problem = cells.number_problem(cell, c.name, c.canonical or c.name)
        is_comma = cells.trimmed(cell).rlike(cells.DECIMAL_COMMA_SHAPE)
        commas.append(F.when(is_comma, problem))
        others.append(F.when(~F.coalesce(is_comma, F.lit(False)), problem))
    problems = F.concat_ws(PROBLEM_SEPARATOR, F.array_compact(F.array(empty_id, *commas, *others)))
    return table.select(
        number.alias("row"), participant.alias("participant_id"), problems.alias("input_problems"), *values
    )


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def canonical(df: DataFrame, columns: list[SourceColumn], units: UnitChoice, settings: ConversionSettings) -> DataFrame:
    """File units -> canonical units; every other column stays as it is."""
    changed = {
        c.column: to_canonical(F.col(c.column), c.quantity, units.of(c.quantity), settings)
        for c in columns
        if c.kind == "variable" and c.quantity
    }
    return df.select(*[changed[n].alias(n) if n in changed else F.col(_q(n)) for n in df.columns])


def duplicate_ids(df: DataFrame, id_column: str = "participant_id") -> DataFrame:
    """Ids on more than one row, with the number of rows."""
    return df.groupBy(id_column).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def problem_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """(row, participant_id, input_problems, total): the first `limit` rows with input problems, all of them with None.

    `total` is the number of rows with problems, shown or not.
    """
    return _first_rows(df.where("input_problems <> ''").select("row", "participant_id", "input_problems"), limit, "row")


def _first_rows(found: DataFrame, limit: int | None, order_by: str) -> DataFrame:
    total = F.lit(found.count()).cast("bigint").alias("total")
    return found.select("*", total) if limit is None else found.orderBy(order_by).limit(limit).select("*", total)


def derive_bmi(df: DataFrame, height_cm: str = "height") -> DataFrame:
    """bmi from weight and height where bmi itself is missing; needs both positive."""
    metres = F.col(height_cm) / 100
    derived = F.when((F.col(height_cm) > 0) & (F.col("weight") > 0), F.col("weight") / (metres * metres))
    return df.withColumn("bmi", F.coalesce(F.col("bmi"), derived) if "bmi" in df.columns else derived)


# Analyte names of the long layout and their column prefixes.
LONG_PREFIXES = {"glucose": "g", "insulin": "i", "glucagon": "gl", "ffa": "ffa"}
# The minutes the indices read.
INDEX_MINUTES = {
    "glucose": (0, 30, 60, 90, 120), "insulin": (0, 30, 60, 90, 120), "glucagon": (0, 30, 60, 120), "ffa": (0, 60, 120),
}


def wide_from_long(
    df: DataFrame, id_column: str, analyte: str = "analyte", minute: str = "minute", value: str = "value"
) -> DataFrame:
    """(id, analyte, minute, value) -> one row per id: the columns the indices read, and per analyte a map
    `<prefix>_series` from every minute to its value, as curve_summary takes it.

    Repeated samples are averaged, with map-side combine: a participant with very many samples is reduced to one row
    per minute before the shuffle. Samples of other analytes are left out; missing values are no samples.
    """
    known = df.where(F.col(analyte).isin(*LONG_PREFIXES) & F.col(minute).isNotNull() & F.col(value).isNotNull())
    averaged = known.groupBy(id_column, analyte, minute).agg(F.avg(value).alias("_value"))
    picked = [
        F.max(F.when((F.col(analyte) == q) & (F.col(minute) == t), F.col("_value"))).alias(f"{LONG_PREFIXES[q]}{t}")
        for q, minutes in INDEX_MINUTES.items() for t in minutes
    ]
    sample = F.struct(F.col(minute).alias("key"), F.col("_value").alias("value"))
    series = [
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(analyte) == q, sample)))).alias(f"{prefix}_series")
        for q, prefix in LONG_PREFIXES.items()
    ]
    everybody = df.select(id_column).distinct()
    return everybody.join(averaged.groupBy(id_column).agg(*picked, *series), id_column, "left")


def find_participants(df: DataFrame, text: str, limit: int | None, order_by: str = "row") -> DataFrame:
    """Case-insensitive search in the ids: the first `limit` rows (None: all) in row order, and `total`, the number of hits."""
    wanted = text.strip().lower()
    hits = df if wanted == "" else df.where(F.contains(F.lower("participant_id"), F.lit(wanted)))
    return _first_rows(hits, limit, order_by)
