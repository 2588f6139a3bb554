"""What a cohort file contains, before anything is calculated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoframe.operators.catalog import INDEX_IDS, describe_selection
from glucoframe.operators.unit_check import check_units
from glucoframe.operators.weight import weight_from_sums, weight_sums
from glucoframe.session import cut_lineage
from glucoframe.settings import ConversionSettings, UnitChoice
from glucoframe.sources.cohort_files import Cohort, canonical, problem_rows


# How many problems and duplicate ids a file check names.
SHOWN_PROBLEMS, SHOWN_DUPLICATES = 20, 5


def check_cohort(
    cohort: Cohort, units: UnitChoice = UnitChoice(), settings: ConversionSettings = ConversionSettings(), selection: list[str] | None = None,
) -> DataFrame:
    """(item, detail, number): rows, duplicate ids with the first of them, rows with problems with the first of them, column
    listing, unit check, cohort weight, and with a `selection` of indices what a calculation would write.

    Examples are in row order (of ids that repeat, of their first row); their number is that row.
    """
    rows = cohort.rows
    spark = rows.sparkSession
    totals = rows.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.count_if(F.col("input_problems") != "").cast("double").alias("rows_with_problems"),
    )
    counted = totals.unpivot([], ["rows", "rows_with_problems"], "item", "number").select(
        "item", F.lit("").alias("detail"), "number"
    )
    repeated = cut_lineage(rows.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row")).where("n > 1"))
    duplicates = repeated.agg(F.count(F.lit(1)).cast("double").alias("number")).select(
        F.lit("duplicate_ids").alias("item"), F.lit("").alias("detail"), "number"
    )
    first = repeated.orderBy("row", "participant_id").limit(SHOWN_DUPLICATES).select(
        F.lit("duplicate_id").alias("item"), F.col("participant_id").alias("detail"), F.col("row").cast("double").alias("number")
    )
    said = F.format_string("row %d (%s): %s", "row", "participant_id", "input_problems")
    problems = problem_rows(rows, SHOWN_PROBLEMS).select(F.lit("problem_row").alias("item"), said.alias("detail"), F.col("row").cast("double").alias("number"))
    duplicates = duplicates.unionByName(first).unionByName(problems)
    listing = spark.createDataFrame(
        [("recognised_column" if c.kind != "ignored" else "ignored_column", c.name, None) for c in cohort.columns]
        + [("column_conflict", text, None) for text in cohort.conflicts]
        + ([] if selection is None else [("selection", _said(selection), float(len(selection)))]),
        "item string, detail string, number double",
    )
    checked = check_units(rows, units).select(
        F.when(F.col("suggested").isNull(), "unit_ok").otherwise("unit_warning").alias("item"),
        F.concat_ws(" ", "column", F.coalesce("suggested", "selected")).alias("detail"),
        F.col("median").alias("number"),
    )
    sums = weight_sums(canonical(rows, cohort.columns, units, settings), settings)
    weight = weight_from_sums(sums).select(
        F.lit("avignon_weight").alias("item"), F.col("source").alias("detail"), F.col("weight").alias("number")
    )
    return counted.unionByName(duplicates).unionByName(listing).unionByName(checked).unionByName(weight)


def _said(selection: list[str]) -> str:
    """A selection in words."""
    if set(selection) == set(INDEX_IDS):
        return f"{len(selection)} of {len(INDEX_IDS)} (all)"
    parts = describe_selection(selection)
    return f"{len(selection)} of {len(INDEX_IDS)} (groups: {', '.join(parts['groups']) or 'none'}; other indices: {', '.join(parts['ids']) or 'none'})"
