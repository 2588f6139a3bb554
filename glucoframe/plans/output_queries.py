"""Queries that write results and read them back, and the streaming forms. Files go to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import glucoframe
from glucoframe.functions.units import unit_choice
from glucoframe.operators import correlation
from glucoframe.operators.calculate import calculate_wide
from glucoframe.operators.catalog import INDEX_IDS, column_name
from glucoframe.operators.parts import Run
from glucoframe.operators.transforms import Transform, transform_results
from glucoframe.operators.unit_check import check_units
from glucoframe.operators.weight import weight_from_sums, weight_sums
from glucoframe.plans import batch_queries, ingest_queries, statistics_queries
from glucoframe.plans.cohort_sql import with_prepared
from glucoframe.plans.index_sql import decimals, long_status_cte, rounded_value_sql, status_sql, wide_values_cte
from glucoframe.plans.source import Query, Source, rounded, rounded_sql
from glucoframe.session import cut_lineage, scratch_path
from glucoframe.sources.results import (
    read_manifest,
    read_results,
    settings_path,
    unit_check_entries,
    write_csv,
    write_results,
)
from glucoframe.sources.cohort_files import canonical
from glucoframe.streaming.scorer import (
    COUNT_KEYS,
    REASON_KEYS,
    SUM_KEYS,
    add_to_ledger,
    compact_ledger,
    count_delta,
    read_ledger,
    reason_delta,
    scored_cells,
    stream_cells,
    stream_cohort,
    stream_score,
    write_cells,
    write_ledger,
    write_scores,
)

SOME = batch_queries.SOME


def _participants(src: Source) -> DataFrame:
    return src.cohort().select(
        "*", F.concat(F.lit("P"), F.col("visit_id").cast("string")).alias("participant_id"),
        F.when(F.col("sex").isNull(), "sex missing").otherwise("").alias("input_problems"),
    )


def results_csv(src: Source) -> DataFrame:
    path = scratch_path(src.spark, "results") + ".csv"
    run = Run("visits", orientation="sensitivity", status_columns=True)
    write_results(_participants(src), path, run, version=glucoframe.__version__, timestamp="")
    back = read_results(src.spark, path)
    named = [(i, column_name(i, "sensitivity")) for i in INDEX_IDS]
    return back.select(
        "participant_id", F.coalesce("input_problems", F.lit("")).alias("input_problems"),
        *[rounded(name, decimals(i)).alias(name) for i, name in named], *[f"{name}_status" for _, name in named],
    )


# The published indices that rise with resistance and are negated in the sensitivity orientation.
TURNED = (
    "homa_ir firi ig_ratio_basal ig_ratio_120 hiri ifc tyg tg_hdl vai lap adipo_ir liri lipo atiri"
).split()
RESULTS_SQL = with_prepared(
    "SELECT concat('P', CAST(visit_id AS VARCHAR)) AS participant_id, "
    "CASE WHEN sex IS NULL THEN 'sex missing' ELSE '' END AS input_problems, "
    + ", ".join(
        f"{rounded_value_sql(i, '-' if i in TURNED else '')} AS {i}{'_inv' if i in TURNED else ''}, "
        f"{status_sql(i)} AS {i}{'_inv' if i in TURNED else ''}_status" for i in INDEX_IDS
    )
    + " FROM prepared"
)


def settings_json(src: Source) -> DataFrame:
    path = scratch_path(src.spark, "results") + ".csv"
    run = Run("visits", selection=["homa_ir", "lap"], orientation="sensitivity")
    people = cut_lineage(_participants(src))
    checked = unit_check_entries(check_units(people, unit_choice(glucose="mg/dL")))
    write_results(
        people, path, run, version=glucoframe.__version__, timestamp="", header=["visit_id", "g0"], size_bytes=1234, unit_check=checked
    )
    doc = read_manifest(src.spark, settings_path(path))
    fits = [c["column"] for c in doc["unit_check"] if c["quantity"] == "glucose" and c["suggested"] == "mmol/L"]
    mark = doc["input_fingerprint"]
    return src.spark.createDataFrame(
        [(doc["row_counts"]["total"], doc["row_counts"]["with_problems"], doc["orientation"], m["id"], m["csv_column"],
          len(doc["unit_check"]), fits[0] if fits else None, mark["total_rows"], mark["header_sha256"])
         for m in doc["methods"]],
        "total bigint, with_problems bigint, orientation string, method_id string, csv_column string, quantities int, "
        "glucose_in_mmol string, input_rows bigint, header_sha256 string",
    )


SETTINGS_SQL = with_prepared(
    "SELECT count(*) AS total, count(CASE WHEN sex IS NULL THEN 1 END) AS with_problems, 'sensitivity' AS orientation, "
    "m.id AS method_id, m.col AS csv_column, CAST(6 AS INTEGER) AS quantities, 'G0' AS glucose_in_mmol, count(*) AS input_rows, "
    "sha256('visit_id' || chr(31) || 'g0') AS header_sha256 FROM prepared, "
    "(VALUES ('homa_ir', 'homa_ir_inv'), ('lap', 'lap_inv')) AS m(id, col) GROUP BY m.id, m.col"
)


def transformed_csv(src: Source) -> DataFrame:
    path = scratch_path(src.spark, "transformed") + ".csv"
    wide = calculate_wide(src.cohort(), keep=["visit_id"])
    write_csv(transform_results(wide, Transform("log"), key="visit_id"), path)
    schema = "visit_id bigint, " + ", ".join(f"{i} double, {i}_log double" for i in INDEX_IDS)
    back = src.spark.read.csv(path, header=True, schema=schema)
    return back.select("visit_id", *[rounded(i, decimals(i)).alias(i) for i in INDEX_IDS], *[rounded(f"{i}_log").alias(f"{i}_log") for i in INDEX_IDS])


TRANSFORMED_CSV_SQL = with_prepared(
    "SELECT visit_id, "
    + ", ".join(
        f"{rounded_sql(i, decimals(i))} AS {i}, {rounded_sql(f'CASE WHEN {i} > 0 THEN ln({i}) END')} AS {i}_log" for i in INDEX_IDS
    )
    + " FROM wide",
    wide_values_cte(INDEX_IDS),
)


def tables_csv(src: Source) -> DataFrame:
    """Correlation comparison, written and read back."""
    values = src.values(statistics_queries.SHOWN)
    raw = correlation.correlation_matrix(values, statistics_queries.SHOWN, "visit_id", "pearson")
    logged = correlation.correlation_matrix(values, statistics_queries.SHOWN, "visit_id", "pearson", Transform("log"))
    path = scratch_path(src.spark, "comparison") + ".csv"
    write_csv(correlation.compare_matrices(raw, logged), path)
    schema = "row string, col string, raw double, transformed double, difference double, n_raw bigint, n_transformed bigint"
    back = src.spark.read.csv(path, header=True, schema=schema)
    return statistics_queries.rounded_all(back)


def density_csv(src: Source) -> DataFrame:
    """The density table, written and read back."""
    table = statistics_queries._density_table(src)
    path = scratch_path(src.spark, "density") + ".csv"
    write_csv(table, path)
    return statistics_queries.rounded_all(src.spark.read.csv(path, header=True, schema=table.schema))


# ---------- streaming: the cohort arrives as files ----------

def _arriving(src: Source) -> DataFrame:
    path = scratch_path(src.spark, "arriving")
    src.cohort().write.parquet(path)
    schema = src.spark.read.parquet(path).schema
    return stream_cohort(src.spark, path, schema, files_per_batch=2)


def scored_stream(src: Source) -> DataFrame:
    path = scratch_path(src.spark, "scored")
    scored = stream_score(_arriving(src), keep=["visit_id"], status_columns=True)
    write_scores(scored, path).awaitTermination()
    back = src.spark.read.parquet(path)
    return back.select("visit_id", *[rounded(i, decimals(i)).alias(i) for i in INDEX_IDS], *[f"{i}_status" for i in INDEX_IDS])


STREAM_SQL = with_prepared(
    "SELECT visit_id, " + ", ".join(f"{rounded_value_sql(i)} AS {i}, {status_sql(i)} AS {i}_status" for i in INDEX_IDS)
    + " FROM prepared"
)


def scored_cells_stream(src: Source) -> DataFrame:
    """Text cells scored as their files arrive, with every problem; the totals are those of the ledger."""
    cells, path = scratch_path(src.spark, "cells"), scratch_path(src.spark, "scored")
    write_csv(ingest_queries.text_table(src).select(*ingest_queries.TEXT_COLUMNS).repartition(5), cells)
    rows, columns = stream_cells(src.spark, cells, ingest_queries.TEXT_COLUMNS, files_per_batch=2)
    values = canonical(rows, columns, unit_choice(tg="mg/dL"), ingest_queries.SETTINGS)
    write_cells(stream_score(values, keep=["participant_id", "input_problems"], ids=["homa_ir", "tg_hdl"]), path).awaitTermination()
    back, totals = scored_cells(src.spark, path)
    counts = totals.head()
    return back.select(
        F.coalesce("participant_id", F.lit("")).alias("participant_id"), "input_problems", rounded("homa_ir").alias("homa_ir"), "homa_ir_status",
        rounded("tg_hdl").alias("tg_hdl"), "tg_hdl_status", F.lit(counts["rows"]).alias("total"), F.lit(counts.rows_with_problems).alias("with_problems"),
    )


def _cell_status(value: str, other: str) -> str:
    return f"CASE WHEN {value} IS NULL OR {other} IS NULL THEN 'unavailable' WHEN {value} <= 0 OR {other} <= 0 THEN 'error' ELSE 'ok' END"


STREAM_CELLS_SQL = ingest_queries._with_text(
    "SELECT participant_id, problems AS input_problems, "
    + ", ".join(
        f"CASE WHEN {_cell_status(a, b)} = 'ok' THEN {rounded_sql(value)} END AS {i}, {_cell_status(a, b)} AS {i}_status"
        for i, a, b, value in (("homa_ir", "g", "i", "g * (i / 6E0) / 225E-1"), ("tg_hdl", "t", "h", "t / (h * 3867E-2)"))
    )
    + ", count(*) OVER () AS total, count(CASE WHEN problems <> '' THEN 1 END) OVER () AS with_problems FROM ("
    "SELECT participant_id, regexp_replace(problems, '; generated row_[0-9]+', '') AS problems, parsed.g0 AS g, CAST(trim(I0) AS DOUBLE) AS i, "
    "CAST(TG AS DOUBLE) AS t, CAST(HDL_c AS DOUBLE) AS h FROM parsed)"
)


def counted_stream(src: Source) -> DataFrame:
    """Counts from the ledger; one batch is repeated and the older ones are compacted on the way."""
    path = scratch_path(src.spark, "counts")
    write_ledger(_arriving(src), count_delta(), path).awaitTermination()
    add_to_ledger(cut_lineage(src.spark.read.parquet(f"{path}/deltas/batch=0")), 0, path)
    compact_ledger(src.spark, path, COUNT_KEYS, keep=1)
    add_to_ledger(count_delta()(src.cohort()), 0, path)  # a batch that is part of the base by now
    return read_ledger(src.spark, path, COUNT_KEYS)


def reason_stream(src: Source) -> DataFrame:
    """The reasons of all batches, added up."""
    path = scratch_path(src.spark, "reasons")
    write_ledger(_arriving(src), reason_delta(SOME), path).awaitTermination()
    return read_ledger(src.spark, path, REASON_KEYS)


def weight_stream(src: Source) -> DataFrame:
    path = scratch_path(src.spark, "weight")
    write_ledger(_arriving(src), weight_sums, path).awaitTermination()
    return weight_from_sums(read_ledger(src.spark, path, SUM_KEYS)).select(rounded("weight", 8).alias("weight"), "source", "pairs")


REASONS_SQL = with_prepared(
    "SELECT method_id, status, reason, count(*) AS rows FROM statuses WHERE status <> 'ok' GROUP BY 1, 2, 3", long_status_cte(SOME, reasons=True)
)
QUERIES = {
    "X01_results_csv": Query(results_csv, RESULTS_SQL),
    "X02_settings_json": Query(settings_json, SETTINGS_SQL),
    "X03_transformed_csv": Query(transformed_csv, TRANSFORMED_CSV_SQL),
    "X04_density_csv": Query(density_csv, statistics_queries.DENSITY_TABLE_SQL),
    "X04_table_csv": Query(tables_csv, statistics_queries.COMPARISON_SQL),
    "P01_stream_score": Query(scored_stream, STREAM_SQL),
    "P01_stream_cells": Query(scored_cells_stream, STREAM_CELLS_SQL),
    "P02_stream_reasons": Query(reason_stream, REASONS_SQL),
    "P02_stream_counts": Query(counted_stream, batch_queries.COUNTS_SQL),
    "P03_stream_weight": Query(weight_stream, batch_queries.WEIGHT_SQL),
}
