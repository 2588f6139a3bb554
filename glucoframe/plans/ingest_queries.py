"""Queries for reading and validating cohort tables.

The text table is written out of the visit cohort with the kinds of cells real files hold: missing codes,
decimal commas, words, an empty id, units in mg/dL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoframe.functions.units import from_canonical, unit_choice
from glucoframe.operators.curve import curve_summary
from glucoframe.plans.cohort_sql import COHORT, with_cohort
from glucoframe.plans.source import Query, Source, rounded, rounded_sql
from glucoframe.session import cut_lineage, scratch_path
from glucoframe.settings import ConversionSettings
from glucoframe.sources.cohort_files import (
    canonical,
    derive_bmi,
    duplicate_ids,
    find_participants,
    parse_table,
    problem_rows,
    read_cohort,
    wide_from_long,
)
from glucoframe.sources.columns import classify_all, mapping_frame
from glucoframe.sources.file_check import check_cohort
from glucoframe.sources.results import write_csv

SETTINGS = ConversionSettings()
TEXT_COLUMNS = [
    "participant_id", "fasting_glucose", "G120", "I0", "insulin_120", "Glucagon0", "TG", "HDL_c", "sex", "weight",
    "site notes",
]


def _cents(value: str, divide: str) -> str:
    """Text of a value with two decimals, made from whole hundredths so that both engines agree."""
    hundredths = f"CAST(floor(({value}) * 100 + 5E-1) AS BIGINT)"
    return f"(CAST({hundredths} {divide} 100 AS STRING) || '.' || lpad(CAST({hundredths} % 100 AS STRING), 2, '0'))"


def _text_columns(divide: str) -> str:
    """The text table as a select list; `divide` is the engine's whole-number division."""
    glucose = _cents("g0", divide)
    return f"""
      visit_id,
      CASE WHEN visit_id % 53 = 0 THEN '' ELSE concat('P', CAST(visit_id AS STRING)) END AS participant_id,
      CASE WHEN visit_id % 13 = 0 THEN 'NA' WHEN visit_id % 17 = 0 THEN replace({glucose}, '.', ',')
           WHEN visit_id % 19 = 0 THEN 'abc' WHEN visit_id % 23 = 0 THEN '1d' WHEN visit_id % 31 = 0 THEN 'Infinity'
           ELSE {glucose} END AS fasting_glucose,
      {_cents('g120', divide)} AS G120,
      ' ' || {_cents('i0', divide)} || ' ' AS I0,
      {_cents('i120', divide)} AS insulin_120,
      {_cents('gl0', divide)} AS Glucagon0,
      {_cents('tg * 8857E-2', divide)} AS TG,
      {_cents('hdl', divide)} AS HDL_c,
      CASE WHEN visit_id % 29 = 0 THEN '3' WHEN sex IS NULL THEN 'null'
           WHEN sex = 'male' THEN CASE visit_id % 3 WHEN 0 THEN '1' WHEN 1 THEN 'm' ELSE 'Male' END
           ELSE CASE visit_id % 3 WHEN 0 THEN '2' WHEN 1 THEN 'F' ELSE 'female' END END AS sex,
      {_cents('weight', divide)} AS weight,
      'kept as text' AS `site notes`"""


def text_table(src: Source) -> DataFrame:
    src.cohort().createOrReplaceTempView("cohort_for_text")
    return src.spark.sql(f"SELECT {_text_columns('div')} FROM cohort_for_text")


_DUCK_TEXT = _text_columns("//").replace("`site notes`", '"site notes"').replace("STRING", "VARCHAR")
_NUMBER = r"'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
_COMMA = r"'^[+-]?[0-9]+,[0-9]+$'"

TEXT = f"""{COHORT},
texts AS (SELECT {_DUCK_TEXT} FROM cohort),
numbered AS (SELECT *, row_number() OVER (ORDER BY visit_id) AS row_no FROM texts),
parsed AS (
  SELECT *,
    CASE WHEN participant_id = '' THEN concat('row_', CAST(row_no AS VARCHAR)) ELSE participant_id END AS pid,
    CASE WHEN regexp_matches(trim(fasting_glucose), {_NUMBER}) THEN CAST(trim(fasting_glucose) AS DOUBLE) END AS g0,
    CASE WHEN lower(sex) IN ('1', 'm', 'male') THEN 'male' WHEN lower(sex) IN ('2', 'f', 'female') THEN 'female' END
      AS sex_label,
    concat_ws(' | ',
      CASE WHEN participant_id = '' THEN concat('participant ID is empty; generated row_', CAST(row_no AS VARCHAR)) END,
      CASE WHEN regexp_matches(fasting_glucose, {_COMMA})
           THEN concat('fasting_glucose: use a decimal point ("', fasting_glucose, '")') END,
      CASE WHEN fasting_glucose <> 'NA' AND NOT regexp_matches(fasting_glucose, {_COMMA})
                AND NOT regexp_matches(trim(fasting_glucose), {_NUMBER})
           THEN concat('G0: not a number ("', fasting_glucose, '")') END,
      CASE WHEN lower(sex) NOT IN ('1', 'm', 'male', '2', 'f', 'female', 'null')
           THEN concat('sex: unrecognised value "', sex, '"') END) AS problems
  FROM numbered
)"""


def _with_text(query: str) -> str:
    return f"WITH {TEXT.strip()}\n{query}"


def _parsed(src: Source) -> DataFrame:
    return parse_table(text_table(src), order_by=["visit_id"]).rows


# ---- S01: a real file, written to the shared folder and read back in file order ----

def read_csv(src: Source) -> DataFrame:
    path = scratch_path(src.spark, "cohort") + ".csv"
    ordered = text_table(src).repartitionByRange("visit_id").sortWithinPartitions("visit_id")
    write_csv(ordered.select(*TEXT_COLUMNS), path)
    rows = read_cohort(src.spark, path).rows
    return rows.select("row", "participant_id", "input_problems", rounded("g0").alias("g0"), "sex")


READ_CSV_SQL = _with_text(
    f"SELECT row_no AS row, pid AS participant_id, problems AS input_problems, {rounded_sql('g0')} AS g0, "
    "sex_label AS sex FROM parsed"
)


def classify_columns(src: Source) -> DataFrame:
    """Every source column with its meaning and how many of its cells are filled."""
    table = text_table(src).select(*TEXT_COLUMNS)
    cells = F.array(*[
        F.struct(F.lit(c).alias("source"), F.coalesce(F.col(f"`{c}`"), F.lit("")).alias("cell")) for c in table.columns
    ])
    filled = table.select(F.inline(cells)).groupBy("source").agg(
        F.count_if(F.col("cell") != "").alias("filled")
    )
    mapping = mapping_frame(src.spark, classify_all(table.columns))
    return mapping.join(filled, "source").select("source", "kind", "canonical", "filled")


_MAPPING = [
    ("participant_id", "id", None), ("fasting_glucose", "variable", "G0"), ("G120", "variable", "G120"),
    ("I0", "variable", "I0"), ("insulin_120", "variable", "I120"), ("Glucagon0", "variable", "Glucagon0"),
    ("TG", "variable", "TG"), ("HDL_c", "variable", "HDL_c"), ("sex", "variable", "sex"),
    ("weight", "variable", "weight"), ("site notes", "ignored", None),
]


def _classify_sql() -> str:
    parts = [
        f"SELECT '{source}' AS source, '{kind}' AS kind, "
        + ("NULL" if name is None else f"'{name}'")
        + f" AS canonical, (SELECT count(*) FROM texts WHERE coalesce(\"{source}\", '') <> '') AS filled"
        for source, kind, name in _MAPPING
    ]
    return _with_text(" UNION ALL ".join(parts))


def parse_cells(src: Source) -> DataFrame:
    return _parsed(src).select("participant_id", "input_problems", rounded("g0").alias("g0"))


PARSE_SQL = _with_text(
    f"SELECT pid AS participant_id, problems AS input_problems, {rounded_sql('g0')} AS g0 FROM parsed"
)


def parse_sex(src: Source) -> DataFrame:
    return parse_table(text_table(src)).rows.groupBy("sex").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.contains("input_problems", F.lit("sex: unrecognised"))).alias("unrecognised"),
    )


PARSE_SEX_SQL = _with_text(
    "SELECT sex_label AS sex, count(*) AS rows, "
    "count(CASE WHEN contains(problems, 'sex: unrecognised') THEN 1 END) AS unrecognised FROM parsed GROUP BY 1"
)


def generated_ids(src: Source) -> DataFrame:
    return _parsed(src).where("participant_id LIKE 'row%'").select("row", "participant_id")


GENERATED_SQL = _with_text("SELECT row_no AS row, pid AS participant_id FROM parsed WHERE participant_id = ''")


def file_list(src: Source) -> DataFrame:
    """Generated ids over a list of files whose names begin alike or need escaping, in the order of the list."""
    folder = scratch_path(src.spark, "listed")
    names = ["x", "x2", "b c", "x%20"]
    table = text_table(src).select("visit_id", *[c for c in TEXT_COLUMNS if c != "participant_id"])
    for k, name in enumerate(names):
        rows = table.where(F.col("visit_id") % len(names) == k).repartitionByRange("visit_id").sortWithinPartitions("visit_id")
        write_csv(rows.withColumn("weight", F.col("visit_id").cast("string")).drop("visit_id"), f"{folder}/{name}.csv")
    rows = read_cohort(src.spark, [f"{folder}/{name}.csv" for name in names]).rows
    return rows.select("row", "participant_id", F.col("weight").cast("bigint").alias("visit_id"))


FILE_LIST_SQL = with_cohort(
    "SELECT r AS row, concat('row_', CAST(r AS VARCHAR)) AS participant_id, visit_id FROM "
    "(SELECT visit_id, row_number() OVER (ORDER BY visit_id % 4, visit_id) AS r FROM cohort)"
)


def duplicates(src: Source) -> DataFrame:
    people = src.table("orders").select(F.col("o_custkey").cast("string").alias("participant_id"))
    return duplicate_ids(people)


DUPLICATES_SQL = (
    "SELECT CAST(o_custkey AS VARCHAR) AS participant_id, count(*) AS rows FROM orders GROUP BY 1 HAVING count(*) > 1"
)


def to_canonical(src: Source) -> DataFrame:
    """File units (mg/dL, uU/mL, pg/mL, umol/L) back to canonical ones."""
    file_units = unit_choice(
        glucose="MG/DL", insulin="µU/mL", glucagon="pg/ml", ffa="umol/L", tg="mg/dL", hdl="mg/dl"
    )
    columns = classify_all(["G0", "I0", "Glucagon0", "FFA", "TG", "HDL_c"])
    in_file = src.cohort().select(
        "visit_id",
        *[from_canonical(F.col(c.column), c.quantity, file_units.of(c.quantity), SETTINGS).alias(c.column) for c in columns],
    )
    back = canonical(in_file, columns, file_units, SETTINGS)
    return back.select("visit_id", *[rounded(c.column).alias(c.column) for c in columns])


TO_CANONICAL_SQL = with_cohort(
    "SELECT visit_id, "
    + ", ".join(
        f"{rounded_sql(e)} AS {n}"
        for n, e in {
            "g0": "g0 * 18E0 / 18E0", "i0": "i0 / 6E0 * 6E0", "gl0": "gl0 * 3485E-3 / 3485E-3",
            "ffa0": "ffa0 * 1000E0 / 1000E0", "tg": "tg * 8857E-2 / 8857E-2", "hdl": "hdl * 3867E-2 / 3867E-2",
        }.items()
    )
    + " FROM cohort"
)


def first_problems(src: Source) -> DataFrame:
    return problem_rows(cut_lineage(_parsed(src)), 20)


PROBLEMS_SQL = _with_text(
    "SELECT row_no AS row, pid AS participant_id, problems AS input_problems, count(*) OVER () AS total FROM parsed WHERE problems <> '' "
    "ORDER BY row_no LIMIT 20"
)


def problem_count(src: Source) -> DataFrame:
    return parse_table(text_table(src)).rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("input_problems") != "").alias("with_problems")
    )


PROBLEM_COUNT_SQL = _with_text(
    "SELECT count(*) AS rows, count(CASE WHEN problems <> '' THEN 1 END) AS with_problems FROM parsed"
)


def bmi(src: Source) -> DataFrame:
    people = src.cohort().select(
        "visit_id", "weight",
        F.when(F.col("visit_id") % 3 == 0, None).otherwise(F.col("bmi")).alias("bmi"),
        F.when(F.col("visit_id") % 7 == 0, None).otherwise((F.col("visit_id") % 50 + 150).cast("double")).alias("height"),
    )
    return derive_bmi(people).select("visit_id", rounded("bmi").alias("bmi"))


_HEIGHT = "(CAST(visit_id % 50 + 150 AS DOUBLE) / 100)"
_DERIVED = f"CASE WHEN weight > 0 THEN weight / ({_HEIGHT} * {_HEIGHT}) END"
BMI_SQL = with_cohort(
    "SELECT visit_id, "
    + rounded_sql(f"CASE WHEN visit_id % 3 <> 0 THEN bmi WHEN visit_id % 7 <> 0 THEN {_DERIVED} END")
    + " AS bmi FROM cohort"
)


SAMPLED = (0, 30, 45, 60, 90, 120, 180)


def series_from_long(src: Source) -> DataFrame:
    """Order lines as glucose samples: the line number is the place in SAMPLED, two minutes of which no index reads.

    Every sample of the series, the column of minute 120 and the area under all samples.
    """
    minute = F.element_at(F.array(*[F.lit(t) for t in SAMPLED]), F.col("l_linenumber"))
    samples = src.table("lineitem").join(
        src.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    ).select(
        F.col("o_custkey").alias("participant"), F.lit("glucose").alias("analyte"), minute.alias("minute"),
        F.col("l_quantity").cast("double").alias("value"),
    )
    wide = wide_from_long(samples, "participant")
    summed = wide.withColumn("summary", curve_summary(F.col("g_series"), "glucose"))
    listed = summed.select("participant", "g120", F.col("summary.auc").alias("auc"), F.explode("g_series").alias("minute", "value"))
    return listed.select(
        "participant", F.col("minute").cast("bigint").alias("minute"), rounded("value").alias("value"), rounded("g120").alias("g120"), rounded("auc").alias("auc")
    )


SERIES_SQL = (
    "WITH averaged AS (SELECT o_custkey AS participant, [0, 30, 45, 60, 90, 120, 180][l_linenumber] AS minute, avg(CAST(l_quantity AS DOUBLE)) AS value "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), "
    "steps AS (SELECT *, (value + lag(value) OVER w) / 2 * (minute - lag(minute) OVER w) AS step FROM averaged "
    "WINDOW w AS (PARTITION BY participant ORDER BY minute)), "
    "sums AS (SELECT *, sum(step) OVER (PARTITION BY participant) AS auc, max(CASE WHEN minute = 120 THEN value END) OVER (PARTITION BY participant) AS g120 FROM steps) "
    f"SELECT participant, CAST(minute AS BIGINT) AS minute, {rounded_sql('value')} AS value, {rounded_sql('g120')} AS g120, {rounded_sql('auc')} AS auc FROM sums"
)


def lookup(src: Source) -> DataFrame:
    ids = src.cohort().select(
        F.concat(F.lit("P"), F.col("visit_id").cast("string")).alias("participant_id"), F.col("visit_id").alias("row")
    )
    return find_participants(ids, "p11", 100).select("participant_id", "total")


LOOKUP_SQL = with_cohort(
    "SELECT participant_id, count(*) OVER () AS total FROM (SELECT concat('P', CAST(visit_id AS VARCHAR)) AS participant_id, visit_id FROM cohort) "
    "WHERE contains(lower(participant_id), 'p11') ORDER BY visit_id LIMIT 100"
)


def file_check(src: Source) -> DataFrame:
    """Rows, problems, ids that repeat, columns, units, a selection and the weight of the text table in one listing."""
    table = text_table(src).withColumn("participant_id", F.expr("CASE WHEN participant_id <> '' THEN concat('P', visit_id - visit_id % 3) ELSE '' END"))
    parsed = parse_table(table, order_by=["visit_id"])
    fixed = type(parsed)(cut_lineage(parsed.rows), parsed.columns, parsed.generated_ids)
    checked = check_cohort(fixed, selection=["quicki", "glucagon_fasting"])
    return checked.select("item", "detail", rounded("number", 4).alias("number"))


def _median(column: str) -> str:
    return f"(SELECT quantile_cont({column}, 5E-1) FROM readings WHERE {column} IS NOT NULL)"


_READ = ", ".join(
    f"CASE WHEN regexp_matches(trim({c}), {_NUMBER}) THEN CAST(trim({c}) AS DOUBLE) END AS {n}"
    for c, n in (("G120", "g120"), ("I0", "i0"), ("insulin_120", "i120"), ("Glucagon0", "gl0"), ("TG", "tg"),
                 ("HDL_c", "hdl"), ("weight", "weight"))
)
_PAIRS = (
    "SELECT 1E8 / (g0 * 18E0 * (i0 / 6E0) * weight * 150E0) AS a, 1E8 / (g120 * 18E0 * (i120 / 6E0) * weight * 150E0) AS b "
    "FROM readings WHERE g0 > 0 AND i0 > 0 AND g120 > 0 AND i120 > 0 AND weight > 0"
)
_RECOGNISED = [s for s, kind, _ in _MAPPING if kind != "ignored"]
_SAID = "concat('row ', CAST(row_no AS VARCHAR), ' (', pid, '): ', problems)"
FILE_CHECK_SQL = (
    f"WITH {TEXT.strip()},\nnamed AS (SELECT row_no, problems, CASE WHEN participant_id = '' THEN pid ELSE "
    "concat('P', CAST(visit_id - visit_id % 3 AS VARCHAR)) END AS pid FROM parsed),\n"
    f"twins AS (SELECT pid, min(row_no) AS row_no FROM named GROUP BY 1 HAVING count(*) > 1),\nreadings AS (SELECT g0, {_READ} FROM parsed),\npairs AS ({_PAIRS}),\nlisting AS (\n"
    "SELECT 'rows' AS item, '' AS detail, CAST(count(*) AS DOUBLE) AS number FROM parsed\n"
    "UNION ALL SELECT 'rows_with_problems', '', CAST(count(CASE WHEN problems <> '' THEN 1 END) AS DOUBLE) FROM parsed\n"
    "UNION ALL SELECT 'duplicate_ids', '', CAST(count(*) AS DOUBLE) FROM twins\n"
    "UNION ALL (SELECT 'duplicate_id', pid, row_no FROM twins ORDER BY row_no LIMIT 5)\n"
    f"UNION ALL (SELECT 'problem_row', {_SAID}, row_no FROM named WHERE problems <> '' ORDER BY row_no LIMIT 20)\n"
    "UNION ALL SELECT 'selection', '2 of 47 (groups: none; other indices: quicki, glucagon_fasting)', 2E0\n"
    + "".join(f"UNION ALL SELECT 'recognised_column', '{s}', NULL\n" for s in _RECOGNISED)
    + "UNION ALL SELECT 'ignored_column', 'visit_id', NULL\nUNION ALL SELECT 'ignored_column', 'site notes', NULL\n"
    + f"UNION ALL SELECT 'unit_ok', 'G0 mmol/L', {_median('g0')}\n"
    + f"UNION ALL SELECT 'unit_ok', 'I0 pmol/L', {_median('i0')}\n"
    + f"UNION ALL SELECT 'unit_ok', 'Glucagon0 pmol/L', {_median('gl0')}\n"
    + f"UNION ALL SELECT 'unit_warning', 'TG mg/dL', {_median('tg')}\n"
    + f"UNION ALL SELECT 'unit_ok', 'HDL_c mmol/L', {_median('hdl')}\n"
    + "UNION ALL SELECT 'avignon_weight', 'sample', (SELECT avg(b) / avg(a) FROM pairs))\n"
    + f"SELECT item, detail, {rounded_sql('number', 4)} AS number FROM listing"
)

QUERIES = {
    "S01_read_cohort": Query(read_csv, READ_CSV_SQL),
    "S03_classify_columns": Query(classify_columns, _classify_sql()),
    "S05_parse_cells": Query(parse_cells, PARSE_SQL),
    "S06_parse_sex": Query(parse_sex, PARSE_SEX_SQL),
    "S07_file_list": Query(file_list, FILE_LIST_SQL),
    "S07_generated_ids": Query(generated_ids, GENERATED_SQL),
    "S08_duplicate_ids": Query(duplicates, DUPLICATES_SQL),
    "S09_to_canonical": Query(to_canonical, TO_CANONICAL_SQL),
    "S11_problem_rows": Query(first_problems, PROBLEMS_SQL),
    "S11_problem_count": Query(problem_count, PROBLEM_COUNT_SQL),
    "S13_derive_bmi": Query(bmi, BMI_SQL),
    "S14_series_from_long": Query(series_from_long, SERIES_SQL),
    "S17_participant_lookup": Query(lookup, LOOKUP_SQL),
    "D10_file_check": Query(file_check, FILE_CHECK_SQL),
}
