"""Queries over whole calculations: statuses, reasons, weights, selection, parts, curves, reconciliation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import glucoframe
from glucoframe.functions.units import from_canonical
from glucoframe.operators.calculate import calculate_long, calculate_wide
from glucoframe.operators.catalog import (
    DEFERRED,
    INDEX_IDS,
    METHODS,
    NEGATED,
    POPULATION,
    SOURCES,
    VERIFICATION,
    Deferred,
    catalog,
    column_name,
    oriented_direction,
    resolve_selection,
)
from glucoframe.operators.curve import curve_summary, curve_summary_long, series_map
from glucoframe.operators.parts import Run, manifest, part_of, part_problems, parts_frame, take_part
from glucoframe.operators.ranking import add_row_numbers
from glucoframe.operators.reconcile import (
    EARLIER_COLUMNS,
    ISLET_COLUMNS,
    ISLET_INSULIN_FACTOR,
    compare_results,
    counterpart_map,
    verdict_counts,
)
from glucoframe.operators.tally import (
    availability,
    merge_counts,
    reason_counts,
    status_counts,
    status_long,
    top_reasons,
)
from glucoframe.operators.weight import cohort_weight, weight_from_sums, weight_sums
from glucoframe.plans.cohort_sql import with_cohort, with_prepared
from glucoframe.plans.index_sql import (
    PLAIN,
    decimals,
    formula_sql,
    long_status_cte,
    long_values_cte,
    rounded_value_sql,
    status_sql,
    value_sql,
)
from glucoframe.plans.source import Query, Source, rounded, rounded_sql
from glucoframe.settings import AvignonWeight, ConversionSettings
from glucoframe.session import cut_lineage, scratch_path
from glucoframe.sources.results import (
    merge_folder,
    merge_part_files,
    read_manifest,
    read_results,
    settings_path,
    write_parts,
    write_results,
)
from glucoframe.sources.visits import COHORT_COLUMNS

SOME = ["homa_ir", "quicki", "avignon_si0", "vai", "homa_beta", "glucagon_auc"]


def _long(src: Source, **more) -> DataFrame:
    return calculate_long(src.cohort(), keep=["visit_id"], **more)


# ---------- status algebra ----------

def missing_reasons(src: Source) -> DataFrame:
    return reason_counts(src.cohort()).where("status = 'unavailable'").drop("status")


_REASONS = long_status_cte(INDEX_IDS, reasons=True)
MISSING_SQL = with_prepared(
    "SELECT method_id, reason, count(*) AS rows FROM statuses WHERE status = 'unavailable' GROUP BY 1, 2", _REASONS
)


def invalid_reasons(src: Source) -> DataFrame:
    return reason_counts(src.cohort()).where("status = 'error'").drop("status")


INVALID_SQL = with_prepared(
    "SELECT method_id, reason, count(*) AS rows FROM statuses WHERE status = 'error' GROUP BY 1, 2", _REASONS
)


def precedence(src: Source) -> DataFrame:
    """Rows by whether an input is missing and whether another is invalid: missing decides."""
    long = calculate_long(
        src.cohort().withColumn("g0_raw", F.col("g0")), ids=["homa_ir", "isi_basal", "avignon_si0", "matsuda_3pt"],
        keep=["g0_raw"],
    )
    return long.groupBy(
        "method_id", "status", (F.col("g0_raw") == 0).alias("glucose_zero"),
        F.exists("reasons", lambda r: F.startswith(r, F.lit("requires"))).alias("lacks_input"),
    ).agg(F.count(F.lit(1)).alias("rows"))


def _precedence_sql() -> str:
    parts = [
        f"SELECT '{i}' AS method_id, {status_sql(i)} AS status, g0 = 0 AS glucose_zero, "
        f"({' OR '.join(n + ' IS NULL' for n in PLAIN[i].needs)}) AS lacks_input FROM prepared"
        for i in ("homa_ir", "isi_basal", "avignon_si0", "matsuda_3pt")
    ]
    return with_prepared("SELECT *, count(*) AS rows FROM (" + " UNION ALL ".join(parts) + ") GROUP BY 1, 2, 3, 4")


def undefined_reasons(src: Source) -> DataFrame:
    counts = reason_counts(src.cohort(), ids=["homa_beta", "cir30", "insulinogenic_dg30"])
    return counts.where("reason LIKE 'not defined%'")


UNDEFINED_SQL = with_prepared(
    "SELECT method_id, status, reason, count(*) AS rows FROM statuses WHERE reason LIKE 'not defined%' GROUP BY 1, 2, 3",
    long_status_cte(["homa_beta", "cir30", "insulinogenic_dg30"], reasons=True),
)


def warnings(src: Source) -> DataFrame:
    return (
        _long(src).select("method_id", "status", F.explode("warnings").alias("warning"))
        .groupBy("method_id", "status", "warning").agg(F.count(F.lit(1)).alias("rows"))
    )


WARNINGS_SQL = with_prepared(
    f"""SELECT 'belfiore_isi_ffa' AS method_id, 'ok' AS status,
      'Basal form used: insulin and FFA series lack 120-min values for an area.' AS warning, count(*) AS rows
    FROM prepared WHERE {status_sql('belfiore_isi_ffa')} = 'ok' HAVING count(*) > 0
    UNION ALL
    SELECT 'belfiore_isi_gly', {status_sql('belfiore_isi_gly')},
      '60-min value present for only one of insulin/glucose; using 0-2h area.', count(*)
    FROM prepared WHERE i0 IS NOT NULL AND i120 IS NOT NULL AND g0 IS NOT NULL AND g120 IS NOT NULL
      AND (i60 IS NULL) <> (g60 IS NULL) GROUP BY 1, 2, 3"""
)


def deferred_rows(src: Source) -> DataFrame:
    long = _long(src).where(F.col("method_id").isin([d.id for d in DEFERRED]))
    return long.groupBy("method_id", "status", F.element_at("reasons", 1).alias("reason")).agg(
        F.count("visit_id").alias("rows"), F.count("value").alias("values")
    )


DEFERRED_SQL = with_cohort(
    " UNION ALL ".join(
        f"SELECT '{d.id}' AS method_id, 'unavailable' AS status, '{d.full_reason}' AS reason, count(*) AS rows, "
        "CAST(0 AS BIGINT) AS values FROM cohort"
        for d in DEFERRED
    )
)


def details(src: Source) -> DataFrame:
    long = calculate_long(src.cohort(), ids=["gutt", "belfiore_isi_gly"], keep=["visit_id"], details=True)

    def number(key: str):
        return F.max(F.try_element_at("details", F.lit(key)).cast("double"))

    return long.where("status = 'ok'").groupBy("visit_id").agg(
        rounded(number("mean_glucose_mmol_L")).alias("mean_glucose"),
        rounded(number("mean_insulin_uU_mL")).alias("mean_insulin"),
        F.max(F.try_element_at("details", F.lit("variant"))).alias("variant"),
    )


DETAILS_SQL = with_prepared(
    "SELECT visit_id, "
    f"{rounded_sql('CASE WHEN gutt = 1 THEN (g0 + g120) / 2E0 END')} AS mean_glucose, "
    f"{rounded_sql('CASE WHEN gutt = 1 THEN (iu0 + iu120) / 2E0 END')} AS mean_insulin, "
    "CASE WHEN gly = 1 THEN CASE WHEN i60 IS NOT NULL AND g60 IS NOT NULL THEN '0_1_2h' ELSE '0_2h' END END AS variant "
    "FROM flagged WHERE gutt = 1 OR gly = 1",
    f"flagged AS (SELECT *, CASE WHEN ({status_sql('gutt')}) = 'ok' THEN 1 ELSE 0 END AS gutt, "
    f"CASE WHEN ({status_sql('belfiore_isi_gly')}) = 'ok' THEN 1 ELSE 0 END AS gly FROM prepared)",
)

# ---------- whole calculations ----------


def calculate_all(src: Source) -> DataFrame:
    wide = calculate_wide(src.cohort(), keep=["visit_id"])
    return wide.select("visit_id", *[rounded(i, decimals(i)).alias(i) for i in INDEX_IDS])


CALCULATE_ALL_SQL = with_prepared(
    "SELECT visit_id, " + ", ".join(f"{rounded_value_sql(i)} AS {i}" for i in INDEX_IDS) + " FROM prepared"
)


def long_layout(src: Source) -> DataFrame:
    long = _long(src, orientation="sensitivity")
    return long.groupBy("method_id", "category", "direction", "orientation", "source_verification", "status").agg(
        F.count("visit_id").alias("rows")
    )


def _long_layout_sql() -> str:
    parts = []
    for m in METHODS:
        name = column_name(m.id, "sensitivity")
        status = "'unavailable'" if isinstance(m, Deferred) else status_sql(m.id)
        parts.append(
            f"SELECT '{name}' AS method_id, '{m.category}' AS category, "
            f"'{oriented_direction(m, 'sensitivity')}' AS direction, "
            f"'{'published' if name == m.id else 'sensitivity'}' AS orientation, "
            f"'{VERIFICATION[m.id]}' AS source_verification, {status} AS status FROM prepared"
        )
    return with_prepared("SELECT *, count(*) AS rows FROM (" + " UNION ALL ".join(parts) + ") GROUP BY 1, 2, 3, 4, 5, 6")


def weight_row(src: Source) -> DataFrame:
    row = weight_from_sums(weight_sums(src.cohort()))
    return row.select(rounded("weight", 8).alias("weight"), "source", "pairs")


_PAIRS = (
    f"pairs AS (SELECT {value_sql('avignon_si0')} AS a, {value_sql('avignon_si120')} AS b FROM prepared), "
    "weight AS (SELECT avg(b) / avg(a) AS w, count(*) AS n FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL)"
)
WEIGHT_SQL = with_prepared(f"SELECT {rounded_sql('w', 8)} AS weight, 'sample' AS source, n AS pairs FROM weight", _PAIRS)


def weighted_sim(src: Source) -> DataFrame:
    cohort = src.fixed_cohort()
    wide = calculate_wide(cohort, ids=["avignon_sim"], keep=["visit_id"], weight=cohort_weight(cohort))
    return wide.select("visit_id", rounded("avignon_sim").alias("avignon_sim"))


WEIGHTED_SIM_SQL = with_prepared(
    f"SELECT visit_id, {rounded_sql(value_sql('avignon_sim', '(SELECT w FROM weight)'))} AS avignon_sim FROM prepared",
    _PAIRS,
)


def given_weight(src: Source) -> DataFrame:
    wide = calculate_wide(src.cohort(), ids=["avignon_sim"], keep=["visit_id"], weight=AvignonWeight.given(0.25))
    return wide.select("visit_id", rounded("avignon_sim").alias("avignon_sim"))


GIVEN_WEIGHT_SQL = with_prepared(
    f"SELECT visit_id, {rounded_sql(value_sql('avignon_sim', '25E-2'))} AS avignon_sim FROM prepared"
)


def status_columns(src: Source) -> DataFrame:
    wide = calculate_wide(src.cohort(), keep=["visit_id"], status_columns=True)
    return wide.select("visit_id", *[f"{i}_status" for i in INDEX_IDS])


STATUS_COLUMNS_SQL = with_prepared(
    "SELECT visit_id, " + ", ".join(f"{status_sql(i)} AS {i}_status" for i in INDEX_IDS) + " FROM prepared"
)


def counts(src: Source) -> DataFrame:
    return status_counts(status_long(calculate_wide(src.cohort(), keep=[], status_columns=True)))


_COUNTED = ", ".join(f"count(CASE WHEN status = '{s}' THEN 1 END) AS {s}" for s in ("ok", "unavailable", "error"))
COUNTS_SQL = with_prepared(f"SELECT method_id, {_COUNTED} FROM statuses GROUP BY 1", long_status_cte(INDEX_IDS))


def merged_counts(src: Source) -> DataFrame:
    """Counts of the men's, women's and other visits, added up again."""
    cohort = src.fixed_cohort()
    parts = [
        status_counts(status_long(calculate_wide(cohort.where(c), keep=[], status_columns=True)))
        for c in ("sex = 'male'", "sex = 'female'", "sex IS NULL")
    ]
    return merge_counts(*parts)


def frequent_reasons(src: Source) -> DataFrame:
    return top_reasons(reason_counts(src.cohort()))


TOP_SQL = with_prepared(
    "SELECT method_id, status, reason, rows, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY method_id, status "
    "ORDER BY rows DESC, reason) AS INTEGER) AS place FROM (SELECT method_id, status, reason, count(*) AS rows "
    "FROM statuses WHERE status <> 'ok' GROUP BY 1, 2, 3)) WHERE place <= 3",
    _REASONS,
)


def selection(src: Source) -> DataFrame:
    ids = resolve_selection(groups=["glucagon", "tracer_dxa"], ids=["lap", "homa_ir"])
    wide = calculate_wide(src.cohort(), ids=ids, keep=["visit_id"])
    return wide.select("visit_id", *[rounded(i, decimals(i)).alias(i) for i in ids])


SELECTED = [
    "homa_ir", "lap", "liri", "lipo", "atiri", "glucagon_fasting", "glucagon_auc", "glucagon_ratio_120_0",
    "glucagon_suppression_pct_60", "glucagon_insulin_ratio",
]
SELECTION_SQL = with_prepared(
    "SELECT visit_id, " + ", ".join(f"{rounded_value_sql(i)} AS {i}" for i in SELECTED) + " FROM prepared"
)

# ---------- parts ----------
PARTS = 7


def _numbered(src: Source) -> DataFrame:
    return add_row_numbers(src.cohort(), ["visit_id"], "row")


def cohort_parts(src: Source) -> DataFrame:
    numbered = _numbered(src)
    total = numbered.count()
    return numbered.groupBy(part_of("row", PARTS, total).alias("part")).agg(
        F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("visit_id").alias("first_visit"),
        F.max("visit_id").alias("last_visit"),
    )


PARTS_SQL = with_cohort(
    f"""SELECT part, min(r) AS first_row, max(r) AS last_row, min(visit_id) AS first_visit, max(visit_id) AS last_visit
FROM (SELECT i AS part, r, visit_id FROM (SELECT visit_id, row_number() OVER (ORDER BY visit_id) AS r FROM cohort)
      JOIN (SELECT i, (i - 1) * n // {PARTS} + 1 AS lo, i * n // {PARTS} AS hi
            FROM (SELECT count(*) AS n FROM cohort), (SELECT unnest(range(1, {PARTS + 1})) AS i)) ON r BETWEEN lo AND hi)
GROUP BY 1"""
)


def _written_parts(src: Source) -> list[str]:
    """The visits calculated as PARTS separate results files with settings; the paths. The rows of a part lie in few tasks, so the
    parts are written side by side."""
    numbered = cut_lineage(_numbered(src)).withColumn("input_problems", F.lit(""))
    total, folder = numbered.count(), scratch_path(src.spark, "parts")

    def write(i: int) -> str:
        path = f"{folder}/part-{i}.csv"
        write_results(
            take_part(numbered, i, PARTS, total), path, Run("visits"), version=glucoframe.__version__, timestamp="",
            header=numbered.columns, part=(i, PARTS, total), keep=["visit_id"],
        )
        return path

    with ThreadPoolExecutor(PARTS) as side_by_side:
        return list(side_by_side.map(write, range(1, PARTS + 1)))


def merged(src: Source) -> DataFrame:
    """The results files of all parts, joined again after their settings were checked."""
    together, _ = merge_part_files(src.spark, list(reversed(_written_parts(src))))
    return together.select(F.col("visit_id").cast("bigint").alias("visit_id"), *[rounded(i, decimals(i)).alias(i) for i in INDEX_IDS])


MERGED_SQL = with_prepared(
    "SELECT visit_id, " + ", ".join(f"{rounded_value_sql(i)} AS {i}" for i in INDEX_IDS) + " FROM prepared"
)


def merged_folder(src: Source) -> DataFrame:
    """The same from a single partitioned write of all parts and a single read; two hundred parts, so that some may be small."""
    numbered = cut_lineage(_numbered(src)).withColumn("input_problems", F.lit(""))
    folder = scratch_path(src.spark, "parts")
    write_parts(numbered, folder, Run("visits"), 200, version=glucoframe.__version__, timestamp="", header=numbered.columns, keep=["visit_id"])
    together, _ = merge_folder(src.spark, folder)
    return together.select(F.col("visit_id").cast("bigint").alias("visit_id"), *[rounded(i, decimals(i)).alias(i) for i in INDEX_IDS])


def misfits(src: Source) -> DataFrame:
    """What is reported of written parts when part 3 is lost and the settings of part 5 name another orientation."""
    listed = []
    for i, path in enumerate(_written_parts(src), start=1):
        if i == 3:
            continue
        doc = read_manifest(src.spark, settings_path(path))
        if i == 5:
            doc["orientation"] = "sensitivity"
        listed.append((f"part-{i}", doc, read_results(src.spark, path).columns))
    return part_problems(parts_frame(src.spark, listed))


MISFITS_SQL = with_cohort(
    f"""SELECT CAST(part AS INTEGER) AS part, name, problem FROM (
  SELECT 4 AS part, 'part-4' AS name, 'missing part 3' AS problem
  UNION ALL SELECT 4, 'part-4', concat('starts at row ', CAST(3 * n // {PARTS} + 1 AS VARCHAR), ', expected ',
    CAST(2 * n // {PARTS} + 1 AS VARCHAR)) FROM (SELECT count(*) AS n FROM cohort)
  UNION ALL SELECT 5, 'part-5', 'differs from part 1 in orientation')"""
)


def run_manifest(src: Source) -> DataFrame:
    cohort = src.fixed_cohort()
    weight = cohort_weight(cohort)
    totals = cohort.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sex").isNull()).alias("bad")).head()
    doc = manifest(
        Run("visits", weight=weight), version=glucoframe.__version__, timestamp="", rows=totals.n,
        rows_with_problems=totals.bad, header=cohort.columns,
    )
    spark = src.spark
    flat = spark.createDataFrame(
        [(doc["row_counts"]["total"], doc["row_counts"]["with_problems"], doc["avignon_weight"]["source"],
          doc["avignon_weight"]["value"], doc["input_fingerprint"]["header_sha256"], len(doc["methods"]))],
        "total bigint, with_problems bigint, weight_source string, weight double, header_sha256 string, methods int",
    )
    return flat.withColumn("weight", rounded("weight", 8))


def _manifest_sql() -> str:
    header = " || chr(31) || ".join(f"'{c}'" for c in COHORT_COLUMNS)
    return with_prepared(
        "SELECT (SELECT count(*) FROM prepared) AS total, (SELECT count(*) FROM prepared WHERE sex IS NULL) "
        f"AS with_problems, 'sample' AS weight_source, {rounded_sql('w', 8)} AS weight, sha256({header}) AS header_sha256, "
        "CAST(47 AS INTEGER) AS methods FROM weight",
        _PAIRS,
    )


def catalog_coverage(src: Source) -> DataFrame:
    """The method list with how many visits each index could be calculated for."""
    counted = status_counts(status_long(calculate_wide(src.cohort(), keep=[], status_columns=True)))
    listed = catalog(src.spark).where("included")
    kept = ["position", "method_id", "name", "category", "direction", "derivation_population", "derivation_n", "derivation_place", "ok"]
    return listed.join(counted, "method_id").select(*kept)


def _catalog_sql() -> str:
    quoted = lambda text: "NULL" if not text else "'" + text.replace("'", "''") + "'"
    rows = ", ".join(
        f"({k}, '{m.id}', '{m.name}', '{m.category}', '{m.direction}', {quoted(POPULATION[m.id])}, {quoted(SOURCES[m.id][1])}, {quoted(SOURCES[m.id][2])})"
        for k, m in enumerate(METHODS) if not isinstance(m, Deferred)
    )
    columns = "position, method_id, name, category, direction, derivation_population, derivation_n, derivation_place"
    return with_prepared(
        "SELECT CAST(position AS INTEGER) AS position, c.method_id, name, category, direction, derivation_population, derivation_n, derivation_place, "
        "count(CASE WHEN status = 'ok' THEN 1 END) AS ok "
        f"FROM (VALUES {rows}) AS c({columns}) JOIN statuses ON statuses.method_id = c.method_id GROUP BY ALL",
        long_status_cte(INDEX_IDS),
    )


def available(src: Source) -> DataFrame:
    return availability(calculate_wide(src.cohort(), keep=["visit_id"]), "visit_id")


def _available_sql() -> str:
    def total(ids):
        return "CAST(" + " + ".join(f"(CASE WHEN {status_sql(i)} = 'ok' THEN 1 ELSE 0 END)" for i in ids) + " AS BIGINT)"

    groups = {}
    for m in METHODS:
        if not isinstance(m, Deferred):
            groups.setdefault(m.category, []).append(m.id)
    return with_prepared(
        f"SELECT visit_id, {total(INDEX_IDS)} AS available, "
        + ", ".join(f"{total(ids)} AS {g}" for g, ids in groups.items()) + " FROM prepared"
    )


def oriented(src: Source) -> DataFrame:
    ids = [i for i in INDEX_IDS if i in NEGATED] + ["quicki", "homa_beta"]
    wide = calculate_wide(src.cohort(), ids=ids, keep=["visit_id"], orientation="sensitivity")
    names = [(i, column_name(i, "sensitivity")) for i in INDEX_IDS if i in ids]
    return wide.select("visit_id", *[rounded(n, decimals(i)).alias(n) for i, n in names])


ORIENTED_SQL = with_prepared(
    "SELECT visit_id, "
    + ", ".join(f"{rounded_value_sql(i, '-')} AS {i}_inv" for i in INDEX_IDS if i in NEGATED)
    + f", {rounded_value_sql('quicki')} AS quicki, {rounded_value_sql('homa_beta')} AS homa_beta FROM prepared"
)

# ---------- curves ----------
GLUCOSE = (0, 30, 60, 90, 120)


def _curves(src: Source) -> DataFrame:
    cohort = src.cohort()
    summary = curve_summary(series_map(cohort, "g", GLUCOSE), "glucose")
    return cohort.select("visit_id", summary.alias("s")).select("visit_id", "s.*")


def auc(src: Source) -> DataFrame:
    return _curves(src).select("visit_id", rounded("auc").alias("auc"), "reason")


def weighted_mean(src: Source) -> DataFrame:
    return _curves(src).select("visit_id", rounded("time_weighted_mean").alias("time_weighted_mean"))


def time_points(src: Source) -> DataFrame:
    return _curves(src).select("visit_id", F.array_join("time_points", ",").alias("time_points"))


def auc_file_units(src: Source) -> DataFrame:
    area = from_canonical(F.col("auc"), "glucose", "mg/dL", ConversionSettings())
    return _curves(src).select("visit_id", rounded(area, 4).alias("auc_mg_dl"))


def _samples_cte(prefix: str, minutes) -> str:
    parts = [f"SELECT visit_id, {t} AS t, {prefix}{t} AS v FROM cohort WHERE {prefix}{t} IS NOT NULL" for t in minutes]
    return "samples AS (" + " UNION ALL ".join(parts) + ")"


_CURVES = (
    f"{_samples_cte('g', GLUCOSE)}, steps AS (SELECT visit_id, t, v, (v + lag(v) OVER w) / 2 * (t - lag(t) OVER w) AS s "
    "FROM samples WINDOW w AS (PARTITION BY visit_id ORDER BY t)), "
    "curves AS (SELECT cohort.visit_id AS visit_id, count(t) AS points, sum(s) AS auc, max(t) - min(t) AS span, "
    "string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS times FROM cohort LEFT JOIN steps ON cohort.visit_id = steps.visit_id "
    "GROUP BY 1)"
)


def _curve_sql(select: str) -> str:
    return with_prepared(f"SELECT visit_id, {select} FROM curves", _CURVES)


def auc_long(src: Source) -> DataFrame:
    """The same areas from one row per sample."""
    cohort = src.cohort()
    samples = cohort.select(
        "visit_id", F.explode(F.map_entries(series_map(cohort, "i", GLUCOSE))).alias("e")
    ).select("visit_id", F.col("e.key").alias("minute"), F.col("e.value").alias("value"))
    summary = curve_summary_long(samples, "visit_id")
    return summary.select(
        "visit_id", "points", rounded("auc", 4).alias("auc"), rounded("time_weighted_mean").alias("time_weighted_mean")
    )


AUC_LONG_SQL = with_prepared(
    f"SELECT visit_id, count(*) AS points, {rounded_sql('sum(s)', 4)} AS auc, "
    f"{rounded_sql('CASE WHEN max(t) > min(t) THEN sum(s) / (max(t) - min(t)) END')} AS time_weighted_mean "
    "FROM (SELECT visit_id, t, v, (v + lag(v) OVER w) / 2 * (t - lag(t) OVER w) AS s "
    "FROM samples WINDOW w AS (PARTITION BY visit_id ORDER BY t)) GROUP BY 1",
    _samples_cte("i", GLUCOSE),
)

# ---------- reconciliation ----------
def _other_implementation(src: Source) -> tuple[DataFrame, DataFrame]:
    """Results with statuses, and a table as another program would have left it: all of its own columns, with its signs
    and scales, half as much again where it is known to differ, and isi_basal wrong on every tenth visit."""
    results = cut_lineage(calculate_wide(src.cohort(), keep=["visit_id", "sex"], status_columns=True))
    columns = []
    for c in EARLIER_COLUMNS:
        value = F.col(c.index_id) / c.scale if c.scale else F.col(c.index_id) * (1.5 if c.relation == "different" else 1.0)
        value = -value if c.relation == "negated" else value
        if c.index_id == "isi_basal":
            value = F.when(F.col("visit_id") % 10 == 0, value * 2).otherwise(value)
        columns += [value.alias(name) for name in (c.column, c.column_male, c.column_female) if name]
    return results, results.select("visit_id", "sex", *columns)


def reconcile(src: Source) -> DataFrame:
    results, other = _other_implementation(src)
    return verdict_counts(compare_results(results, other, EARLIER_COLUMNS, "visit_id"))


def reconcile_one_sided(src: Source) -> DataFrame:
    """Some visits are in one of the two tables only, some in neither."""
    results, other = _other_implementation(src)
    compared = compare_results(results.where("visit_id % 11 <> 0"), other.where("visit_id % 7 <> 3"), EARLIER_COLUMNS, "visit_id")
    return verdict_counts(compared)


# index, how the other column relates, whether it holds one sex
_COUNTERPARTS = (
    [(i, "same", False) for i in (
        "homa_ir", "raynaud", "isi_basal", "ig_ratio_basal", "isi_120", "ig_ratio_120", "matsuda_3pt", "matsuda_auc_3pt", "stumvoll_mod",
        "stumvoll_dem", "bigtt_si", "avignon_si0", "avignon_si120", "revised_quicki", "mcauley", "tyg", "tg_hdl", "adipo_ir", "hiri",
        "avignon_sim", "ifc", "liri", "lipo", "atiri")]
    + [(i, "differs", False) for i in ("quicki", "firi", "belfiore_basal", "belfiore_isi_gly", "belfiore_isi_ffa")]
    + [("gutt", "scaled", False), ("vai", "same", True), ("lap", "same", True)]
)


def _reconcile_sql(here: str = "TRUE", there: str = "TRUE") -> str:
    rows = ", ".join(f"('{i}', '{how}', {one_sex})" for i, how, one_sex in _COUNTERPARTS)
    return with_prepared(
        "SELECT index_id, verdict, count(*) AS rows FROM (SELECT c.index_id, "
        f"CASE WHEN NOT ({here}) AND NOT ({there}) THEN 'absent' WHEN NOT ({here}) THEN 'missing_here' WHEN NOT ({there}) THEN 'missing_there' "
        "WHEN v.value IS NULL THEN 'unavailable_both' WHEN one_sex AND p.sex IS NULL THEN 'missing_there' WHEN how = 'scaled' THEN 'known_scale' "
        "WHEN how = 'differs' AND v.value <> 0 THEN 'known_difference' WHEN how = 'differs' THEN 'mismatch' "
        "WHEN c.index_id = 'isi_basal' AND p.visit_id % 10 = 0 THEN 'mismatch' ELSE 'match' END AS verdict "
        f"FROM prepared p CROSS JOIN (VALUES {rows}) AS c(index_id, how, one_sex) "
        "LEFT JOIN vals v ON v.visit_id = p.visit_id AND v.index_id = c.index_id) WHERE verdict <> 'absent' GROUP BY 1, 2",
        long_values_cte(INDEX_IDS),
    )


RECONCILE_SQL = _reconcile_sql()
ONE_SIDED_SQL = _reconcile_sql("p.visit_id % 11 <> 0", "p.visit_id % 7 <> 3")


def mapping_coverage(src: Source) -> DataFrame:
    """The counterpart columns, with the number of visits each can be compared on."""
    values = calculate_wide(src.cohort(), keep=["sex"])
    long = values.unpivot("sex", INDEX_IDS, "index_id", "value").where("value IS NOT NULL")
    counted = long.groupBy("index_id", "sex").agg(F.count(F.lit(1)).alias("n"))
    mapped = counterpart_map(src.spark, EARLIER_COLUMNS).withColumnRenamed("sex", "only_sex")
    joined = mapped.join(counted, "index_id", "left")
    comparable = F.sum(
        F.when(F.col("only_sex").isNull() | (F.col("only_sex") == F.col("sex")), F.col("n")).otherwise(0)
    )
    return joined.groupBy("index_id", "relation", "column").agg(F.coalesce(comparable, F.lit(0)).alias("rows"))


def _mapping_sql() -> str:
    rows = []
    for c in EARLIER_COLUMNS:
        if c.column:
            rows.append(f"('{c.index_id}', '{c.relation}', '{c.column}', NULL)")
        else:
            rows.append(f"('{c.index_id}', '{c.relation}', '{c.column_male}', 'male')")
            rows.append(f"('{c.index_id}', '{c.relation}', '{c.column_female}', 'female')")
    return with_prepared(
        "SELECT m.index_id, relation, col AS column, count(CASE WHEN only_sex IS NULL OR only_sex = sex THEN value END) AS rows "
        f"FROM (VALUES {', '.join(rows)}) AS m(index_id, relation, col, only_sex) "
        "LEFT JOIN vals ON vals.index_id = m.index_id GROUP BY 1, 2, 3",
        long_values_cte(INDEX_IDS),
    )


def islet(src: Source) -> DataFrame:
    """Islet-hormone columns written with that implementation's insulin factor, compared under the same factor."""
    cohort = src.fixed_cohort()
    settings = ConversionSettings(insulin_pmol_per_uu=ISLET_INSULIN_FACTOR)
    other = cohort.selectExpr(
        "visit_id", "sex", "CASE WHEN g0 > 3.5D AND i0 > 0 THEN 20D * (i0 * 0.1667D) / (g0 - 3.5D) END AS Homa_beta",
        "CASE WHEN g30 > 0 AND i30 > 0 AND i0 > 0 THEN (i30 * 0.1667D - i0 * 0.1667D) / g30 END AS Xinsg30",
        "CASE WHEN gl0 > 0 AND gl120 > 0 THEN gl120 / gl0 END AS Glucagon_suppression_ratio",
    )
    results = []
    for name, used in (("islet factor", settings), ("default factor", ConversionSettings())):
        wide = calculate_wide(
            cohort, ids=["homa_beta", "insulinogenic_g30", "glucagon_ratio_120_0"], keep=["visit_id"], settings=used, status_columns=True
        )
        compared = compare_results(wide, other, ISLET_COLUMNS, "visit_id")
        results.append(verdict_counts(compared).withColumn("settings", F.lit(name)))
    return results[0].unionByName(results[1])


def _islet_sql() -> str:
    def verdict(name, index_id, match, there):
        return (
            f"SELECT '{name}' AS settings, '{index_id}' AS index_id, CASE WHEN ({status_sql(index_id)}) = 'ok' "
            f"THEN {match} ELSE 'unavailable_both' END AS verdict FROM prepared"
        )

    parts = []
    for name in ("islet factor", "default factor"):
        differs = "'match'" if name == "islet factor" else "'mismatch'"
        parts.append(verdict(name, "homa_beta", differs, None))
        zero = f"CASE WHEN i30 = i0 THEN 'match' ELSE {differs} END"
        parts.append(verdict(name, "insulinogenic_g30", zero, None))
        parts.append(verdict(name, "glucagon_ratio_120_0", "'match'", None))
    return with_prepared("SELECT settings, index_id, verdict, count(*) AS rows FROM (" + " UNION ALL ".join(parts) + ") GROUP BY 1, 2, 3")


QUERIES = {
    "A01_missing_reasons": Query(missing_reasons, MISSING_SQL),
    "A02_invalid_reasons": Query(invalid_reasons, INVALID_SQL),
    "A03_precedence": Query(precedence, _precedence_sql()),
    "A04_undefined": Query(undefined_reasons, UNDEFINED_SQL),
    "A05_warnings": Query(warnings, WARNINGS_SQL),
    "A06_deferred_methods": Query(deferred_rows, DEFERRED_SQL),
    "A07_details": Query(details, DETAILS_SQL),
    "B01_calculate_all": Query(calculate_all, CALCULATE_ALL_SQL),
    "B02_calculate_long": Query(long_layout, _long_layout_sql()),
    "B03_cohort_weight": Query(weight_row, WEIGHT_SQL),
    "B03_weighted_sim": Query(weighted_sim, WEIGHTED_SIM_SQL),
    "B03_given_weight": Query(given_weight, GIVEN_WEIGHT_SQL),
    "B04_status_columns": Query(status_columns, STATUS_COLUMNS_SQL),
    "B05_status_counts": Query(counts, COUNTS_SQL),
    "B05_merged_counts": Query(merged_counts, COUNTS_SQL),
    "B06_top_reasons": Query(frequent_reasons, TOP_SQL),
    "B07_selection": Query(selection, SELECTION_SQL),
    "B09_cohort_parts": Query(cohort_parts, PARTS_SQL),
    "B10_merge_parts": Query(merged, MERGED_SQL),
    "B10_merge_folder": Query(merged_folder, MERGED_SQL),
    "B10_part_problems": Query(misfits, MISFITS_SQL),
    "B11_run_manifest": Query(run_manifest, _manifest_sql()),
    "B12_method_catalog": Query(catalog_coverage, _catalog_sql()),
    "B14_availability": Query(available, _available_sql()),
    "O01_orient": Query(oriented, ORIENTED_SQL),
    "U01_series_auc": Query(auc, _curve_sql(
        f"{rounded_sql('auc')} AS auc, CASE WHEN points < 2 THEN 'requires at least two glucose time points' END AS reason"
    )),
    "U01_series_auc_long": Query(auc_long, AUC_LONG_SQL),
    "U02_time_weighted_mean": Query(weighted_mean, _curve_sql(
        f"{rounded_sql('CASE WHEN span > 0 THEN auc / span END')} AS time_weighted_mean"
    )),
    "U03_time_points": Query(time_points, _curve_sql("coalesce(times, '') AS time_points")),
    "U04_auc_file_units": Query(auc_file_units, _curve_sql(f"{rounded_sql('auc * 18E0', 4)} AS auc_mg_dl")),
    "R01_compare_results": Query(reconcile, RECONCILE_SQL),
    "R01_one_sided": Query(reconcile_one_sided, ONE_SIDED_SQL),
    "R02_counterpart_map": Query(mapping_coverage, _mapping_sql()),
    "R03_islet_map": Query(islet, _islet_sql()),
}
