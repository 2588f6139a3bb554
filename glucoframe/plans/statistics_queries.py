"""Queries over result values: transforms, descriptions, unit check, correlation, density, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoframe.functions import normal
from glucoframe.functions.normal import qnorm
from glucoframe.functions.units import unit_choice
from glucoframe.operators import correlation, density, descriptives, tally, transforms, unit_check
from glucoframe.operators.calculate import calculate_wide, to_long
from glucoframe.operators.catalog import GROUPS, INDEX_IDS, METHODS, Deferred, catalog, display_order
from glucoframe.operators.ranking import Limits, exact_quantiles
from glucoframe.operators.transforms import Transform
from glucoframe.plans.cohort_sql import with_cohort, with_prepared
from glucoframe.plans.index_sql import long_status_cte, long_values_cte, wide_values_cte
from glucoframe.plans.source import Query, Source, rounded, rounded_sql
from glucoframe.session import cut_lineage

SHOWN = list(INDEX_IDS)
VALS = long_values_cte(SHOWN)
BY_SEX = Transform("rint", "sex")


def graded(values: DataFrame) -> DataFrame:
    """Wide values on a grid of 1e-8. Two engines' logarithms differ in the last digit, which would make or break ties."""
    return values.select(*[rounded(c, 8).alias(c) if c in INDEX_IDS else F.col(c) for c in values.columns])


def graded_long(src: Source) -> DataFrame:
    return to_long(graded(src.values(SHOWN)), SHOWN, ["visit_id", "sex"])


GRADED = f"graded AS (SELECT visit_id, sex, index_id, {rounded_sql('value', 8)} AS value FROM vals)"
GRADED_WIDE = "graded_wide AS (SELECT visit_id, sex, " + ", ".join(f"{rounded_sql(i, 8)} AS {i}" for i in SHOWN) + " FROM wide)"


def rounded_all(df: DataFrame, decimals: int = 6) -> DataFrame:
    return df.select(*[
        rounded(f.name, decimals).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema
    ])


# ---------- transforms ----------

def ranks(src: Source) -> DataFrame:
    return transforms.rank_long(graded_long(src)).select("visit_id", "index_id", "rank")


_RANK = (
    "rank() OVER (PARTITION BY {keys} ORDER BY value) + (count(*) OVER (PARTITION BY {keys}, value) - 1) / 2E0"
)


def _ranked(keys: str, where: str = "TRUE", of: str = "graded") -> str:
    return (
        f"ranked AS (SELECT visit_id, sex, index_id, value, {_RANK.format(keys=keys)} AS rank, "
        f"count(*) OVER (PARTITION BY {keys}) AS n FROM {of} WHERE {where})"
    )


RANK_SQL = with_prepared(
    "SELECT visit_id, index_id, CAST(rank AS DOUBLE) AS rank FROM ranked", VALS, GRADED, _ranked("index_id")
)


def logs(src: Source) -> DataFrame:
    long = transforms.transform_long(src.long_values(SHOWN), Transform("log"))
    return long.select("visit_id", "index_id", rounded("transformed").alias("transformed"))


LOG_SQL = with_prepared(
    f"SELECT visit_id, index_id, {rounded_sql('CASE WHEN value > 0 THEN ln(value) END')} AS transformed FROM vals", VALS
)


def z_scores(src: Source) -> DataFrame:
    long = transforms.transform_long(src.long_values(SHOWN), Transform("z"))
    return long.select("visit_id", "index_id", rounded("transformed").alias("transformed"))


_Z = "(value - avg(value) OVER (PARTITION BY {k})) / stddev_samp(value) OVER (PARTITION BY {k})"
Z_SQL = with_prepared(
    f"SELECT visit_id, index_id, {rounded_sql(_Z.format(k='index_id'))} AS transformed FROM vals", VALS
)


def rint(src: Source) -> DataFrame:
    long = transforms.transform_long(graded_long(src), Transform("rint"))
    return long.select("visit_id", "index_id", rounded("transformed").alias("transformed"))


def qnorm_sql(p: str) -> str:
    """The same quantile algorithm as SQL."""
    q = f"({p} - 5E-1)"
    r = f"(180625E-6 - {q} * {q})"
    t = f"sqrt(-ln(least({p}, 1 - {p})))"
    middle = f"{_sql_ratio(normal.MIDDLE_NUM, normal.MIDDLE_DEN, f'({t} - 16E-1)')}"
    far = f"{_sql_ratio(normal.TAIL_NUM, normal.TAIL_DEN, f'({t} - 5E0)')}"
    size = f"(CASE WHEN {t} <= 5 THEN {middle} ELSE {far} END)"
    return (
        f"CASE WHEN abs({q}) <= 425E-3 THEN {q} * {_sql_ratio(normal.CENTRE_NUM, normal.CENTRE_DEN, r)} "
        f"WHEN {q} < 0 THEN -{size} ELSE {size} END"
    )


def _sql_ratio(numerator, denominator, x: str) -> str:
    def poly(coefficients):
        text = f"{coefficients[-1]:.17E}"
        for c in reversed(coefficients[:-1]):
            text = f"({text} * {x} + {c:.17E})"
        return text

    return f"({poly(numerator)} / {poly(denominator)})"


_BLOM = "((rank - 375E-3) / (n + 25E-2))"
RINT_SQL = with_prepared(
    f"SELECT visit_id, index_id, {rounded_sql(qnorm_sql('p'))} AS transformed FROM (SELECT *, {_BLOM} AS p FROM ranked)",
    VALS, GRADED, _ranked("index_id"),
)


def quantiles_of_normal(src: Source) -> DataFrame:
    """The normal quantile at (row - 1/2) / rows of all visits, tails included."""
    visits = src.cohort().select(F.col("visit_id").alias("value"), F.lit("visit").alias("index_id"))
    ranked = transforms.rank_long(visits)
    total = F.lit(visits.count())
    return ranked.select(F.col("value").alias("visit_id"), rounded(qnorm((F.col("rank") - 0.5) / total), 8).alias("quantile"))


QNORM_SQL = with_cohort(
    f"SELECT visit_id, {rounded_sql(qnorm_sql('p'), 8)} AS quantile FROM (SELECT visit_id, "
    "(row_number() OVER (ORDER BY visit_id) - 5E-1) / count(*) OVER () AS p FROM cohort)"
)


def rint_by_sex(src: Source) -> DataFrame:
    long = transforms.transform_long(graded_long(src), BY_SEX)
    return long.select("visit_id", "sex", "index_id", rounded("transformed").alias("transformed"))


RINT_BY_SEX_SQL = with_prepared(
    f"SELECT visit_id, sex, index_id, {rounded_sql(qnorm_sql('p'))} AS transformed "
    f"FROM (SELECT *, {_BLOM} AS p FROM ranked)",
    VALS, GRADED, _ranked("index_id, sex", "sex IS NOT NULL"),
)


def rint_by_sex_hot(src: Source) -> DataFrame:
    """The same with runs of equal values that no task holds back, and without broadcasts of the offsets."""
    long = transforms.transform_long(graded_long(src), BY_SEX, Limits(held=2, broadcast_rows=0))
    return long.select("visit_id", "sex", "index_id", rounded("transformed").alias("transformed"))


def z_by_sex_layout(src: Source) -> DataFrame:
    """Each transformed column directly after its source."""
    table = transforms.transform_results(src.values(SHOWN), Transform("z", "sex"), key="visit_id")
    return rounded_all(table)


def _wide_z(i: str) -> str:
    return f"CASE WHEN sex IS NOT NULL THEN ({i} - avg({i}) OVER (PARTITION BY sex)) / stddev_samp({i}) OVER (PARTITION BY sex) END"


Z_LAYOUT_SQL = with_prepared(
    "SELECT visit_id, sex, " + ", ".join(f"{rounded_sql(i)} AS {i}, {rounded_sql(_wide_z(i))} AS {i}_z_bysex" for i in SHOWN)
    + " FROM wide",
    wide_values_cte(SHOWN),
)


def transformed_file(src: Source) -> DataFrame:
    """A results table whose sex labels are looked up in the original one, RINT within sex."""
    values = graded(src.values(SHOWN))
    attached = transforms.attach_sex(values.drop("sex"), values, key="visit_id")
    return rounded_all(transforms.transform_results(attached, BY_SEX, key="visit_id"))


def repeated_ids(src: Source) -> DataFrame:
    """Two visits share each id; RINT over everybody keeps them apart."""
    values = src.values(["homa_ir", "lap"]).withColumn("visit_id", F.expr("visit_id div 2"))
    return rounded_all(transforms.transform_results(values, Transform("rint"), key="visit_id"))


def _rint_wide(columns: list[str]) -> str:
    return ", ".join(f"{rounded_sql(f'max(CASE WHEN index_id = {i!r} THEN z END)')} AS {i}_rint_bysex" for i in columns)


TRANSFORMED_SQL = with_prepared(
    "SELECT w.visit_id, sex, " + ", ".join(f"{rounded_sql(i)} AS {i}, {i}_rint_bysex" for i in SHOWN)
    + " FROM graded_wide w LEFT JOIN added ON w.visit_id = added.visit_id",
    VALS, GRADED, wide_values_cte(SHOWN), GRADED_WIDE, _ranked("index_id, sex", "sex IS NOT NULL"),
    f"added AS (SELECT visit_id, {_rint_wide(SHOWN)} FROM (SELECT *, {qnorm_sql('p')} AS z FROM "
    f"(SELECT *, {_BLOM} AS p FROM ranked)) GROUP BY visit_id)",
)


REPEATED_SQL = with_prepared(
    "SELECT visit_id // 2 AS visit_id, sex, "
    + ", ".join(f"{rounded_sql(i)} AS {i}, {rounded_sql(f'CASE WHEN {i} IS NOT NULL THEN {qnorm_sql(p)} END')} AS {i}_rint"
                for i, p in (("homa_ir", "p1"), ("lap", "p2")))
    + " FROM (SELECT *, "
    + ", ".join(
        f"((rank() OVER (ORDER BY {i} NULLS LAST) + (count(*) OVER (PARTITION BY {i}) - 1) / 2E0 - 375E-3) / (count({i}) OVER () + 25E-2)) AS p{k}"
        for k, i in ((1, "homa_ir"), (2, "lap")))
    + " FROM wide)",
    wide_values_cte(["homa_ir", "lap"]),
)


def keep_only(src: Source) -> DataFrame:
    table = transforms.transform_results(src.values(SHOWN), Transform("log"), key="visit_id", keep_only=True)
    return rounded_all(table)


KEEP_ONLY_SQL = with_prepared(
    "SELECT visit_id, "
    + ", ".join(f"{rounded_sql(f'CASE WHEN {i} > 0 THEN ln({i}) END')} AS {i}_log" for i in SHOWN) + " FROM wide",
    wide_values_cte(SHOWN),
)


def report(src: Source) -> DataFrame:
    return transforms.transform_report(src.values(SHOWN), Transform("log", "sex"), SHOWN)


REPORT_SQL = with_prepared(
    "SELECT v.index_id, v.sex, count(*) AS n, count(CASE WHEN value <= 0 THEN 1 END) AS non_positive, "
    "CAST(NULL AS VARCHAR) AS not_transformed, max(l.no_group) AS no_group FROM vals v "
    "JOIN (SELECT index_id, count(CASE WHEN sex IS NULL THEN 1 END) AS no_group FROM vals GROUP BY 1) l "
    "ON v.index_id = l.index_id WHERE sex IS NOT NULL GROUP BY 1, 2",
    VALS,
)

# ---------- description ----------


def describe(src: Source) -> DataFrame:
    values = src.values(INDEX_IDS)
    rows = values.count()
    return rounded_all(descriptives.describe(to_long(values, INDEX_IDS, []), rows, ids=INDEX_IDS), 3)


ALL_VALS = long_values_cte(INDEX_IDS)
DESCRIBE_SQL = with_prepared(
    "SELECT index_id, count(*) AS n, (SELECT count(*) FROM prepared) - count(*) AS missing, "
    + ", ".join(
        f"{rounded_sql(e, 3)} AS {n}"
        for n, e in {
            "mean": "avg(value)", "sd": "stddev_samp(value)", "median": "quantile_cont(value, 5E-1)",
            "q1": "quantile_cont(value, 25E-2)", "q3": "quantile_cont(value, 75E-2)", "min": "min(value)",
            "max": "max(value)", "skewness": "skewness(value)",
        }.items()
    )
    + ", count(CASE WHEN value <= 0 THEN 1 END) AS non_positive FROM vals GROUP BY 1",
    ALL_VALS,
)


def quantiles(src: Source) -> DataFrame:
    probabilities = [0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0]
    found = exact_quantiles(src.long_values(SHOWN), ["index_id"], probabilities)
    return rounded_all(found)


QUANTILES_SQL = with_prepared(
    "SELECT index_id, count(*) AS n, "
    + ", ".join(
        f"{rounded_sql(f'quantile_cont(value, {p})')} AS q{k}"
        for k, p in enumerate(("0", "1E-2", "1E-1", "5E-1", "9E-1", "99E-2", "1"))
    )
    + " FROM vals GROUP BY 1",
    VALS,
)


def quantiles_bracketed(src: Source) -> DataFrame:
    """The same by the plan for very many rows: brackets of a coarse sketch, and shuffled joins."""
    probabilities = [0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0]
    return rounded_all(exact_quantiles(src.long_values(SHOWN), ["index_id"], probabilities, limits=Limits(accuracy=200, broadcast_rows=0)))


def skewness(src: Source) -> DataFrame:
    long = src.long_values(SHOWN)
    return long.groupBy("index_id").agg(rounded(descriptives.adjusted_skewness()).alias("skewness"))


SKEWNESS_SQL = with_prepared(f"SELECT index_id, {rounded_sql('skewness(value)')} AS skewness FROM vals GROUP BY 1", VALS)


def medians_by_sex(src: Source) -> DataFrame:
    return rounded_all(descriptives.sex_medians(src.long_values(SHOWN)))


MEDIANS_SQL = with_prepared(
    f"SELECT index_id, sex, count(*) AS n, {rounded_sql('quantile_cont(value, 5E-1)')} AS median FROM vals "
    "WHERE sex IS NOT NULL GROUP BY 1, 2",
    VALS,
)


def split_by_sex(src: Source) -> DataFrame:
    return descriptives.sex_split(to_long(calculate_wide(src.cohort(), keep=["sex"]), INDEX_IDS, ["sex"]))


SPLIT_SQL = with_prepared(
    "SELECT index_id, count(CASE WHEN sex = 'male' THEN 1 END) AS male, count(CASE WHEN sex = 'female' THEN 1 END) "
    "AS female, count(CASE WHEN sex IS NULL THEN 1 END) AS no_sex FROM vals GROUP BY 1",
    ALL_VALS,
)


def not_positive(src: Source) -> DataFrame:
    return descriptives.non_positive(to_long(calculate_wide(src.cohort(), keep=[]), INDEX_IDS, []))


NOT_POSITIVE_SQL = with_prepared(
    "SELECT index_id, count(CASE WHEN value <= 0 THEN 1 END) AS non_positive FROM vals GROUP BY 1", ALL_VALS
)


def summary(src: Source) -> DataFrame:
    cohort = src.fixed_cohort()
    wide = cut_lineage(calculate_wide(cohort, keep=["visit_id", "sex"], status_columns=True))
    table = descriptives.summary_table(
        to_long(wide, INDEX_IDS, ["sex"]), tally.status_counts(tally.status_long(wide)), tally.top_reasons(tally.reason_counts(cohort)),
        catalog(src.spark),
    )
    flat = table.withColumn("why", F.array_join("why", " / ")).drop("position", "name")
    return rounded_all(flat, 4)


SUMMARY_SQL = with_prepared(
    "SELECT s.method_id, s.category, n_ok, n_missing, nullif(coalesce(why, ''), '') AS why, "
    + ", ".join(f"{rounded_sql(c, 4)} AS {c}" for c in ("median", "q1", "q3", "skewness", "median_male", "median_female"))
    + " FROM s LEFT JOIN w ON s.method_id = w.method_id LEFT JOIN d ON s.method_id = d.index_id",
    long_status_cte(INDEX_IDS, reasons=True),
    ALL_VALS,
    "categories AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{m.id}', '{m.category}')" for m in METHODS if not isinstance(m, Deferred))
    + ") AS t(id, category))",
    "s AS (SELECT method_id, max(category) AS category, count(CASE WHEN status = 'ok' THEN 1 END) AS n_ok, "
    "count(CASE WHEN status <> 'ok' THEN 1 END) AS n_missing FROM statuses JOIN categories ON id = method_id GROUP BY 1)",
    "r AS (SELECT method_id, status, reason, count(*) AS rows FROM statuses WHERE status <> 'ok' GROUP BY 1, 2, 3)",
    "p AS (SELECT *, row_number() OVER (PARTITION BY method_id, status ORDER BY rows DESC, reason) AS place FROM r)",
    "w AS (SELECT method_id, string_agg(CASE WHEN status = 'error' THEN 'error: ' ELSE '' END || reason || ' (' || "
    "CAST(rows AS VARCHAR) || ')', ' / ' ORDER BY CASE WHEN status = 'error' THEN 1 ELSE 0 END, place) AS why "
    "FROM p WHERE place <= 3 GROUP BY 1)",
    "d AS (SELECT index_id, quantile_cont(value, 5E-1) AS median, quantile_cont(value, 25E-2) AS q1, "
    "quantile_cont(value, 75E-2) AS q3, skewness(value) AS skewness, "
    "quantile_cont(CASE WHEN sex = 'male' THEN value END, 5E-1) AS median_male, "
    "quantile_cont(CASE WHEN sex = 'female' THEN value END, 5E-1) AS median_female FROM vals GROUP BY 1)",
)


def units(src: Source) -> DataFrame:
    """The cohort is canonical, but glucose, insulin and HDL are declared in other units."""
    declared = unit_choice(glucose="mg/dL", insulin="uU/mL", hdl="mg/dL")
    return rounded_all(unit_check.check_units(src.fixed_cohort(), declared))


def _units_sql() -> str:
    rows = [
        ("glucose", "G0", "g0", "mg/dL", "mmol/L"), ("insulin", "I0", "i0", "uU/mL", "pmol/L"),
        ("glucagon", "Glucagon0", "gl0", "pmol/L", None), ("tg", "TG", "tg", "mmol/L", None),
        ("hdl", "HDL_c", "hdl", "mg/dL", "mmol/L"), ("ffa", "FFA", "ffa0", "mmol/L", None),
    ]
    return with_cohort(" UNION ALL ".join(
        f"SELECT '{q}' AS quantity, '{name}' AS column, count({c}) AS n, {rounded_sql(f'quantile_cont({c}, 5E-1)')} AS median, "
        f"'{selected}' AS selected, {'NULL' if suggested is None else repr(suggested)} AS suggested FROM cohort"
        for q, name, c, selected, suggested in rows
    ))


def check_time(src: Source) -> DataFrame:
    """Without fasting glucose the 120-minute values are checked; insulin without fasting values is not."""
    cohort = src.cohort().select("g30", "g120", "i120", "tg")
    chosen = unit_check.check_units(cut_lineage(cohort))
    return chosen.select("quantity", "column", "n")


CHECK_TIME_SQL = with_cohort(
    "SELECT 'glucose' AS quantity, 'G120' AS column, count(g120) AS n FROM cohort "
    "UNION ALL SELECT 'tg', 'TG', count(tg) FROM cohort"
)

# ---------- correlation ----------


def pearson_pair(src: Source) -> DataFrame:
    found = correlation.pearson(calculate_wide(src.cohort(), ids=SHOWN, keep=[]), "homa_ir", "tg_hdl")
    return rounded_all(found)


PEARSON_PAIR_SQL = with_prepared(
    f"SELECT count(*) AS n, {rounded_sql('corr(homa_ir, tg_hdl)')} AS r FROM wide "
    "WHERE homa_ir IS NOT NULL AND tg_hdl IS NOT NULL",
    wide_values_cte(SHOWN),
)


def spearman_pair(src: Source) -> DataFrame:
    return rounded_all(correlation.spearman(src.values(SHOWN), "homa_ir", "tg_hdl"))


def spearman_pair_repeated(src: Source) -> DataFrame:
    """Rows that share an id or have none count like any other."""
    values = src.values(SHOWN).withColumn("visit_id", F.expr("CASE WHEN visit_id % 3 = 0 THEN visit_id div 4 END"))
    return rounded_all(correlation.spearman(values, "homa_ir", "tg_hdl"))


def _pair_ranks(x: str, y: str) -> str:
    def rank(c):
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2E0"

    return (
        f"(SELECT {rank(x)} AS a, {rank(y)} AS b FROM wide WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    )


SPEARMAN_PAIR_SQL = with_prepared(
    f"SELECT count(*) AS n, {rounded_sql('corr(a, b)')} AS rho FROM {_pair_ranks('homa_ir', 'tg_hdl')}",
    wide_values_cte(SHOWN),
)


def pearson_matrix(src: Source) -> DataFrame:
    matrix = correlation.pearson_matrix(src.values(INDEX_IDS), INDEX_IDS)
    return rounded_all(matrix)


PEARSON_SQL = with_prepared(
    "SELECT a.index_id AS row, b.index_id AS col, "
    + rounded_sql(
        "CASE WHEN count(*) >= 3 AND min(a.value) < max(a.value) AND min(b.value) < max(b.value) "
        "THEN CASE WHEN a.index_id = b.index_id THEN 1E0 ELSE corr(a.value, b.value) END END"
    )
    + " AS value, count(*) AS n FROM vals a JOIN vals b ON a.visit_id = b.visit_id GROUP BY a.index_id, b.index_id",
    ALL_VALS.replace("vals AS (", "vals AS MATERIALIZED (", 1),
)


_EVERY_PAIR = (
    "grid AS (SELECT a.i AS row, b.i AS col FROM (VALUES " + ", ".join(f"('{i}')" for i in SHOWN) + ") AS a(i), (VALUES "
    + ", ".join(f"('{i}')" for i in SHOWN) + ") AS b(i))"
)


def _pearson_cells(name: str, of: str) -> str:
    varies = "count(*) >= 3 AND min(a.value) < max(a.value) AND min(b.value) < max(b.value)"
    return (
        f"{name} AS (SELECT a.index_id AS row, b.index_id AS col, CASE WHEN {varies} THEN CASE WHEN a.index_id = b.index_id THEN 1E0 "
        f"ELSE corr(a.value, b.value) END END AS v, count(*) AS n FROM {of} a JOIN {of} b ON a.visit_id = b.visit_id GROUP BY 1, 2)"
    )


_INFINITE_CTES = (_pearson_cells("m", "finite"), _EVERY_PAIR)


def pearson_with_infinite(src: Source) -> DataFrame:
    """Infinite and NaN values in four columns count as missing."""
    spoilt = src.values(SHOWN).withColumns({
        c: F.when(F.col("visit_id") % 50 == k, F.lit(float(what))).otherwise(F.col(c))
        for k, (c, what) in enumerate((("homa_ir", "inf"), ("tg_hdl", "-inf"), ("lap", "nan"), ("tyg", "inf")))
    })
    return rounded_all(correlation.pearson_matrix(spoilt, SHOWN))


INFINITE_SQL = with_prepared(
    f"SELECT row, col, {rounded_sql('v')} AS value, coalesce(n, 0) AS n FROM grid LEFT JOIN m USING (row, col)",
    VALS.replace("vals AS (", "vals AS MATERIALIZED (", 1),
    "finite AS (SELECT * FROM vals WHERE NOT (index_id = 'homa_ir' AND visit_id % 50 = 0) AND NOT (index_id = 'tg_hdl' AND visit_id % 50 = 1) "
    "AND NOT (index_id = 'lap' AND visit_id % 50 = 2) AND NOT (index_id = 'tyg' AND visit_id % 50 = 3))",
    *_INFINITE_CTES,
)


def spearman_matrix(src: Source) -> DataFrame:
    return rounded_all(correlation.spearman_matrix(graded(src.computed(SHOWN)), SHOWN))


def _spearman_ctes(of: str) -> tuple[str, ...]:
    """Every pair once, ranked over the visits that have both; then both ways round and the diagonal."""
    rank = "rank() OVER (PARTITION BY i, j ORDER BY {c}) + (count(*) OVER (PARTITION BY i, j, {c}) - 1) / 2E0"
    return (
        f"pairs AS (SELECT a.index_id AS i, b.index_id AS j, a.value AS x, b.value AS y FROM {of} a JOIN {of} b "
        "ON a.visit_id = b.visit_id AND a.index_id < b.index_id)",
        f"ranks AS (SELECT i, j, {rank.format(c='x')} AS x, {rank.format(c='y')} AS y FROM pairs)",
        "upper AS (SELECT i, j, CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS v, count(*) AS n "
        "FROM ranks GROUP BY 1, 2)",
        "cells AS (SELECT i AS row, j AS col, v, n FROM upper UNION ALL SELECT j, i, v, n FROM upper UNION ALL "
        f"SELECT index_id, index_id, CASE WHEN count(*) >= 3 AND min(value) < max(value) THEN 1E0 END, count(*) FROM {of} GROUP BY 1)",
        _EVERY_PAIR,
    )


_CELLS = f"SELECT row, col, {rounded_sql('v')} AS value, coalesce(n, 0) AS n FROM grid LEFT JOIN cells USING (row, col)"
SPEARMAN_SQL = with_prepared(_CELLS, VALS, GRADED, *_spearman_ctes("graded"))


def members(src: Source) -> DataFrame:
    """Indices with at least 3 values, by group and then name."""
    long = to_long(calculate_wide(src.cohort(), keep=[]), INDEX_IDS, [])
    order = display_order()
    found = correlation.matrix_members(long, order)
    return src.spark.createDataFrame([(k, i) for k, i in enumerate(found)], "position int, index_id string")


def _members_sql() -> str:
    labels = {g: k for k, (g, _) in enumerate(GROUPS)}
    rows = ", ".join(
        f"('{m.id}', {labels[m.category]}, '{m.name.lower()}')" for m in METHODS if not isinstance(m, Deferred)
    )
    return with_prepared(
        "SELECT CAST(row_number() OVER (ORDER BY g, name) - 1 AS INTEGER) AS position, index_id FROM "
        f"(VALUES {rows}) AS t(id, g, name) JOIN (SELECT index_id FROM vals GROUP BY 1 HAVING count(*) >= 3) ON id = index_id",
        ALL_VALS,
    )


def comparison(src: Source) -> DataFrame:
    """Pearson on raw values against Pearson on logs (which drop values <= 0)."""
    values = src.values(SHOWN)
    raw = correlation.correlation_matrix(values, SHOWN, "visit_id", "pearson")
    logged = correlation.correlation_matrix(values, SHOWN, "visit_id", "pearson", Transform("log"))
    return rounded_all(correlation.compare_matrices(raw, logged))


COMPARISON_SQL = with_prepared(
    "SELECT row, col, "
    f"{rounded_sql('a.v')} AS raw, {rounded_sql('b.v')} AS transformed, {rounded_sql('b.v - a.v')} AS difference, "
    "coalesce(a.n, 0) AS n_raw, coalesce(b.n, 0) AS n_transformed FROM grid LEFT JOIN m1 a USING (row, col) LEFT JOIN m2 b USING (row, col)",
    VALS.replace("vals AS (", "vals AS MATERIALIZED (", 1),
    "logged AS (SELECT visit_id, index_id, ln(value) AS value FROM vals WHERE value > 0)",
    _pearson_cells("m1", "vals"), _pearson_cells("m2", "logged"), _EVERY_PAIR,
)


def spearman_by_sex_rint(src: Source) -> DataFrame:
    """Spearman of values that were rank-normalised within sex."""
    matrix = correlation.correlation_matrix(graded(src.computed(SHOWN)), SHOWN, "visit_id", "spearman", BY_SEX)
    return rounded_all(matrix)


SPEARMAN_BY_SEX_SQL = with_prepared(
    _CELLS, VALS, GRADED, _ranked("index_id, sex", "sex IS NOT NULL"),
    f"changed AS (SELECT visit_id, index_id, {_BLOM} AS value FROM ranked)", *_spearman_ctes("changed"),
)


def matrix_layout(src: Source) -> DataFrame:
    matrix = correlation.pearson_matrix(src.values(SHOWN), SHOWN)
    return rounded_all(correlation.matrix_table(matrix, SHOWN))


def _corr_cell(a: str, b: str) -> str:
    return "1E0" if a == b else f"corr({a}, {b})"


MATRIX_LAYOUT_SQL = with_prepared(
    " UNION ALL ".join(
        f"SELECT '{a}' AS index, " + ", ".join(f"{rounded_sql(_corr_cell(a, b))} AS {b}" for b in SHOWN) + " FROM wide"
        for a in SHOWN
    ),
    wide_values_cte(SHOWN),
)


def matrix_counts(src: Source) -> DataFrame:
    matrix = correlation.pearson_matrix(src.values(SHOWN), SHOWN)
    return correlation.matrix_table(matrix, SHOWN, "n")


MATRIX_COUNTS_SQL = with_prepared(
    " UNION ALL ".join(
        f"SELECT '{a}' AS index, "
        + ", ".join(f"count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS {b}" for b in SHOWN) + " FROM wide"
        for a in SHOWN
    ),
    wide_values_cte(SHOWN),
)


def scatter(src: Source) -> DataFrame:
    in_order = src.values(SHOWN).repartitionByRange("visit_id").sortWithinPartitions("visit_id")  # the row order of this table
    found = correlation.scatter_sample(in_order, "homa_ir", "tg_hdl", "visit_id", at_most=1000)
    return rounded_all(found)


SCATTER_SQL = with_prepared(
    f"SELECT visit_id, {rounded_sql('homa_ir')} AS x, {rounded_sql('tg_hdl')} AS y, n AS total FROM both_present "
    "JOIN (SELECT n, CASE WHEN n <= 1000 THEN k ELSE k * n // 1000 END AS p FROM (SELECT count(*) AS n FROM both_present), "
    "(SELECT unnest(range(0, 1000)) AS k)) ON row_no - 1 = p",
    wide_values_cte(SHOWN),
    "both_present AS (SELECT *, row_number() OVER (ORDER BY visit_id) AS row_no FROM wide "
    "WHERE homa_ir IS NOT NULL AND tg_hdl IS NOT NULL)",
)

# ---------- density and histogram ----------
GROUPED = (
    "grouped AS (SELECT index_id, 'all' AS \"group\", value FROM vals UNION ALL SELECT index_id, sex, value FROM vals "
    "WHERE sex IS NOT NULL)"
)
STATS = (
    "stats AS (SELECT index_id, \"group\", count(*) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi, "
    "quantile_cont(value, 25E-2) AS q1, quantile_cont(value, 75E-2) AS q3, quantile_cont(value, 5E-1) AS median "
    "FROM grouped GROUP BY 1, 2), "
    "widths AS (SELECT *, 9E-1 * CASE WHEN least(sd, (q3 - q1) / 134E-2) > 0 THEN least(sd, (q3 - q1) / 134E-2) "
    "WHEN sd > 0 THEN sd WHEN abs(lo) > 0 THEN abs(lo) ELSE 1E0 END * pow(n, -2E-1) AS bw FROM stats WHERE n >= 2)"
)


def bandwidth(src: Source) -> DataFrame:
    grouped = density.with_pooled(src.long_values(SHOWN))
    found = density.bandwidths(grouped, ["index_id", "group"])
    return rounded_all(found.select("index_id", "group", "n", "median", "bandwidth"))


BANDWIDTH_SQL = with_prepared(
    f"SELECT index_id, \"group\", n, {rounded_sql('median')} AS median, {rounded_sql('bw')} AS bandwidth FROM widths",
    VALS, GROUPED, STATS,
)


def exact_density(src: Source) -> DataFrame:
    found = density.density(src.long_values(INDEX_IDS), ["index_id"])
    return rounded_all(found)


_GRID = (
    "grid AS (SELECT index_id, \"group\", n, bw, lo - 3 * bw + k * ((hi + 3 * bw) - (lo - 3 * bw)) / 255 AS x "
    "FROM widths, (SELECT unnest(range(0, 256)) AS k))"
)
EXACT_SQL = with_prepared(
    f"SELECT g.index_id, g.n, {rounded_sql('g.bw')} AS bandwidth, {rounded_sql('x')} AS x, "
    f"{rounded_sql('sum(exp(-5E-1 * ((x - value) / g.bw) * ((x - value) / g.bw))) / (sqrt(2 * pi()) * g.bw * g.n)')} AS density "
    "FROM grid g JOIN vals v ON g.index_id = v.index_id GROUP BY g.index_id, g.n, g.bw, x",
    ALL_VALS, "grouped AS (SELECT index_id, 'all' AS \"group\", value FROM vals)", STATS, _GRID,
)


def binned_density(src: Source) -> DataFrame:
    """Every index, its values summed into bins first."""
    found = density.density(src.long_values(INDEX_IDS), ["index_id"], method="binned")
    return rounded_all(found)


BINNED_SQL = with_prepared(
    f"SELECT g.index_id, g.n, {rounded_sql('g.bw')} AS bandwidth, {rounded_sql('x')} AS x, "
    f"{rounded_sql('coalesce(sum(w * exp(-5E-1 * ((x - c) / g.bw) * ((x - c) / g.bw))), 0) / (sqrt(2 * pi()) * g.bw * g.n)')} AS density "
    "FROM grid g LEFT JOIN weights v ON g.index_id = v.index_id AND abs(x - c) <= 9 * g.bw GROUP BY g.index_id, g.n, g.bw, x",
    ALL_VALS, "grouped AS (SELECT index_id, 'all' AS \"group\", value FROM vals)", STATS, _GRID,
    "binned AS (SELECT *, (hi - lo) / (b - 1) AS step FROM (SELECT index_id, lo, hi, "
    "greatest(2048, ceil(32 * (hi - lo) / bw)) AS b FROM widths))",
    "placed AS (SELECT v.index_id, lo, step, (value - lo) / step AS p, least(b - 2, floor((value - lo) / step)) AS j "
    "FROM vals v JOIN binned ON v.index_id = binned.index_id)",
    "weights AS (SELECT index_id, lo + j * step AS c, sum(w) AS w FROM (SELECT index_id, lo, step, j, 1 - (p - j) AS w "
    "FROM placed UNION ALL SELECT index_id, lo, step, j + 1, p - j FROM placed) GROUP BY index_id, lo, step, j)",
)


def densities(src: Source) -> DataFrame:
    """Curves of everybody, men and women."""
    curves = density.group_densities(src.long_values(INDEX_IDS))
    return curves.groupBy("index_id", "scale", "group").agg(
        F.max("n").alias("n"), rounded(F.max("bandwidth")).alias("bandwidth"), F.count("x").alias("points"),
        rounded(F.max("density")).alias("peak"),
    )


DENSITIES_SQL = with_prepared(
    f"SELECT index_id, 'none' AS scale, \"group\", max(n) AS n, {rounded_sql('max(bw)')} AS bandwidth, count(*) AS points, "
    f"{rounded_sql('max(d)')} AS peak FROM (SELECT g.index_id, g.\"group\", g.n, g.bw, x, "
    "sum(exp(-5E-1 * ((x - value) / g.bw) * ((x - value) / g.bw))) / (sqrt(2 * pi()) * g.bw * g.n) AS d "
    "FROM grid g JOIN grouped v ON g.index_id = v.index_id AND g.\"group\" = v.\"group\" GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 3",
    ALL_VALS, GROUPED, STATS, _GRID,
)


def density_table(src: Source) -> DataFrame:
    return rounded_all(_density_table(src))


def _density_table(src: Source) -> DataFrame:
    """The export layout of a transformed scale."""
    long = transforms.transform_long(src.long_values(INDEX_IDS), Transform("log"))
    logged = long.where("transformed IS NOT NULL").select("index_id", "sex", F.col("transformed").alias("value"))
    return density.group_densities(logged, "log")


DENSITY_TABLE_SQL = with_prepared(
    f"SELECT g.index_id, 'log' AS scale, g.\"group\", g.n, {rounded_sql('g.bw')} AS bandwidth, {rounded_sql('x')} AS x, "
    f"{rounded_sql('sum(exp(-5E-1 * ((x - value) / g.bw) * ((x - value) / g.bw))) / (sqrt(2 * pi()) * g.bw * g.n)')} AS density "
    "FROM grid g JOIN grouped v ON g.index_id = v.index_id AND g.\"group\" = v.\"group\" "
    "GROUP BY g.index_id, g.\"group\", g.n, g.bw, x",
    long_values_cte(INDEX_IDS, "raw_vals"),
    "vals AS (SELECT visit_id, sex, index_id, ln(value) AS value FROM raw_vals WHERE value > 0)", GROUPED, STATS, _GRID,
)


def histogram(src: Source) -> DataFrame:
    return rounded_all(density.histogram(src.long_values(INDEX_IDS), ["index_id"], least=10, most=60))


def _bins_cte(of: str) -> str:
    return (
        f"hstats AS (SELECT index_id, count(*) AS n, min(value) AS lo0, max(value) AS hi0, quantile_cont(value, 25E-2) AS q1, "
        f"quantile_cont(value, 75E-2) AS q3 FROM {of} GROUP BY 1), "
        "bins AS (SELECT index_id, CASE WHEN hi0 > lo0 THEN lo0 ELSE lo0 - 5E-1 END AS lo, "
        "CASE WHEN hi0 > lo0 THEN hi0 ELSE hi0 + 5E-1 END AS hi, CAST(ceil(CASE WHEN q3 > q1 AND hi0 > lo0 "
        "THEN (hi0 - lo0) / (2 * (q3 - q1) * pow(n, -1E0 / 3E0)) ELSE log2(n) + 1 END) AS BIGINT) AS wanted, "
        "CAST(greatest(10, least(60, wanted)) AS INTEGER) AS b FROM hstats), "
        "listed AS (SELECT index_id, lo, (hi - lo) / b AS w, b, wanted, CAST(k AS INTEGER) AS bin FROM bins, "
        "(SELECT unnest(range(0, 60)) AS k) WHERE k < b)"
    )


_AT = "CAST(least(b - 1, floor((value - lo) / ((hi - lo) / b))) AS INTEGER)"
HISTOGRAM_SQL = with_prepared(
    f"SELECT l.index_id, l.bin, {rounded_sql('l.lo + l.bin * l.w')} AS lo, {rounded_sql('l.lo + (l.bin + 1) * l.w')} AS hi, "
    "coalesce(c.k, 0) AS count, wanted FROM listed l LEFT JOIN "
    f"(SELECT v.index_id, {_AT} AS bin, count(*) AS k FROM vals v JOIN bins ON v.index_id = bins.index_id GROUP BY 1, 2) c "
    "ON l.index_id = c.index_id AND l.bin = c.bin",
    ALL_VALS, _bins_cte("vals"),
)


def histogram_sex(src: Source) -> DataFrame:
    return rounded_all(density.histogram_by_sex(src.long_values(INDEX_IDS), least=10, most=60))


HISTOGRAM_SEX_SQL = with_prepared(
    f"SELECT l.index_id, s.sex, l.bin, {rounded_sql('l.lo + l.bin * l.w')} AS lo, "
    f"{rounded_sql('l.lo + (l.bin + 1) * l.w')} AS hi, coalesce(c.k, 0) AS count, wanted FROM listed l "
    "JOIN (SELECT DISTINCT index_id, sex FROM known) s ON l.index_id = s.index_id LEFT JOIN "
    f"(SELECT v.index_id, sex, {_AT} AS bin, count(*) AS k FROM known v JOIN bins ON v.index_id = bins.index_id GROUP BY 1, 2, 3) c "
    "ON l.index_id = c.index_id AND l.bin = c.bin AND s.sex = c.sex",
    ALL_VALS, "known AS (SELECT * FROM vals WHERE sex IS NOT NULL)", _bins_cte("known"),
)

QUERIES = {
    "T01_rank_avg": Query(ranks, RANK_SQL),
    "T02_log": Query(logs, LOG_SQL),
    "T03_z": Query(z_scores, Z_SQL),
    "T04_rint": Query(rint, RINT_SQL),
    "T05_qnorm": Query(quantiles_of_normal, QNORM_SQL),
    "T06_rint_within_sex": Query(rint_by_sex, RINT_BY_SEX_SQL),
    "T06_rint_hot_values": Query(rint_by_sex_hot, RINT_BY_SEX_SQL),
    "T08_layout_z_within_sex": Query(z_by_sex_layout, Z_LAYOUT_SQL),
    "T09_transform_results": Query(transformed_file, TRANSFORMED_SQL),
    "T09_repeated_ids": Query(repeated_ids, REPEATED_SQL),
    "T10_keep_only": Query(keep_only, KEEP_ONLY_SQL),
    "T11_transform_report": Query(report, REPORT_SQL),
    "D01_describe": Query(describe, DESCRIBE_SQL),
    "D02_quantile": Query(quantiles, QUANTILES_SQL),
    "D02_quantile_brackets": Query(quantiles_bracketed, QUANTILES_SQL),
    "D03_skewness": Query(skewness, SKEWNESS_SQL),
    "D04_sex_medians": Query(medians_by_sex, MEDIANS_SQL),
    "D05_sex_split": Query(split_by_sex, SPLIT_SQL),
    "D06_non_positive": Query(not_positive, NOT_POSITIVE_SQL),
    "D07_summary_table": Query(summary, SUMMARY_SQL),
    "D08_unit_check": Query(units, _units_sql()),
    "D09_check_time": Query(check_time, CHECK_TIME_SQL),
    "C01_pearson_pair": Query(pearson_pair, PEARSON_PAIR_SQL),
    "C02_spearman_pair": Query(spearman_pair, SPEARMAN_PAIR_SQL),
    "C03_pearson_matrix": Query(pearson_matrix, PEARSON_SQL),
    "C03_with_infinite": Query(pearson_with_infinite, INFINITE_SQL),
    "C02_repeated_ids": Query(spearman_pair_repeated, SPEARMAN_PAIR_SQL),
    "C04_spearman_matrix": Query(spearman_matrix, SPEARMAN_SQL),
    "C04_spearman_rint_by_sex": Query(spearman_by_sex_rint, SPEARMAN_BY_SEX_SQL),
    "C05_matrix_members": Query(members, _members_sql()),
    "C06_matrix_comparison": Query(comparison, COMPARISON_SQL),
    "C07_matrix_layout": Query(matrix_layout, MATRIX_LAYOUT_SQL),
    "C07_matrix_counts": Query(matrix_counts, MATRIX_COUNTS_SQL),
    "C08_scatter_sample": Query(scatter, SCATTER_SQL),
    "K01_bandwidth": Query(bandwidth, BANDWIDTH_SQL),
    "K02_density_exact": Query(exact_density, EXACT_SQL),
    "K03_density_binned": Query(binned_density, BINNED_SQL),
    "K04_density_by_sex": Query(densities, DENSITIES_SQL),
    "K05_density_table": Query(density_table, DENSITY_TABLE_SQL),
    "K06_histogram": Query(histogram, HISTOGRAM_SQL),
    "K07_histogram_by_sex": Query(histogram_sex, HISTOGRAM_SEX_SQL),
}
