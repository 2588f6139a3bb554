"""Contiguous parts of a cohort, their manifests, and joining them again."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glucoframe.operators.catalog import (
    INDEX_IDS,
    VERIFICATION,
    column_name,
    describe_selection,
    index,
)
from glucoframe.operators.transforms import BLOM_OFFSET, Transform
from glucoframe.session import cut_lineage
from glucoframe.settings import AvignonWeight, ConversionSettings, UnitChoice

HEADER_SEPARATOR = "\x1f"


def part_rows(part: int, parts: int, total: int) -> tuple[int, int]:
    """First and last row (1-based, inclusive) of part i of n; last < first when empty."""
    if not 1 <= part <= parts:
        raise ValueError(f"part {part}/{parts} is not valid (use i/n with 1 <= i <= n)")
    return (part - 1) * total // parts + 1, part * total // parts


def part_of(row: str, parts: int, total: str | int) -> Column:
    """The part a 1-based row number belongs to: the smallest i with floor(i * total / parts) >= row."""
    return F.expr(f"({row} * {parts} + {total} - 1) div {total}")


def take_part(numbered: DataFrame, part: int, parts: int, total: int, row: str = "row") -> DataFrame:
    first, last = part_rows(part, parts, total)
    return numbered.where(F.col(row).between(first, last))


# ---------- manifest ----------

@dataclass(frozen=True)
class Run:
    """What was run; becomes the settings document next to the results."""

    input_name: str
    delimiter: str = "comma"
    units: UnitChoice = UnitChoice()
    settings: ConversionSettings = ConversionSettings()
    weight: AvignonWeight = AvignonWeight()
    orientation: str = "published"
    status_columns: bool = False
    selection: list[str] = field(default_factory=lambda: list(INDEX_IDS))
    transform: Transform = Transform()


def header_fingerprint(columns: list[str]) -> str:
    return hashlib.sha256(HEADER_SEPARATOR.join(columns).encode()).hexdigest()


def transform_settings(t: Transform, added: bool = True) -> dict:
    if t.kind == "none":
        return {"kind": "none"}
    return {
        "kind": t.kind, "within_sex": t.within is not None, "applied_to": "oriented values",
        "transformed_columns_added": added, "column_suffix": t.suffix, "blom_offset": BLOM_OFFSET,
        "log_base": "e", "z_sd": "sample (n - 1)",
    }


def manifest(
    run: Run,
    *,
    version: str,
    timestamp: str,
    rows: int,
    rows_with_problems: int,
    unit_check: list[dict] | None = None,
    header: list[str] | None = None,
    size_bytes: int | None = None,
    part: tuple[int, int, int] | None = None,
    columns: list[str] | None = None,
) -> dict:
    """The settings document. `part` is (i, n, total rows) when only a part was calculated, `columns` are those of the results."""
    s = run.settings
    doc = {
        "engine_version": version,
        "timestamp": timestamp,
        "input_file": run.input_name,
        "delimiter": run.delimiter,
        "units": asdict(run.units),
        "unit_check": unit_check or [],
        "conversion_factors": {
            "glucose_mg_per_dL_per_mmol": s.glucose_mg_per_dl,
            "insulin_pmol_per_uU": s.insulin_pmol_per_uu,
            "tg_mg_per_dL_per_mmol": s.tg_mg_per_dl,
            "hdl_mg_per_dL_per_mmol": s.hdl_mg_per_dl,
            "glucagon_pg_per_mL_per_pmol": s.glucagon_pg_per_pmol,
        },
        "avignon_weight": {"value": run.weight.value, "source": run.weight.source},
        "orientation": run.orientation,
        "belfiore_reference_set": "belfiore_1998",
        "include_status_columns": run.status_columns,
        "transform": transform_settings(run.transform),
        "row_counts": {"total": rows, "with_problems": rows_with_problems, "calculated": rows},
        "methods": [
            {
                "id": i, "name": index(i).name, "csv_column": column_name(i, run.orientation),
                "source_verification": VERIFICATION.get(i),
            }
            for i in run.selection
        ],
    }
    if set(run.selection) != set(INDEX_IDS):
        doc["selection"] = {**describe_selection(run.selection), "methods": run.selection}
    if header is not None:
        doc["input_fingerprint"] = {
            "size_bytes": size_bytes, "total_rows": part[2] if part else rows,
            "header_sha256": header_fingerprint(header),
        }
    if columns is not None:
        doc["results_columns"] = columns
    if part is not None:
        first, last = part_rows(*part)
        doc["chunk"] = {"index": part[0], "of": part[1], "first_row": first, "last_row": last, "total_rows": part[2]}
    return doc


def manifest_frame(spark: SparkSession, doc: dict) -> DataFrame:
    return spark.createDataFrame([(json.dumps(doc, ensure_ascii=False, indent=2),)], "value string")


# ---------- joining parts ----------

# Settings that must agree between parts.
MUST_AGREE = (
    ("engine version", "engine_version"),
    ("units", "units"),
    ("conversion factors", "conversion_factors"),
    ("orientation", "orientation"),
    ("Avignon weight", "avignon_weight"),
    ("status-columns setting", "include_status_columns"),
    ("index selection", "selection"),
    ("delimiter", "delimiter"),
    ("input fingerprint (size, rows, header)", "input_fingerprint"),
)
PARTS_SCHEMA = (
    "name string, part int, of int, first_row bigint, last_row bigint, total_rows bigint, columns string, "
    "settings map<string,string>"
)


def parts_frame(spark: SparkSession, parts: list[tuple[str, dict, list[str]]]) -> DataFrame:
    """(name, manifest, result columns) of each part as rows."""
    rows = []
    for name, doc, columns in parts:
        chunk = doc.get("chunk")
        if not chunk:
            raise ValueError(f"{name}: settings have no part information")
        settings = {key: json.dumps(doc.get(key), sort_keys=True) for _, key in MUST_AGREE}
        rows.append((
            name, chunk["index"], chunk["of"], chunk["first_row"], chunk["last_row"], chunk["total_rows"],
            HEADER_SEPARATOR.join(columns), settings,
        ))
    return spark.createDataFrame(rows, PARTS_SCHEMA)


def manifest_rows(texts: DataFrame) -> DataFrame:
    """(name, value) rows with settings documents -> the columns of parts_frame, `rows` they promise and their `counts`.

    Objects are compared by their entries, whatever their order. `part` is null for a document of no part.
    """
    def entries(text: Column) -> Column:
        inner = F.from_json(text, "map<string,string>")
        return F.when(F.ltrim(text).startswith("{"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(inner))))).otherwise(text)

    shape = (
        "chunk struct<index:int,of:int,first_row:bigint,last_row:bigint,total_rows:bigint>, results_columns array<string>, "
        "row_counts struct<total:bigint,with_problems:bigint,calculated:bigint>"
    )
    read = texts.select("name", F.from_json("value", shape).alias("d"), F.from_json("value", "map<string,string>").alias("top"))
    settings = F.create_map(*[x for _, key in MUST_AGREE for x in (F.lit(key), entries(F.try_element_at("top", F.lit(key))))])
    chunk = [F.col(f"d.chunk.{name}").alias(name if name != "index" else "part") for name in ("index", "of", "first_row", "last_row", "total_rows")]
    rows = F.col("d.chunk.last_row") - F.col("d.chunk.first_row") + 1
    columns = F.array_join("d.results_columns", HEADER_SEPARATOR)
    return read.select("name", *chunk, columns.alias("columns"), settings.alias("settings"), rows.alias("rows"), F.col("d.row_counts").alias("counts"))


def checked_parts(texts: DataFrame, found: DataFrame) -> dict:
    """The settings document of the whole, from those of its parts (name, value) and the rows found of each (name, found).

    Everything that does not fit is an error. The number of jobs does not depend on the number of parts.
    """
    parts = cut_lineage(manifest_rows(texts).join(found, "name", "left"))
    strange = parts.where("part IS NULL").select("name", F.lit("settings have no part information").alias("problem"))
    differ = parts.where("coalesce(found, 0) != rows").select(
        "name", F.format_string("%d rows were found where its settings promise %d", F.coalesce("found", F.lit(0).cast("bigint")), F.col("rows")).alias("problem")
    )
    fitting = part_problems(parts.where("part IS NOT NULL")).select("name", "problem")
    problems = strange.union(fitting).union(differ).orderBy("name", "problem").collect()
    if problems:
        raise ValueError("these parts cannot be joined:\n  " + "\n  ".join(f"{p.name}: {p.problem}" for p in problems))
    summed = parts.agg(
        *[F.sum(f"counts.{name}").alias(name) for name in ("total", "with_problems", "calculated")],
        F.transform(F.array_sort(F.collect_list(F.struct("part", "name"))), lambda p: p["name"]).alias("names"),
    ).head()
    doc = json.loads(texts.where(F.col("name") == summed.names[0]).head().value)
    doc.pop("chunk")
    return doc | {
        "unit_check": [], "merged_from": summed.names,
        "row_counts": {name: summed[name] for name in ("total", "with_problems", "calculated")},
    }


def part_problems(parts: DataFrame) -> DataFrame:
    """(part, problem) for everything that keeps parts from being joined; empty when they fit.

    `parts` has one row per part, so the running window is over a list of files.
    """
    whole = Window.partitionBy(F.lit(1))
    order = Window.partitionBy(F.lit(1)).orderBy("part", "name")
    first = {key: F.first(F.col("settings")[key]).over(order) for _, key in MUST_AGREE}
    checks = [
        F.when(~F.col("settings")[key].eqNullSafe(F.col(f"first_{key}")), F.lit(f"differs from part 1 in {label}"))
        for label, key in MUST_AGREE
    ]
    seen = parts.select(
        "*",
        *[column.alias(f"first_{key}") for key, column in first.items()],
        F.first("columns").over(order).alias("first_columns"),
        F.first("of").over(order).alias("first_of"),
        F.lag("last_row").over(order).alias("previous_last"),
        F.lag("part").over(order).alias("previous_part"),
        F.lead("part").over(order).alias("next_part"),
        F.count(F.lit(1)).over(whole).alias("given"),
        F.row_number().over(order).alias("place"),
    )
    expected = F.coalesce(F.col("previous_last"), F.lit(0)) + 1
    checks += [
        F.when(F.col("of") != F.col("first_of"), F.lit("differs from part 1 in number of parts")),
        F.when(~F.col("part").between(1, F.col("of")), F.lit("part number is out of range")),
        F.when(F.col("part") == F.col("previous_part"), F.lit("this part is given twice")),
        F.when(
            F.col("part") > F.coalesce(F.col("previous_part"), F.lit(0)) + 1,
            F.concat(F.lit("missing part "), (F.coalesce(F.col("previous_part"), F.lit(0)) + 1).cast("string")),
        ),
        F.when(
            F.col("next_part").isNull() & (F.col("part") < F.col("of")),
            F.concat(F.lit("missing part "), (F.col("part") + 1).cast("string")),
        ),
        F.when(F.col("columns") != F.col("first_columns"), F.lit("header differs from part 1")),
        F.when(
            F.col("first_row") != expected,
            F.concat(F.lit("starts at row "), F.col("first_row").cast("string"), F.lit(", expected "), expected.cast("string")),
        ),
        F.when(
            F.col("next_part").isNull() & (F.col("last_row") != F.col("total_rows")),
            F.concat(F.lit("rows end at "), F.col("last_row").cast("string"), F.lit(" of "), F.col("total_rows").cast("string")),
        ),
    ]
    return seen.select("part", "name", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def merge_parts(
    spark: SparkSession, parts: list[tuple[str, dict, DataFrame]]
) -> tuple[DataFrame, dict]:
    """Join tables that hold the results of parts 1..n: checks the manifests and the row counts, then unions.

    Written parts are better joined by results.merge_part_files or merge_folder, which read them as one table.
    """
    listed = [(name, doc, df.columns) for name, doc, df in parts]
    problems = part_problems(parts_frame(spark, listed)).orderBy("part", "problem").collect()
    if problems:
        raise ValueError("these parts cannot be joined:\n  " + "\n  ".join(f"{p.name}: {p.problem}" for p in problems))
    ordered = sorted(parts, key=lambda p: p[1]["chunk"]["index"])
    merged = None
    counts = None
    for name, doc, df in ordered:
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        counts = one if counts is None else counts.unionByName(one)
        merged = df if merged is None else merged.unionByName(df)
    found = {r["name"]: r["rows"] for r in counts.collect()}
    for name, doc, _ in ordered:
        expected = doc["chunk"]["last_row"] - doc["chunk"]["first_row"] + 1
        if found[name] != expected:
            raise ValueError(f"{name}: {found[name]} rows were found where its settings promise {expected}")
    doc = {k: v for k, v in ordered[0][1].items() if k != "chunk"}
    doc["unit_check"] = []
    doc["row_counts"] = {
        key: sum(d["row_counts"][key] for _, d, _ in ordered) for key in ("total", "with_problems", "calculated")
    }
    doc["merged_from"] = [name for name, _, _ in ordered]
    return merged, doc
