"""Header names -> canonical columns. The vocabulary is closed; values never influence types."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Recognised scalar headers and what they hold.
SCALARS = {
    "tg": "triglycerides",
    "hdl": "HDL cholesterol",
    "hdl_c": "HDL cholesterol",
    "weight": "weight",
    "bmi": "BMI",
    "waist": "waist",
    "age": "age",
    "fat_mass": "fat mass",
    "rate_glycerol": "glycerol Ra",
    "rate_palmitate": "palmitate Ra",
    "sex": "sex",
}
ID_NAMES = ("participant_id", "id")
# Series headers; the minute is the number at the end, none means fasting.
SERIES_SHAPES = (
    (re.compile(r"fasting_glucose|g|glucose_(\d+)|g(\d+)"), "g", "glucose", "G{t}"),
    (re.compile(r"fasting_insulin|i|insulin_(\d+)|i(\d+)"), "i", "insulin", "I{t}"),
    (re.compile(r"fasting_glucagon|glucagon_?|glucagon_?(\d+)"), "gl", "glucagon", "Glucagon{t}"),
    (re.compile(r"ffa|ffa(\d+)"), "ffa", "FFA", "FFA{t}"),
)


@dataclass(frozen=True)
class SourceColumn:
    """A header: what it means, its display name and the physical column it becomes."""

    name: str
    kind: str  # id | variable | ignored
    variable: str | None = None
    canonical: str | None = None
    column: str | None = None
    quantity: str | None = None
    minute: int | None = None


def classify(name: str) -> SourceColumn:
    key = name.lstrip("﻿").strip().lower()
    if key in ID_NAMES:
        return SourceColumn(name, "id", "participant ID", column="participant_id")
    if key in SCALARS:
        column = "hdl" if key == "hdl_c" else key
        quantity = column if column in ("tg", "hdl") else None
        return SourceColumn(name, "variable", SCALARS[key], name, column, quantity)
    for shape, prefix, quantity, display in SERIES_SHAPES:
        match = shape.fullmatch(key)
        if match:
            minute = int(next((g for g in match.groups() if g), "0"))
            canonical = "FFA" if prefix == "ffa" and minute == 0 else display.format(t=minute)
            variable = f"fasting {quantity}" if minute == 0 else f"{quantity} at {minute} min"
            return SourceColumn(
                name, "variable", variable, canonical, f"{prefix}{minute}", quantity.lower(), minute
            )
    return SourceColumn(name, "ignored")


def classify_all(names: list[str]) -> list[SourceColumn]:
    return [classify(n) for n in names]


def conflicts(columns: list[SourceColumn]) -> list[str]:
    """Two source columns for one series value (or one scalar): texts naming both."""
    first: dict[str, SourceColumn] = {}
    found = []
    for c in columns:
        if c.kind != "variable":
            continue
        if c.column in first:
            # fixed wording, as that of cell problems
            found.append(f"Columns {first[c.column].name} and {c.name} both give {c.variable}; keep only one")
        else:
            first[c.column] = c
    return found


def mapping_frame(spark: SparkSession, columns: list[SourceColumn]) -> DataFrame:
    """The header listing: position, source name, kind, meaning, canonical name."""
    rows = [(k, c.name, c.kind, c.variable, c.canonical, c.column) for k, c in enumerate(columns)]
    return spark.createDataFrame(
        rows, "position int, source string, kind string, variable string, canonical string, column string"
    )
