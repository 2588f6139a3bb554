"""Do the chosen units look right? Medians of the values as read, against plausible ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glucoframe.functions.units import parse_unit
from glucoframe.operators.index_model import sql_text
from glucoframe.operators.ranking import exact_quantiles
from glucoframe.settings import UnitChoice

MIN_VALUES = 5


@dataclass(frozen=True)
class Rule:
    """Median below `low` points to one unit, above `high` to another; between them nothing is said."""

    quantity: str
    label: str
    low: float
    low_unit: str
    high: float
    high_unit: str


# Plausible ranges.
RULES = (
    Rule("glucose", "Fasting glucose", 25, "mmol/L", 30, "mg/dL"),
    Rule("insulin", "Fasting insulin", 25, "uU/mL", 40, "pmol/L"),
    Rule("glucagon", "Fasting glucagon", 25, "pmol/L", 30, "pg/mL"),
    Rule("tg", "TG", 8, "mmol/L", 15, "mg/dL"),
    Rule("hdl", "HDL", 4, "mmol/L", 10, "mg/dL"),
    Rule("ffa", "FFA", 5, "mmol/L", 20, "umol/L"),
)
PREFIX = {"glucose": "g", "insulin": "i", "glucagon": "gl", "ffa": "ffa"}
DISPLAY = {"glucose": "G{t}", "insulin": "I{t}", "glucagon": "Glucagon{t}", "ffa": "FFA{t}", "tg": "TG", "hdl": "HDL_c"}


def _candidates(columns: list[str]) -> list[tuple[str, int, str, str]]:
    """(quantity, preference, column, display name): fasting first, then 120 minutes, then other minutes
    in order; insulin and glucagon are checked at fasting only."""
    found = []
    for rule in RULES:
        if rule.quantity not in PREFIX:
            if rule.quantity in columns:
                found.append((rule.quantity, 0, rule.quantity, DISPLAY[rule.quantity]))
            continue
        prefix = PREFIX[rule.quantity]
        minutes = sorted(
            int(c[len(prefix):]) for c in columns if c.startswith(prefix) and c[len(prefix):].isdigit()
        )
        if rule.quantity in ("insulin", "glucagon"):
            minutes = [t for t in minutes if t == 0]
        for preference, t in enumerate(sorted(minutes, key=lambda t: (t != 0, t != 120, t))):
            name = "FFA" if rule.quantity == "ffa" and t == 0 else DISPLAY[rule.quantity].format(t=t)
            found.append((rule.quantity, preference, f"{prefix}{t}", name))
    return found


def choose_columns(df: DataFrame) -> list[tuple[str, str, str]]:
    """(quantity, column, display name) to check: the first candidate with at least 5 values."""
    candidates = _candidates(df.columns)
    if not candidates:
        return []
    finite = [F.count_if(F.abs(c) < float("inf")).alias(c) for _, _, c, _ in candidates]
    counts = df.agg(*finite).head().asDict()
    chosen: dict[str, tuple[str, str, str]] = {}
    for quantity, _, column, name in candidates:
        if quantity not in chosen and counts[column] >= MIN_VALUES:
            chosen[quantity] = (quantity, column, name)
    return list(chosen.values())


EMPTY = "quantity string, column string, n bigint, median double, selected string, suggested string"


def check_units(df: DataFrame, units: UnitChoice = UnitChoice()) -> DataFrame:
    """Per quantity: column, n, median, selected unit and the unit the median suggests instead (NULL = fine).

    `df` holds values in file units. Never changes anything.
    """
    chosen = choose_columns(df)
    spark: SparkSession = df.sparkSession
    if not chosen:
        return spark.createDataFrame([], EMPTY)
    cells = ", ".join(
        f"named_struct('quantity', {sql_text(q)}, 'column', {sql_text(name)}, 'value', cast({c} AS double))"
        for q, c, name in chosen
    )
    values = df.selectExpr(f"inline(array({cells}))").where("abs(value) < double('Infinity')")
    medians = exact_quantiles(values, ["quantity", "column"], [0.5])
    suggestion, selected = None, None
    for rule in RULES:
        mine = F.col("quantity") == rule.quantity
        low, high = F.col("q0") < rule.low, F.col("q0") > rule.high
        chosen_unit = units.of(rule.quantity)
        # mU/L is another name of uU/mL
        low_unit = chosen_unit if chosen_unit == "mU/L" and rule.low_unit == "uU/mL" else rule.low_unit
        unit = F.when(low, low_unit).when(high, rule.high_unit)
        suggestion = F.when(mine, unit) if suggestion is None else suggestion.when(mine, unit)
        text = parse_unit(rule.quantity, chosen_unit)
        selected = F.when(mine, text) if selected is None else selected.when(mine, text)
    return medians.select(
        "quantity", "column", "n", F.col("q0").alias("median"), selected.alias("selected"),
        F.when(suggestion != selected, suggestion).alias("suggested"),
    )


def unit_warnings(checked: DataFrame) -> DataFrame:
    """One sentence per suspicious quantity."""
    label = None
    for rule in RULES:
        mine = F.col("quantity") == rule.quantity
        label = F.when(mine, rule.label) if label is None else label.when(mine, rule.label)
    digits = F.greatest(F.lit(0), F.lit(2) - F.floor(F.log10(F.abs("median"))))
    rounded = F.round(F.col("median") * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    return checked.where("suggested IS NOT NULL").select(
        "quantity",
        F.concat(
            label, F.lit(": median "), rounded.cast("string"), F.lit(" looks like "), F.col("suggested"),
            F.lit(", but "), F.col("selected"), F.lit(" is selected."),
        ).alias("warning"),
    )
