"""Parsing of text cells: numbers, sex labels, problem texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "missing", number shapes, sex spellings.
EMPTY_TEXTS = ("", "na", "nan", "null")
NUMBER_SHAPE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DECIMAL_COMMA_SHAPE = r"^[+-]?[0-9]+,[0-9]+$"
MALE_TEXTS = ("1", "m", "male")
FEMALE_TEXTS = ("2", "f", "female")


def trimmed(cell: Column) -> Column:
    """Without surrounding whitespace of any kind (tabs and line breaks too)."""
    return F.regexp_replace(cell, r"^\s+|\s+$", "")


def is_empty(cell: Column) -> Column:
    return cell.isNull() | F.lower(trimmed(cell)).isin(*EMPTY_TEXTS)


def number(cell: Column) -> Column:
    """The cell as a finite double, else NULL. The shape test keeps out texts such as '1d' or
    'Infinity', which a plain cast would accept."""
    value = F.when(trimmed(cell).rlike(NUMBER_SHAPE), trimmed(cell).try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


# The wording of problems below and of column conflicts, which users of results files compare.
def number_problem(cell: Column, name: str, canonical: str) -> Column:
    """Problem text of a numeric cell, NULL when it is missing or fine.

    `name` is the header as written (decimal commas are reported under it), `canonical` the
    column name other problems are reported under.
    """
    return (
        F.when(trimmed(cell).rlike(DECIMAL_COMMA_SHAPE), F.concat(F.lit(f'{name}: use a decimal point ("'), cell, F.lit('")')))
        .when(is_empty(cell), F.lit(None).cast("string"))
        .when(number(cell).isNull(), F.concat(F.lit(f'{canonical}: not a number ("'), cell, F.lit('")')))
    )


def sex(cell: Column) -> Column:
    """'male', 'female' or NULL."""
    text = F.lower(trimmed(cell))
    return F.when(text.isin(*MALE_TEXTS), "male").when(text.isin(*FEMALE_TEXTS), "female")


def sex_problem(cell: Column) -> Column:
    return F.when(
        ~is_empty(cell) & sex(cell).isNull(), F.concat(F.lit('sex: unrecognised value "'), cell, F.lit('"'))
    )


def number_text(value: Column) -> Column:
    """A double as text with no trailing '.0' on whole numbers."""
    whole = (F.abs(value) < 1e15) & (value == F.floor(value))
    return (
        F.when(F.isnan(value), "NaN")
        .when(value == float("inf"), "Infinity")
        .when(value == float("-inf"), "-Infinity")
        .when(whole, value.cast("bigint").cast("string"))
        .otherwise(value.cast("string"))
    )
