"""Unit conversion. Canonical units: glucose, FFA, TG, HDL in mmol/L; insulin, glucagon in pmol/L."""

from __future__ import annotations

from pyspark.sql import Column

from glucoframe.settings import ConversionSettings, UnitChoice

# Accepted units per quantity, the canonical one first, and accepted spellings.
ALLOWED = {
    "glucose": ("mmol/L", "mg/dL"),
    "insulin": ("pmol/L", "uU/mL", "mU/L"),
    "glucagon": ("pmol/L", "pg/mL"),
    "ffa": ("mmol/L", "umol/L"),
    "tg": ("mmol/L", "mg/dL"),
    "hdl": ("mmol/L", "mg/dL"),
}
MICRO_SIGNS = ("µ", "μ")


def canonical_unit(quantity: str) -> str:
    return ALLOWED[quantity][0]


def parse_unit(quantity: str, text: str) -> str:
    """Unit option in any letter case, with u or a micro sign; unknown units are a ValueError."""
    wanted = text.strip().lower()
    for sign in MICRO_SIGNS:
        wanted = wanted.replace(sign, "u")
    for unit in ALLOWED.get(quantity, ()):
        if unit.lower() == wanted:
            return unit
    allowed = " or ".join(ALLOWED.get(quantity, ()))
    raise ValueError(f"{quantity} unit {text!r} is not valid (use {allowed})")


def unit_choice(**options: str) -> UnitChoice:
    """UnitChoice from option texts, e.g. unit_choice(glucose="MG/DL")."""
    return UnitChoice(**{q: parse_unit(q, text) for q, text in options.items()})


def to_canonical(value: Column, quantity: str, unit: str, s: ConversionSettings) -> Column:
    """File unit -> canonical unit; the same unit leaves the value untouched."""
    unit = parse_unit(quantity, unit)
    if unit == canonical_unit(quantity):
        return value
    if quantity == "insulin":
        return value * s.insulin_pmol_per_uu
    return value / _per_canonical(quantity, s)


def from_canonical(value: Column, quantity: str, unit: str, s: ConversionSettings) -> Column:
    """Canonical unit -> the given unit."""
    unit = parse_unit(quantity, unit)
    if unit == canonical_unit(quantity):
        return value
    if quantity == "insulin":
        return value / s.insulin_pmol_per_uu
    return value * _per_canonical(quantity, s)


def _per_canonical(quantity: str, s: ConversionSettings) -> float:
    return {
        "glucose": s.glucose_mg_per_dl,
        "glucagon": s.glucagon_pg_per_pmol,
        "ffa": 1000.0,
        "tg": s.tg_mg_per_dl,
        "hdl": s.hdl_mg_per_dl,
    }[quantity]
