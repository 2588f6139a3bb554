"""Run settings: conversion factors, units of the input columns, reference means, Avignon weight."""

from __future__ import annotations

from dataclasses import dataclass, field

# Published weight of Si0 in Avignon's SiM.
PUBLISHED_AVIGNON_WEIGHT = 0.137

SAMPLE_WEIGHT_WARNING = (
    "Sample-derived Avignon coefficient (ratio of mean Si120 to mean Si0 in the analysed cohort): "
    "the result depends on the cohort analysed."
)
TOO_FEW_PAIRS_WARNING = (
    "Fewer than 2 rows have both Si0 and Si120; sample weight unavailable, using 0.137 (Avignon 1999)."
)


@dataclass(frozen=True)
class ConversionSettings:
    """How many file units make one canonical unit (insulin: pmol per microunit)."""

    glucose_mg_per_dl: float = 18.0
    insulin_pmol_per_uu: float = 6.0
    tg_mg_per_dl: float = 88.57
    hdl_mg_per_dl: float = 38.67
    glucagon_pg_per_pmol: float = 3.485


@dataclass(frozen=True)
class UnitChoice:
    """Units of the columns in a file; canonical by default."""

    glucose: str = "mmol/L"
    insulin: str = "pmol/L"
    glucagon: str = "pmol/L"
    ffa: str = "mmol/L"
    tg: str = "mmol/L"
    hdl: str = "mmol/L"

    def of(self, quantity: str) -> str:
        return getattr(self, quantity)


@dataclass(frozen=True)
class BelfioreMeans:
    """Normal-population means (canonical units; areas in unit x hour). None = not supplied."""

    name: str = "custom"
    insulin_0: float | None = None
    glucose_0: float | None = None
    ffa_0: float | None = None
    insulin_area_0_2h: float | None = None
    glucose_area_0_2h: float | None = None
    ffa_area_0_2h: float | None = None
    insulin_area_0_1_2h: float | None = None
    glucose_area_0_1_2h: float | None = None
    ffa_area_0_1_2h: float | None = None


# Belfiore 1998 means. They have not been checked against the printed paper.
BELFIORE_MEANS = BelfioreMeans(
    name="belfiore_1998",
    insulin_0=65.71,
    glucose_0=5.08,
    ffa_0=398.88 / 1000,
    insulin_area_0_2h=363.04,
    glucose_area_0_2h=10.26,
    ffa_area_0_2h=478.0 / 1000,
    insulin_area_0_1_2h=638.0,
    glucose_area_0_1_2h=11.36,
    ffa_area_0_1_2h=296.25 / 1000,
)


@dataclass(frozen=True)
class AvignonWeight:
    """The weight of Si0 in avignon_sim and where it came from."""

    value: float = PUBLISHED_AVIGNON_WEIGHT
    source: str = "avignon_1999"
    pairs: int | None = None
    warnings: tuple[str, ...] = field(default=())

    @staticmethod
    def given(value: float) -> "AvignonWeight":
        if not 0 < value < float("inf"):
            raise ValueError(f"Avignon weight must be a positive number, got {value!r}")
        return AvignonWeight(float(value), "user")
