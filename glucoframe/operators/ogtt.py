"""Indices from the oral glucose tolerance test."""

from __future__ import annotations

from dataclasses import dataclass

from glucoframe.operators.index_model import (
    INVALID,
    MISSING,
    NO_TEXTS,
    RESISTANT,
    SENSITIVE,
    VALID,
    Index,
    least_state,
    sql_number,
    sql_text,
    texts,
)

OGTT = "ogtt"
THREE = (0, 30, 120)
FIVE = (0, 30, 60, 90, 120)


def plain_mean(prefix: str, minutes: tuple[int, ...]) -> str:
    return f"(({' + '.join(f'{prefix}_{t}' for t in minutes)}) / {len(minutes)}D)"


def curve_mean_3pt(prefix: str, minutes: tuple[int, ...]) -> str:
    """Trapezoid mean over 0, 30 and 120 minutes."""
    return f"((15D * {prefix}_0 + 60D * {prefix}_30 + 45D * {prefix}_120) / 120D)"


def matsuda_value(minutes: tuple[int, ...], mean) -> str:
    return f"try_divide(10000D, sqrt(gmg_0 * iu_0 * {mean('gmg', minutes)} * {mean('iu', minutes)}))"


def _matsuda(id_: str, name: str, minutes: tuple[int, ...], mean) -> Index:
    return Index(
        id_, name, OGTT, SENSITIVE, tuple(f"{p}{t}" for t in minutes for p in ("g", "i")),
        matsuda_value(minutes, mean),
        details={
            "mean_glucose_mg_dL": mean("gmg", minutes),
            "mean_insulin_uU_mL": mean("iu", minutes),
            "time_points": sql_text(",".join(map(str, minutes))),
        },
    )


BIGTT_INPUTS = ("g0", "g30", "g120", "i0", "i30", "i120", "bmi", "sex")
BIGTT_SI = (
    "exp(4.9D - 0.00402D * i0 - 0.000556D * i30 - 0.00127D * i120 - 0.152D * g0 - 0.00871D * g30 "
    "- 0.0373D * g120 - 0.145D * CASE WHEN sex = 'male' THEN 1D ELSE 0D END - 0.0376D * bmi)"
)
GUTT_GLUCOSE = "((g0 + g120) / 2D)"
GUTT_INSULIN = "((iu_0 + iu_120) / 2D)"


def _si(minute: int) -> str:
    return f"try_divide(1e8D, gmg_{minute} * iu_{minute} * weight * 150D)"


@dataclass(frozen=True)
class AvignonMean(Index):
    """SiM = (w * Si0 + Si120) / 2: state and reasons come from its two components, error before
    unavailable, reasons merged without repeats."""

    first: tuple[str, ...] = ("g0", "i0", "weight")
    second: tuple[str, ...] = ("g120", "i120", "weight")

    def value_sql(self, run):
        return f"({sql_number(run.weight.value)} * {_si(0)} + {_si(120)}) / 2D"

    def details_sql(self, run):
        return {
            "weight": sql_number(run.weight.value),
            "weight_source": sql_text(run.weight.source),
            "si0": _si(0),
            "si120": _si(120),
        }

    def state(self, run):
        a, b = least_state(*self.first), least_state(*self.second)
        return (
            f"CASE WHEN {a} = {INVALID} OR {b} = {INVALID} THEN {INVALID} "
            f"WHEN {a} = {MISSING} OR {b} = {MISSING} THEN {MISSING} ELSE {VALID} END"
        )

    def _component_reasons(self, run, names):
        part, state = Index("", "", "", "", names, ""), least_state(*names)
        return (
            f"CASE WHEN {state} = {MISSING} THEN {part.missing_reasons(run)} "
            f"WHEN {state} = {INVALID} THEN {part.invalid_reasons(run)} ELSE {NO_TEXTS} END"
        )

    def missing_reasons(self, run):
        parts = ", ".join(self._component_reasons(run, names) for names in (self.first, self.second))
        return f"array_distinct(concat({parts}))"

    invalid_reasons = missing_reasons

    def warnings(self, run):
        return texts(*[sql_text(w) for w in run.weight.warnings])


OGTT_INDICES = (
    Index("isi_120", "ISI 120", OGTT, SENSITIVE, ("g120", "i120"), "try_divide(10000D, gmg_120 * iu_120)"),
    Index(
        "ig_ratio_120", "Insulin-to-glucose ratio 120 min", OGTT, RESISTANT, ("g120", "i120"),
        "try_divide(iu_120, g120)",
    ),
    Index(
        "gutt", "Gutt index (ISI0,120)", OGTT, SENSITIVE, ("g0", "g120", "i0", "i120", "weight"),
        "try_divide(try_divide((75000D + (gmg_0 - gmg_120) * 0.19D * weight) / 120D, "
        f"{GUTT_GLUCOSE}), log10({GUTT_INSULIN}))",
        details={
            "mean_glucose_mmol_L": GUTT_GLUCOSE, "mean_insulin_uU_mL": GUTT_INSULIN, "time_points": "'0,120'",
        },
    ),
    _matsuda("matsuda_3pt", "Matsuda ISI (3-point)", THREE, plain_mean),
    _matsuda("matsuda_auc_3pt", "Matsuda ISI (3-point, trapezoid mean)", THREE, curve_mean_3pt),
    _matsuda("matsuda_5pt", "Matsuda ISI (5-point)", FIVE, plain_mean),
    Index(
        "stumvoll_mod", "Stumvoll (modified)", OGTT, SENSITIVE, ("i0", "i120", "g120"),
        "0.156D - 0.0000459D * i120 - 0.000321D * i0 - 0.00541D * g120",
    ),
    Index(
        "stumvoll_dem", "Stumvoll (demographics)", OGTT, SENSITIVE, ("i120", "bmi", "age"),
        "0.222D - 0.00333D * bmi - 0.0000779D * i120 - 0.000422D * age",
    ),
    Index("bigtt_si", "BIGTT-SI", OGTT, SENSITIVE, BIGTT_INPUTS, BIGTT_SI),
    Index("avignon_si120", "Avignon Si2h (Si120)", OGTT, SENSITIVE, ("g120", "i120", "weight"), _si(120)),
    AvignonMean("avignon_sim", "Avignon SiM", OGTT, SENSITIVE, ("g0", "i0", "weight", "g120", "i120"), ""),
    Index(
        "hiri", "Hepatic insulin resistance index", OGTT, RESISTANT, ("g0", "g30", "i0", "i30"),
        "(gmg_0 + gmg_30) / 2D / 100D * ((iu_0 + iu_30) / 2D)",
        details={"time_points": "'0,30'"},
    ),
    Index("ifc", "Insulin fold change (IFC)", OGTT, RESISTANT, ("i0", "i120"), "ln(try_divide(i120, i0))"),
)
