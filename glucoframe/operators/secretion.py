"""Insulin secretion (beta cell) and glucagon (alpha cell) indices; all descriptive, never negated.

The wording of the three "not defined" reasons is this library's own.
"""

from __future__ import annotations

from glucoframe.operators.index_model import DESCRIPTIVE, Index
from glucoframe.operators.ogtt import BIGTT_INPUTS, BIGTT_SI, THREE, matsuda_value, plain_mean

SECRETION, GLUCAGON = "secretion", "glucagon"
SIX_INPUTS = ("g0", "i0", "g30", "i30", "g120", "i120")

RISE_OVER_GLUCOSE = "try_divide(iu_30 - iu_0, g30)"
BIGTT_AIR = (
    "exp(8.20D + 0.00178D * i0 + 0.00168D * i30 - 0.000383D * i120 - 0.314D * g0 - 0.109D * g30 "
    "+ 0.0781D * g120 + 0.180D * CASE WHEN sex = 'male' THEN 1D ELSE 0D END + 0.032D * bmi)"
)
DISPOSITION_TEXT = "higher = better beta-cell function relative to insulin sensitivity"


def _secretion(id_, name, text, needs, value, **more):
    return Index(id_, name, SECRETION, DESCRIPTIVE, needs, value, direction_text=text, **more)


def _glucagon(id_, name, text, needs, value):
    return Index(id_, name, GLUCAGON, DESCRIPTIVE, needs, value, direction_text=text)


SECRETION_INDICES = (
    _secretion(
        "homa_beta", "HOMA-beta", "higher = more basal insulin secretion", ("g0", "i0"),
        "try_divide(20D * iu_0, g0 - 3.5D)",
        undefined=("g0 <= 3.5D", "not defined when fasting glucose is 3.5 mmol/L or lower"),
    ),
    _secretion(
        "cir30", "Corrected insulin response at 30 min (CIR)", "higher = more insulin secretion", ("g30", "i30"),
        "try_divide(100D * iu_30, gmg_30 * (gmg_30 - 70D))",
        undefined=("gmg_30 <= 70D", "not defined when 30-min glucose is 70 mg/dL or lower"),
    ),
    _secretion(
        "stumvoll_first_phase", "Stumvoll first-phase insulin release", "higher = more first-phase insulin secretion",
        ("i0", "i30", "g30"), "1283D + 1.829D * i30 - 138.7D * g30 + 3.772D * i0",
    ),
    _secretion(
        "insulinogenic_dg30", "Insulinogenic index (delta glucose, 30 min)", "higher = more insulin secretion",
        ("g0", "g30", "i0", "i30"), "try_divide(iu_30 - iu_0, gmg_30 - gmg_0)",
        undefined=("g30 = g0", "not defined when 30-min glucose equals fasting glucose"),
    ),
    _secretion(
        "insulinogenic_g30", "Insulinogenic index (30-min glucose)", "higher = more insulin secretion",
        ("i0", "i30", "g30"), RISE_OVER_GLUCOSE,
    ),
    _secretion(
        "di_madsen_table", "Disposition index (Madsen 2024 table form)", DISPOSITION_TEXT, SIX_INPUTS,
        f"try_divide({RISE_OVER_GLUCOSE} * 1000D, "
        f"sqrt(gmg_0 * iu_0) * {plain_mean('gmg', THREE)} * {plain_mean('iu', THREE)})",
    ),
    _secretion(
        "di_xinsg30_matsuda", "Disposition index (xinsG30 x Matsuda)", DISPOSITION_TEXT, SIX_INPUTS,
        f"{RISE_OVER_GLUCOSE} * {matsuda_value(THREE, plain_mean)}",
    ),
    _secretion("bigtt_air", "BIGTT-AIR", "higher = greater acute insulin response", BIGTT_INPUTS, BIGTT_AIR),
    _secretion(
        "di_bigtt", "Disposition index (BIGTT-AIR x BIGTT-SI)", DISPOSITION_TEXT, BIGTT_INPUTS,
        f"{BIGTT_AIR} * {BIGTT_SI}",
    ),
)

GLUCAGON_INDICES = (
    _glucagon("glucagon_fasting", "Fasting glucagon", "higher = more fasting glucagon", ("gl0",), "gl0"),
    _glucagon(
        "glucagon_auc", "Glucagon AUC (0-120 min)", "higher = more glucagon over the test", ("gl0", "gl30", "gl120"),
        "0.5D * ((gl30 + gl0) * 30D + (gl120 + gl30) * 90D)",
    ),
    _glucagon(
        "glucagon_ratio_120_0", "Glucagon 120-min / fasting ratio", "higher = less glucagon suppression after glucose",
        ("gl0", "gl120"), "try_divide(gl120, gl0)",
    ),
    _glucagon(
        "glucagon_suppression_pct_60", "Glucagon suppression at 60 min (%)", "higher = more glucagon suppression",
        ("gl0", "gl60"), "(1D - try_divide(gl60, gl0)) * 100D",
    ),
    _glucagon(
        "glucagon_insulin_ratio", "Glucagon / insulin ratio (fasting)", "higher = more glucagon relative to insulin",
        ("gl0", "i0"), "try_divide(gl0, i0)",
    ),
)
