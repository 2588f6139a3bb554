"""Indices from fasting glucose and insulin."""

from __future__ import annotations

from glucoframe.operators.index_model import RESISTANT, SENSITIVE, Index

FASTING = "fasting"

FASTING_INDICES = (
    Index("homa_ir", "HOMA-IR", FASTING, RESISTANT, ("g0", "i0"), "g0 * iu_0 / 22.5D"),
    Index(
        "quicki", "QUICKI", FASTING, SENSITIVE, ("i0", "g0"),
        "try_divide(1D, log10(iu_0) + log10(gmg_0))",
        not_finite="log10(I0) + log10(G0) is zero; QUICKI is undefined.",
        invalid_text="{who} must be a finite value > 0 (log10 is undefined otherwise).",
        details={"insulin_uU_per_mL": "iu_0", "glucose_mg_per_dL": "gmg_0"},
    ),
    Index(
        "firi", "FIRI", FASTING, RESISTANT, ("i0", "g0"), "g0 * iu_0 / 25D",
        invalid_text="{who} must be a finite value > 0.",
    ),
    Index("raynaud", "Raynaud index", FASTING, SENSITIVE, ("i0",), "try_divide(40D, iu_0)"),
    Index("isi_basal", "ISI basal", FASTING, SENSITIVE, ("g0", "i0"), "try_divide(10000D, gmg_0 * iu_0)"),
    Index(
        "ig_ratio_basal", "Fasting insulin-to-glucose ratio", FASTING, RESISTANT, ("g0", "i0"),
        "try_divide(iu_0, g0)",
    ),
    Index(
        "avignon_si0", "Avignon Sib (Si0)", FASTING, SENSITIVE, ("g0", "i0", "weight"),
        "try_divide(1e8D, gmg_0 * iu_0 * weight * 150D)",
    ),
)
