"""Indices that add lipids, body measures, DXA or tracer rates."""

from __future__ import annotations

from dataclasses import dataclass

from glucoframe.operators.index_model import RESISTANT, SENSITIVE, Index, sql_number

LIPID, TRACER = "lipid", "tracer_dxa"
AS_SUPPLIED = {"note": "'tracer rate units as supplied by user'"}

VAI = (
    "CASE WHEN sex = 'male' "
    "THEN try_divide(waist, 39.68D + 1.88D * bmi) * (tg / 1.03D) * try_divide(1.31D, hdl) "
    "ELSE try_divide(waist, 36.58D + 1.89D * bmi) * (tg / 0.81D) * try_divide(1.52D, hdl) END"
)


@dataclass(frozen=True)
class Liri(Index):
    """The insulin mean goes back to pmol/L with the insulin factor of the run."""

    def value_sql(self, run):
        factor = sql_number(run.settings.insulin_pmol_per_uu)
        return (
            f"-0.091D + 0.4D * log10((iu_0 + iu_30) / 2D * {factor}) "
            "+ 0.346D * log10(try_divide(fat_mass, weight) * 100D) - 0.408D * log10(hdlmg) + 0.435D * log10(bmi)"
        )


LIPID_INDICES = (
    Index(
        "revised_quicki", "Revised QUICKI", LIPID, SENSITIVE, ("g0", "i0", "ffa0"),
        "try_divide(1D, log10(iu_0) + log10(gmg_0) + log10(ffa0))",
    ),
    Index(
        "mcauley", "McAuley index", LIPID, SENSITIVE, ("i0", "tg"),
        "exp(2.63D - 0.28D * ln(iu_0) - 0.31D * ln(tg))",
    ),
    Index("tyg", "TyG index", LIPID, RESISTANT, ("tg", "g0"), "ln(tgmg * gmg_0 / 2D)"),
    Index("tg_hdl", "TG/HDL-C ratio", LIPID, RESISTANT, ("tg", "hdl"), "try_divide(tgmg, hdlmg)"),
    Index("vai", "Visceral Adiposity Index", LIPID, RESISTANT, ("waist", "bmi", "tg", "hdl", "sex"), VAI),
    Index(
        "lap", "Lipid Accumulation Product", LIPID, RESISTANT, ("waist", "tg", "sex"),
        "(waist - CASE WHEN sex = 'male' THEN 65D ELSE 58D END) * tg",
    ),
    Index("adipo_ir", "Adipo-IR", LIPID, RESISTANT, ("ffa0", "i0"), "ffa0 * iu_0"),
)

TRACER_INDICES = (
    Liri("liri", "LIRI", TRACER, RESISTANT, ("i0", "i30", "fat_mass", "weight", "hdl", "bmi"), ""),
    Index("lipo", "Lipo-IR", TRACER, RESISTANT, ("rate_glycerol", "i0"), "rate_glycerol * iu_0", details=AS_SUPPLIED),
    Index("atiri", "ATIRI", TRACER, RESISTANT, ("rate_palmitate", "i0"), "rate_palmitate * iu_0", details=AS_SUPPLIED),
)
