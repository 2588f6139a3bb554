"""The 47 indices as SQL over the prepared cohort, written apart from the Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass

from glucoframe.operators.index_model import label, label_at_start
from glucoframe.plans.cohort_sql import with_prepared
from glucoframe.plans.source import rounded_sql

MEAN_G3, MEAN_I3 = "((gm0 + gm30 + gm120) / 3E0)", "((iu0 + iu30 + iu120) / 3E0)"
MEAN_G5, MEAN_I5 = "((gm0 + gm30 + gm60 + gm90 + gm120) / 5E0)", "((iu0 + iu30 + iu60 + iu90 + iu120) / 5E0)"
AUC_G3, AUC_I3 = "((15E0*gm0 + 60E0*gm30 + 45E0*gm120) / 120E0)", "((15E0*iu0 + 60E0*iu30 + 45E0*iu120) / 120E0)"
SI0, SI120 = "(1E8 / (gm0 * iu0 * weight * 150E0))", "(1E8 / (gm120 * iu120 * weight * 150E0))"
MALE = "CASE WHEN sex = 'male' THEN 1E0 ELSE 0E0 END"
BIGTT_SI = (
    f"exp(49E-1 - 402E-5*i0 - 556E-6*i30 - 127E-5*i120 - 152E-3*g0 - 871E-5*g30 - 373E-4*g120 - 145E-3*({MALE}) "
    "- 376E-4*bmi)"
)
BIGTT_AIR = (
    f"exp(82E-1 + 178E-5*i0 + 168E-5*i30 - 383E-6*i120 - 314E-3*g0 - 109E-3*g30 + 781E-4*g120 + 18E-2*({MALE}) "
    "+ 32E-3*bmi)"
)
MATSUDA = "(1E4 / sqrt(gm0 * iu0 * {g} * {i}))"
RISE = "((iu30 - iu0) / g30)"


@dataclass(frozen=True)
class IndexSql:
    needs: tuple[str, ...]
    value: str
    decimals: int = 6
    undefined: str | None = None
    undefined_reason: str | None = None
    invalid_text: str = " must be a finite value > 0."


def _q(needs: str, value: str, decimals: int = 6, undefined: str | None = None, reason: str | None = None, **more):
    return IndexSql(tuple(needs.split()), value, decimals, undefined, reason, **more)


PLAIN = {
    "homa_ir": _q("g0 i0", "g0 * iu0 / 225E-1"),
    "quicki": _q("i0 g0", "1E0 / (log10(iu0) + log10(gm0))",
                 invalid_text=" must be a finite value > 0 (log10 is undefined otherwise)."),
    "firi": _q("i0 g0", "g0 * iu0 / 25E0"),
    "raynaud": _q("i0", "40E0 / iu0"),
    "isi_basal": _q("g0 i0", "1E4 / (gm0 * iu0)"),
    "ig_ratio_basal": _q("g0 i0", "iu0 / g0"),
    "avignon_si0": _q("g0 i0 weight", SI0),
    "isi_120": _q("g120 i120", "1E4 / (gm120 * iu120)"),
    "ig_ratio_120": _q("g120 i120", "iu120 / g120"),
    "gutt": _q("g0 g120 i0 i120 weight",
               "(75000E0 + (gm0 - gm120) * 19E-2 * weight) / 120E0 / ((g0 + g120) / 2E0) / log10((iu0 + iu120) / 2E0)"),
    "matsuda_3pt": _q("g0 i0 g30 i30 g120 i120", MATSUDA.format(g=MEAN_G3, i=MEAN_I3)),
    "matsuda_auc_3pt": _q("g0 i0 g30 i30 g120 i120", MATSUDA.format(g=AUC_G3, i=AUC_I3)),
    "matsuda_5pt": _q("g0 i0 g30 i30 g60 i60 g90 i90 g120 i120", MATSUDA.format(g=MEAN_G5, i=MEAN_I5)),
    "stumvoll_mod": _q("i0 i120 g120", "156E-3 - 459E-7 * i120 - 321E-6 * i0 - 541E-5 * g120", 9),
    "stumvoll_dem": _q("i120 bmi age", "222E-3 - 333E-5 * bmi - 779E-7 * i120 - 422E-6 * age", 9),
    "bigtt_si": _q("g0 g30 g120 i0 i30 i120 bmi sex", BIGTT_SI),
    "avignon_si120": _q("g120 i120 weight", SI120),
    "hiri": _q("g0 g30 i0 i30", "(gm0 + gm30) / 2E0 / 100E0 * ((iu0 + iu30) / 2E0)", 5),
    "ifc": _q("i0 i120", "ln(i120 / i0)"),
    "revised_quicki": _q("g0 i0 ffa0", "1E0 / (log10(iu0) + log10(gm0) + log10(ffa0))"),
    "mcauley": _q("i0 tg", "exp(263E-2 - 28E-2 * ln(iu0) - 31E-2 * ln(tg))"),
    "tyg": _q("tg g0", "ln(tgmg * gm0 / 2E0)"),
    "tg_hdl": _q("tg hdl", "tgmg / hdlmg"),
    "vai": _q("waist bmi tg hdl sex",
              "CASE WHEN sex = 'male' THEN waist / (3968E-2 + 188E-2 * bmi) * (tg / 103E-2) * (131E-2 / hdl) "
              "ELSE waist / (3658E-2 + 189E-2 * bmi) * (tg / 81E-2) * (152E-2 / hdl) END"),
    "lap": _q("waist tg sex", "(waist - CASE WHEN sex = 'male' THEN 65E0 ELSE 58E0 END) * tg"),
    "adipo_ir": _q("ffa0 i0", "ffa0 * iu0"),
    "liri": _q("i0 i30 fat_mass weight hdl bmi",
               "-91E-3 + 4E-1 * log10((iu0 + iu30) / 2E0 * 6E0) + 346E-3 * log10(fat_mass / weight * 100E0) "
               "- 408E-3 * log10(hdlmg) + 435E-3 * log10(bmi)"),
    "lipo": _q("rate_glycerol i0", "rate_glycerol * iu0"),
    "atiri": _q("rate_palmitate i0", "rate_palmitate * iu0"),
    "homa_beta": _q("g0 i0", "20E0 * iu0 / (g0 - 35E-1)", 3, "g0 <= 35E-1",
                    "not defined when fasting glucose is 3.5 mmol/L or lower"),
    "cir30": _q("g30 i30", "100E0 * iu30 / (gm30 * (gm30 - 70E0))", 5, "gm30 <= 70E0",
                "not defined when 30-min glucose is 70 mg/dL or lower"),
    "stumvoll_first_phase": _q("i0 i30 g30", "1283E0 + 1829E-3 * i30 - 1387E-1 * g30 + 3772E-3 * i0", 4),
    "insulinogenic_dg30": _q("g0 g30 i0 i30", "(iu30 - iu0) / (gm30 - gm0)", 4, "g30 = g0",
                             "not defined when 30-min glucose equals fasting glucose"),
    "insulinogenic_g30": _q("i0 i30 g30", RISE),
    "di_madsen_table": _q("g0 i0 g30 i30 g120 i120", f"{RISE} * 1000E0 / (sqrt(gm0 * iu0) * {MEAN_G3} * {MEAN_I3})", 9),
    "di_xinsg30_matsuda": _q("g0 i0 g30 i30 g120 i120", f"{RISE} * {MATSUDA.format(g=MEAN_G3, i=MEAN_I3)}", 5),
    "bigtt_air": _q("g0 g30 g120 i0 i30 i120 bmi sex", BIGTT_AIR, 3),
    "di_bigtt": _q("g0 g30 g120 i0 i30 i120 bmi sex", f"{BIGTT_AIR} * {BIGTT_SI}", 3),
    "glucagon_fasting": _q("gl0", "gl0"),
    "glucagon_auc": _q("gl0 gl30 gl120", "5E-1 * ((gl30 + gl0) * 30E0 + (gl120 + gl30) * 90E0)", 4),
    "glucagon_ratio_120_0": _q("gl0 gl120", "gl120 / gl0"),
    "glucagon_suppression_pct_60": _q("gl0 gl60", "(1E0 - gl60 / gl0) * 100E0"),
    "glucagon_insulin_ratio": _q("gl0 i0", "gl0 / i0", 9),
}
AVIGNON_WEIGHT = "137E-3"
HOUR = "i60 IS NOT NULL AND g60 IS NOT NULL"
GLY_0 = "2E0 / (((i0 + i120) / 36304E-2) * ((g0 + g120) / 1026E-2) + 1E0)"
GLY_1 = "2E0 / (((5E-1*i0 + i60 + 5E-1*i120) / 638E0) * ((5E-1*g0 + g60 + 5E-1*g120) / 1136E-2) + 1E0)"


def _missing(names) -> str:
    return "(" + " OR ".join(f"{n} IS NULL" for n in names) + ")"


def _invalid(names) -> str:
    return "(" + " OR ".join(f"NOT {n} > 0" for n in names if n != "sex") + ")"


def status_sql(id_: str) -> str:
    if id_ == "avignon_sim":
        bad = [f"(NOT {_missing(n)} AND {_invalid(n)})" for n in (("g0", "i0", "weight"), ("g120", "i120", "weight"))]
        return (
            f"CASE WHEN {bad[0]} OR {bad[1]} THEN 'error' "
            f"WHEN {_missing(('g0', 'i0', 'g120', 'i120', 'weight'))} THEN 'unavailable' ELSE 'ok' END"
        )
    if id_ == "belfiore_basal":
        return _status(("i0", "g0"), None)
    if id_ == "belfiore_isi_gly":
        return (
            f"CASE WHEN {_missing(('i0', 'i120', 'g0', 'g120'))} THEN 'unavailable' "
            f"WHEN {_invalid(('i0', 'i120', 'g0', 'g120'))} OR ({HOUR} AND {_invalid(('i60', 'g60'))}) THEN 'error' "
            "ELSE 'ok' END"
        )
    if id_ == "belfiore_isi_ffa":
        return _status(("i0", "ffa0"), None)
    m = PLAIN[id_]
    return _status(m.needs, m.undefined)


def _status(needs, undefined) -> str:
    extra = f"WHEN {undefined} THEN 'unavailable' " if undefined else ""
    return (
        f"CASE WHEN {_missing(needs)} THEN 'unavailable' WHEN {_invalid(needs)} THEN 'error' {extra}ELSE 'ok' END"
        if any(n != "sex" for n in needs) else "'ok'"
    )


def formula_sql(id_: str, weight: str = AVIGNON_WEIGHT) -> str:
    if id_ == "avignon_sim":
        return f"({weight} * {SI0} + {SI120}) / 2E0"
    if id_ == "belfiore_basal":
        return "2E0 / ((i0 / 6571E-2) * (g0 / 508E-2) + 1E0)"
    if id_ == "belfiore_isi_gly":
        return f"CASE WHEN {HOUR} THEN {GLY_1} ELSE {GLY_0} END"
    if id_ == "belfiore_isi_ffa":  # the cohort has fasting FFA only
        return "2E0 / ((i0 / 6571E-2) * (ffa0 / (39888E-2 / 1000)) + 1E0)"
    return PLAIN[id_].value


def decimals(id_: str) -> int:
    return PLAIN[id_].decimals if id_ in PLAIN else 6


def value_sql(id_: str, weight: str = AVIGNON_WEIGHT) -> str:
    """The value where the status is ok, else NULL."""
    return f"CASE WHEN ({status_sql(id_)}) = 'ok' THEN {formula_sql(id_, weight)} END"


def rounded_value_sql(id_: str, sign: str = "") -> str:
    return rounded_sql(sign + "(" + value_sql(id_) + ")", decimals(id_))


def _reason_list(cases: list[str]) -> str:
    return f"concat_ws('; ', {', '.join(cases)})"


def _missing_cases(names) -> list[str]:
    return [f"CASE WHEN {n} IS NULL THEN 'requires {label(n)}' END" for n in names]


def _invalid_cases(names, subject=label_at_start, text=" must be a finite value > 0.") -> list[str]:
    return [f"CASE WHEN NOT {n} > 0 THEN '{subject(n)}{text}' END" for n in names if n != "sex"]


def reason_sql(id_: str) -> str:
    """Reasons joined by '; ' (without the offending value), '' when ok."""
    if id_ == "avignon_sim":
        # weight is always present and positive here, so no reason can be shared by both components
        parts = []
        for names in (("g0", "i0"), ("g120", "i120")):
            parts.append(
                f"CASE WHEN {_missing(names)} THEN nullif({_reason_list(_missing_cases(names))}, '') "
                f"ELSE nullif({_reason_list(_invalid_cases(names))}, '') END"
            )
        return _reason_list(parts)
    if id_ in ("belfiore_basal", "belfiore_isi_ffa", "belfiore_isi_gly"):
        other = "ffa0" if id_ == "belfiore_isi_ffa" else "g0"
        needs = ("i0", "i120", "g0", "g120") if id_ == "belfiore_isi_gly" else ("i0", other)
        if id_ == "belfiore_isi_gly":
            # only fasting glucose can be invalid in this cohort
            invalid = ["CASE WHEN NOT g0 > 0 THEN 'glucose at 0 min must be a finite value > 0.' END"]
        else:
            invalid = _invalid_cases(needs)
        return (
            f"CASE WHEN {_missing(needs)} THEN {_reason_list(_missing_cases(needs))} "
            f"ELSE {_reason_list(invalid)} END"
        )
    m = PLAIN[id_]
    undefined = f"WHEN ({m.undefined}) THEN '{m.undefined_reason}' " if m.undefined else ""
    return (
        f"CASE WHEN {_missing(m.needs)} THEN {_reason_list(_missing_cases(m.needs))} "
        f"WHEN {_invalid(m.needs) if any(n != 'sex' for n in m.needs) else 'FALSE'} "
        f"THEN {_reason_list(_invalid_cases(m.needs, text=m.invalid_text))} {undefined}ELSE '' END"
    )


def index_query(id_: str) -> str:
    return with_prepared(
        f"SELECT visit_id, {status_sql(id_)} AS status, {rounded_value_sql(id_)} AS value FROM prepared"
    )


def long_values_cte(ids: list[str], name: str = "vals") -> str:
    """CTE (visit_id, sex, index_id, value) without missing values."""
    parts = [
        f"SELECT visit_id, sex, '{i}' AS index_id, {value_sql(i)} AS value FROM prepared" for i in ids
    ]
    return f"{name} AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL)"


def long_status_cte(ids: list[str], name: str = "statuses", reasons: bool = False) -> str:
    parts = [
        f"SELECT visit_id, '{i}' AS method_id, {status_sql(i)} AS status"
        + (f", {reason_sql(i)} AS reason" if reasons else "") + " FROM prepared"
        for i in ids
    ]
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


def wide_values_cte(ids: list[str], name: str = "wide") -> str:
    return f"{name} AS (SELECT visit_id, sex, " + ", ".join(f"{value_sql(i)} AS {i}" for i in ids) + " FROM prepared)"
