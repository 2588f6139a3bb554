"""Belfiore's indices: subject values relative to the means of a normal population."""

from __future__ import annotations

from dataclasses import dataclass

from glucoframe.operators.index_model import (
    INVALID,
    MISSING,
    SENSITIVE,
    UNDEFINED,
    Index,
    RunContext,
    has,
    least_state,
    must_be_positive,
    sql_number,
    sql_text,
    texts,
)

# Reason and warning texts.
NEEDS_MEANS = "requires normal-population reference means"
ONE_SIXTY = "60-min value present for only one of insulin/glucose; using 0-2h area."
BASAL_FORM = "Basal form used: insulin and FFA series lack 120-min values for an area."


def _usable(mean: float | None) -> bool:
    return mean is not None and 0 < mean < float("inf")


def area(prefix: str, with_hour: bool) -> str:
    """Area in unit x hour from the 0, (60) and 120 minute values."""
    if with_hour:
        return f"(0.5D * {prefix}0 + {prefix}60 + 0.5D * {prefix}120)"
    return f"({prefix}0 + {prefix}120)"


@dataclass(frozen=True)
class Form:
    """One way of computing an index: its inputs and the means it is relative to."""

    name: str
    inputs: tuple[tuple[str, str], ...]  # (input column, subject in an error text)
    means: tuple[tuple[str, str], ...]  # (field of BelfioreMeans, subject in an error text)
    lacking: str  # reason when a mean is not supplied
    numerators: tuple[str, str]  # subject values, in the order of the means

    def given(self, run: RunContext) -> list[float | None]:
        return [getattr(run.means, name) for name, _ in self.means]

    def value(self, run: RunContext) -> str:
        if not all(_usable(m) for m in self.given(run)):
            return "cast(NULL AS double)"
        ratios = [f"{x} / {sql_number(m)}" for x, m in zip(self.numerators, self.given(run), strict=True)]
        return f"try_divide(2D, ({ratios[0]}) * ({ratios[1]}) + 1D)"

    def state(self, run: RunContext) -> str:
        if any(m is None for m in self.given(run)):
            return str(UNDEFINED)
        if not all(_usable(m) for m in self.given(run)):
            return str(INVALID)
        return least_state(*[name for name, _ in self.inputs])

    def computable(self, run: RunContext) -> bool:
        return all(_usable(m) for m in self.given(run))

    def errors(self, run: RunContext) -> str:
        items = [f"CASE WHEN s_{n} = {INVALID} THEN {must_be_positive(who, n)} END" for n, who in self.inputs]
        items += [
            must_be_positive(who, sql_number(mean))
            for (_, who), mean in zip(self.means, self.given(run), strict=True)
            if mean is not None and not _usable(mean)
        ]
        return texts(*items)


def _area_form(prefix: str, quantity: str, subject: str, with_hour: bool) -> Form:
    variant = "0_1_2h" if with_hour else "0_2h"
    minutes = (0, 60, 120) if with_hour else (0, 120)
    return Form(
        variant,
        tuple((f"i{t}", f"insulin at {t} min") for t in minutes)
        + tuple((f"{prefix}{t}", f"{subject} at {t} min") for t in minutes),
        (
            (f"insulin_area_{variant}", "Reference insulin area"),
            (f"{quantity}_area_{variant}", f"Reference {subject} area"),
        ),
        f"{NEEDS_MEANS} ({variant} area for insulin and {subject})",
        (area("i", with_hour), area(prefix, with_hour)),
    )


def _basal_form(prefix: str, quantity: str, subject: str, lacking: str) -> Form:
    return Form(
        "basal",
        (("i0", "Fasting insulin"), (f"{prefix}0", f"Fasting {subject}")),
        (("insulin_0", "Reference insulin_0"), (f"{quantity}_0", f"Reference {quantity}_0")),
        lacking,
        ("i0", f"{prefix}0"),
    )


def _first_match(cases: list[tuple[str | None, str]]) -> str:
    """CASE over (condition, expression); the last one has no condition."""
    whens = " ".join(f"WHEN {condition} THEN {expression}" for condition, expression in cases[:-1])
    return f"CASE {whens} ELSE {cases[-1][1]} END" if whens else cases[-1][1]


@dataclass(frozen=True)
class BelfioreIndex(Index):
    """Index with alternative forms, chosen per row by which samples are present."""

    forms: tuple[tuple[str | None, Form], ...] = ()
    warning: tuple[str, str] | None = None  # (condition, text)
    optional: tuple[str, ...] = ()

    def inputs(self):
        return self.needs + self.optional

    def _by_form(self, pick):
        return _first_match([(condition, pick(form)) for condition, form in self.forms])

    def value_sql(self, run):
        return self._by_form(lambda f: f.value(run))

    def state(self, run):
        missing = f"{least_state(*self.needs)} = {MISSING}"
        return f"CASE WHEN {missing} THEN {MISSING} ELSE {self._by_form(lambda f: f.state(run))} END"

    def invalid_reasons(self, run):
        return self._by_form(lambda f: f.errors(run))

    def undefined_reasons(self, run):
        return self._by_form(lambda f: f"array({sql_text(f.lacking)})")

    def warnings(self, run):
        if self.warning is None:
            return texts()
        condition, text = self.warning
        return texts(f"CASE WHEN {has(*self.needs)} AND ({condition}) THEN {sql_text(text)} END")

    def details_sql(self, run):
        return {**self.details, "reference_set": sql_text(run.means.name)}


@dataclass(frozen=True)
class BelfioreFfa(BelfioreIndex):
    """Only a computed value of the basal form carries the warning."""

    def warnings(self, run):
        basal = self.forms[-1][1]
        if not basal.computable(run):
            return texts()
        computed = f"{least_state(*self.needs)} > {INVALID} AND NOT {FFA_AREA}"
        return texts(f"CASE WHEN {computed} THEN {sql_text(BASAL_FORM)} END")


GLY_HOUR = has("i60", "g60")
FFA_AREA = has("i120", "ffa120")
FFA_HOUR = has("i120", "ffa120", "i60", "ffa60")

BELFIORE_INDICES = (
    BelfioreIndex(
        "belfiore_basal", "Belfiore ISI (basal)", "fasting", SENSITIVE, ("i0", "g0"), "",
        forms=((None, _basal_form("g", "glucose", "glucose", NEEDS_MEANS)),),
        details={"form": "'basal'"},
    ),
    BelfioreIndex(
        "belfiore_isi_gly", "Belfiore ISI(gly)", "ogtt", SENSITIVE, ("i0", "i120", "g0", "g120"), "",
        forms=(
            (GLY_HOUR, _area_form("g", "glucose", "glucose", True)),
            (None, _area_form("g", "glucose", "glucose", False)),
        ),
        warning=(f"{has('i60')} <> {has('g60')}", ONE_SIXTY),
        optional=("i60", "g60"),
        details={
            "variant": f"CASE WHEN {GLY_HOUR} THEN '0_1_2h' ELSE '0_2h' END",
            "insulin_area": f"CASE WHEN {GLY_HOUR} THEN {area('i', True)} ELSE {area('i', False)} END",
            "glucose_area": f"CASE WHEN {GLY_HOUR} THEN {area('g', True)} ELSE {area('g', False)} END",
        },
    ),
    BelfioreFfa(
        "belfiore_isi_ffa", "Belfiore ISI(FFA)", "lipid", SENSITIVE, ("i0", "ffa0"), "",
        forms=(
            (FFA_HOUR, _area_form("ffa", "ffa", "FFA", True)),
            (FFA_AREA, _area_form("ffa", "ffa", "FFA", False)),
            (None, _basal_form("ffa", "ffa", "FFA", f"{NEEDS_MEANS} (basal insulin and FFA)")),
        ),
        optional=("i60", "i120", "ffa60", "ffa120"),
        details={
            "form": f"CASE WHEN {FFA_AREA} THEN 'area' ELSE 'basal' END",
            "variant": f"CASE WHEN {FFA_HOUR} THEN '0_1_2h' WHEN {FFA_AREA} THEN '0_2h' END",
            "insulin_area": f"CASE WHEN {FFA_HOUR} THEN {area('i', True)} WHEN {FFA_AREA} THEN {area('i', False)} END",
            "ffa_area": f"CASE WHEN {FFA_HOUR} THEN {area('ffa', True)} WHEN {FFA_AREA} THEN {area('ffa', False)} END",
        },
    ),
)
