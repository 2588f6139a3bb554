"""What an index is: identity, required inputs, and SQL expressions for value, state and reasons.

The expressions read the columns that operators.calculate prepares once per row: the canonical inputs
(g0, i30, tg, ...), their states (s_g0, ...) and converted units (gmg_0 = glucose in mg/dL, iu_0 = insulin
in uU/mL, tgmg, hdlmg). They are expression texts rather than Column objects because all indices together
would otherwise take tens of thousands of calls into the JVM to build.

State codes (per input and per index) are ordered MISSING < INVALID < VALID, so the state of an index is the
least state of its inputs: any missing input makes it unavailable even when another one is invalid.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from glucoframe.settings import AvignonWeight, BelfioreMeans, ConversionSettings

MISSING, INVALID, VALID, UNDEFINED = 0, 1, 2, 3

SENSITIVE = "higher_more_sensitive"
RESISTANT = "higher_more_resistant"
DESCRIPTIVE = "descriptive"

GLUCOSE_MINUTES = (0, 30, 60, 90, 120)
INSULIN_MINUTES = (0, 30, 60, 90, 120)
GLUCAGON_MINUTES = (0, 30, 60, 120)
FFA_MINUTES = (0, 60, 120)
SERIES_PREFIX = {"g": "glucose", "i": "insulin", "gl": "glucagon", "ffa": "FFA"}

# How inputs are named in reasons.
SCALAR_LABELS = {
    "tg": "triglycerides",
    "hdl": "HDL cholesterol",
    "weight": "body weight",
    "bmi": "BMI",
    "waist": "waist circumference",
    "age": "age",
    "sex": "sex (male/female)",
    "fat_mass": "fat mass (DXA)",
    "rate_glycerol": "glycerol rate of appearance",
    "rate_palmitate": "palmitate rate of appearance",
}
NOT_FINITE = "Result is not finite for these inputs (division by zero or log of a non-positive value)."
BAD_SEX = "Sex must be male or female."

SERIES_INPUTS = tuple(
    [f"g{t}" for t in GLUCOSE_MINUTES]
    + [f"i{t}" for t in INSULIN_MINUTES]
    + [f"gl{t}" for t in GLUCAGON_MINUTES]
    + [f"ffa{t}" for t in FFA_MINUTES]
)
INPUTS = SERIES_INPUTS + tuple(SCALAR_LABELS)

NO_TEXTS = "cast(array() AS array<string>)"


def split_series(name: str) -> tuple[str, int] | None:
    """'gl30' -> ('gl', 30); None for scalars."""
    head = name.rstrip("0123456789")
    if head in SERIES_PREFIX and head != name:
        return head, int(name[len(head):])
    return None


def label(name: str) -> str:
    series = split_series(name)
    if series is None:
        return SCALAR_LABELS.get(name, name)
    prefix, minute = series
    return f"{'fasting' if minute == 0 else f'{minute}-min'} {SERIES_PREFIX[prefix]}"


def label_at_start(name: str) -> str:
    text = label(name)
    return text[0].upper() + text[1:]


def sql_text(text: str | None) -> str:
    """A string literal."""
    if text is None:
        return "cast(NULL AS string)"
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def sql_number(value: float) -> str:
    """A double literal."""
    return f"{float(value)!r}D"


def least_state(*names: str) -> str:
    states = [f"s_{n}" for n in names]
    return states[0] if len(states) == 1 else f"least({', '.join(states)})"


def has(*names: str) -> str:
    return f"({least_state(*names)} > {MISSING})"


def is_finite(v: str) -> str:
    """True for finite doubles; NaN sorts above every number in Spark, so it fails the second test."""
    return f"({v} > double('-Infinity') AND {v} < double('Infinity'))"


def texts(*items: str) -> str:
    """Array of the non-NULL texts."""
    return f"array_compact(array({', '.join(items)}))" if items else NO_TEXTS


def number_text(v: str) -> str:
    """A double as text, whole numbers without '.0'."""
    return (
        f"CASE WHEN isnan({v}) THEN 'NaN' "
        f"WHEN abs({v}) < 1e15D AND {v} = floor({v}) THEN cast(cast({v} AS bigint) AS string) "
        f"ELSE cast({v} AS string) END"
    )


def must_be_positive(subject: str, v: str) -> str:
    return f"concat({sql_text(subject + ' must be a finite value > 0 (got ')}, {number_text(v)}, ').')"


@dataclass(frozen=True)
class RunContext:
    """Settings an expression may depend on."""

    settings: ConversionSettings
    means: BelfioreMeans
    weight: AvignonWeight


@dataclass(frozen=True)
class Index:
    """One published index.

    value         expression over valid inputs; NULL or a non-finite result becomes an error
    undefined     (condition, reason): valid inputs for which the index does not exist
    invalid_text  text for an invalid input with {who}; by default the offending value is named
    details       extra named expressions, see calculate_long(details=True)
    """

    id: str
    name: str
    category: str
    direction: str
    needs: tuple[str, ...]
    value: str
    direction_text: str | None = None
    undefined: tuple[str, str] | None = None
    not_finite: str = NOT_FINITE
    invalid_text: str | None = None
    details: dict[str, str] = field(default_factory=dict, hash=False)

    def inputs(self) -> tuple[str, ...]:
        """Every input column that value, state or reasons read."""
        return self.needs

    def value_sql(self, run: RunContext) -> str:
        return self.value

    def details_sql(self, run: RunContext) -> dict[str, str]:
        return self.details

    def state(self, run: RunContext) -> str:
        code = least_state(*self.needs)
        if self.undefined is None:
            return code
        return f"CASE WHEN {code} = {VALID} AND ({self.undefined[0]}) THEN {UNDEFINED} ELSE {code} END"

    def missing_reasons(self, run: RunContext) -> str:
        return texts(*[f"CASE WHEN s_{n} = {MISSING} THEN {sql_text('requires ' + label(n))} END" for n in self.needs])

    def invalid_reasons(self, run: RunContext) -> str:
        return texts(*[f"CASE WHEN s_{n} = {INVALID} THEN {self._invalid(n)} END" for n in self.needs])

    def undefined_reasons(self, run: RunContext) -> str:
        return f"array({sql_text(self.undefined[1])})" if self.undefined else NO_TEXTS

    def warnings(self, run: RunContext) -> str:
        return NO_TEXTS

    def _invalid(self, name: str) -> str:
        if name == "sex":
            return sql_text(BAD_SEX)
        if self.invalid_text is not None:
            return sql_text(self.invalid_text.format(who=label_at_start(name)))
        return must_be_positive(label_at_start(name), name)

    def reasons(self, run: RunContext, state: str, status: str) -> str:
        return (
            f"CASE WHEN {status} = 'ok' THEN {NO_TEXTS} "
            f"WHEN {state} = {MISSING} THEN {self.missing_reasons(run)} "
            f"WHEN {state} = {INVALID} THEN {self.invalid_reasons(run)} "
            f"WHEN {state} = {UNDEFINED} THEN {self.undefined_reasons(run)} "
            f"ELSE array({sql_text(self.not_finite)}) END"
        )
