"""All indices of every row: wide (one column per index) or long (one row per participant and method).

Every step is a narrow projection, so the calculation adds no shuffle. The steps are separate selects:
canonical inputs -> input states and converted units -> state per index -> raw value per index -> status.
Each is read several times by the next, and Catalyst then keeps them apart instead of repeating expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from glucoframe.operators.catalog import (
    INDEX_IDS,
    METHODS,
    NEGATED,
    PROVISIONAL_LEVELS,
    VERIFICATION,
    Deferred,
    check_orientation,
    column_name,
    index,
    oriented_direction,
)
from glucoframe.operators.index_model import (
    INPUTS,
    INVALID,
    MISSING,
    NO_TEXTS,
    UNDEFINED,
    VALID,
    Index,
    RunContext,
    is_finite,
    split_series,
    sql_number,
    sql_text,
)
from glucoframe.settings import BELFIORE_MEANS, AvignonWeight, BelfioreMeans, ConversionSettings

DEFAULTS = ConversionSettings()
NEGATED_NOTE = "negated published index: higher = more sensitive"
NO_DETAILS = "cast(NULL AS map<string,string>)"


def _input_state(name: str, present: bool) -> str:
    if not present:
        return f"{MISSING} AS s_{name}"
    valid = f"{name} IN ('male', 'female')" if name == "sex" else f"{name} > 0D AND {name} < double('Infinity')"
    return f"CASE WHEN {name} IS NULL THEN {MISSING} WHEN {valid} THEN {VALID} ELSE {INVALID} END AS s_{name}"


def _conversion(name: str, s: ConversionSettings) -> str | None:
    """Canonical -> the unit the published formulas use."""
    series = split_series(name)
    if series and series[0] == "g":
        return f"{name} * {sql_number(s.glucose_mg_per_dl)} AS gmg_{series[1]}"
    if series and series[0] == "i":
        return f"{name} / {sql_number(s.insulin_pmol_per_uu)} AS iu_{series[1]}"
    if name == "tg":
        return f"tg * {sql_number(s.tg_mg_per_dl)} AS tgmg"
    if name == "hdl":
        return f"hdl * {sql_number(s.hdl_mg_per_dl)} AS hdlmg"
    return None


def _prepare(df: DataFrame, ids: list[str], run: RunContext, keep: list[str]) -> DataFrame:
    used = {name for id_ in ids for name in index(id_).inputs()}
    names = [name for name in INPUTS if name in used]
    present = set(df.columns)
    raw = []
    for n in names:
        kind = "string" if n == "sex" else "double"
        raw.append(f"cast({n if n in present else 'NULL'} AS {kind}) AS {n}")
    conversions = [x for x in (_conversion(n, run.settings) for n in names) if x]
    states = [_input_state(n, n in present) for n in names]
    kept = [_quoted(k) for k in keep if k not in names]
    return df.selectExpr(*kept, *raw).selectExpr("*", *states, *conversions)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def evaluated(df: DataFrame, ids: list[str], run: RunContext, keep: list[str]) -> DataFrame:
    """The kept columns, input states s_*, and per index state_* and raw_*."""
    states = [f"{index(i).state(run)} AS state_{i}" for i in ids]
    values = [f"CASE WHEN state_{i} = {VALID} THEN {index(i).value_sql(run)} END AS raw_{i}" for i in ids]
    return _prepare(df, ids, run, keep).selectExpr("*", *states).selectExpr("*", *values)


def status_of(id_: str) -> str:
    """SQL for ok, unavailable or error over the columns of evaluated."""
    return (
        f"CASE WHEN state_{id_} IN ({MISSING}, {UNDEFINED}) THEN 'unavailable' "
        f"WHEN state_{id_} = {VALID} AND {is_finite(f'raw_{id_}')} THEN 'ok' ELSE 'error' END"
    )


def _value(id_: str, orientation: str) -> str:
    raw = f"raw_{id_}"
    if orientation == "published" or id_ not in NEGATED:
        return f"CASE WHEN {is_finite(raw)} THEN {raw} END"
    return f"CASE WHEN {raw} = 0D THEN 0D WHEN {is_finite(raw)} THEN -{raw} END"


def _checked(ids: list[str] | None) -> list[str]:
    if ids is None:
        return list(INDEX_IDS)
    for id_ in ids:
        index(id_)
    return [i for i in INDEX_IDS if i in set(ids)]


def calculate_wide(
    df: DataFrame,
    *,
    ids: list[str] | None = None,
    keep: list[str] | None = None,
    settings: ConversionSettings = DEFAULTS,
    means: BelfioreMeans = BELFIORE_MEANS,
    weight: AvignonWeight = AvignonWeight(),
    orientation: str = "published",
    status_columns: bool = False,
) -> DataFrame:
    """`keep` columns, then one value column per index (NULL = not calculated, never 0), then, if asked,
    one `<column>_status` per index. `df` is in canonical units."""
    check_orientation(orientation)
    ids = _checked(ids)
    keep = ["participant_id"] if keep is None else keep
    rows = evaluated(df, ids, RunContext(settings, means, weight), keep)
    names = {i: column_name(i, orientation) for i in ids}
    values = [f"{_value(i, orientation)} AS {names[i]}" for i in ids]
    statuses = [f"{status_of(i)} AS {names[i]}_status" for i in ids] if status_columns else []
    return rows.selectExpr(*map(_quoted, keep), *values, *statuses)


def calculate_long(
    df: DataFrame,
    *,
    ids: list[str] | None = None,
    keep: list[str] | None = None,
    settings: ConversionSettings = DEFAULTS,
    means: BelfioreMeans = BELFIORE_MEANS,
    weight: AvignonWeight = AvignonWeight(),
    orientation: str = "published",
    deferred: bool = True,
    details: bool = False,
) -> DataFrame:
    """One row per (row of df, method): value, status, reasons, warnings and what describes the method.

    The deferred methods are included unless `ids` narrows the list or deferred=False.
    """
    check_orientation(orientation)
    with_deferred = deferred and ids is None
    ids = _checked(ids)
    keep = ["participant_id"] if keep is None else keep
    run = RunContext(settings, means, weight)
    shown = [
        m for m in METHODS if (with_deferred if isinstance(m, Deferred) else m.id in ids)
    ]
    cells = [_long_cell(k, m, run, orientation, details) for k, m in enumerate(shown, start=1)]
    # what describes a method is looked up after the rows are made, so that it costs nothing when unused
    facts = {
        "method_id": [column_name(m.id, orientation) for m in shown],
        "name": [m.name for m in shown],
        "category": [m.category for m in shown],
        "direction": [oriented_direction(m, orientation) for m in shown],
        "orientation": ["published" if column_name(m.id, orientation) == m.id else "sensitivity" for m in shown],
        "source_verification": [VERIFICATION.get(m.id, "unresolved") for m in shown],
    }
    look_up = {name: f"{_text_array(texts)}[_method - 1] AS {name}" for name, texts in facts.items()}
    return (
        evaluated(df, ids, run, keep)
        .selectExpr(*map(_quoted, keep), f"inline(array({', '.join(cells)}))")
        .selectExpr(
            *map(_quoted, keep), look_up["method_id"], look_up["name"], look_up["category"], "value", "status",
            look_up["direction"], look_up["orientation"], look_up["source_verification"], "reasons", "warnings",
            *(["details"] if details else []),
        )
    )


def _text_array(texts: list[str]) -> str:
    return f"array({', '.join(map(sql_text, texts))})"


def _long_cell(number: int, m: Index | Deferred, run: RunContext, orientation: str, details: bool) -> str:
    """The part of a long row that depends on the participant."""
    if isinstance(m, Deferred):
        fields = {
            "value": "cast(NULL AS double)", "status": "'unavailable'",
            "reasons": f"array({sql_text(m.full_reason)})", "warnings": NO_TEXTS,
        }
        entries = {}
    else:
        status = status_of(m.id)
        warnings = m.warnings(run)
        if VERIFICATION.get(m.id) in PROVISIONAL_LEVELS:
            warnings = f"concat({warnings}, array({sql_text(f'Source verification ({VERIFICATION[m.id]})')}))"
        fields = {
            "value": _value(m.id, orientation), "status": status,
            "reasons": m.reasons(run, f"state_{m.id}", status), "warnings": warnings,
        }
        entries = dict(m.details_sql(run)) if details else {}
        if column_name(m.id, orientation) != m.id:
            entries["orientation_note"] = sql_text(NEGATED_NOTE)
    if details:
        pairs = ", ".join(f"{sql_text(k)}, cast({v} AS string)" for k, v in entries.items())
        fields["details"] = f"CASE WHEN {fields['status']} = 'ok' THEN map({pairs}) END" if pairs else NO_DETAILS
    return f"named_struct('_method', {number}, " + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def to_long(wide: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Wide values -> (keep, index_id, value) without the missing ones. Negative zero becomes zero."""
    cells = ", ".join(f"named_struct('index_id', {sql_text(c)}, 'value', {_quoted(c)} + 0D)" for c in columns)
    return wide.selectExpr(*map(_quoted, keep), f"inline(array({cells}))").where(
        "value IS NOT NULL AND NOT isnan(value)"
    )
