"""Counts over results: status per index, reasons, what each participant has."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glucoframe.operators.calculate import evaluated, status_of
from glucoframe.operators.catalog import GROUPS, INDEX_IDS, column_name, index
from glucoframe.operators.index_model import INPUTS, RunContext, sql_text
from glucoframe.settings import BELFIORE_MEANS, AvignonWeight, BelfioreMeans, ConversionSettings

NO_REASON = "(no reason given)"
GOT_VALUE = r" \(got [^)]*\)"


def status_long(wide: DataFrame, ids: list[str] | None = None, keep: list[str] | None = None,
                orientation: str = "published") -> DataFrame:
    """(keep, method_id, status) from the status columns of calculate_wide."""
    names = [column_name(i, orientation) for i in (ids or INDEX_IDS)]
    cells = ", ".join(f"named_struct('method_id', {sql_text(n)}, 'status', {n}_status)" for n in names)
    return wide.selectExpr(*(keep or []), f"inline(array({cells}))")


def status_counts(statuses: DataFrame) -> DataFrame:
    """Per method: ok, unavailable, error. `statuses` needs method_id and status (long results do)."""
    return statuses.groupBy("method_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "unavailable", "error")]
    )


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Add up status counts of several parts of a cohort."""
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together.groupBy("method_id").agg(*[F.sum(s).alias(s) for s in ("ok", "unavailable", "error")])


def reason_counts(
    df: DataFrame, *, ids: list[str] | None = None, settings: ConversionSettings = ConversionSettings(),
    means: BelfioreMeans = BELFIORE_MEANS, weight: AvignonWeight = AvignonWeight(),
) -> DataFrame:
    """Per method and status that is not ok: method_id, status, reason, rows. `df` is canonical.

    What a reason says follows from the states of a method's inputs. So rows are counted by those states, packed into
    one number, and texts are made for the few combinations that occur. They leave out the offending value, which
    would make every bad value its own reason.
    """
    run = RunContext(settings, means, weight)
    ids = [i for i in INDEX_IDS if ids is None or i in set(ids)]
    cells, cases = [], []
    for k, id_ in enumerate(ids):
        inputs = index(id_).inputs()
        states = " + ".join(f"cast(s_{n} AS bigint) * {4 ** place}L" for place, n in enumerate(inputs))
        status = status_of(id_)
        cells.append(f"named_struct('method', {k}, 'status', {status}, 'state', state_{id_}, 'states', CASE WHEN {status} <> 'ok' THEN {states} END)")
        place = {n: at for at, n in enumerate(inputs)}
        reasons = re.sub(r"\bs_([a-z][a-z0-9_]*)\b", lambda m: f"cast(shiftright(states, {2 * place[m[1]]}) & 3 AS int)", index(id_).reasons(run, "state", "status"))
        cases.append(f"WHEN {k} THEN {reasons}")
    counted = (
        evaluated(df, ids, run, []).selectExpr(f"inline(array({', '.join(cells)}))").where("status <> 'ok'")
        .groupBy("method", "status", "state", "states").agg(F.count(F.lit(1)).alias("rows"))
    )
    # the values that a text would name are not known any more; any number does, it is taken out again
    named = counted.selectExpr("*", *[f"{'NULL' if n == 'sex' else '0D'} AS {n}" for n in INPUTS])
    texts = named.selectExpr(
        f"array({', '.join(map(sql_text, ids))})[method] AS method_id", "status", "rows",
        f"concat_ws('; ', CASE method {' '.join(cases)} END) AS text",
    )
    plain = F.regexp_replace("text", GOT_VALUE, "")
    return texts.groupBy("method_id", "status", F.when(plain == "", NO_REASON).otherwise(plain).alias("reason")).agg(F.sum("rows").alias("rows"))


def top_reasons(counts: DataFrame, n: int = 3) -> DataFrame:
    """The n most frequent reasons per method and status, ties in text order.

    Works on counted reasons, of which there are at most a few dozen per method.
    """
    order = Window.partitionBy("method_id", "status").orderBy(F.desc("rows"), F.asc("reason"))
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def availability(wide: DataFrame, key: str, ids: list[str] | None = None) -> DataFrame:
    """Per participant: how many indices could be calculated, in total and per group."""
    ids = ids or INDEX_IDS

    def count(members: list[str]) -> str:
        return "cast(" + " + ".join(f"(CASE WHEN {i} IS NULL THEN 0 ELSE 1 END)" for i in members) + " AS bigint)"

    groups = [(g, [i for i in ids if index(i).category == g]) for g, _ in GROUPS]
    return wide.selectExpr(
        key, f"{count(ids)} AS available", *[f"{count(members)} AS {g}" for g, members in groups if members]
    )
