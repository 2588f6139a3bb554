"""Conversation structure repair: the cheapest edits that make turns alternate, ties broken by ranked audits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucoframe.session import cut_lineage

# What an edit costs; an undeleted truncated turn adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# Turns of one conversation that are repaired at once. Longer conversations are cut into such segments.
SEGMENT = 8192
BLANKS = " \t\n\v\f\r"
# What may follow: START, SYSTEM and ASSISTANT lead on; a conversation ends at START (nothing left) or ASSISTANT.
START, SYSTEM, USER, ASSISTANT = range(4)
_FIRST = {"s": 0, "u": 1, "a": 2}
_OTHER = 3
_KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
_GIVEN = np.array([USER, USER, ASSISTANT, USER])  # the role a reroled or inserted turn takes after each state
_CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
_ENDS = np.array([0, 2 * INSERT, INSERT, 0])
_FAR = 1 << 40
_LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
_LEGAL = {"su", "ua", "au"}
SOUND, BLANK, DUPLICATE, CUT_SHORT = range(4)


@dataclass
class Problem:
    """Turns to repair: per turn 4 * fault + role (system, user, assistant, other), and the cost still to come per end state."""

    codes: np.ndarray
    ends: np.ndarray


@dataclass
class Solution:
    """Per state before the first turn: the least cost, its least audit, that audit's place among the audits of equally
    long problems that were solved together, and the state after the last turn."""

    costs: np.ndarray
    audits: list[str]
    ranks: np.ndarray
    exits: np.ndarray


def solve(problems: list[Problem]) -> list[Solution]:
    """The cheapest edits of each problem; of equally cheap ones those with the least audit (letters of D, I, K, R in order).

    Nodes are (turn, state). A cost recursion from the end finds the arcs that lie on cheapest paths. Insertions stand before a
    turn, so an audit ends with the last turn's letter and none is the start of another one that is as cheap. Nodes are
    ranked by the least letter of their cheapest arcs, then by the ranks of 2, 4, 8, ... letters: the pair of a node's own rank
    and that of the node so many letters on. The pointers of all rounds then give the path from any node.
    Problems are solved together by size (powers of two), so that no table is padded by more than twice.
    """
    solved: list[Solution | None] = [None] * len(problems)
    sizes: dict[int, list[int]] = {}
    for k, problem in enumerate(problems):
        sizes.setdefault(len(problem.codes).bit_length(), []).append(k)
    for members in sizes.values():
        for k, solution in zip(members, _solve([problems[k] for k in members])):
            solved[k] = solution
    return solved  # type: ignore[return-value]


def _solve(problems: list[Problem]) -> list[Solution]:
    lengths = np.array([len(p.codes) for p in problems])
    order = np.argsort(-lengths, kind="stable")
    layers = lengths + 1
    first = np.concatenate([[0], np.cumsum(layers)])[:-1]  # number of each problem's first layer; four nodes a layer
    codes = np.concatenate([p.codes for p in problems]) if problems else np.zeros(0, np.int64)
    code_at = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    total = int(layers.sum())
    cost = np.full((total, 4), _FAR, np.int64)
    letter = np.zeros((total, 4), np.int8)
    target = np.arange(total * 4).reshape(total, 4)
    cost[first + lengths] = np.array([p.ends for p in problems])
    sorted_lengths = -lengths[order]
    for back in range(1, int(lengths.max(initial=0)) + 1):
        active = order[: np.searchsorted(sorted_lengths, -back, side="right")]
        at = first[active] + lengths[active] - back
        code = codes[code_at[active] + lengths[active] - back]
        role, fault = code & 3, code >> 2
        later = cost[at + 1]
        stays = (fault != BLANK) & (fault != DUPLICATE)
        extra = np.where(fault == CUT_SHORT, TRUNCATED, 0)
        kept_state = _KEPT[:, role].T
        # options in the order of their letters D, I, K, R, which decides between equal costs
        options = np.full((4, len(at), 4), _FAR, np.int64)
        options[0] = later + DELETE
        kept = np.take_along_axis(later, np.maximum(kept_state, 0), 1) + KEEP + extra[:, None]
        options[2] = np.where((kept_state >= 0) & stays[:, None], kept, _FAR)
        options[3] = np.where(stays[:, None], later[:, _GIVEN] + REROLE + extra[:, None], _FAR)
        plain = options.min(0)
        closed = plain.copy()
        closed[:, USER] = np.minimum(plain[:, USER], plain[:, ASSISTANT] + INSERT)
        closed[:, ASSISTANT] = np.minimum(plain[:, ASSISTANT], plain[:, USER] + INSERT)
        options[1] = closed[:, _GIVEN] + INSERT
        best = options.argmin(0)
        cost[at] = np.minimum(np.take_along_axis(options, best[None], 0)[0], _FAR)
        next_layer, same_layer = 4 * (at + 1)[:, None], 4 * at[:, None]
        targets = np.stack([
            next_layer + np.arange(4), same_layer + _GIVEN[None, :].repeat(len(at), 0), next_layer + np.maximum(kept_state, 0), next_layer + _GIVEN[None, :].repeat(len(at), 0),
        ])
        reachable = cost[at] < _FAR
        letter[at] = np.where(reachable, best + 1, 0)
        target[at] = np.where(reachable, np.take_along_axis(targets, best[None], 0)[0], same_layer + np.arange(4))
    letters, pointers = letter.reshape(-1), [target.reshape(-1)]
    ranks = letters.astype(np.int64)
    moving = letters > 0
    while moving[pointers[-1]].any():
        ranks = np.unique(ranks * (ranks.max() + 1) + ranks[pointers[-1]], return_inverse=True)[1]
        pointers.append(pointers[-1][pointers[-1]])
    steps = (4 * first[:, None] + np.arange(4)).reshape(-1, 1)
    for pointer in pointers:
        steps = np.concatenate([steps, pointer[steps]], 1)
    written = _LETTERS[letters[steps]]
    out = []
    for k, begin in enumerate(first.tolist()):
        rows = slice(4 * k, 4 * k + 4)
        audits = [row.tobytes().rstrip(b"\0").decode() for row in written[rows]]
        out.append(Solution(cost[begin], audits, ranks[4 * begin : 4 * begin + 4], steps[rows, -1] & 3))
    return out


def fault_of(role: str, text: str, seen: set) -> int:
    """The first fault of a turn after those seen before it."""
    bare = text.rstrip(BLANKS)
    known = (role, text) in seen
    seen.add((role, text))
    if not bare:
        return BLANK
    return DUPLICATE if known else CUT_SHORT if bare[-1] not in ".!?" else SOUND


def code_of(role: str, fault: int) -> int:
    return 4 * fault + _FIRST.get(role[:1], _OTHER)


def repaired(turns: Iterable[tuple[str, str]], audit: str, state: int = START) -> Iterator[tuple[str, str]]:
    """The turns (role, text) that an audit makes of others, from a state on."""
    left = iter(turns)
    for edit in audit:
        given = "user" if _GIVEN[state] == USER else "assistant"
        if edit == "I":
            yield given, ""
            state = int(_GIVEN[state])
            continue
        role, text = next(left)
        if edit == "R":
            yield given, text
            state = int(_GIVEN[state])
        elif edit == "K":
            yield role, text
            state = int(_KEPT[state, _FIRST[role[0]]])


@dataclass
class Tally:
    """What is counted along the turns of a conversation or of a segment of it."""

    first: str = ""
    last: str = ""
    turns: int = 0
    low: int | None = None
    high: int | None = None
    distinct: int = 0
    faults: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0

    def add(self, turn: int | None, role: str, fault: int) -> None:
        initial = role[:1]
        if self.turns:
            self.illegal += self.last + initial not in _LEGAL
        else:
            self.first = initial
        self.last = initial
        self.turns += 1
        self.faults[fault] += 1
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.distinct += turn != self.high
            self.high = turn

    @staticmethod
    def joined(parts: list[Tally]) -> Tally:
        """That of parts in order."""
        whole = Tally()
        for part in parts:
            whole.illegal += part.illegal + bool(whole.turns and part.turns and whole.last + part.first not in _LEGAL)
            whole.distinct += part.distinct - (part.low is not None and part.low == whole.high)
            whole.faults = [a + b for a, b in zip(whole.faults, part.faults)]
            if part.turns:
                whole.first = whole.first if whole.turns else part.first
                whole.last = part.last
            whole.turns += part.turns
            whole.low = part.low if whole.low is None else whole.low
            whole.high = whole.high if part.high is None else part.high
        return whole

    def counts(self) -> tuple[int, int, int, int, int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT_SHORT], self.illegal


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_COUNTED = ", ".join(f"{name} long" for name in COUNTS)
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def damaged(conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): the rows with faults put in by the checksum of `id:turn`, and how often each stands.

    Null roles and texts, and null ids and turns in the checksum, count as one space.
    """
    def filled(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled(id_column), F.lit(":"), filled(turn_column)).cast("binary")) % 20
    rows = conversations.select(
        F.col(f"`{id_column}`").alias("conv"), F.col(f"`{turn_column}`").cast("long").alias("turn"), filled(role_column).alias("role"),
        filled(text_column).alias("text"), kind.alias("kind"),
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _read(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            yield from zip(*(piece.column(name).to_pylist() for name in names))


def _first_pass(segment: int):
    """Repairs conversations that lie inside a sorted partition; hands on the turns of all others.

    The first and last conversation of a partition may go on in its neighbours, and one of more than `segment` turns is
    too long to hold: their turns go on as rows. At most `segment` turns are held, in all conversations that wait.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        closed: list[tuple] = []  # conversations that wait to be solved: id, turns, codes, tally
        waiting = 0
        no = 0

        def solutions() -> pa.RecordBatch:
            nonlocal closed, waiting
            rows = []
            for (conv, turns, _, tally), solution in zip(closed, solve([Problem(np.array(codes, np.int64), _ENDS) for _, _, codes, _ in closed])):
                audit = solution.audits[START] + _CLOSING[int(solution.exits[START])]
                made = [{"role": role, "text": text} for role, text in repaired(turns, audit)]
                rows.append((conv, *tally.counts(), int(solution.costs[START]), audit, made))
            closed, waiting = [], 0
            return _batch(kind, results=rows)

        def opened(conv, rows: list[tuple]) -> pa.RecordBatch:
            nonlocal no
            made = [(conv, part, no + k, turn, role, text) for k, (turn, role, text) in enumerate(rows)]
            no += len(made)
            return _batch(kind, rows=made)

        kind = None
        now, held, is_open, started, places = None, [], True, False, 0
        for batch in batches:
            kind = kind or batch.schema.field("conv").type
            for conv, turn, role, text, copies in _read(iter([batch]), ("conv", "turn", "role", "text", "copies")):
                if started and conv != now or not started:
                    if started:
                        if is_open:
                            yield opened(now, held)
                        else:
                            seen: set = set()
                            tally, codes = Tally(), []
                            for t, r, x in held:
                                fault = fault_of(r, x, seen)
                                tally.add(t, r, fault)
                                codes.append(code_of(r, fault))
                            closed.append((now, [(r, x) for _, r, x in held], codes, tally))
                            waiting += len(held) + 1
                            if waiting > segment:
                                yield solutions()
                    now, held, is_open, started, places = conv, [], not started, True, 0
                    if is_open:
                        yield _batch(kind, rows=[(conv, part, -1, None, None, None)])
                held += [(turn, role, text)] * copies
                places += copies
                if len(held) > (256 if is_open else segment):
                    if not is_open:
                        yield _batch(kind, rows=[(conv, part, -1, None, None, None)])
                    is_open = True
                    yield opened(now, held)
                    held = []
        if started:
            if not is_open:
                yield _batch(kind, rows=[(now, part, -1, None, None, None)])
            yield opened(now, held)
        if closed:
            yield solutions()

    return run


def _batch(kind: pa.DataType, rows: list[tuple] = (), results: list[tuple] = ()) -> pa.RecordBatch:
    """Turns that go on, or finished conversations, in one shape. A place of -1 names a conversation without a turn."""
    count = len(rows) + len(results)
    shape = [kind, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string(), _TURNS]
    lines = [(*row, *[None] * 8) for row in rows] + [(row[0], None, None, None, None, None, *row[1:]) for row in results]
    columns = list(zip(*lines)) if count else [()] * len(shape)
    return pa.RecordBatch.from_arrays([pa.array(column, k) for column, k in zip(columns, shape)], names=["conv", "part", "no", "turn", "role", "text", *COUNTS, "audit", "turns"])


def _segments(table: pa.Table) -> pa.Table:
    """One row for a segment of turns: its tally, and for each state before and after it the least cost, audit and rank."""
    table = table.sort_by("no")
    conv, part, block = (table.column(name)[0].as_py() for name in ("conv", "part", "block"))
    tally, codes = Tally(), []
    for turn, initial, fault in zip(*(table.column(name).to_pylist() for name in ("turn", "initial", "fault"))):
        if fault is not None:
            tally.add(turn, initial, fault)
            codes.append(code_of(initial, fault))
    problems = [Problem(np.array(codes, np.int64), np.where(np.arange(4) == end, 0, _FAR)) for end in range(4)]
    costs, audits, ranks = [], [], []
    for solution in solve(problems):
        costs += solution.costs.tolist()
        audits += solution.audits
        ranks += solution.ranks.tolist()
    made = {
        "conv": [conv], "part": [part], "block": [block], "first": [tally.first], "last": [tally.last],
        "numbers": [[tally.turns, tally.low, tally.high, tally.distinct, tally.illegal, *tally.faults]],
        "costs": [costs], "audits": [audits], "ranks": [ranks],
    }
    return pa.table({name: pa.array(value, k) for (name, value), k in zip(made.items(), _segment_types(table.schema.field("conv").type))})


def _segment_types(kind: pa.DataType) -> list[pa.DataType]:
    return [kind, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())]


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through the segments of each conversation from the last to the first and picks the least path.

    Per state the cost to the end and its first segment's audit are kept; between equal costs the rank of that audit decides, as
    audits of the same turns differ inside the segment.
    """
    kind, now, chosen, tallies, cost = None, None, None, [], _ENDS
    names = ("conv", "part", "block", "first", "last", "numbers", "costs", "audits", "ranks")

    def finished() -> pa.RecordBatch:
        state, rows = START, []
        total = Tally.joined(tallies[::-1])
        for place, (part, block, nexts, audits) in enumerate(reversed(chosen)):
            audit, after = audits[state], nexts[state]
            if place == len(chosen) - 1:
                audit += _CLOSING[after]
            rows.append((now, part, block, state, audit, *total.counts(), int(cost[START])))
            state = after
        shape = [kind, pa.int32(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 6]
        labels = ["conv", "part", "block", "state", "audit", *COUNTS]
        return pa.RecordBatch.from_arrays([pa.array(column, k) for column, k in zip(zip(*rows), shape)], names=labels)

    for batch in batches:
        kind = kind or batch.schema.field("conv").type
        for conv, part, block, first, last, numbers, costs, audits, ranks in _read(iter([batch]), names):
            if chosen is None or conv != now:
                if chosen:
                    yield finished()
                now, chosen, tallies, cost = conv, [], [], _ENDS
            turns, low, high, distinct, illegal, *faults = numbers
            tallies.append(Tally(first, last, turns, low, high, distinct, faults, illegal))
            best, nexts, texts = [], [], []
            for state in range(4):
                options = [(min(costs[4 * end + state] + int(cost[end]), _FAR), ranks[4 * end + state], end) for end in range(4)]
                least = min(options)
                best.append(least[0])
                nexts.append(least[2])
                texts.append(audits[4 * least[2] + state])
            cost = np.array(best)
            chosen.append((part, block, nexts, texts))
    if chosen:
        yield finished()


def _mended(table: pa.Table) -> pa.Table:
    """The repaired turns of one segment."""
    table = table.sort_by("no")
    turns = [(role, text) for role, text in zip(table.column("role").to_pylist(), table.column("text").to_pylist()) if role is not None]
    made = repaired(turns, table.column("audit")[0].as_py(), table.column("state")[0].as_py())
    keep = table.slice(0, 1).drop(["no", "role", "text", "state"])
    return keep.append_column("turns", pa.array([[{"role": role, "text": text} for role, text in made]], _TURNS))


def repair(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Rows (conv_id, part, block, gaps, blank, duplicate, truncated, illegal, cost, audit, turns) from (conv, turn, role, text, copies).

    A conversation has one row with part null, or, if it was cut, one per segment in the order of part and block, each with
    its piece of the audit and of the repaired turns (the counts are those of the whole conversation).

    Turns are sorted by conversation, turn (nulls first), role and the SHA-256 of the text over all tasks, so a conversation of any
    length is spread over as many tasks as it fills. Conversations inside one task are repaired there, in bounded batches.
    Those cut by a task's border or longer than `segment` turns are cut into segments: duplicates are found by a least place
    per role and text, each segment is solved for all states before and after it, and the segments of a conversation are
    chained by costs and ranks. No text of a whole conversation is ever in one task; its audit is, in the chain.

    `copies` 0 stands for a dropped turn: a conversation without turns has zeros and an empty audit. A null conv is a
    conversation. Roles count by their first letter; an empty or other role is never kept. Repeated rows are duplicates.
    An empty table gives no rows.
    """
    order = ["conv", "turn", "role", "digest", "place"]
    placed = turns.select("conv", "turn", "role", "text", "copies", F.unhex(F.sha2("text", 256)).alias("digest"), F.monotonically_increasing_id().alias("place"))
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    id_type = turns.schema["conv"].dataType.simpleString()
    result = f"{_COUNTED}, audit string, turns array<struct<role:string,text:string>>"
    shape = f"conv {id_type}, part int, no long, turn long, role string, text string, {result}"
    read = cut_lineage(ordered.select("conv", "turn", "role", "text", "copies").mapInArrow(_first_pass(segment), shape))
    done = read.where(F.col("audit").isNotNull()).select("conv", "part", F.lit(0).cast("long").alias("block"), *COUNTS, "audit", "turns")
    rest = read.where(F.col("audit").isNull()).select("conv", "part", "no", "turn", "role", "text", F.expr(f"greatest(no, 0) div {segment}").alias("block"))
    by = ["conv", "part", "block"]
    numbers = "first string, last string, numbers array<bigint>, costs array<bigint>, audits array<string>, ranks array<bigint>"
    solved = _faults(rest).groupBy(*by).applyInArrow(_segments, f"conv {id_type}, part int, block long, {numbers}")
    backwards = solved.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("block"))
    chosen = cut_lineage(backwards.mapInArrow(_chain, f"conv {id_type}, part int, block long, state int, audit string, {_COUNTED}"))
    picked = chosen.select(F.col("conv").alias("of"), F.col("part").alias("of_part"), F.col("block").alias("of_block"), "state", "audit", *COUNTS)
    here = F.col("conv").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")) & (F.col("block") == F.col("of_block"))
    held = rest.join(picked, here).select(*by, "no", "role", "text", "state", *COUNTS, "audit")
    long_ones = held.groupBy(*by).applyInArrow(_mended, f"conv {id_type}, part int, block long, {result}")
    return done.unionByName(long_ones).withColumnRenamed("conv", "conv_id")


def _faults(rest: DataFrame) -> DataFrame:
    """The first fault of every turn of the conversations that were cut; null for a row without a turn."""
    said = F.sha2(F.concat(F.sha2("role", 256), F.sha2("text", 256)), 256)
    initial, end = F.substring("role", 1, 1), F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    place = F.struct("part", "no")
    coded = rest.where("no >= 0").select("conv", "part", "block", "no", "turn", initial.alias("initial"), said.alias("said"), end.alias("end"))
    first = coded.groupBy("conv", "said").agg(F.min(place).alias("first")).select(F.col("conv").alias("of"), F.col("said").alias("what"), "first")
    same = F.col("conv").eqNullSafe(F.col("of")) & (F.col("said") == F.col("what"))
    fault = (
        F.when(F.col("end") == "", BLANK).when(F.col("first") < place, DUPLICATE).when(~F.col("end").isin(".", "!", "?"), CUT_SHORT).otherwise(SOUND)
    )
    faults = coded.join(first, same).select("conv", "part", "block", "no", "turn", "initial", fault.alias("fault"))
    empty = rest.where("no < 0").select("conv", "part", "block", "no", "turn", F.lit("").alias("initial"), F.lit(None).cast("int").alias("fault"))
    return faults.unionByName(empty)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its segments in order; lines are fed to the digest and not kept."""
    kind, now, pieces, digest, some, counts = None, None, None, None, False, ()

    def finished() -> pa.RecordBatch:
        shape = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        row = (now, *counts, "".join(pieces), digest.hexdigest())
        return pa.RecordBatch.from_arrays([pa.array([value], k) for value, k in zip(row, shape)], names=["conv_id", *COUNTS, "audit", "repaired_sha256"])

    for batch in batches:
        kind = kind or batch.schema.field("conv_id").type
        for conv, audit, lines, *numbers in _read(iter([batch]), ("conv_id", "audit", "lines", *COUNTS)):
            if pieces is None or conv != now:
                if pieces is not None:
                    yield finished()
                now, pieces, digest, some, counts = conv, [], hashlib.sha256(), False, numbers
            pieces.append(audit)
            if lines is not None:
                digest.update(("\n" + lines if some else lines).encode())
                some = True
    if pieces is not None:
        yield finished()


def digested(repairs: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, the counts, the whole audit, and the SHA-256 of its lines role:text.

    The segments of a cut conversation meet in order in one task, which feeds them to the digest one by one: SHA-256 can't be
    put together from parts.
    """
    lines = F.when(F.size("turns") > 0, F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"))
    rows = repairs.select("conv_id", "part", "block", *COUNTS, "audit", lines.alias("lines"))
    whole = rows.where(F.col("part").isNull())
    cut = rows.where(F.col("part").isNotNull()).repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    id_type = repairs.schema["conv_id"].dataType.simpleString()
    joined = cut.mapInArrow(_joined, f"conv_id {id_type}, {_COUNTED}, audit string, repaired_sha256 string")
    digest = F.sha2(F.coalesce("lines", F.lit("")), 256).alias("repaired_sha256")
    return whole.select("conv_id", *COUNTS, "audit", digest).unionByName(joined)
