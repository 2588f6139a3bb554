"""Cheapest edits and least audits against all edits of small conversations and a plain search over larger ones."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glucoframe.llm import conversation_repair as repair

SHAPE = "conv_id long, turn long, role string, text string"
FULL = re.compile("(s?(ua)+)?")


def faults(turns):
    seen, found = set(), []
    for role, text in turns:
        bare = text.rstrip(" \t\n\v\f\r")
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "sound" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def all_edits(turns):
    """The least (cost, audit, lines) by trying every edit of every turn with up to two insertions at every place."""
    found, best = faults(turns), None
    steps = [[("D", 4, None)] + ([] if fault in ("blank", "duplicate") else [(letter, price + 3 * (fault == "truncated"), role_) for letter, price, role_ in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant"))]) for (role, _), fault in zip(turns, found)]
    inserts = [()] + [tuple(c) for n in (1, 2) for c in itertools.product(("user", "assistant"), repeat=n)]
    for choice in itertools.product(*steps):
        for added in itertools.product(inserts, repeat=len(turns) + 1):
            audit, cost, lines = "", 0, []
            for k in range(len(turns) + 1):
                audit += "I" * len(added[k])
                cost += 3 * len(added[k])
                lines += [(role, "") for role in added[k]]
                if k < len(turns):
                    letter, price, role = choice[k]
                    audit, cost = audit + letter, cost + price
                    if role is not None:
                        lines.append((role, turns[k][1]))
            if FULL.fullmatch("".join(role[:1] or "?" for role, _ in lines)):
                best = min(best, (cost, audit, lines)) if best else (cost, audit, lines)
    return best


def searched(turns):
    """The same by a search that always extends the least (cost, audit)."""
    found, queue, done = faults(turns), [(0, "", 0, 0, ())], set()
    after = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    while queue:
        cost, audit, k, state, lines = heapq.heappop(queue)
        if k == len(turns) and state in (0, 3):
            return cost, audit, list(lines)
        if (k, state, audit) in done:
            continue
        done.add((k, state, audit))
        target, given = after[state]
        heapq.heappush(queue, (cost + 3, audit + "I", k, target, (*lines, (given, ""))))
        if k < len(turns):
            role, text = turns[k]
            heapq.heappush(queue, (cost + 4, audit + "D", k + 1, state, lines))
            if found[k] not in ("blank", "duplicate"):
                more = 3 * (found[k] == "truncated")
                heapq.heappush(queue, (cost + 3 + more, audit + "R", k + 1, target, (*lines, (given, text))))
                kept = 1 if role[:1] == "s" and state == 0 else target if role[:1] == given[0] else None
                if kept is not None:
                    heapq.heappush(queue, (cost + more, audit + "K", k + 1, kept, (*lines, (role, text))))


def stepped(turns):
    """The same by carrying the least (cost, audit) per state from turn to turn, for long conversations."""
    found, now = faults(turns), {0: (0, "")}
    after = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}
    for (role, _), fault in zip(turns, found):
        options = {}
        for state, (cost, audit) in now.items():
            for _ in range(3):
                target, given = after[state]
                moves = [(cost + 4, audit + "D", state)]
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    moves.append((cost + 3 + more, audit + "R", target))
                    if role[:1] == "s" and state == 0:
                        moves.append((cost + more, audit + "K", 1))
                    elif role[:1] == given:
                        moves.append((cost + more, audit + "K", target))
                for price, text, end in moves:
                    options[end] = min(options.get(end, (price, text)), (price, text))
                state, cost, audit = target, cost + 3, audit + "I"
        now = options
    return min((cost + {0: 0, 1: 6, 2: 3, 3: 0}[q], audit + {0: "", 1: "II", 2: "I", 3: ""}[q]) for q, (cost, audit) in now.items())


def random_turns(rng, count):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "sys", "a"]
    return [(rng.choice(roles), rng.choice(["One.", "Two!", "Three", " ", "", f"Text {rng.randrange(1000)}.", f"Cut {rng.randrange(1000)}", "ok? \n"])) for _ in range(count)]


def test_small_conversations_by_all_edits():
    rng = random.Random(1)
    for _ in range(60):
        turns = random_turns(rng, rng.randrange(3))
        assert searched(turns) == all_edits(turns)


def solved(turns):
    seen = set()
    codes = [repair.code_of(role, repair.fault_of(role, text, seen)) for role, text in turns]
    solution = repair.solve([repair.Problem(np.array(codes, np.int64), repair._ENDS)])[0]
    audit = solution.audits[0] + repair._CLOSING[int(solution.exits[0])]
    return int(solution.costs[0]), audit, list(repair.repaired(turns, audit))


def test_solutions_equal_a_search():
    rng = random.Random(2)
    for count in [0, 1, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8] * 25:
        turns = random_turns(rng, count)
        assert solved(turns) == searched(turns)
    for count in (100, 500):
        turns = random_turns(rng, count)
        assert solved(turns)[:2] == stepped(turns)


def test_problems_solved_together_equal_those_alone():
    rng = random.Random(3)
    codes = [np.array([rng.randrange(16) for _ in range(rng.randrange(40))], np.int64) for _ in range(200)]
    together = repair.solve([repair.Problem(c, repair._ENDS) for c in codes])
    for c, solution in zip(codes, together):
        alone = repair.solve([repair.Problem(c, repair._ENDS)])[0]
        assert solution.audits == alone.audits and solution.costs.tolist() == alone.costs.tolist() and solution.exits.tolist() == alone.exits.tolist()


def test_a_long_segment_takes_little_time():
    rng = np.random.default_rng(4)
    started = time.time()
    problems = [repair.Problem(rng.integers(0, 16, repair.SEGMENT), np.where(np.arange(4) == end, 0, repair._FAR)) for end in range(4)]
    solutions = repair.solve(problems)
    assert time.time() - started < 20
    reached = [a for s in solutions for a, cost in zip(s.audits, s.costs) if cost < repair._FAR]
    assert len(reached) >= 8 and all(len(a.replace("I", "")) == repair.SEGMENT for a in reached)


def damage(rows):
    """Rows after damage by conversation, from the definition."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for mine in out.values():
        mine.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))
    return out


def expected(rows):
    found = []
    for conv, turns in damage(rows).items():
        said = [(role, text) for _, role, text in turns]
        numbers, kinds = {t for t, _, _ in turns if t is not None}, faults(said)
        pairs = [a[:1] + b[:1] for (a, _), (b, _) in zip(said, said[1:])]
        cost, audit, lines = searched(said) if len(said) < 30 else (*stepped(said), None)
        lines = list(repair.repaired(said, audit)) if lines is None else lines
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        found.append((conv, gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return sorted(found, key=repr)


@pytest.mark.parametrize("segment", [1, 3, 8192])
def test_odd_rows_and_cut_conversations(spark, segment):
    rng = random.Random(5)
    rows = [(conv, turn, *rng.choice(random_turns(rng, 3))) for conv in range(60) for turn in range(rng.randrange(9))]
    rows += [(None, k, "user", "No id.") for k in range(5)] + [(70, None, None, None), (70, None, "user", "x."), (71, None, "user", None), (72, 5, "", "")]
    rows += [(80, 7, "user", "The same.")] * 40 + [(81, -(2**40), "user", "far"), (81, 2**40, "assistant", "away.")]
    rows += [(90, k, ("user", "assistant")[k % 2] if k % 11 else "system", f"Turn {k % 700}" + "."[: k % 5]) for k in range(3000)]
    rows += [(100, k, "user", "x") for k in range(400) if zlib.crc32(f"100:{k}".encode()) % 20 == 0]  # nothing is left
    frame = spark.createDataFrame(rows, SHAPE).select("*", F.lit(1).alias("part"), F.lit(2).alias("no"), F.lit(3).alias("conv"), F.lit(4).alias("block"), F.lit("x").alias("audit"))
    made = repair.repair(repair.damaged(frame.repartition(3)), segment)
    found = repair.digested(made).collect()
    assert sorted((tuple(r) for r in found), key=repr) == expected(rows)


def test_hot_conversation_is_spread(spark):
    """A conversation with most rows fills many segments, and its parts follow each other."""
    rows = [(1, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(4000)] + [(k, 0, "user", "Hi.") for k in range(2, 200)]
    made = repair.repair(repair.damaged(spark.createDataFrame(rows, SHAPE)), 100)
    assert made.where("conv_id = 1").count() >= 40 and made.select(F.max(F.size("turns"))).first()[0] <= 500
    assert sorted(map(tuple, repair.digested(made).collect()), key=repr) == expected(rows)


def test_no_rows(spark):
    assert repair.digested(repair.repair(repair.damaged(spark.createDataFrame([], SHAPE)))).count() == 0
