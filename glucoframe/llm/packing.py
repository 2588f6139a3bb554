"""Mixture-controlled packing: deficit round-robin over source queues of tokens."""

from __future__ import annotations

import base64
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucoframe.llm.common import few_rows, running_sum, small_batches, strings
from glucoframe.session import broadcast_if_small, cut_lineage

LENGTH = 1024
WINDOW_SEQUENCES = 64
END = 0
SPECIAL = "<|endoftext|>"
# Sources with at least one MANY-th of all tokens, and those given a proportion, have a queue of their own; smaller ones follow each
# other in order in at most as many shared queues. That bounds the numbers per window, whatever the number of sources.
MANY = 256
FANOUT = 64  # windows, or groups of windows, that one step of the schedule deals out
KEPT = 128  # steps of the schedule a task remembers
MOST_FIRSTS = 1_000_000  # rows of (source, input partition) up to which they are broadcast


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, pattern: str):
    """Byte-level BPE from a file of ranks, with the vocabulary's one special token behind the last rank."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: max(ranks.values()) + 1})


def encoded(encoder, text: str) -> list[int]:
    """The ids of a text as the tokenizers library gives them: SPECIAL is one token wherever it stands."""
    return encoder.encode(text, allowed_special={SPECIAL}, disallowed_special=()) if SPECIAL in text else encoder.encode_ordinary(text)


def deal(left: np.ndarray, weights: np.ndarray, deficits: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: how many tokens each queue gives to a window of `room` tokens, and the deficits it carries on.

    Every queue that still holds tokens is credited its share by weight and serves the whole part of its credit; what
    stays open goes to the queues with the largest unserved credit. An exhausted queue loses its deficit, its share
    goes to the others.
    """
    room = int(min(room, left.sum()))
    active = (left > 0) & (weights > 0)
    if not active.any():
        active = left > 0
        weights = active.astype(float)
    total = float(weights[active].sum())
    credit = np.where(active, deficits + (room * weights / total if total else 0.0), 0.0)
    given = np.clip(np.floor(credit), 0, left * active).astype(np.int64)
    over = int(given.sum()) - room
    if over > 0:  # credits carried over may exceed the room: the least owed give back
        for q in np.argsort(credit - given, kind="stable"):
            back = min(over, int(given[q]))
            given[q] -= back
            over -= back
            if not over:
                break
    while (open_ := room - int(given.sum())) > 0:
        able = np.flatnonzero(given < left * (active if (given < left * active).any() else 1))
        owed = able[np.argsort(given[able] - credit[able], kind="stable")]
        if open_ < len(owed):
            given[owed[:open_]] += 1
        else:
            each = max(1, open_ // len(owed))
            given[owed] += np.minimum(each, left[owed] - given[owed])
    return given, np.where(left > given, credit - given, 0.0)


@dataclass
class Plan:
    """Where every token of every queue goes.

    The windows are the leaves of a tree in which a node stands for FANOUT times as many windows as its children. Rounds of
    deficit round-robin deal a node's tokens to its children, whole children at first and single windows at the last level,
    with the same target weights everywhere; deficits are carried from child to child, and through the node's own share from node to node.
    So the windows around any place follow from one path through the tree, and nothing is kept per window.
    """

    totals: np.ndarray
    window: int
    weights: np.ndarray
    _steps: OrderedDict[tuple[int, int], np.ndarray] = field(default_factory=OrderedDict, repr=False)

    @property
    def levels(self) -> int:
        windows, levels = -(-int(self.totals.sum()) // self.window), 1
        while FANOUT**levels < windows:
            levels += 1
        return levels

    def bounds(self, level: int, index: int) -> np.ndarray:
        """(children + 1, queues): the tokens of each queue before each child of a node; at level 1 children are windows."""
        known = self._steps.get((level, index))
        if known is not None:
            self._steps.move_to_end((level, index))
            return known
        if level == self.levels:
            begin, left = np.zeros(len(self.totals), np.int64), self.totals.copy()
        else:
            above = self.bounds(level + 1, index // FANOUT)
            begin = above[index % FANOUT]
            left = above[index % FANOUT + 1] - begin
        room, deficits, rows = self.window * FANOUT ** (level - 1), np.zeros(len(left)), [begin]
        while left.sum() > 0:
            given, deficits = deal(left, self.weights, deficits, room)
            left = left - given
            rows.append(rows[-1] + given)
        self._steps[level, index] = np.array(rows)
        while len(self._steps) > KEPT:
            self._steps.popitem(last=False)
        return self._steps[level, index]

    def place(self, queue: int, start: int, stop: int) -> Iterator[tuple[int, int]]:
        """The queue's tokens start to stop as runs (first global position, tokens), in order."""
        while start < stop:
            index = 0
            for level in range(self.levels, 0, -1):
                bounds = self.bounds(level, index)
                index = index * FANOUT + int(np.searchsorted(bounds[:, queue], start, side="right")) - 1
            first = index // FANOUT * FANOUT
            at = index - first
            while start < stop and at < len(bounds) - 1:
                end = min(stop, int(bounds[at + 1, queue]))
                if end > start:
                    earlier = int((bounds[at + 1, :queue] - bounds[at, :queue]).sum())
                    yield (first + at) * self.window + earlier + start - int(bounds[at, queue]), end - start
                    start = end
                at += 1


def plan_windows(totals: np.ndarray, window: int, weights: np.ndarray | None = None) -> Plan:
    """Deal the queues into windows. Weights default to the queues' own sizes, so that all run dry together."""
    totals = totals.astype(np.int64)
    return Plan(totals, window, totals.astype(float) if weights is None else weights.astype(float))


def tokens(docs: DataFrame, ranks_path: str, pattern: str, id_column: str, text_column: str, queue_column: str) -> DataFrame:
    """(doc_id, queue, part, start, ids): the ids of a text and END as unsigned 32-bit numbers, little end first.

    `start` counts the tokens of the queue that precede the document inside its input partition `part`, so a queue's
    order is that of the input and needs no sort. An input partition read again after a loss holds the same rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = _encoder(ranks_path, pattern), TaskContext.get().partitionId(), {}
        end = np.array([END], "<u4").tobytes()
        for batch in few_rows(batches):
            queues, ids, starts = batch.column("queue").to_pylist(), [], []
            for queue, text in zip(queues, strings(batch.column("text"))):
                ids.append(np.array(encoded(encoder, text), "<u4").tobytes() + end)
                starts.append(seen.get(queue, 0))
                seen[queue] = starts[-1] + len(ids[-1]) // 4
            columns = [batch.column("doc_id"), batch.column("queue"), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "queue", "part", "start", "n", "ids"])

    chosen = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{queue_column}`").cast("string").alias("queue"), F.col(f"`{text_column}`").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(encode, f"doc_id {kind}, queue string, part int, start long, n long, ids binary")


def pack(
    docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", queue_column: str = "source",
    length: int = LENGTH, window_sequences: int = WINDOW_SEQUENCES, proportions: dict[str | None, float] | None = None, many: int = MANY,
    most_firsts: int = MOST_FIRSTS,
) -> DataFrame:
    """Pieces of all documents in sequences of `length` tokens: doc_id, start, n (tokens), ids, doc_tokens, sequence_id, offset.

    Each source is a queue of tokens. Deficit round-robin fills one window of `window_sequences` sequences after the
    other with the target proportions (default: the corpus's own; else by source, 0 where unnamed: such queues are
    served when the others are dry). Windows are full, so only the last sequence needs padding. Documents are cut
    where a window's share or a sequence ends; every id lies in exactly one piece.

    Texts are encoded once and the ids written to the shared folder. Tokens are added up by source and input partition; sources
    become queues (see MANY), and a running sum in Spark gives the place of every source and partition in its queue, which is
    joined back to the ids (broadcast up to `most_firsts` rows, else a join). The driver gets the totals of the queues, at most
    2 * MANY and the given proportions. Each task then places its own documents: no sort, and without that join no shuffle of ids.
    Null text: the END id alone. Null source: a queue of its own. Null or repeated ids: each row is a document of
    its own. Further columns are ignored. An empty table gives no pieces.
    """
    small_batches(docs.sparkSession)
    ids = cut_lineage(tokens(docs, ranks_path, pattern, id_column, text_column, queue_column))
    spark, kind = docs.sparkSession, ids.schema["doc_id"].dataType.simpleString()
    firsts, totals, weights = _queues(ids, proportions, many)
    plan = plan_windows(totals, window_sequences * length, weights)
    placed = ids.join(broadcast_if_small(firsts, most_firsts), F.col("queue").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    placed = placed.select("doc_id", "line", (F.col("first") + F.col("start")).alias("first"), "n", "ids")
    shared = spark.sparkContext.broadcast((plan.totals, plan.window, plan.weights))  # at most 2 * MANY queues and the named ones

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(*shared.value)
        for batch in few_rows(batches):
            rows: list[list] = [[] for _ in range(6)]
            row_of = []
            columns = [batch.column(c).to_pylist() for c in ("line", "first", "n", "ids")]
            for k, (line, first, n, data) in enumerate(zip(*columns)):
                done = 0
                for position, run in plan.place(line, first, first + n):
                    while run:
                        offset = position % length
                        size = min(run, length - offset)
                        for column, value in zip(rows, (done, size, data[done * 4 : (done + size) * 4], n, position // length, offset)):
                            column.append(value)
                        row_of.append(k)
                        done, position, run = done + size, position + size, run - size
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            made = [pa.array(column, k) for column, k in zip(rows, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row_of, pa.int64())), *made], names=["doc_id", "start", "n", "ids", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(cut, f"doc_id {kind}, start long, n long, ids binary, doc_tokens long, sequence_id long, offset long")


def _queues(ids: DataFrame, proportions: dict[str | None, float] | None, many: int) -> tuple[DataFrame, np.ndarray, np.ndarray | None]:
    """Where every source and input partition begins in its queue (of, of_part, line, first), and the totals and weights of the queues.

    Own queues come first in code-point order, then the shared ones, null last in each; a shared queue holds its sources one after
    the other. Unnamed sources have weight 0 if proportions are given.
    """
    sums = cut_lineage(ids.groupBy("queue", "part").agg(F.sum("n").alias("n")))
    sources = cut_lineage(sums.groupBy("queue").agg(F.sum("n").alias("n")))
    total = sources.agg(F.sum("n")).first()[0] or 0
    named = [F.col("queue").eqNullSafe(F.lit(name)) for name in proportions or {}]
    large = F.col("n") * many >= total
    for name in named:
        large = large | name
    own = sources.where(large).orderBy(F.col("queue").asc_nulls_last()).collect()  # at most `many` and the named ones
    spark = ids.sparkSession
    lines = spark.createDataFrame([(r.queue, k, 0, r.n) for k, r in enumerate(own)], "queue string, line int, ahead long, n long")
    small = running_sum(sources.where(~large), [F.col("queue").asc_nulls_last()], "n", "before")
    small = small.select("queue", (F.lit(len(own)) + F.floor(F.col("before") * many / total)).cast("int").alias("line"), "before", "n")
    held = cut_lineage(small)
    shared = held.groupBy("line").agg(F.sum("n").alias("n"), F.min("before").alias("base")).orderBy("line").collect()  # at most `many`
    bases = spark.createDataFrame([(r.line, r.base, len(own) + k) for k, r in enumerate(shared)], "line int, base long, place int")
    moved = held.join(F.broadcast(bases), "line").select("queue", F.col("place").alias("line"), (F.col("before") - F.col("base")).alias("ahead"), "n")
    places = lines.unionByName(moved).select(F.col("queue").alias("of"), "line", "ahead")
    joined = sums.join(broadcast_if_small(cut_lineage(places), MOST_FIRSTS), F.col("queue").eqNullSafe(F.col("of")))
    summed = running_sum(joined.select("of", "line", "ahead", "part", "n"), ["line", "ahead", "of", "part"], "n", "before")
    totals = [r.n for r in own] + [r.n for r in shared]
    begin = np.concatenate([[0], np.cumsum(totals)]).astype(int).tolist()  # running sums go on from queue to queue
    starts = F.element_at(F.array(*[F.lit(b) for b in begin]), F.col("line") + 1)
    firsts = summed.select("of", F.col("part").alias("of_part"), "line", (F.col("before") - starts).alias("first"))
    weights = None
    if proportions is not None:
        weights = np.array([float(proportions.get(r.queue, 0.0)) for r in own] + [0.0] * len(shared))
    return cut_lineage(firsts), np.array(totals, np.int64), weights


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", F.col("n").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


