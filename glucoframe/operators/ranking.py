"""Distributed ordering: average ranks, row numbers and exact quantiles with no one-task window.

A window ordered by value would put a whole index into one task. For ranks a sample cuts the values of every key into groups;
rows travel in packed pieces to the task that orders their group and get their rank in it; a small table of the groups' sizes turns
these into ranks. Ranks of the columns of a wide table travel as differences of few bits, because of them there are many.
For quantiles equal values are counted first and the distinct ones ordered the same way.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from glucoframe.session import broadcast_if_small, cut_lineage

LOCAL_POSITION_BITS = 33  # monotonically_increasing_id: partition number above, position below
MAX_OFFSETS_BROADCAST = 1_000_000
ROW_BITS = 16  # ranks of columns come back to blocks of at most 65,536 row numbers
SHARE_BITS = 20  # of the share of a group's rows that a set holds
PIECE_ROWS = 1 << 13
LONG_ROWS = 1 << 20  # rows that are split into pieces together
LEAST_SAMPLED, MOST_SAMPLED, SAMPLE_SEED = 10_000, 1_000_000, 11
PROBED = 1 / 64
LEAST_GROUPS = 64  # however small `held` is, a key is not cut into smaller shares


@dataclass(frozen=True)
class Limits:
    """Sizes at which another plan takes over. Results never depend on them; tests and queries lower them to reach every plan.

    accuracy       of the quantile sketch; keys with fewer than four times as many rows are ordered whole
    held           rows of a key that one task orders, about; a value on more rows is dealt to several tasks
    broadcast_rows rows up to which a small table is broadcast
    """

    accuracy: int = 10_000
    held: int = 200_000
    broadcast_rows: int = MAX_OFFSETS_BROADCAST


LIMITS = Limits()


def add_row_numbers(df: DataFrame, order_by: list[str], name: str = "row") -> DataFrame:
    """1-based row numbers in the given total order, without moving rows into one task.

    Rows that agree in every column of the order come to lie in one partition: end it with a column that tells them apart.
    """
    placed = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = cut_lineage(placed.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", LOCAL_POSITION_BITS)
    placed = placed.withColumn("_part", part).withColumn(
        "_at", F.col("_at").bitwiseAND(F.lit((1 << LOCAL_POSITION_BITS) - 1))
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    return (
        placed.join(broadcast_if_small(offsets, MAX_OFFSETS_BROADCAST), "_part")
        .withColumn(name, F.col("_ahead") + F.col("_at") + 1)
        .drop("_part", "_at", "_ahead")
    )


def order_counts(counts: DataFrame, keys: list[str], value: str, of: list[str] | None = None, limits: Limits = LIMITS) -> DataFrame:
    """Adds before_<c> and n_<c> for every count column c in `of`: the sum of c over the smaller values of
    the key, and over all its values. `counts` has one row per (keys, value)."""
    of = of or ["cnt"]
    placed = (
        counts.repartitionByRange(*keys, value)
        .sortWithinPartitions(*keys, value)
        .withColumn("part", F.spark_partition_id())
    )
    schema = T.StructType([*placed.schema.fields, *[T.StructField(f"upto_{c}", T.LongType()) for c in of]])
    schema_names = schema.names

    def running_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, carried = None, None
        for batch in batches:
            rows = batch.num_rows
            if rows == 0:
                continue
            # rows of a key are together, so a new key starts where any key column changes
            new_key = np.zeros(rows, dtype=bool)
            new_key[0] = True
            for k in keys:
                column = batch.column(k)
                changed = pc.not_equal(column.slice(1), column.slice(0, rows - 1))
                new_key[1:] |= changed.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new_key)
            sizes = np.diff(np.append(starts, rows))
            sums = np.cumsum(np.column_stack([batch.column(c).to_numpy() for c in of]), axis=0, dtype="int64")
            ahead = np.zeros((len(starts), len(of)), dtype="int64")
            ahead[1:] = sums[starts[1:] - 1]
            sums -= np.repeat(ahead, sizes, axis=0)
            if last_key is not None and tuple(batch.column(k)[0].as_py() for k in keys) == last_key:
                sums[: sizes[0]] += carried
            last_key, carried = tuple(batch.column(k)[rows - 1].as_py() for k in keys), sums[-1].copy()
            added = [pa.array(sums[:, position]) for position in range(len(of))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema_names)

    ordered = cut_lineage(placed.mapInArrow(running_count, schema))
    totals = ordered.groupBy("part", *keys).agg(*[F.sum(c).alias(f"rows_{c}") for c in of])
    key = Window.partitionBy(*keys)
    above = key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # sorted by key, so there are at most (partitions + keys) of these rows
    offsets = totals.select(
        "part", *keys,
        *[F.coalesce(F.sum(f"rows_{c}").over(above), F.lit(0)).alias(f"ahead_{c}") for c in of],
        *[F.sum(f"rows_{c}").over(key).alias(f"n_{c}") for c in of],
    )
    return ordered.join(broadcast_if_small(offsets, limits.broadcast_rows), ["part", *keys]).select(
        *counts.columns,
        *[(F.col(f"ahead_{c}") + F.col(f"upto_{c}") - F.col(c)).alias(f"before_{c}") for c in of],
        *[f"n_{c}" for c in of],
    )


Flags = Callable[[pa.RecordBatch], np.ndarray]
Cuts = dict[tuple, tuple[np.ndarray, np.ndarray]]


def _by_key(table: pa.Table, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """The keys of a table, each with the places of its rows."""
    code = np.zeros(table.num_rows, np.int64)
    for k in keys:
        words = table.column(k).combine_chunks().dictionary_encode()
        code = code * (len(words.dictionary) + 1) + words.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    borders = [0, *(np.flatnonzero(np.diff(code[order])) + 1).tolist(), table.num_rows]
    for start, stop in zip(borders[:-1], borders[1:]):
        if stop > start:
            yield tuple(table.column(k)[int(order[start])].as_py() for k in keys), order[start:stop]


def _sample_share(rows: int) -> float:
    """A sixteenth of the rows, at least 10,000 and at most a million of them."""
    return min(1.0, min(max(rows / 16, LEAST_SAMPLED), MOST_SAMPLED) / max(rows, 1))


def find_cuts(sample: DataFrame, keys: list[str], value: str, share: float, limits: Limits) -> Cuts:
    """Per key that one task should not order alone: rising values to cut at, and over how many groups the rows with that very
    value are dealt (0: they lie with the larger ones). A value that takes two cuts or more fills a group by itself."""
    table, found = sample.select(*keys, value).toArrow(), {}
    for key, at in _by_key(table, keys):
        values = np.sort(table.column(value).to_numpy()[at])
        rows = len(values) / share
        held = max(limits.held, min(LIMITS.held, rows / LEAST_GROUPS))
        number = min(math.ceil(rows / held), len(values))
        if number > 1:
            cuts, times = np.unique(values[np.arange(1, number) * len(values) // number], return_counts=True)
            found[key] = cuts, np.where(times > 1, times, 0)
    return found


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(piece: pa.Scalar) -> pa.Table:
    """The rows of one piece."""
    return pa.ipc.open_stream(piece.as_buffer()).read_all()


class _Pieces:
    """Collects pieces: rows of one key whose values lie between two cuts, packed into one cell."""

    def __init__(self, cuts: Cuts, schema: pa.Schema):
        self._cuts, self._schema = cuts, schema
        self._turn = TaskContext.get().partitionId()
        self._made: list[tuple] = []

    def add(self, key: tuple, values: np.ndarray, rows: pa.Table) -> None:
        """Odd groups hold one value: that of a cut."""
        if key not in self._cuts:
            self._made.append((*key, 0, 0, _packed(rows)))
            return
        cuts, spread = self._cuts[key]
        above = np.searchsorted(cuts, values, side="right")
        at = np.maximum(above - 1, 0)
        group = 2 * above - ((above > 0) & (spread[at] > 0) & (values == cuts[at]))
        order = np.argsort(group, kind="stable")
        rows, group = rows.take(pa.array(order)), group[order]
        borders = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for start, stop in zip(borders[:-1], borders[1:]):
            number = int(group[start])
            dealt = self._turn % int(spread[number // 2]) if number % 2 else 0
            self._made.append((*key, number, dealt, _packed(rows.slice(start, stop - start))))

    def batch(self) -> Iterator[pa.RecordBatch]:
        self._turn += 1
        made, self._made = self._made, []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(cells, f.type) for cells, f in zip(zip(*made), self._schema)], schema=self._schema)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= rows:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting = []
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _fields(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def _rank_pieces(pieces: DataFrame, keys: list[str], value: str, flags: Callable[[tuple, pa.Table], np.ndarray] | None, limits: Limits) -> DataFrame:
    """The rows in pieces of their own with their ranks: keys, _rows, _base, _total.

    A task orders the rows of one group and counts, per set, twice their rank there (columns t0, t1, ...); _base is what the smaller
    groups add to it and _total the rows of the key, per set. Rows of a value that is a group of its own need no order: their rank
    is in _base.
    """
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*_fields(pieces, [*keys, "_group"]), T.StructField("_rows", T.BinaryType()), T.StructField("_count", longs)])
    arrow = to_arrow_schema(schema)

    def order(known: tuple, found: pa.Table) -> pa.Table:
        *key, group, _ = (k.as_py() for k in known)
        rows = pa.concat_tables([unpacked(p) for p in found.column("_rows")]).combine_chunks()
        n = rows.num_rows
        at, ends = np.arange(n), np.array([0, n])  # one run of equal values, whose rank is in _base
        run = np.zeros(n, np.int64)  # of every row the number of its run
        if group % 2 == 0:
            at, ends, run = _runs(rows.column(value).to_numpy())
        member = None if flags is None else flags(tuple(key), rows.take(pa.array(at)))
        counts = [n] if member is None else member.sum(0).tolist()
        borders = [*range(0, n, PIECE_ROWS), n]
        for s in range(len(counts)):
            upto = np.arange(n + 1) if member is None else np.append(0, np.cumsum(member[:, s]))
            twice = upto[ends[:-1]] + upto[ends[1:]] + 1 if group % 2 == 0 else np.zeros(1, np.int64)
            rows = rows.append_column(f"t{s}", pa.array(twice.astype(np.int32)[run]))
        made = [_packed(rows.slice(a, b - a)) for a, b in zip(borders[:-1], borders[1:])]
        size = len(made) + 1  # the last row holds the counts
        columns = [pa.array([k] * size, f.type) for k, f in zip([*key, group], arrow)]
        return pa.Table.from_arrays([*columns, pa.array([*made, None], pa.binary()), pa.array([None] * len(made) + [counts], arrow.field("_count").type)], schema=arrow)

    read = cut_lineage(pieces.groupBy(*keys, "_group", "_dealt").applyInArrow(order, schema))
    # one row per key, group and set; both windows see the groups of one key
    sizes = read.where(F.col("_count").isNotNull()).select(*keys, "_group", F.posexplode("_count").alias("_set", "_n"))
    sizes = sizes.groupBy(*keys, "_group", "_set").agg(F.sum("_n").alias("_n"))
    key = Window.partitionBy(*keys, "_set")
    above = key.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    alone = F.when(F.col("_group") % 2 == 1, F.col("_n") + 1).otherwise(0)
    base = 2 * F.coalesce(F.sum("_n").over(above), F.lit(0)) + alone
    sums = sizes.select(*keys, "_group", F.struct("_set", base.alias("b"), F.sum("_n").over(key).alias("t")).alias("_s"))
    entries = sums.groupBy(*keys, "_group").agg(F.sort_array(F.collect_list("_s")).alias("_s"))
    offsets = cut_lineage(entries.select(*keys, "_group", F.col("_s.b").alias("_base"), F.col("_s.t").alias("_total")))
    ranked = read.where(F.col("_rows").isNotNull()).join(broadcast_if_small(offsets, limits.broadcast_rows), [*keys, "_group"])
    return ranked.select(*keys, "_rows", "_base", "_total")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of values, where the runs of equal ones begin (and the last ends), and of every value the number of its run."""
    at = np.argsort(values, kind="stable")
    ordered = values[at]
    starts = np.append(True, ordered[1:] != ordered[:-1])
    run = np.empty(len(at), np.int64)
    run[at] = np.cumsum(starts) - 1
    return at, np.append(np.flatnonzero(starts), len(at)), run


def _piece_schema(df: DataFrame, keys: list[T.StructField]) -> T.StructType:
    numbers = [T.StructField(n, T.IntegerType()) for n in ("_group", "_dealt")]
    return T.StructType([*keys, *numbers, T.StructField("_rows", T.BinaryType())])


@functools.cache
def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers in few bytes: the lowest bytes of all numbers of an array, then the next ones, each compressed
    where that helps. Highest bytes that are all zero are left out."""
    head, body = [len(arrays)], []
    for numbers in arrays:
        size = len(numbers)
        used = (int(numbers.max()).bit_length() + 7) // 8 if size else 0
        head += [size, used]
        for plane in np.ascontiguousarray(numbers).view(np.uint8).reshape(size, numbers.itemsize).T[:used]:
            plain = plane.tobytes()
            small = _zstd().compress(plain, asbytes=True)
            body.append(small if len(small) < size else plain)
            head.append(len(body[-1]))
    return b"".join([np.array([len(head), *head], np.uint32).tobytes(), *body])


def expanded(cell: pa.Scalar, most: int | None = None) -> list[np.ndarray]:
    """What `squeezed` was given, as numbers of 64 bits; of `most` arrays at most."""
    found = cell.as_buffer()
    at = 4 * (int(np.frombuffer(found, np.uint32, 1)[0]) + 1)
    count, *head = np.frombuffer(found, np.uint32, at // 4)[1:].tolist()
    left, out = iter(head), []
    for _ in range(count if most is None else min(most, count)):
        size, used = next(left), next(left)
        numbers = np.zeros(size, np.uint64)
        planes = numbers.view(np.uint8).reshape(size, 8)
        for plane in range(used):
            held = next(left)
            part = found.slice(at, held)
            planes[:, plane] = np.frombuffer(part if held == size else _zstd().decompress(part, size), np.uint8)
            at += held
        out.append(numbers)
    return out


def _steps(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences of neighbours; at `starts` the numbers themselves."""
    steps = np.diff(numbers, prepend=numbers[:1])
    steps[starts] = numbers[starts]
    return steps


def _folded(steps: np.ndarray) -> np.ndarray:
    """Signed numbers as unsigned ones, small where these are near zero."""
    return ((steps << 1) ^ (steps >> 63)).view(np.uint64)


def _unfolded(numbers: np.ndarray) -> np.ndarray:
    return (numbers >> np.uint64(1)).view(np.int64) ^ -(numbers & np.uint64(1)).view(np.int64)


def _ordered_bits(values: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits in the order of the values."""
    bits = values.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))


def _blocks(batches: Iterator[pa.RecordBatch], row: str, bits: int) -> Iterator[tuple[int, pa.Table]]:
    """Neighbouring rows whose numbers agree above the lowest `bits` bits."""
    waiting: list[pa.RecordBatch] = []
    block = None
    for batch in batches:
        blocks = batch.column(row).to_numpy() >> bits
        borders = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for start, stop in zip(borders[:-1], borders[1:]):
            if stop == start:
                continue
            if waiting and blocks[start] != block:
                yield block, pa.Table.from_batches(waiting).combine_chunks()
                waiting = []
            block = int(blocks[start])
            waiting.append(batch.slice(start, stop - start))
    if waiting:
        yield block, pa.Table.from_batches(waiting).combine_chunks()


def read_places(cell: pa.Scalar) -> np.ndarray:
    """Of a piece of column_ranks: the places of its rows in their block."""
    return np.cumsum(expanded(cell, 1)[0]).astype(np.uint16)


def read_ranks(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a piece of column_ranks: the places of its rows in their block, twice their rank in their group, and what set_ranks needs."""
    places, own, rest = expanded(cell)
    return np.cumsum(places).astype(np.uint16), np.cumsum(own).view(np.int64), _unfolded(rest)


def _expected(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per set and row what twice the rank would be if the set's rows lay evenly in the group. counts: of the group, of its sets."""
    return (own * ((counts[1:, None] << SHARE_BITS) // max(int(counts[0]), 1))) >> SHARE_BITS


def set_ranks(own: np.ndarray, rest: np.ndarray, member: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Per set, twice the rank of its rows in the group. member: sets x rows of the piece, True where the set holds the row."""
    expected, out, start = _expected(own, counts), [], 0
    for line, held in zip(expected, member):
        line = line[held]
        out.append(np.cumsum(rest[start : start + len(line)]) + line)
        start += len(line)
    return out


def column_ranks(
    numbered: DataFrame, columns: list[str], group: list[str], row: str, also: list[str] | None = None,
    flags: Callable[[tuple, pa.Table], np.ndarray] | None = None, finite: bool = False, limits: Limits = LIMITS, bits: int = ROW_BITS,
) -> DataFrame:
    """Ranks of every column of a written table (within `group`, where its label is neither NULL nor empty) in pieces of blocks of
    2^bits row numbers: _column (the number), the group, _block, _rows (see read_ranks, set_ranks), _base, _total, _count.

    NULL and NaN have no rank, infinite values only without `finite`. The first set of a column is all its rows. `flags` gets
    (column, *group) and the rows (`row`, values and the columns `also`) and gives the others, as a table of 0 and 1 (rows x sets).
    Per set, _base is twice the rows of smaller groups, _total the rows of the key and _count those of the group.

    Values leave their row in the order of their size, as differences, with the place of their row in its block and the sets that
    hold it. A first pass counts the groups, so ranks come back without being written in between: a piece holds, in the order of
    rank, the steps between places and between ranks, and per set how far the ranks of its rows are from those in an even mix.
    Whoever reads a block knows which sets hold a row: other columns' pieces tell where these have a value.
    """
    also = also or []
    keys = ["_column", *group]
    labelled = numbered
    for g in group:
        labelled = labelled.where(F.col(f"`{g}`").isNotNull() & (F.col(f"`{g}`") != ""))
    cells = ", ".join(f"named_struct('_column', {k}, 'value', `{c}` + 0D)" for k, c in enumerate(columns))
    usable = "value IS NOT NULL AND NOT isnan(value)" + (" AND abs(value) < double('Infinity')" if finite else "")
    share = _sample_share(numbered.count() * len(columns))
    sample = labelled.sample(share, seed=SAMPLE_SEED).selectExpr(*[f"`{g}`" for g in group], f"inline(array({cells}))").where(usable)
    cuts = find_cuts(sample, keys, "value", share, limits)
    none = np.zeros(0), np.zeros(0, np.int64)

    def ordered(table: pa.Table) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per key the places of its rows, ordered by value, the values, where the groups begin, and which sets hold the rows."""
        labels = list(_by_key(table, group)) if group else [((), np.arange(table.num_rows))]
        for k in range(len(columns)):
            values = table.column(f"c{k}").to_numpy()
            good = np.isfinite(values) if finite else ~np.isnan(values)
            for label, at in labels:
                key, at = (k, *label), at[good[at]]
                if not len(at):
                    continue
                at = at[np.argsort(values[at], kind="stable")]
                found = values[at]
                at_cut, spread = cuts.get(key, none)
                low, high = (np.searchsorted(found, at_cut, side) for side in ("left", "right"))
                edges = np.concatenate([[0], np.column_stack([low, np.where(spread > 0, high, low)]).reshape(-1), [len(found)]])
                member = np.zeros((len(at), 0), bool) if flags is None else flags(key, table)[at].astype(bool)
                yield key, at, found, edges, member

    of_keys = [T.StructField("_column", T.IntegerType()), *_fields(numbered, group)]
    count_schema = T.StructType([*of_keys, T.StructField("_counts", T.BinaryType())])
    count_arrow = to_arrow_schema(count_schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for _, table in _blocks(batches, row, bits):
            for key, at, _, edges, member in ordered(table):
                upto = np.zeros((len(at) + 1, member.shape[1] + 1), np.int64)
                upto[:, 0] = np.arange(len(at) + 1)
                np.cumsum(member, axis=0, out=upto[1:, 1:])
                sizes = np.diff(upto[edges], axis=0)
                sums[key] = sums[key] + sizes if key in sums else sizes
        if sums:
            lines = [(*key, squeezed(sizes.reshape(-1).view(np.uint64))) for key, sizes in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array(cells, f.type) for cells, f in zip(zip(*lines), count_arrow)], schema=count_arrow)

    longs = T.ArrayType(T.LongType())
    offset_schema = T.StructType([*of_keys, T.StructField("_group", T.IntegerType()), *[T.StructField(n, longs) for n in ("_base", "_total", "_count")]])
    offset_arrow = to_arrow_schema(offset_schema)

    def add_up(known: tuple, found: pa.Table) -> pa.Table:
        key = tuple(k.as_py() for k in known)
        flat = sum(expanded(cell)[0].view(np.int64) for cell in found.column("_counts"))
        sizes = flat.reshape(2 * len(cuts.get(key, none)[0]) + 1, -1)
        base = 2 * (np.cumsum(sizes, axis=0) - sizes)
        base[1::2] += sizes[1::2] + 1  # rows of one value share their rank
        total = sizes.sum(0).tolist()
        made = [*[[k] * len(sizes) for k in key], range(len(sizes)), base.tolist(), [total] * len(sizes), sizes.tolist()]
        return pa.Table.from_arrays([pa.array(cells, f.type) for cells, f in zip(made, offset_arrow)], schema=offset_arrow)

    schema = T.StructType([*of_keys, *[T.StructField(n, T.IntegerType()) for n in ("_group", "_dealt")], *[T.StructField(n, T.LongType()) for n in ("_block", "_least")], T.StructField("_rows", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for block, table in _blocks(batches, row, bits):
            turn, made = turn + 1, []
            numbers = (table.column(row).to_numpy() & ((1 << bits) - 1)).astype(np.uint16)
            for key, at, found, edges, member in ordered(table):
                starts = edges[:-1][edges[:-1] < edges[1:]]
                codes = _ordered_bits(found)
                gaps = np.diff(codes.view(np.uint64), prepend=np.uint64(0))
                gaps[starts] = 0
                places = _steps(numbers[at], starts)
                packed = np.packbits(member, axis=1, bitorder="little")
                spread = cuts.get(key, none)[1]
                for g in np.flatnonzero(edges[:-1] < edges[1:]).tolist():
                    part = slice(edges[g], edges[g + 1])
                    dealt = turn % int(spread[g // 2]) if g % 2 else 0
                    made.append((*key, g, dealt, block, int(codes[edges[g]]), squeezed(gaps[part], places[part], *packed[part].T)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(cells, f.type) for cells, f in zip(zip(*made), arrow)], schema=arrow)

    ranked_schema = T.StructType([*of_keys, T.StructField("_group", T.IntegerType()), T.StructField("_block", T.LongType()), T.StructField("_rows", T.BinaryType())])
    ranked_arrow = to_arrow_schema(ranked_schema)

    def order(known: tuple, found: pa.Table) -> pa.Table:
        *key, group, _ = (k.as_py() for k in known)
        values, places, member = [], [], []
        for least, cell in zip(found.column("_least"), found.column("_rows")):
            gaps, steps, *packed = expanded(cell)
            values.append((np.cumsum(gaps) + np.int64(least.as_py()).view(np.uint64)).view(np.int64))
            places.append(np.cumsum(steps).astype(np.uint16))
            member.append(np.column_stack(packed).astype(np.uint8) if packed else np.zeros((len(gaps), 0), np.uint8))
        sizes = [len(v) for v in values]
        piece = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) < 1 << 16 else np.int64), sizes)
        values, places = np.concatenate(values), np.concatenate(places)
        member = np.unpackbits(np.concatenate(member), axis=1, bitorder="little").astype(bool)  # with some more columns of zeros
        n = len(values)
        own = np.zeros(n, np.int64)  # in a group of one value, whose rank is in _base
        if group % 2 == 0:
            at, ends, run = _runs(values)
            own = (ends[:-1] + ends[1:] + 1)[run]
        by_piece = np.lexsort((own, piece)) if group % 2 == 0 else np.arange(n)
        piece, starts = piece[by_piece], np.cumsum([0, *sizes[:-1]])
        counts = np.array([n, *member.sum(0)])
        expected = (own * 0)[None].repeat(member.shape[1], 0) if group % 2 else _expected(own, counts)
        far, far_of = [np.zeros(0, np.int64)], [piece[:0]]
        for s in range(member.shape[1]):
            held = member[:, s]
            twice = np.zeros(n, np.int64)
            if group % 2 == 0:
                upto = np.append(0, np.cumsum(held[at]))
                twice = (upto[ends[:-1]] + upto[ends[1:]] + 1)[run]
            inside = held[by_piece]
            of, off = piece[inside], (twice - expected[s])[by_piece][inside]
            far.append(_steps(off, np.append(True, of[1:] != of[:-1])[: len(of)]))
            far_of.append(of)
        far, far_of = np.concatenate(far), np.concatenate(far_of)
        far, upto = _folded(far[np.argsort(far_of, kind="stable")]), np.append(0, np.cumsum(np.bincount(far_of, minlength=len(sizes))))
        steps, ranks = _steps(places[by_piece], starts), _steps(own[by_piece], starts).view(np.uint64)
        made = [squeezed(steps[a : a + size], ranks[a : a + size], far[b:c]) for a, size, b, c in zip(starts, sizes, upto[:-1], upto[1:])]
        columns = [pa.array([k] * len(made), f.type) for k, f in zip([*key, group], ranked_arrow)]
        return pa.Table.from_arrays([*columns, found.column("_block"), pa.array(made, pa.binary())], schema=ranked_arrow)

    out = labelled.selectExpr(row, *[f"`{c}`" for c in [*group, *also]], *[f"`{c}` + 0D AS c{k}" for k, c in enumerate(columns)])
    offsets = cut_lineage(out.mapInArrow(count, count_schema).groupBy(*keys).applyInArrow(add_up, offset_schema))
    ranked = out.mapInArrow(split, schema).groupBy(*keys, "_group", "_dealt").applyInArrow(order, ranked_schema)
    return ranked.join(broadcast_if_small(offsets, limits.broadcast_rows), [*keys, "_group"]).select(*keys, "_block", "_rows", "_base", "_total", "_count")


def range_ranks(rows: DataFrame, keys: list[str], value: str, row: str | None = None, flags: Flags | None = None, limits: Limits = LIMITS) -> DataFrame:
    """The rows with `twice`: twice the mean rank of their value among the rows of the same key, and `total`: how many these are.

    With `flags` both are arrays with one entry per set: it gives for rows of one key (an Arrow batch) which sets each belongs to,
    as a table of 0 and 1 (rows x sets). Of sets a row does not belong to its entry has no meaning. Keys and values must not be
    NULL or NaN. Nothing needs to tell the rows apart; a `row` column is one of them like any other.

    One shuffle: a sample cuts the values of every key into groups of about `limits.held` rows, and rows travel in packed pieces to the
    task that orders their group. A value that fills a group is one of its own, dealt to as many tasks as it fills; it is
    counted, not ordered. What is added up over groups has a row per key and group.
    """
    names = rows.columns
    # rows may be costly to make: of many, one pass writes some of them, whose number tells how many there are
    probe = cut_lineage(rows.select(*keys, value).sample(PROBED, seed=SAMPLE_SEED))
    some = probe.count()
    if some > LEAST_SAMPLED:
        share = min(1.0, MOST_SAMPLED / some)
        sample, share = probe.sample(share, seed=SAMPLE_SEED), share * PROBED
    else:
        share = _sample_share(int(some / PROBED))
        sample = rows.sample(share, seed=SAMPLE_SEED)
    cuts = find_cuts(sample, keys, value, share, limits)
    others = [n for n in names if n not in keys]
    schema = _piece_schema(rows, _fields(rows, keys))
    arrow, of_rows = to_arrow_schema(schema), to_arrow_schema(T.StructType(_fields(rows, names)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces(cuts, arrow)
        for table in _chunks(batches, LONG_ROWS):
            if any(table.column(n).null_count for n in [*keys, value]):
                raise ValueError(f"no rank without {', '.join(keys)} and {value}")
            kept = table.select(others)
            values = table.column(value).to_numpy()
            for key, at in _by_key(table, keys):
                pieces.add(key, values[at], kept.take(pa.array(at)))
            yield from pieces.batch()

    def with_keys(key: tuple, table: pa.Table) -> list[pa.Array]:
        known = {k: pa.repeat(pa.scalar(x, of_rows.field(k).type), table.num_rows) for k, x in zip(keys, key)}
        return [known[n] if n in known else table.column(n).combine_chunks() for n in names]

    def sets(key: tuple, table: pa.Table) -> np.ndarray:
        return flags(pa.RecordBatch.from_arrays(with_keys(key, table), schema=of_rows))

    ranked = _rank_pieces(rows.mapInArrow(split, schema), keys, value, None if flags is None else sets, limits)
    longs = T.LongType() if flags is None else T.ArrayType(T.LongType())
    out = T.StructType([*_fields(rows, names), T.StructField("twice", longs), T.StructField("total", longs)])
    out_arrow = to_arrow_schema(out)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                table = pa.ipc.open_stream(piece["_rows"]).read_all()
                n, base, total = table.num_rows, piece["_base"], piece["_total"]
                twice = np.column_stack([table.column(f"t{s}").to_numpy() + b for s, b in enumerate(base)])
                if flags is None:
                    added = [pa.array(twice[:, 0]), pa.array(np.full(n, total[0]))]
                else:
                    places = pa.array(np.arange(n + 1, dtype=np.int32) * len(base))
                    added = [pa.ListArray.from_arrays(places, pa.array(x)) for x in (twice.reshape(-1), np.tile(np.array(total, np.int64), n))]
                yield pa.RecordBatch.from_arrays([*with_keys(tuple(piece[k] for k in keys), table), *added], schema=out_arrow)

    return ranked.select(*keys, "_rows", "_base", "_total").mapInArrow(unpack, out)


def mean_rank() -> Column:
    """1-based rank shared by ties, over the columns of range_ranks without flags."""
    return F.col("twice") / 2.0


def exact_quantiles(
    values: DataFrame,
    keys: list[str],
    probabilities: list[float],
    value: str = "value",
    also: list[Column] | None = None,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Type-7 quantiles (linear interpolation at (n - 1) * p) per key: columns n and q0, q1, ... in the order
    of `probabilities`. `also` are named aggregates to compute in the first of the two passes.

    Pass 1 brackets every quantile with a mergeable sketch; pass 2 keeps only the values inside a bracket, a few
    ten-thousandths of the rows, which are then ordered exactly, and counts the others by the gap they lie in. The
    full data is therefore scanned twice but never sorted or shuffled, and no value is copied. A position that no
    kept value covers is an error, never a missing result.
    """
    slack = 2.0 / limits.accuracy
    asked = sorted(set(probabilities))
    ends = sorted({min(max(p + s, 0.0), 1.0) for p in asked for s in (-slack, slack)} | {0.0, 1.0})
    sketch = F.percentile_approx(value, F.array(*[F.lit(e) for e in ends]), F.lit(limits.accuracy))
    also = also or []
    brackets = cut_lineage(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sketch.alias("ends"), *also))
    more = [c for c in brackets.columns if c not in (*keys, "n", "ends")]

    def bound(p: float) -> Column:
        return F.element_at("ends", ends.index(min(max(p, 0.0), 1.0)) + 1)

    # the sketch may be off by n / accuracy ranks; a bracket is only wide enough for that and for the
    # neighbouring rank when n is large, so smaller keys keep all their values
    few = F.col("n") < 4 * limits.accuracy
    spans = [F.when(few, bound(e)).otherwise(bound(p + s)).alias(f"_{name}{k}")
             for k, p in enumerate(asked) for name, e, s in (("lo", 0.0, -slack), ("hi", 1.0, slack))]
    spanned = broadcast_if_small(brackets.select(*keys, *spans), limits.broadcast_rows)
    v = F.col(value) + 0.0
    # brackets rise with the probability: how many lie wholly below a value, and how many begin at or below it
    above = sum((F.when(v > F.col(f"_hi{k}"), 1).otherwise(0) for k in range(len(asked))), F.lit(0))
    begun = sum((F.when(v >= F.col(f"_lo{k}"), 1).otherwise(0) for k in range(len(asked))), F.lit(0))
    cells = values.join(spanned, keys).select(*keys, v.alias("v"), above.alias("gap"), begun.alias("begun"))
    cells = cells.select(*keys, "gap", F.when(F.col("begun") > F.col("gap"), F.col("v")).alias("v"))
    counts = cut_lineage(cells.groupBy(*keys, "gap", "v").agg(F.count(F.lit(1)).alias("cnt")))
    in_gap = [F.sum(F.when(F.col("v").isNull() & (F.col("gap") <= k), F.col("cnt")).otherwise(0)) for k in range(len(asked) + 1)]
    below = counts.groupBy(*keys).agg(F.array(*in_gap).alias("below"))  # rows in the gaps up to each one
    inside = order_counts(counts.where(F.col("v").isNotNull()), keys, "v", limits=limits)
    located = (
        inside.join(broadcast_if_small(cut_lineage(below), limits.broadcast_rows), keys)
        .join(broadcast_if_small(brackets.select(*keys, "n", *more), limits.broadcast_rows), keys)
        .withColumn("start", F.col("before_cnt") + F.element_at("below", F.col("gap") + 1))
    )

    def value_at(position: Column) -> Column:
        covers = (F.col("start") <= position) & (position < F.col("start") + F.col("cnt"))
        return F.max(F.when(covers, F.col("v")))

    picked, results = [], []
    for k, p in enumerate(asked):
        h = (F.col("n") - 1) * F.lit(float(p))
        picked += [value_at(F.floor(h)).alias(f"_a{k}"), value_at(F.least(F.floor(h) + 1, F.col("n") - 1)).alias(f"_b{k}")]
    found = located.groupBy(*keys, "n").agg(*[F.first(c).alias(c) for c in more], *picked)
    for i, p in enumerate(probabilities):
        k = asked.index(p)
        low, high = F.col(f"_a{k}"), F.col(f"_b{k}")
        part = (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
        lost = F.raise_error(F.lit(f"no value was kept for quantile {p}")).cast("double")
        between = F.when(part == 0, low).otherwise(low + part * (high - low))
        results.append(F.when(low.isNull() | high.isNull(), lost).otherwise(between).alias(f"q{i}"))
    return found.select(*keys, "n", *more, *results)
