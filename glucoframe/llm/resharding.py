"""Resharding by minimum-cost flow: which files change their shard so that the fewest bytes move."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glucoframe.llm.common import BROADCAST_ROWS, packed
from glucoframe.session import broadcast_if_small, cut_lineage


def cheapest_flow(supply: np.ndarray, capacity: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """How many bytes go from each old to each new shard at the least total cost (successive shortest paths).

    The capacities must add up to at least the supply. One path search per saturated shard over a matrix of shards;
    prices keep all reduced costs at zero or more, so Dijkstra's search applies.
    """
    olds, news = cost.shape
    flow = np.zeros(cost.shape, np.int64)
    left, room = supply.astype(np.int64).copy(), capacity.astype(np.int64).copy()
    if left.sum() > room.sum():
        raise ValueError("the new shards hold less than the old ones have")
    price = np.zeros(olds + news)
    while left.sum() > 0:
        far = np.full(olds + news, np.inf)
        came = np.full(olds + news, -1)
        far[:olds][left > 0] = 0.0
        heap = [(0.0, int(i)) for i in np.flatnonzero(left > 0)]
        done = np.zeros(olds + news, bool)
        while heap:
            dist, node = heapq.heappop(heap)
            if done[node]:
                continue
            done[node] = True
            if node < olds:
                others = np.arange(olds, olds + news)
                steps = cost[node] + price[node] - price[olds:]
            else:  # bytes already sent to a new shard can be sent elsewhere instead
                others = np.flatnonzero(flow[:, node - olds] > 0)
                steps = -cost[others, node - olds] + price[node] - price[others]
            reached = dist + np.maximum(steps, 0.0)
            for k in np.flatnonzero(reached < far[others] - 1e-12):
                far[others[k]], came[others[k]] = reached[k], node
                heapq.heappush(heap, (float(reached[k]), int(others[k])))
        ends = np.flatnonzero((room > 0) & np.isfinite(far[olds:]))
        end = int(ends[np.argmin((far + price)[olds:][ends])])
        path = [olds + end]
        while came[path[-1]] >= 0:
            path.append(int(came[path[-1]]))
        path.reverse()
        amount = min(int(left[path[0]]), int(room[end]))
        for a, b in zip(path, path[1:]):
            if a >= olds:
                amount = min(amount, int(flow[b, a - olds]))
        for a, b in zip(path, path[1:]):
            if a < olds:
                flow[a, b - olds] += amount
            else:
                flow[b, a - olds] -= amount
        left[path[0]] -= amount
        room[end] -= amount
        price += np.where(np.isfinite(far), far, np.max(far[np.isfinite(far)]))
    return flow


def even_capacities(total: int, shards: int) -> np.ndarray:
    """Capacities that differ by at most one byte and add up to the total."""
    return np.array([total // shards + (k < total % shards) for k in range(shards)], np.int64)


@dataclass
class Layout:
    """Files of rows by shard: `row` (struct of the source row) and `size`, below folders shard=N."""

    spark: SparkSession
    path: str
    schema: T.StructType

    def rows(self, *paths: str) -> DataFrame:
        """row, size, file, place (of the row in its file); only the named files if any are."""
        reader = self.spark.read.schema(self.schema)
        read = reader.option("basePath", self.path).parquet(*paths) if paths else reader.parquet(self.path)
        return read.select("row", "size", "shard", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))


def store(docs: DataFrame, shard: Column, size: Column, path: str) -> Layout:
    """Write the rows below `path` by shard: each task writes a file for every shard it meets, without a shuffle."""
    rows = packed(docs, size=size.cast("long"), shard=shard.cast("int"))
    rows.write.partitionBy("shard").parquet(path)
    return Layout(docs.sparkSession, path, rows.schema)


@dataclass
class Moves:
    """The solved plan: bytes from old to new shard, and a table of file pieces with their new places."""

    flow: np.ndarray
    pieces: DataFrame  # file, first, until (rows of the file), shard, slot (of the first row), cut (file is rewritten)

    @property
    def moved_bytes(self) -> int:
        return int(self.flow.sum() - np.trace(self.flow[:, : self.flow.shape[0]]))


def _cuts(layout: Layout, wanted: list[tuple[str, int]]) -> dict[tuple[str, int], int]:
    """For cut positions (file, bytes before the cut): the number of rows before the cut.

    A row belongs before it if at least half of its bytes do. Only the named files are read, and only their sizes;
    there is at most one cut file for each pair of shards that exchange rows.
    """
    if not wanted:
        return {}
    spark = layout.spark
    positions = spark.createDataFrame(wanted, "of string, at long")
    running = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = layout.rows(*sorted({file for file, _ in wanted})).select("file", "place", "size").withColumn("upto", F.sum("size").over(running))
    met = sizes.join(F.broadcast(positions), F.col("file") == F.col("of")).where(F.col("upto") - F.col("size") / 2 <= F.col("at"))
    return {(r.file, r.at): r.n for r in met.groupBy("file", "at").agg(F.count(F.lit(1)).alias("n")).collect()}


def plan(layout: Layout, capacities: np.ndarray | None = None, shards: int | None = None, cost: np.ndarray | None = None) -> Moves:
    """Solve the transfers from the stored shards to new ones with the given capacities (default: `shards` even ones).

    Cost per byte defaults to 0 for staying and 1 for moving. A shard's files are taken in the order of their names:
    what stays comes first, then what goes to each new shard. Files inside such a range keep their content and only
    change their shard; a file on a border is cut between two rows. The driver holds one entry per file.
    """
    stats = layout.rows().groupBy("shard", "file").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    files = sorted((r.shard, r.file, r.bytes, r.n) for r in stats.toLocalIterator())
    olds = 1 + max((f[0] for f in files), default=-1)
    supply = np.zeros(max(olds, 1), np.int64)
    for shard, _, size, _ in files:
        supply[shard] += size
    capacities = even_capacities(int(supply.sum()), shards or 1) if capacities is None else capacities
    if cost is None:
        cost = 1.0 - np.eye(len(supply), len(capacities))
    flow = cheapest_flow(supply, capacities, cost)

    ranges, cuts = [], []  # (file, first byte, last byte + 1, rows, bytes, new shard)
    for old in range(len(supply)):
        order = [new for new in sorted(range(len(capacities)), key=lambda new: (new != old, new)) if flow[old, new]]
        order = order or [min(old, len(capacities) - 1)]  # rows of no bytes at all
        ends, start = np.cumsum(flow[old][order]), 0
        for _, file, size, n in (f for f in files if f[0] == old):
            stop = start + size
            a = min(int(np.searchsorted(ends, start, side="right")), len(ends) - 1)
            b = max(a, min(int(np.searchsorted(ends, stop, side="left")), len(ends) - 1))
            borders = [start, *[int(e) for e in ends[a:b]], stop]
            for new, lo, hi in zip(order[a : b + 1], borders, borders[1:]):
                ranges.append((file, lo - start, hi - start, n, size, new))
            cuts += [(file, border - start) for border in borders[1:-1]]
            start = stop
    found = _cuts(layout, sorted(set(cuts)))
    fills, pieces = [0] * len(capacities), []
    for file, start, stop, n, size, new in ranges:
        first = 0 if start == 0 else found.get((file, start), 0)
        until = n if stop == size else found.get((file, stop), 0)
        if until > first:
            pieces.append((file, first, until, new, fills[new], until - first < n))
            fills[new] += until - first
    table = layout.spark.createDataFrame(pieces, "file string, first long, until long, shard int, slot long, cut boolean")
    return Moves(flow, cut_lineage(table))


def reshard(layout: Layout, moves: Moves, rewritten: str) -> DataFrame:
    """All rows in their new places: row, size, shard, slot (gapless from 0 in each shard).

    Only cut files are rewritten, below `rewritten` by new shard; the others are read where they are. The pieces are
    joined by file: broadcast up to BROADCAST_ROWS of them. No row is shuffled beyond that.

    Null columns, repeated rows and very long texts are rows like others (a row is never cut). An empty table gives no
    rows. A single row larger than a capacity still lands in one shard, which then exceeds it.
    """
    spark = layout.spark
    pieces = moves.pieces.withColumnRenamed("file", "of").withColumnRenamed("shard", "new")
    inside = (F.col("file") == F.col("of")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("until"))
    placed = [F.col("new").alias("shard"), (F.col("slot") + F.col("place") - F.col("first")).alias("slot")]
    whole = layout.rows().join(broadcast_if_small(pieces.where("NOT cut"), BROADCAST_ROWS), inside).select("row", "size", *placed)
    cut = sorted({r.of for r in pieces.where("cut").select("of").collect()})
    if not cut:
        return whole
    moved = layout.rows(*cut).join(F.broadcast(pieces.where("cut")), inside).select("row", "size", *placed)
    moved.write.partitionBy("shard").parquet(rewritten)
    again = spark.read.schema(moved.schema).parquet(rewritten)
    return whole.unionByName(again)
