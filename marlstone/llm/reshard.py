"""Resharding by minimum-cost flow.

Old shards are the files of a table. Bytes flow from each old shard to new ones: what
stays in its place costs nothing, what moves costs its bytes. A flow of least cost
that keeps to the capacities is turned into blocks, runs of consecutive rows, and only
files that lose a block are written again; a shard that only gains has new files
beside the old one, which stays where it is.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marlstone.llm.common import fresh, shared_folder, written

HEADROOM = 1.05
PLAN = "old int, new int, low bigint, high bigint"


class Flow:
    """Minimum-cost flow by successive shortest paths with potentials."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [room, 0]
        self.cost += [cost, -cost]
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> tuple[int, int]:
        """Amount and cost of a largest flow of least cost. Costs must not be negative."""
        n = len(self.out)
        potential = [0] * n
        amount = cost = 0
        while True:
            far: list[float] = [float("inf")] * n
            came = [-1] * n
            far[source] = 0
            heap = [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    b = self.to[e]
                    step = d + self.cost[e] + potential[a] - potential[b]
                    if self.room[e] and step < far[b]:
                        far[b], came[b] = step, e
                        heapq.heappush(heap, (step, b))
            if came[sink] < 0:
                return amount, cost
            potential = [p + int(f) if f < float("inf") else p for p, f in zip(potential, far, strict=True)]
            # along all shortest paths at once
            at = [0] * n
            while pushed := self._push(source, sink, 1 << 62, potential, at, [False] * n):
                amount += pushed
                cost += pushed * (potential[sink] - potential[source])

    def _push(self, source: int, sink: int, most: int, potential: list[int], at: list[int], on: list[bool]) -> int:
        path: list[int] = []
        a = source
        on[a] = True
        while a != sink:
            while at[a] < len(self.out[a]):
                e = self.out[a][at[a]]
                b = self.to[e]
                if self.room[e] and not on[b] and self.cost[e] + potential[a] == potential[b]:
                    path.append(e)
                    on[b] = True
                    a = b
                    break
                at[a] += 1
            else:
                if not path:
                    return 0
                e = path.pop()
                a = self.to[e ^ 1]
                at[a] += 1
        pushed = min(most, *(self.room[e] for e in path))
        for e in path:
            self.room[e] -= pushed
            self.room[e ^ 1] += pushed
        return pushed


def transfers(sizes: Sequence[int], capacities: Sequence[int]) -> list[tuple[int, int, int]]:
    """(old shard, new shard, bytes) of a cheapest flow; what stays has the same number.

    Shard k of old is shard k of new; where the new have fewer, the old ones beyond
    are emptied. Raises ValueError if the capacities don't hold all.
    """
    if sum(capacities) < sum(sizes):
        raise ValueError(f"capacities of {sum(capacities)} bytes for {sum(sizes)} bytes")
    n, m = len(sizes), len(capacities)
    source, sink, hub = n + m, n + m + 1, n + m + 2
    flow = Flow(n + m + 3)
    for i, size in enumerate(sizes):
        flow.edge(source, i, size, 0)
    stay = [flow.edge(i, n + i, sizes[i], 0) if i < m else -1 for i in range(n)]
    # every move costs the same by byte, so they all pass one node: edges grow with the shards, not their pairs
    leave = [flow.edge(i, hub, size, 1) for i, size in enumerate(sizes)]
    enter = [flow.edge(hub, n + j, max(capacity, 0), 0) for j, capacity in enumerate(capacities)]
    for j, capacity in enumerate(capacities):
        flow.edge(n + j, sink, max(capacity, 0), 0)
    flow.run(source, sink)
    found = [(i, i, flow.room[e ^ 1]) for i, e in enumerate(stay) if e >= 0 and flow.room[e ^ 1]]
    wanted = [[j, flow.room[e ^ 1]] for j, e in enumerate(enter) if flow.room[e ^ 1]]
    for i, e in enumerate(leave):
        left = flow.room[e ^ 1]
        while left:
            j, room = wanted[-1]
            part = min(left, room)
            found.append((i, j, part))
            left -= part
            wanted[-1][1] -= part
            if not wanted[-1][1]:
                wanted.pop()
    return sorted(found, key=lambda x: (x[0], x[0] != x[1], x[1]))


def grown(sizes: Sequence[int], headroom: float = HEADROOM) -> list[int]:
    """Equal capacities for a quarter more shards, at least one more, with some room to spare."""
    n = len(sizes) + max(1, len(sizes) // 4)
    return [int(sum(sizes) / n * headroom) + 1] * n


def _row_bytes(schema: T.StructType) -> Column:
    size = F.lit(16).cast("bigint")
    for field in schema.fields:
        name = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            size = size + F.coalesce(F.greatest(F.size(name), F.lit(0)), F.lit(0)) * 8
        else:
            size = size + 8
    return size


def _small(df: DataFrame, rows: int) -> DataFrame:
    """The table, to be broadcast if it has so few rows as to be a few MB; else Spark chooses the join."""
    return F.broadcast(df) if rows <= 100_000 else df


def plan(spark: SparkSession, path: str, capacities: Sequence[int] | None = None) -> tuple[list[str], list[int], DataFrame]:
    """Files of a Parquet table in the order of their names, their bytes, and the blocks.

    Bytes of a row are those of its strings and 8 for other values. A block is the rows
    low to high of file old (high left out), to be in shard new. Its bytes are those of
    the flow but for a row where two blocks meet.
    """
    table = spark.read.parquet(path)
    file, row, size, end = fresh(table, "mls_file", "mls_row", "mls_bytes", "mls_end")
    rows = table.select(F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row), _row_bytes(table.schema).alias(size))
    rows = written(rows, "row-sizes")
    # a row for each file
    totals = rows.groupBy(file).agg(F.sum(size).alias("n"), F.count("*").alias("rows")).orderBy(file).collect()
    files, sizes = [r[file] for r in totals], [int(r.n) for r in totals]
    capacities = grown(sizes) if capacities is None else list(capacities)
    moves = transfers(sizes, capacities)
    bounds, at = [], dict.fromkeys(range(len(files)), 0)
    for old, new, n in moves:
        bounds.append((files[old], old, new, at[old], at[old] + n))
        at[old] += n
    if not files:
        return files, sizes, spark.createDataFrame([], PLAN)
    spans = spark.createDataFrame(bounds, f"`{file}` string, old int, new int, begin bigint, stop bigint")
    ends = rows.withColumn(end, F.sum(size).over(Window.partitionBy(file).orderBy(row)) - F.col(size))
    # a row belongs to the block in which it begins
    blocks = ends.join(_small(spans, len(bounds)), file).where((F.col(end) >= F.col("begin")) & (F.col(end) < F.col("stop")))
    blocks = blocks.groupBy("old", "new", "begin").agg(F.min(row).alias("low"), (F.max(row) + 1).alias("high"))
    return files, sizes, written(blocks.select("old", "new", "low", "high"), "plan")


def reshard(spark: SparkSession, path: str, capacities: Sequence[int] | None = None, out: str | None = None) -> tuple[DataFrame, str]:
    """Rewrites what must be, and gives the table in its new layout: all columns, and shard and rewritten.

    capacities are the bytes that the new shards hold, a quarter more shards of equal
    size unless given. Files that lose no row stay as they are. The other rows are
    written to folders out/mls_shard=k, next to what is kept. Rows are moved as they are: nulls,
    repeated rows, empty and long texts are no different. A table without rows stays
    as it is. If a column is named shard or rewritten, the new one's name gets a _.
    """
    files, _, blocks = plan(spark, path, capacities)
    table = spark.read.parquet(path)
    shard, again = fresh(table, "shard", "rewritten")
    if not files:
        return table.select("*", F.lit(0).alias(shard), F.lit(False).alias(again)), path
    out = out or shared_folder(spark, "shards")
    kept = blocks.groupBy("old").agg(F.count("*").alias("n"), F.max(F.col("new") != F.col("old")).alias("moves")).where("n = 1 and not moves")
    kept = {r.old for r in kept.select("old").toLocalIterator()}
    lost = [k for k in range(len(files)) if k not in kept]
    parts = []
    file, row, old, low, high, to = fresh(table, "mls_file", "mls_row", "mls_old", "mls_low", "mls_high", "mls_shard")
    columns = [F.col(f"`{c}`") for c in table.columns]
    if kept:
        number = spark.createDataFrame([(files[k], k) for k in sorted(kept)], f"`{file}` string, `{shard}` int")
        whole = spark.read.schema(table.schema).parquet(*[files[k] for k in sorted(kept)])
        named = whole.select(*columns, F.col("_metadata.file_path").alias(file))
        parts.append(named.join(_small(number, len(kept)), file).select(*columns, shard, F.lit(False).alias(again)))
    if lost:
        names = spark.createDataFrame([(files[k], k) for k in lost], f"`{file}` string, `{old}` int")
        spans = blocks.select(F.col("old").alias(old), F.col("new").alias(to), F.col("low").alias(low), F.col("high").alias(high))
        ranges = _small(spans.join(names, old).drop(old), 4 * len(files))
        source = spark.read.schema(table.schema).parquet(*[files[k] for k in lost])
        source = source.select(*columns, F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
        # a few ranges for each file: no row is shuffled
        moved = source.join(ranges, file).where((F.col(row) >= F.col(low)) & (F.col(row) < F.col(high)))
        moved.select(*columns, to).write.partitionBy(to).parquet(out)
        schema = T.StructType([*table.schema.fields, T.StructField(to, T.IntegerType())])
        new = spark.read.schema(schema).parquet(out)
        parts.append(new.select(*columns, F.col(to).alias(shard), F.lit(True).alias(again)))
    return (parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]), out
