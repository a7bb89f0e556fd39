"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is learned from a bounded sample of the vectors, level by level: each node's
vectors are split by k-means into as many children, until leaves hold about the square
root of all vectors. Every vector is then put in the leaf where it belongs. A query goes down
best bin first: a priority queue holds the nodes not yet looked into by the distance of
their centre, and leaves are visited in that order. How many leaves is calibrated: for
a sample of queries whose true neighbours are known from a comparison with all
vectors, visits widen until the recall aimed at is reached.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.common import fresh, written

BRANCHES = 16
FIT_ROWS = 1 << 16  # vectors that the tree is learned from, about, if there are more
FIT_BYTES = 64 << 20  # and so many bytes of them
FIT_LEAF = 16  # vectors of the sample in a leaf, at least: the tree has at most about FIT_ROWS / FIT_LEAF leaves
LEAF_ROWS = 1024  # more vectors than this a leaf needn't hold, as long as there is sample enough to split it
BLOCK_ROWS = 8192  # vectors of a leaf that one task compares at a time, and queries
SAMPLE = 400  # queries that calibrate the visits
_ROW = "leaf bigint, vec_id bigint, v binary"


@dataclass
class Tree:
    """Centres by node, and each node's children; a node without children is a leaf."""

    centres: np.ndarray
    children: list[list[int]] = field(default_factory=list)

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that a greedy descent ends in, for each vector."""
        at = np.zeros(len(vectors), np.int64)
        nodes = {0: np.arange(len(vectors))}
        while nodes:
            node, rows = nodes.popitem()
            if not (below := self.children[node]):
                at[rows] = node
                continue
            to = _nearest(vectors[rows], self.centres[below])
            nodes |= {child: own for k, child in enumerate(below) if len(own := rows[to == k])}
        return at

    def leaves(self, vector: np.ndarray, visits: int) -> list[int]:
        """Leaves in the order of a best-bin-first search, as many as visits."""
        heap: list[tuple[float, int]] = [(0.0, 0)]
        out: list[int] = []
        while heap and len(out) < visits:
            _, node = heapq.heappop(heap)
            if not (below := self.children[node]):
                out.append(node)
                continue
            far = ((self.centres[below] - vector) ** 2).sum(axis=1)
            for d, child in zip(far.tolist(), below, strict=True):
                heapq.heappush(heap, (d, child))
        return out


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * (vectors @ centres.T), axis=1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def learn(x: np.ndarray, leaves: int, branches: int = BRANCHES, rounds: int = 6) -> Tree:
    """A tree of about as many leaves: a node that holds more than its share of the vectors is split."""
    tree = Tree(np.zeros((1, x.shape[1]), np.float32), [[]])
    most = max(1, -(-len(x) // leaves))
    open_nodes = [(0, np.arange(len(x)))]
    while open_nodes:
        node, rows = open_nodes.pop()
        if len(rows) <= most:
            continue
        own = x[rows]
        # no more children than leaves are wanted here; vectors that come first, of an order by hash, begin as centres
        centres = np.unique(own[: 8 * branches], axis=0)
        centres = centres[np.random.default_rng(len(rows)).permutation(len(centres))][: min(branches, max(2, -(-len(rows) // most)))]
        if len(centres) < 2:
            continue  # equal vectors
        for _ in range(rounds):
            to = _nearest(own, centres)
            n = np.bincount(to, minlength=len(centres))
            sums = np.stack([np.bincount(to, weights=c, minlength=len(centres)) for c in own.T], axis=1)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
        to = _nearest(own, centres)
        used = np.flatnonzero(np.bincount(to, minlength=len(centres)))
        if len(used) < 2:
            continue
        first = len(tree.children)
        tree.children[node] = list(range(first, first + len(used)))
        tree.children += [[] for _ in used]
        tree.centres = np.concatenate([tree.centres, centres[used]])
        open_nodes += [(first + k, rows[to == u]) for k, u in enumerate(used)]
    return tree


def prepare(vectors: DataFrame, dim: int | None = None) -> tuple[DataFrame, int]:
    """Distinct (vec_id, v, asked): v is the vector at length 1 as bytes; and the dimension, the most common one unless given.

    asked is that of vectors, true where it has no such column.
    """
    asked = F.coalesce(F.col("asked").cast("boolean"), F.lit(False)) if "asked" in vectors.columns else F.lit(True)
    source = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), asked.alias("asked"))
    source = source.where("vec_id is not null and embedding is not null and size(embedding) > 0")
    if dim is None:
        common = source.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = common.d if common else 0

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            ok = (np.diff(lists.offsets.to_numpy()) == dim) if len(batch) else np.zeros(0, bool)
            rows = batch.filter(pa.array(ok))
            flat = rows.column("embedding").flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            ok = np.isfinite(x).all(axis=1)
            x, rows = x[ok], rows.filter(pa.array(ok))
            norm = np.sqrt((x**2).sum(axis=1, keepdims=True))
            x = (x / np.where(norm > 0, norm, 1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary()), rows.column("asked")], ["vec_id", "v", "asked"])

    made = source.mapInArrow(unit, "vec_id bigint, v binary, asked boolean").groupBy("vec_id", "v").agg(F.bool_or("asked").alias("asked"))
    return written(made, "vectors"), dim


def _chance(rows: int, total: int, seed: int) -> F.Column:
    """True for about so many of all rows, by a hash of their ids."""
    part = min(1.0, rows / max(total, 1))
    return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(np.ceil(part * (1 << 30)))


def grow(points: DataFrame, dim: int, branches: int = BRANCHES, leaf_rows: int | None = None, fit_rows: int = FIT_ROWS) -> Tree:
    """A tree learned by one task from about fit_rows vectors, those with the least hashes of vec_id.

    Leaves hold about leaf_rows of all vectors: the square root of their number, 1,024 at
    most, unless given; more where fit_rows don't tell so many leaves apart.
    """
    total = points.count()
    fit_rows = min(fit_rows, FIT_BYTES // max(1, 4 * dim))
    leaf_rows = leaf_rows or max(1, min(LEAF_ROWS, int(total**0.5)))
    leaves = max(1, min(total // leaf_rows, max(min(total, fit_rows) // FIT_LEAF, 1)))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows := [b for b in batches if len(b)]:
            table = pa.Table.from_batches(rows).sort_by([("h", "ascending"), ("vec_id", "ascending"), ("v", "ascending")])
            tree = learn(_matrix(table["v"].combine_chunks(), dim), leaves, branches)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tree)], pa.binary())], ["tree"])

    sample = points.where(_chance(fit_rows, total, 5)).select("vec_id", "v", F.xxhash64("vec_id", F.lit(5)).alias("h"))
    made = sample.repartition(1).mapInArrow(train, "tree binary").collect()
    return pickle.loads(made[0].tree) if made else Tree(np.zeros((1, dim), np.float32), [[]])


def calibrate(points: DataFrame, tree: Tree, dim: int, k: int, recall: float, sample: int = SAMPLE) -> int:
    """Least number of leaf visits with which the sample's queries find as large a part of their true neighbours.

    The sample are the vectors with the least hashes of vec_id; its true neighbours come
    from a comparison with all vectors.
    """
    spark = points.sparkSession
    few = points.where(_chance(8 * sample, points.count(), 3))
    queries = few.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "v").limit(sample).collect()
    if not queries:
        return 1
    ids = np.array([q.vec_id for q in queries])
    x = np.stack([np.frombuffer(q.v, np.float32) for q in queries])
    shared = spark.sparkContext.broadcast((tree, ids, x))  # a few hundred vectors and a tree of bounded size

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, ids, asked = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x, own = _matrix(batch.column("v"), dim), batch.column("vec_id").to_numpy()
            near = asked @ x.T
            near[ids[:, None] == own[None, :]] = -np.inf
            top = _top(near, k)
            leaf = tree.leaf_of(x)
            q = np.repeat(np.arange(len(ids)), top.shape[1])
            s = np.take_along_axis(near, top, axis=1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(s.astype(np.float64)), pa.array(leaf[top.ravel()])], ["q", "s", "leaf"]).filter(pa.array(np.isfinite(s)))

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "leaf"))
    truth = points.mapInArrow(best, "q bigint, s double, leaf bigint").withColumn("r", rank).where(F.col("r") <= k).collect()
    if not truth:
        return 1
    leaves = sum(not c for c in tree.children)
    order = [{leaf: at for at, leaf in enumerate(tree.leaves(p, leaves), 1)} for p in x]
    needed = np.sort([order[t.q][t.leaf] for t in truth])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def _top(near: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest of each row, in no order; all places if there are fewer."""
    n = near.shape[1]
    return np.argpartition(near, n - k, axis=1)[:, n - k :] if n > k else np.tile(np.arange(n), (len(near), 1))


def _best(asked: np.ndarray, who: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query ids and similarities of its k nearest others among own, which is in order; ties go to the lesser id."""
    rounding = np.float32(4e-6)  # two similarities that are equal once rounded are no further apart in single precision
    for low in range(0, len(asked), 512):
        near = asked[low : low + 512] @ x.T
        near[who[low : low + 512, None] == own[None, :]] = -np.inf
        n = near.shape[1]
        least = np.partition(near, n - k, axis=1)[:, n - k] if n > k else np.full(len(near), -np.inf, np.float32)
        maybe = near >= least[:, None] - rounding
        # equal vectors can make many candidates: about 100,000 are compared at a time
        group = np.cumsum(maybe.sum(axis=1)) // 100_000
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            row, at = np.nonzero(maybe[rows])
            exact = np.round(np.einsum("ij,ij->i", asked[low + rows[row]].astype(np.float64), x[at].astype(np.float64)), 6)
            order = np.lexsort((at, -exact, row))
            row, at, exact = row[order], at[order], exact[order]
            bounds = np.searchsorted(row, np.arange(len(rows) + 1))
            for q, a, b in zip(rows, bounds[:-1], np.minimum(bounds[1:], bounds[:-1] + k), strict=True):
                ids = own[at[a:b]]
                other = ids != who[low + q]
                yield ids[other], exact[a:b][other]


def nearest_neighbours(
    vectors: DataFrame, k: int = 10, recall: float = 0.96, branches: int = BRANCHES, leaf_rows: int | None = None, dim: int | None = None, queries: str | None = None
) -> DataFrame:
    """The k nearest others of every query: vec_id, neighbour_id, rank from 1, similarity (cosine).

    queries is an SQL condition on vectors; without it, every vector is a query. All
    vectors are searched. recall is what the calibration aims at; it is above the 0.9 to
    be kept, as the sample's is an estimate. Ties go to the lesser neighbour_id. A
    vector that is null, has a null, infinite or NaN entry or another dimension than
    most, or has no vec_id, is left out; a vector of zeros has similarity 0 to all.
    Repeated rows count once; different vectors with one vec_id are one query that has
    the neighbours of both. Fewer than k others give fewer rows. Other columns are not
    read. A leaf of any size is searched whole, in blocks.
    """
    spark = vectors.sparkSession
    if queries is not None:
        [name] = fresh(vectors, "mls_asked")
        vectors = vectors.withColumn(name, F.expr(queries)).select("vec_id", "embedding", F.col(name).alias("asked"))
    else:
        vectors = vectors.select("vec_id", "embedding")
    points, dim = prepare(vectors, dim)
    tree = grow(points, dim, branches, leaf_rows)
    visits = calibrate(points, tree, dim, k, recall)
    shared = spark.sparkContext.broadcast((tree, visits))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value[0].leaf_of(_matrix(batch.column("v"), dim)) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column("vec_id"), batch.column("v")], ["leaf", "vec_id", "v"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, visits = shared.value
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            for low in range(0, len(x), 1024):
                found = [tree.leaves(p, visits) for p in x[low : low + 1024]]
                row = np.repeat(np.arange(low, low + len(found)), [len(f) for f in found])
                leaf = np.concatenate([np.array(f, np.int64) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *(batch.column(c).take(pa.array(row)) for c in ("vec_id", "v"))], ["leaf", "vec_id", "v"])

    data = written(points.select("vec_id", "v").mapInArrow(place, _ROW), "leaves")
    asked = written(points.where("asked").select("vec_id", "v").mapInArrow(visit, _ROW), "visits")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        """Of each leaf the number of blocks: a row for each leaf, whose number the sample of the tree bounds."""
        return df.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))

    # a leaf's vectors in blocks, its queries in parts; each part meets each block
    counts = F.broadcast(blocks(data, "blocks").join(blocks(asked, "parts"), "leaf"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.col(n)).cast("int")
    data = data.join(counts, "leaf").select("leaf", own("blocks", 11).alias("block"), all_of("parts").alias("part"), "vec_id", "v")
    asked = asked.join(counts, "leaf").select("leaf", all_of("blocks").alias("block"), own("parts", 12).alias("part"), "vec_id", "v")

    def compare(queries: pa.Table, data: pa.Table) -> pa.Table:
        if not len(queries) or not len(data):
            return pa.table({"vec_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "s": pa.array([], pa.list_(pa.float64()))})
        ids = data["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, who = _matrix(data["v"].combine_chunks(), dim)[order], queries["vec_id"].to_numpy()
        found = list(_best(_matrix(queries["v"].combine_chunks(), dim), who, x, ids[order], k))
        return pa.table({"vec_id": who, "ids": pa.array([i for i, _ in found], pa.list_(pa.int64())), "s": pa.array([s for _, s in found], pa.list_(pa.float64()))})

    keys = ("leaf", "block", "part")
    found = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(compare, "vec_id bigint, ids array<bigint>, s array<double>")
    pairs = found.select("vec_id", F.explode(F.arrays_zip("ids", "s")).alias("x"))
    pairs = pairs.groupBy("vec_id", F.col("x.ids").alias("neighbour_id")).agg(F.max("x.s").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "neighbour_id", F.col("rank").cast("int"), "similarity")
