"""MinHash near-dedup by a chosen-path similarity join.

Each document has a signature: for each of its coordinates the least hash of its word
pairs under one hash function. A tree branches the documents of a node by some of
the coordinates, those that a hash of the node's path selects with probability
1 / (threshold * coordinates): each selected coordinate sends a document to the child
of its value there (Christiani and Pagh, 2017). Small nodes are compared pair by
pair, larger ones branch again. Independent trees repeat this until a pair at the
threshold is met with the recall aimed at.

Documents with equal signatures are one from the start. A node too large for one task
holds many documents that are alike but not equal: all its members are compared with one of
them, in parts, and those that are like it are known to be connected. Only what has
pairs that are not yet known to be connected branches on; what is left after some rounds of
that is compared pair by pair, a block against a block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import chunks, fresh, hashes, map_texts, mix, normal_words, release, with_key, written

COORDINATES = 128
THRESHOLD = 0.6
SHINGLE = 2
DEEPEST = 2  # times that a task branches nodes again; the root has been branched before
ROUNDS = 4  # of branching across the cluster; nodes still large after them are compared block by block
_NODE = "path bigint, vals binary, sig bigint, label bigint"
_EDGES = "a bigint, b bigint"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def signatures(text: pa.Array, coordinates: int = COORDINATES, shingle: int = SHINGLE) -> np.ndarray:
    """A row of 32-bit minima for each text; all ones, the greatest value, for a text without words.

    Shingles are runs of words in normal form; a text with fewer words is one shingle.
    """
    index, words, offsets = normal_words(text)
    h = hashes(words)[index] if len(index) else np.zeros(0, np.uint64)
    n = np.diff(offsets)
    out = np.full((len(text), coordinates), 0xFFFFFFFF, np.uint32)
    mixed = h.copy()
    for k in range(1, shingle):
        mixed[: len(h) - k] = mix(mixed[: len(h) - k] + _GOLD) + h[k:] if len(h) > k else mixed[: len(h) - k]
    start, stop = offsets[:-1], np.maximum(offsets[1:] - (shingle - 1), offsets[:-1] + (n > 0))
    for k in np.flatnonzero((n > 0) & (n < shingle)):
        one = np.zeros(1, np.uint64)
        for x in h[offsets[k] : offsets[k + 1]]:
            one = mix(one + _GOLD) + x
        mixed[offsets[k]] = one[0]
    seeds = np.arange(1, coordinates + 1, dtype=np.uint64)
    odd = (mix(seeds * _GOLD) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    add = mix(seeds + _GOLD).astype(np.uint32)
    low = mix(mixed)
    low = (low >> np.uint64(32)).astype(np.uint32) ^ low.astype(np.uint32)
    for k in np.flatnonzero(n > 0):
        own = np.unique(low[start[k] : stop[k]])
        for at in range(0, len(own), 512):  # stays in cache
            x = own[at : at + 512][None, :] * odd[:, None] + add[:, None]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(13)
            np.minimum(out[k], x.min(axis=1), out=out[k])
    return out


def _selected(path: np.ndarray, coordinates: int, threshold: float) -> np.ndarray:
    """For each node's path, which coordinates branch it."""
    draws = mix(path[:, None] ^ mix(np.arange(1, coordinates + 1, dtype=np.uint64) * _GOLD)[None, :])
    return draws < np.uint64(min(2**64 - 1, int(2.0**64 / (threshold * coordinates))))


def _children(path: np.ndarray, values: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and paths of the children of (row's path, row's signature)."""
    row, coordinate = np.nonzero(_selected(path, values.shape[1], threshold))
    key = mix(path[row] + coordinate.astype(np.uint64) * _GOLD) ^ mix(values[row, coordinate].astype(np.uint64) + np.uint64(1))
    return row, mix(key)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each component of the links, its members linked to its least member."""
    ids, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = both[: len(a)], both[len(a) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(ids))
    return ids[label[other]], ids[other]


def _pairs(rows: np.ndarray, bounds: np.ndarray, size: np.ndarray, values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs within each of many small nodes, those that agree in as many coordinates."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in np.unique(size):
        i, j = np.triu_indices(s, 1)
        starts = bounds[size == s]
        step = max(1, 60_000 // len(i))
        for at in range(0, len(starts), step):
            x = rows[starts[at : at + step, None] + i].ravel()
            y = rows[starts[at : at + step, None] + j].ravel()
            alike = (values[x] == values[y]).sum(axis=1) >= least
            left.append(x[alike])
            right.append(y[alike])
    return np.concatenate(left), np.concatenate(right)


def _connected(rows: np.ndarray, values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of a large node linked to the first of their component: the components that all its pairs give.

    A member is compared with all those that no component has taken yet, so a node of
    many near copies takes about one comparison for each.
    """
    left, right = [], []
    rest = rows
    while len(rest) > 1:
        first, rest = rest[0], rest[1:]
        front = [first]
        while front and len(rest):
            alike = (values[rest] == values[front.pop()]).sum(axis=1) >= least
            found, rest = rest[alike], rest[~alike]
            left.append(np.full(len(found), first))
            right.append(found)
            front += found.tolist()
    return (np.concatenate(left), np.concatenate(right)) if left else (rows[:0], rows[:0])


def _tree(values: np.ndarray, path: np.ndarray, threshold: float, least: int, small: int, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of the nodes given as rows (path, values), and of those below them."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows = np.arange(len(path))
    for depth in range(deepest + 1):
        if not len(rows):
            break
        order = np.lexsort((rows, path))
        rows, path = rows[order], path[order]
        bounds = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1], [True]]))
        size = np.diff(bounds)
        few = (size > 1) & (size <= small)
        found = [_pairs(rows, bounds[:-1][few], size[few], values, least)]
        if depth == deepest:
            found += [_connected(rows[bounds[k] : bounds[k + 1]], values, least) for k in np.flatnonzero(size > small)]
        for x, y in found:
            left.append(x)
            right.append(y)
        large = np.repeat(size > small, size)
        rows, path = rows[large], path[large]
        child, path = _children(path, values[rows], threshold)
        rows = rows[child]
    return np.concatenate(left), np.concatenate(right)


def least_agreeing(threshold: float, coordinates: int) -> int:
    """Coordinates in which near copies agree at least, by chance or not."""
    return int(np.ceil((threshold + (1 - threshold) / 256) * coordinates - 1e-9))


def trees_for(threshold: float, recall: float, branchings: int = DEEPEST + 1) -> int:
    """Trees so that a pair at the threshold meets with the recall, if its path ends after at most so many branchings.

    A pair as similar as the threshold has one common child on average, in number
    about Poisson distributed, so if a child's pair is met with probability p, its
    parent's is with 1 - exp(-p).
    """
    met = 1.0
    for _ in range(branchings):
        met = 1 - np.exp(-met)
    return int(np.ceil(np.log(1 - recall) / np.log(1 - met)))


def _components(edges: DataFrame) -> DataFrame:
    """id and group, the least id of its component, by large-star and small-star steps (Kiveris et al., 2014)."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    signature = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small-star: each node's smaller neighbours, and itself, to its least neighbour
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a")).where("a <> b")
        edges = written(small.select("a", "b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(now) == signature:
            break
        signature = tuple(now)
    return edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("group"))


def groups(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    recall: float = 0.99,
    coordinates: int = COORDINATES,
    shingle: int = SHINGLE,
    small: int = 48,
    local_rows: int = 20_000,
    trees: int | None = None,
) -> DataFrame:
    """did, uid (see with_key) and set, which copies and near copies have in common.

    A row for each row of docs whose text isn't blank.
    """
    keyed, did, uid = with_key(docs)
    trees = trees or trees_for(threshold, recall)
    roots = mix(np.arange(1, trees + 1, dtype=np.uint64) * _GOLD)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = signatures(batch.column("text"), coordinates, shingle)
            words = (found != 0xFFFFFFFF).any(axis=1)
            # a text of symbols alone has no pairs of words: it is in no node, and its group are its exact copies
            symbols = pc.not_equal(pc.utf8_trim_whitespace(batch.column("text")), "").to_numpy(zero_copy_only=False) & ~words
            if symbols.any():
                seeds = hashes(batch.column("text").filter(pa.array(symbols)).to_pylist())
                found[symbols] = mix(seeds[:, None] + np.arange(1, coordinates + 1, dtype=np.uint64) * _GOLD).astype(np.uint32)
            used = words | symbols
            rows, found, plain = batch.filter(pa.array(used)), found[used], words[used]
            children = [_children(np.full(len(found), root), found, threshold) for root in roots]
            children = [(r[plain[r]], p[plain[r]]) for r, p in children]
            row = np.concatenate([r for r, _ in children])
            order = np.argsort(row, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(found)))]).astype(np.int32)
            paths = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([p for _, p in children])[order].view(np.int64)))
            short = [x.tobytes() for x in found.astype(np.uint8)]
            whole = hashes(short).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("did"), rows.column("uid"), pa.array(whole), pa.array(short, pa.binary()), paths], ["did", "uid", "sig", "vals", "paths"])

    source = keyed.where("text is not null").select(F.col(did).alias("did"), F.col(uid).alias("uid"), "text")
    signed = written(map_texts(source, sign, "did bigint, uid bigint, sig bigint, vals binary, paths array<bigint>"), "signatures")
    one = signed.groupBy("sig").agg(F.first(F.struct("vals", "paths")).alias("s"))
    # agreement by chance of values cut to 8 bits counts too
    least = least_agreeing(threshold, coordinates)

    def values_of(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, coordinates)

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, child = _children(batch.column("path").to_numpy().view(np.uint64), values_of(batch.column("vals")), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *(batch.column(c).take(pa.array(row)) for c in ("vals", "sig", "label"))], ["path", "vals", "sig", "label"])

    def like_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = (values_of(batch.column("vals")) == values_of(batch.column("first"))).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "vals", "sig", "label", "first_sig")), pa.array(alike)], ["path", "vals", "sig", "label", "first_sig", "alike"])

    def in_block(rows: pa.Table) -> pa.Table:
        sig = rows["sig"].to_numpy()
        left, right = _connected(np.arange(len(sig)), values_of(rows["vals"].combine_chunks()), least)
        return pa.table({"a": sig[left], "b": sig[right]})

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # all nodes of a partition; a row carries no id, as the signature gives it
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        vals = [v for b in parts for v in b.column("vals").to_pylist()]
        path = np.concatenate([b.column("path").to_numpy() for b in parts]).view(np.uint64)
        sig = hashes(vals).view(np.int64)
        left, right = _tree(np.frombuffer(b"".join(vals), np.uint8).reshape(-1, coordinates), path, threshold, least, small, DEEPEST)
        left, right = _stars(sig[left], sig[right])
        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])
        del parts, vals, path, sig
        release()

    spark = docs.sparkSession
    # so many that a partition's rows fit a task at any size of the input
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(signed.count() * trees / threshold / 30_000))
    # copies count once
    sizes = signed.groupBy("sig").agg(F.first("paths").alias("paths")).select(F.explode("paths").alias("path")).groupBy("path").count()
    large = written(sizes.where(F.col("count") > local_rows), "large-nodes")
    nodes = one.select(F.explode("s.paths").alias("path"), F.col("s.vals").alias("vals"), "sig", F.lit(None).cast("bigint").alias("label"))
    links = []
    for step in range(ROUNDS + 1):
        # nodes too large for one task; most often there is none
        more = not large.isEmpty()
        here = nodes.join(large, "path", "left_anti") if more else nodes
        links.append(written(here.select("path", "vals").repartition(buckets, "path").mapInArrow(below, _EDGES), "links"))
        if not more:
            break
        most = large.agg(F.max("count")).first()[0]
        parts = -(-most // local_rows)  # of a node at most: no task has a node whole
        part = F.pmod(F.xxhash64("sig", F.lit(7)), F.least(F.lit(parts), F.ceil(F.col("count") / local_rows))).cast("int")
        inside = written(nodes.join(large, "path").withColumn("part", part).select("path", "vals", "sig", "label", "part", "count"), "nodes")
        if step == ROUNDS:  # every part against every part
            other = F.explode(F.sequence(F.lit(0), F.ceil(F.col("count") / local_rows).cast("int") - 1))
            pairs = inside.withColumn("other", other).select("path", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "vals", "sig")
            links.append(written(pairs.groupBy("path", "i", "j").applyInArrow(in_block, _EDGES), "links"))
            break
        # one member of each node, best one that isn't connected to others yet
        rank = F.struct(F.col("label").isNotNull(), F.xxhash64("sig", F.lit(step)), "sig")
        first = inside.groupBy("path").agg(F.min_by(F.struct("vals", "sig"), rank).alias("f"), F.first("count").alias("count"))
        first = first.select("path", F.col("f.vals").alias("first"), F.col("f.sig").alias("first_sig"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("count") / local_rows).cast("int") - 1)).alias("part"))
        kind = "path bigint, vals binary, sig bigint, label bigint, first_sig bigint, alike boolean"
        met = written(inside.join(first, ["path", "part"]).select("path", "vals", "sig", "label", "first", "first_sig").mapInArrow(like_first, kind), "met")
        links.append(met.where("alike and sig <> first_sig").select(F.col("first_sig").alias("a"), F.col("sig").alias("b")))
        # labels that members like the first have are one with it now: at most as many as there were rounds
        merged = met.where("alike and label is not null").groupBy("path").agg(F.collect_set("label").alias("labels"))
        salted = merged.select("path", "labels", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        met = met.withColumn("part", F.pmod(F.xxhash64("sig", F.lit(7)), F.lit(parts)).cast("int")).join(salted, ["path", "part"], "left")
        label = F.when(F.col("alike") | F.coalesce(F.array_contains("labels", F.col("label")), F.lit(False)), F.col("first_sig")).otherwise(F.col("label"))
        nodes = written(met.select("path", "vals", "sig", label.alias("label")).mapInArrow(branch, _NODE), "nodes")
        # a node whose members all have one label has nothing left to compare
        found = nodes.groupBy("path").agg(F.count("*").alias("count"), F.count("label").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
        found = written(found.where("n < count or low <> high").select("path", "count"), "open-nodes")
        nodes = nodes.join(found.select("path"), "path", "left_semi")
        large = written(found.where(F.col("count") > local_rows), "large-nodes")
    edges = links[0]
    for found in links[1:]:
        edges = edges.unionByName(found)
    linked = _components(edges)
    return signed.select("did", "uid", "sig").join(linked, F.col("sig") == F.col("id"), "left").select("did", "uid", F.coalesce("group", "sig").alias("set"))


def duplicates(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """did, uid, rank and n of every document that is in a group: rank 1 stays, others go; n is the group's rows."""
    grouped = groups(docs, **options)
    sets = grouped.groupBy("set").agg(F.min(F.struct("did", "uid")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return grouped.join(sets, "set").select("did", "uid", "first", "n")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """doc_id, group_id and kept for every document that is an exact or near copy of another.

    Two documents are near copies if their signatures, cut to 8 bits a coordinate, agree
    in at least threshold of the coordinates and the share that chance adds, which
    estimates the Jaccard similarity of their word pairs; a group is what such pairs connect. group_id is the least doc_id of the group, and
    the document that has it is kept: null ids come first, equal ids are told apart
    by a hash of the text, and of repeated rows each has a row here, all kept or none. Null and
    blank texts are in no group; texts of symbols alone are grouped if they are equal. Other columns are not read.
    """
    found = duplicates(docs, **options)
    null = F.lit(-(2**63))
    return found.select(
        F.nullif("did", null).alias("doc_id"),
        F.nullif(F.col("first.did"), null).alias("group_id"),
        (F.struct("did", "uid") == F.col("first")).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """docs, with all columns, with one document of each group (see near_duplicates) and one row of those repeated."""
    keyed, did, uid = with_key(docs)
    found = written(duplicates(docs, **options), "duplicates")
    gone = found.where(F.struct("did", "uid") != F.col("first")).select(F.col("did").alias(did), F.col("uid").alias(uid)).distinct()
    rest = keyed.join(gone, [did, uid], "left_anti")
    twice = found.groupBy(F.col("did").alias(did), F.col("uid").alias(uid)).count().where("count > 1").select(did, uid)
    if twice.isEmpty():
        return rest.drop(did, uid)
    once = rest.join(twice, [did, uid], "left_anti").unionByName(rest.join(twice, [did, uid], "left_semi").dropDuplicates([did, uid]))
    return once.drop(did, uid)
