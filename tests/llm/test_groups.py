"""Operators 3, 7 and 8 and the pipeline against brute force, and on awkward rows."""

from __future__ import annotations

import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import decontaminate, line_dedup, near_dedup, neighbours, pieces, queries, reshard, toxicity
from tests.llm.test_text_operators import SCHEMA, awkward, brute_lines

SF = "/root/testdata/sf0.001"

# 7. near duplicates


def brute_groups(ids: list[int], texts: list[str], threshold: float) -> dict[int, int]:
    """Least id of each document's group, by comparing all signatures; documents alone are left out."""
    found = near_dedup.signatures(pa.array(texts))
    words = (found != 0xFFFFFFFF).any(axis=1)
    found, least = found.astype(np.uint8), near_dedup.least_agreeing(threshold, found.shape[1])
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if words[i] and words[j] and (found[i] == found[j]).sum() >= least:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    size = Counter(group)
    return {ids[k]: min(ids[m] for m in range(len(ids)) if group[m] == g) for k, g in enumerate(group) if size[g] > 1}


def near_copies(rng: random.Random, n: int) -> list[str]:
    texts = []
    for _ in range(n):
        words = [f"v{rng.randrange(4000)}" for _ in range(rng.randint(40, 160))]
        for _ in range(rng.choice([1, 1, 1, 2, 6])):
            own = list(words)
            for _ in range(rng.randint(0, len(own) // 20)):
                own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return texts


def test_near_duplicates_are_those_of_all_pairs(spark):
    texts = near_copies(random.Random(1), 150)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_groups(list(range(len(texts))), texts, near_dedup.THRESHOLD)
    rows = near_dedup.near_duplicates(docs).collect()
    found = {r.doc_id: r.group_id for r in rows}
    assert len(found) == len(rows)
    assert set(found) <= set(want)
    assert sum(found.get(d) == g for d, g in want.items()) >= 0.97 * len(want)
    assert {r.doc_id for r in rows if r.kept} == set(found.values())
    kept = {r.doc_id for r in near_dedup.without_near_duplicates(docs).collect()}
    assert kept == set(range(len(texts))) - {r.doc_id for r in rows if not r.kept}


def test_large_nodes_branch_across_the_cluster(spark):
    rng = random.Random(2)
    base = [f"b{k}" for k in range(60)]
    texts = near_copies(rng, 40) + [" ".join(base[:-1] + [f"own{k}"]) for k in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_groups(list(range(len(texts))), texts, near_dedup.THRESHOLD)
    for options in ({"local_rows": 20, "small": 8}, {"small": 4}):
        found = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(docs, **options).collect()}
        assert sum(found.get(d) == g for d, g in want.items()) >= 0.97 * len(want)


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_families_in_nodes_larger_than_a_task(spark, monkeypatch, rounds):
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    rng = random.Random(5)
    # three families that share half of their words, so they meet in nodes but are no copies of each other
    shared = [f"s{k}" for k in range(60)]
    texts = []
    for f in range(3):
        own = [f"f{f}w{k}" for k in range(40)]
        for k in range(50):
            words = shared + own
            words[rng.randrange(100)] = f"x{f}y{k}"
            words[rng.randrange(100)] = f"z{f}y{k}"
            texts.append(" ".join(words))
    # and a chain in which only neighbours are near copies
    chain = [f"c{k}" for k in range(260)]
    texts += [" ".join(chain[k * 5 : k * 5 + 100]) for k in range(30)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_groups(list(range(len(texts))), texts, near_dedup.THRESHOLD)
    found = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(docs, local_rows=10, small=4).collect()}
    assert found == want


@pytest.mark.parametrize("rounds", [1, 3])
def test_nodes_still_large_after_the_last_round_are_compared(spark, monkeypatch, rounds):
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds, raising=False)
    base = [f"b{k}" for k in range(80)]
    docs = spark.createDataFrame([(k, " ".join([*base, f"own{k}", f"more{k}"])) for k in range(60)], "doc_id long, text string")
    found = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(docs, local_rows=1, small=8).collect()}
    assert found == dict.fromkeys(range(60), 0)


def test_similarity_is_estimated_right():
    rng = random.Random(3)
    for share in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(30):
            same = [f"s{rng.random()}" for _ in range(int(600 * share))]
            a, b = ([f"{k}{rng.random()}" for _ in range(300 - int(300 * share))] for k in "ab")
            x, y = " ".join(same + a), " ".join(same + b)
            sets = [set(zip(t.split(), t.split()[1:], strict=False)) for t in (x, y)]
            got = near_dedup.signatures(pa.array([x, y]))
            errors.append((got[0] == got[1]).mean() - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
        assert abs(np.mean(errors)) < 0.03


def test_near_duplicates_of_awkward_rows(spark):
    df, rows = awkward(spark, ["one two", "ONE, two!", "one"])
    found = near_dedup.near_duplicates(df).collect()
    by = Counter(r.doc_id for r in found)
    assert by == Counter({4: 2, 5: 1, None: 1, 9: 1, 10: 1})
    assert {r.group_id for r in found if r.doc_id in (9, 10)} == {9}
    kept = near_dedup.without_near_duplicates(df)
    assert kept.columns == df.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter({0: 1, 1: 1, 2: 1, 3: 1, None: 2, 6: 1, 7: 1, 8: 1, 9: 1, 11: 1})
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    assert near_dedup.without_near_duplicates(df.limit(0)).count() == 0


def test_texts_of_symbols_are_grouped_by_their_copies(spark):
    docs = spark.createDataFrame([(1, "!!! ???"), (2, "!!! ???"), (3, "!!! ??"), (4, " "), (5, " "), (6, "words here"), (7, "--- ***")], "doc_id long, text string")
    assert {(r.doc_id, r.group_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()} == {(1, 1, True), (2, 1, False)}
    assert {r.doc_id for r in near_dedup.without_near_duplicates(docs).collect()} == {1, 3, 4, 5, 6, 7}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1040)]
    group = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    found = {r.id: r.group for r in near_dedup._components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found.get(x, x) == g for x, g in group.items())


# 3. nearest neighbours


def brute_neighbours(x: np.ndarray, ids: np.ndarray, k: int) -> dict[int, set[int]]:
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T
    np.fill_diagonal(near, -np.inf)
    return {int(i): set(ids[np.argsort(-row, kind="stable")[:k]].tolist()) for i, row in zip(ids, near, strict=True)}


def test_recall_of_neighbours(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(60, 24))[rng.integers(0, 60, 3000)] + 0.3 * rng.normal(size=(3000, 24))).astype(np.float32)
    ids = rng.permutation(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    rows = neighbours.nearest_neighbours(df, k=10, leaf_rows=120).collect()
    found: dict[int, set[int]] = {}
    for r in rows:
        found.setdefault(r.vec_id, set()).add(r.neighbour_id)
    want = brute_neighbours(x, ids, 10)
    assert len(rows) == 30_000
    assert np.mean([len(found[i] & w) / 10 for i, w in want.items()]) >= 0.9
    points, dim = neighbours.prepare(df)
    tree = neighbours.grow(points, dim, 8, 120)
    leaves = [k for k, c in enumerate(tree.children) if not c]
    assert len(leaves) > 20
    assert neighbours.calibrate(points, tree, dim, 10, 0.96) < len(leaves)
    order = tree.leaves(x[0] / np.linalg.norm(x[0]), 10_000)
    assert sorted(order) == leaves
    small = neighbours.grow(points, dim, 8, fit_rows=320)  # learned from a part, still all are found
    assert 4 < sum(not c for c in small.children) < 60


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_query_goes_through_a_tree_and_keeps_its_recall(spark, sf, monkeypatch):
    folder = f"/root/testdata/{sf}"
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    x = df.toPandas()
    grown, visited = [], []
    grow, calibrate = neighbours.grow, neighbours.calibrate
    monkeypatch.setattr(neighbours, "grow", lambda *a: grown.append(grow(*a)) or grown[-1])
    monkeypatch.setattr(neighbours, "calibrate", lambda *a: visited.append(calibrate(*a)) or visited[-1])
    rows = queries.op3_nearest_neighbours(spark, folder).collect()
    leaves = sum(not c for c in grown[0].children)
    assert leaves > 10
    assert visited[0] < leaves
    want = brute_neighbours(np.stack(x.embedding).astype(float), x.vec_id.to_numpy(), 10)
    found: dict[int, set[int]] = {}
    for r in rows:
        found.setdefault(r.vec_id, set()).add(r.neighbour_id)
    assert set(found) == {i for i in want if i % 100 == 0}
    assert np.mean([len(found[i] & want[i]) / 10 for i in found]) >= 0.9


def test_equal_vectors_and_leaves_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    rows = [(k, [1.0, 0.0, 0.0]) for k in range(300)] + [(1000 + k, [float(k % 7), 1.0, float(k)]) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found: dict[int, list[int]] = {}
    for r in neighbours.nearest_neighbours(df, k=3, recall=1.0, queries="vec_id < 300").orderBy("vec_id", "rank").collect():
        found.setdefault(r.vec_id, []).append(r.neighbour_id)
    assert found == {k: [i for i in range(4) if i != k][:3] for k in range(300)}


def test_awkward_vectors(spark):
    v = [1.0, 2.0]
    rows = [(1, v), (1, v), (2, v), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [None, 1.0]), (None, v), (10, [-1.0, -2.0])]
    df = spark.createDataFrame([(*r, None, "x") for r in rows], "vec_id long, embedding array<float>, label int, rank string")
    found = {(r.vec_id, r.rank): (r.neighbour_id, r.similarity) for r in neighbours.nearest_neighbours(df, k=2).collect()}
    assert found == {
        (1, 1): (2, 1.0), (1, 2): (3, 0.0), (2, 1): (1, 1.0), (2, 2): (3, 0.0),
        (3, 1): (1, 0.0), (3, 2): (2, 0.0), (10, 1): (3, 0.0), (10, 2): (1, -1.0),
    }
    assert neighbours.nearest_neighbours(df.limit(0)).count() == 0


# 8. resharding


def test_flow_moves_least():
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.randint(0, 50) for _ in range(rng.randint(1, 6))]
        room = [rng.randint(0, 60) for _ in range(rng.randint(1, 8))]
        if sum(room) < sum(sizes):
            with pytest.raises(ValueError, match="capacities"):
                reshard.transfers(sizes, room)
            continue
        found = reshard.transfers(sizes, room)
        least = sum(max(0, s - (room[k] if k < len(room) else 0)) for k, s in enumerate(sizes))
        assert sum(n for a, b, n in found if a != b) == least
        assert all(sum(n for _, b, n in found if b == k) <= c for k, c in enumerate(room))
        assert all(sum(n for a, _, n in found if a == k) == s for k, s in enumerate(sizes))
    flow = reshard.Flow(4)  # two ways, the cheap one too narrow
    for edge in ((0, 1, 5, 1), (1, 3, 3, 1), (0, 2, 5, 4), (2, 3, 5, 0), (1, 2, 9, 0)):
        flow.edge(*edge)
    assert flow.run(0, 3) == (8, 3 * 2 + 2 * 1 + 3 * 4)


def test_rewritten_table_is_the_same_and_fits(spark, tmp_path):
    path = str(tmp_path / "t")
    os.makedirs(path)
    rng = random.Random(2)
    columns = ["doc_id", "text", "shard", "Rewritten", "mls_row", "n"]
    total = 0
    for k, n in enumerate((400, 50, 300, 0, 10)):
        rows = [(rng.choice([None, total + i]), rng.choice([None, "", "x" * rng.randint(1, 900)]), "s", None, i, None) for i in range(n)]
        total += n
        table = pa.table({c: pa.array([r[j] for r in rows], pa.int64() if c in ("doc_id", "mls_row", "n") else pa.string()) for j, c in enumerate(columns)})
        pq.write_table(table, f"{path}/part-{k}.parquet", row_group_size=64)
    files, sizes, _ = reshard.plan(spark, path)
    room = [sizes[0] // 2, sizes[1] + 5000, sizes[2], sizes[3] + 200_000]
    before = Counter(map(tuple, spark.read.parquet(path).select(columns).collect()))
    found, out = reshard.reshard(spark, path, room)
    assert found.columns[-2:] == ["shard_", "rewritten_"]
    assert Counter(map(tuple, found.select(columns).collect())) == before
    size = found.select("shard_", reshard._row_bytes(spark.read.parquet(path).schema).alias("b")).groupBy("shard_").agg(F.sum("b").alias("b"))
    assert all(r.b <= room[r.shard_] + 2000 for r in size.collect())
    again = {r.shard_ for r in found.where("not rewritten_").select("shard_").distinct().collect()}
    assert again == {1, 2, 3}
    assert len(files) == 4
    assert os.path.exists(out.removeprefix("file:"))


def test_resharding_awkward_tables(spark, tmp_path):
    df, _ = awkward(spark)
    df.coalesce(1).write.parquet(str(tmp_path / "a"))
    found, _ = reshard.reshard(spark, str(tmp_path / "a"))
    assert Counter(map(tuple, found.select(df.columns).collect())) == Counter(map(tuple, df.collect()))
    df.limit(0).write.parquet(str(tmp_path / "e"))
    assert reshard.reshard(spark, str(tmp_path / "e"))[0].count() == 0
    assert queries.op8_resharding(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


# the pipeline


def test_stages_do_what_the_operators_do(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("toxic").collect()}
    one = stages[0](spark, docs, SF).cache()
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in one.collect()} == set(rows) - bad
    two = stages[1](spark, one, SF).cache()
    want = brute_lines(sorted((r.doc_id, r.text) for r in one.collect()), set())
    want = {k: t for k, t in want.items() if t.strip() or not rows[k].strip()}
    assert {r.doc_id: r.text for r in two.collect()} == want
    assert all(r.n_chars == len(r.text) for r in two.collect())
    three = stages[2](spark, two, SF).cache()
    groups = brute_groups(list(want), list(want.values()), near_dedup.THRESHOLD)
    assert {r.doc_id for r in three.collect()} == {k for k in want if groups.get(k, k) == k}
    four = stages[3](spark, three, SF).cache()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect() if not any(t in r.text for t in items)}
    assert all(s.columns == columns for s in (one, two, three, four))
    model = pieces.PieceModel(open(pieces.MODEL, "rb").read())
    five = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert five == {r.doc_id: model.encode(r.text) for r in four.collect()}


def test_stages_take_awkward_rows(spark):
    df, _ = awkward(spark)
    docs = df.select("doc_id", "text", "LANG", "source", "n_chars", *[c for c in SCHEMA.replace(",", "").split() if c in ("ids", "shard", "mls_uid")])
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, given, SF)
            if name != "sentencepiece":
                assert made.columns == docs.columns
            assert made.count() <= given.count()
    assert decontaminate and line_dedup
