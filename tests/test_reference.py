"""Golden tables, properties and edge cases of the operators outside llm."""

from __future__ import annotations

import itertools
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from marlstone.functions import csv_text, fuzzy, nearest, text
from marlstone.functions.vectors import cosine
from marlstone.models import NATIVE, SimilarityModel
from marlstone.operators import match, metrics, roc, sampling
from marlstone.plans import evaluation, extraction
from marlstone.sources import pages, sinks, tables

R = "row_id long, recommendation string, class string, LOE string"


def rec(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], R)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_id(df):
    return {r.row_id: r for r in df.collect()}


def test_exact_gate_is_by_case_and_lookup_is_not(spark):
    gt = rec(spark, ("abc", "I", "A"), ("ABC", "II", "B"))
    [row] = match.exact_matches(rec(spark, ("ABC", "II", "B")), gt).collect()
    assert (row.matched_text, row.grade_eval, row.level_eval, row.match_score) == ("ABC", False, False, 100.0)


def test_cascade_by_stage(spark):
    gt = rec(spark, ("Give X", "I", "A"), ("x daily give", "I", "B"), ("start the therapy now", "II", "C"), (None, None, None))
    ext = rec(spark, ("give x", "i", "a"), ("give x daily", "I", "C"), ("start therapy the now", "II", None), ("quite unlike", "I", "A"), (None, "I", "A"), ("Give X", None, "A"))
    found = by_id(match.cascade(ext, gt, semantic=lambda a, b: F.when(a.contains("unlike") & b.contains("therapy"), 0.6).otherwise(F.lit(float("nan")))))
    assert (found[0].match_stage, found[0].matched_text, found[0].match_score, found[0].grade_eval) == ("fuzzy", "give x", 100.0, True)
    assert (found[1].match_stage, found[1].match_score, found[1].level_eval) == ("fuzzy", 95.0, False)
    assert found[2].match_stage == "fuzzy"
    assert found[2].level_eval is False
    assert (found[3].match_stage, found[3].matched_text, found[3].match_score) == ("semantic", "start the therapy now", 60.0)
    assert (found[4].match_stage, found[4].matched_text) == ("none", None)
    assert (found[5].match_stage, found[5].grade_eval, found[5].level_eval) == ("exact", False, True)


def test_semantic_threshold_is_inclusive_and_the_first_maximum_wins(spark):
    gt = rec(spark, ("one", "I", "A"), ("two", "II", "B"))
    ext = rec(spark, ("x", "I", "A"))
    for value, stage in ((0.6, "semantic"), (0.599, "none")):
        [row] = match.cascade(ext, gt, semantic=lambda a, b, value=value: F.lit(value)).collect()
        assert row.match_stage == stage
        assert row.matched_text == ("one" if stage == "semantic" else None)


def test_self_evaluation_and_empty_sides(spark):
    gt = rec(spark, ("a b", "I", "A"), ("c d", "II", "B"))
    none = spark.createDataFrame([], R)
    [m] = evaluation.evaluate_extraction(gt, gt).metrics.collect()
    assert tuple(m) == (100.0, 100.0, 100.0, 0)
    [m] = evaluation.evaluate_extraction(none, gt).metrics.collect()
    assert tuple(m) == (None, 0.0, 0.0, 2)
    [m] = evaluation.evaluate_extraction(gt, none).metrics.collect()
    assert tuple(m) == (0.0, 0.0, 0.0, 0)
    lines = [r.line for r in sinks.metric_lines(evaluation.evaluate_extraction(none, gt).metrics).orderBy("pos").collect()]
    assert lines == ["Recommendation accuracy: n/a", "Grade accuracy: 0.00%", "Level accuracy: 0.00%", "Missing recommendations: 2"]


def test_missing_is_a_bag_and_null_safe(spark):
    gt = rec(spark, ("a", "I", "A"), ("a", "I", "A"), (None, "I", "A"), ("b", "I", "A"))
    assert match.missing(gt, rec(spark, ("b", "I", "A"))).count() == 3
    assert match.missing(gt, rec(spark, (None, "I", "A"))).count() == 3


def test_adjudication(spark):
    gt = rec(spark, ("alpha beta", "I", "A"), ("gamma delta", "II", "B"))
    ext = rec(spark, *[("zeta eta", "ii", "B")] * 5)
    chosen = spark.createDataFrame([(0, "0"), (1, "2"), (2, "3"), (3, "x"), (4, "")], "row_id long, choice string")
    found = by_id(match.cascade(ext, gt, adjudications=chosen))
    assert [found[k].match_stage for k in range(5)] == ["manual", "none", "none", "none", "none"]
    assert found[0].manual_validation
    made = sinks.with_sentinels(match.cascade(ext, gt)).collect()
    assert {r.matched_text for r in made} == {"-1"}


def test_lcs_and_weighted_ratio():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert fuzzy.lcs(a, b) == table[-1][-1]
    assert fuzzy.weighted("Give X", "give x") == 100
    assert fuzzy.weighted("give x daily", "x daily give") == 95
    assert fuzzy.weighted("", "a") == fuzzy.weighted(None, "a") == fuzzy.weighted("...", "a") == 0
    assert fuzzy.weighted("abc", "xx abc yy zz ww") == 90


def test_blocked_fuzzy_is_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["patients", "with", "acute", "syndrome", "should", "be", "given", "aspirin", "daily", "dose", "of", "heparin"]
    gt, ext = [], []
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 9))]
        gt.append((" ".join(words), "I", "A"))
        kind = rng.randint(0, 4)
        if kind == 1:
            rng.shuffle(words)
        elif kind == 2:
            words[0] = words[0][:-1]
        elif kind == 3:
            words.append(rng.choice(vocabulary))
        elif kind == 4:
            words = [w.upper() + "!" for w in words]
        ext.append((" ".join(words), "I", "A"))
    e, g = rec(spark, *ext), rec(spark, *gt)
    a = {(r.row_id, r.matched_text, r.match_score) for r in match.fuzzy_matches(e, g).collect()}
    b = {(r.row_id, r.matched_text, r.match_score) for r in match.blocked_fuzzy_matches(e, g).collect()}
    assert a == b
    assert len(a) > 10


def test_roc_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for model, size in (("ties", 60), ("many", 300)):
        rows += [(model, float(rng.randint(0, 6)) if model == "ties" else rng.random(), float(rng.randint(0, 5))) for _ in range(size)]
    rows += [("perfect", float(s), float(s)) for s in range(6)] + [("inverted", float(-s), float(s)) for s in range(6)]
    rows += [("constant", 1.0, float(s)) for s in range(6)] + [("single", float(s), 5.0) for s in range(4)]
    rows += [("ties", float("nan"), 5.0), ("ties", None, 1.0), ("ties", 2.0, None)]
    found = {r.model: r for r in roc.evaluate(spark.createDataFrame(rows, "model string, pred double, score double")).collect()}
    for model in ("ties", "many", "perfect", "inverted", "constant"):
        own = [(p, s >= 3) for m, p, s in rows if m == model and p is not None and s is not None and not math.isnan(p)]
        pos, neg = [p for p, y in own if y], [p for p, y in own if not y]
        auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
        assert found[model].auc == pytest.approx(auc)
        cuts = [math.inf, *{p for p, _ in own}]
        best = max((sum(p >= c for p in pos) / len(pos) - sum(n >= c for n in neg) / len(neg), c) for c in cuts)
        assert found[model].youden_index == best[1]
    assert found["inverted"].youden_index == math.inf
    assert found["single"].auc is None
    assert found["single"].youden_index is None
    assert math.isnan(found["constant"].pearson_correlation)
    assert found["perfect"].pearson_correlation == pytest.approx(1)


@pytest.mark.parametrize("n", [0, 1, 10, 11, 100])
def test_split_sizes(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    parts = {r.split: r["count"] for r in sampling.split_exact(df, "k").groupBy("split").count().collect()}
    held = math.ceil(round(0.3 * n, 9))
    assert parts.get("test", 0) == math.ceil(held / 2)
    assert sum(parts.values()) == n
    assert parts.get("train", 0) == n - held
    assert sampling.sample_exact(df, "k", 0.1).count() == round(n * 0.1)


def test_csv_answers(spark):
    line = "0, 'Adults who have stable angina should take a statin', 'strong recommendation', 'high'"
    assert csv_text.parse_answer(line) == ("ok", [["0", "Adults who have stable angina should take a statin", "strong recommendation", "high"]])
    assert csv_text.parse_answer(line + "\n'\n")[0] == "malformed"
    assert csv_text.parse_answer(line + "\n1, 'a', 'b', 'c', 'd'")[0] == "malformed"
    assert csv_text.parse_answer(line + "\n1, 'a', NA")[1][1] == ["1", "a", None, None]
    assert csv_text.parse_answer("0, 'a', 'b'")[0] == "arity"
    assert csv_text.parse_answer("")[0] == csv_text.parse_answer(None)[0] == "empty"
    assert csv_text.parse_answer("0, 'it''s', 'b', 'c'")[1][0][1] == "it's"
    assert csv_text.parse_answer("0, 'two\nlines', 'b', 'c'")[1][0][1] == "two\nlines"


def test_extraction_keeps_pages(spark):
    docs = spark.createDataFrame([("d", "page one\fpage two\fpage three\fpage four")], "id string, t string")
    paged = pages.page_explode(docs, "id", "t", "\f")
    answers = {"one": "NO Recommendation Found.", "two": tables.BOILERPLATE[0] + "0, 'a', 'b', 'c'" + tables.BOILERPLATE[3], "three": "0, 'a'"}

    def client(prompt: str) -> str:
        return next((a for k, a in answers.items() if prompt.endswith(k)), "0, 'a', 'b', 'c', 'd'\n0, 'a', 'b', 'c', 'd', 'e'")

    rows = extraction.extract(paged, client).orderBy("page").collect()
    assert [(r.page, r.status, r.recommendation) for r in rows] == [(1, "ok", "a"), (2, "arity", None), (3, "malformed", None)]
    [single] = pages.doc_single(paged, "\f").collect()
    assert single.page_content == "page one\fpage two\fpage three\fpage four"
    assert extraction.ask_fields(paged.select("doc", "page_content"), tables.constants(spark, "task", ("a", "b"))).count() == 8


def test_tables_of_pages(spark):
    html = "<p>x</p><table><tr><th>a</th><th>b</th></tr><tr><td>1 &amp; <b>2</b><td>3</tr></table><ul><li>i<li>ii</ul><table></table>"
    assert pages.html_tables_of(html) == [[["a", "b"], ["1 & 2", "3"]], [["i"], ["ii"]]]
    df = spark.createDataFrame([(1, html), (2, None)], "p long, h string")
    assert [(r.table_no, r.row_no, r.cells) for r in pages.extract_tables(df, "p", "h").collect()][2] == (1, 0, ["i"])


def test_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("1\tx\ty\t3.5\n")
    (tmp_path / "a.txt").write_text("2\tx\"q\ty\t1\n")
    (tmp_path / "c.md").write_text("no")
    pairs = tables.read_pairs(spark, str(tmp_path))
    assert [r.score for r in sorted(pairs.collect(), key=lambda r: r.row_id)] == [1.0, 3.5]
    more = spark.createDataFrame([("s", "t", 2.0, "e")], "sentence1 string, sentence2 string, score double, extra string")
    both = evaluation.combine_pairs(pairs, more)
    assert both.count() == 3
    assert {r.extra for r in both.collect()} == {None, "e"}
    (tmp_path / "r.csv").write_text('recommendation,class,LOE,more\n"a, ""b""\nc",1,NA,z\n')
    [row] = tables.read_recommendations(spark, str(tmp_path / "r.csv")).collect()
    assert (row.recommendation, row["class"], row.LOE, row.more) == ('a, "b"\nc', "1", None, "z")
    results, wide = evaluation.evaluate_models(both)
    assert results.count() == 3
    assert set(wide.columns) >= {"edit_ratio", "token_jaccard", "weighted_ratio"}
    sinks.write_model_results(results, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/similarity_model_evaluation_results.csv"), header=True).count() == 3
    assert tables.model_names(spark).count() == 11


def test_row_ids_follow_the_order(spark):
    df = spark.createDataFrame([(k % 7, str(k)) for k in range(50)] + [(None, "x")], "a long, b string").repartition(5)
    rows = sorted(tables.with_row_id(df, "a", "b").collect(), key=lambda r: r.row_id)
    assert [(r.a, r.b) for r in rows] == sorted(((r.a, r.b) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert len({r.row_id for r in rows}) == 51


def test_embedding_models(spark):
    import pandas as pd

    pairs = spark.createDataFrame([(0, "aab", "aab", 5.0), (1, "ab", "ba", 4.0), (2, "aa", "bb", 0.0), (3, None, "b", 0.0)], "row_id long, sentence1 string, sentence2 string, score double")

    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(t.count("a")), float(t.count("b"))] for t in texts])

    model = SimilarityModel("counts", embed=encode, prompts={"A": "a"})
    found = {r.row_id: r.pred for r in model.add_to(pairs).collect()}
    assert found[0] == pytest.approx(1)
    assert found[1] == pytest.approx(1)
    assert found[2] == 0
    assert found[3] is None
    assert {r.row_id: r.pred for r in model.with_prompt("A").add_to(pairs).collect()}[2] > 0
    trained = []
    can = SimilarityModel("can", NATIVE[0].score, train=lambda a, b: trained.append((a.columns, b.columns)) or NATIVE[0])
    results, _ = evaluation.evaluate_models(pairs, (can, NATIVE[1]), retrain=True)
    assert all(r.retrained for r in results.collect())
    assert trained == [(["text1", "text2", "label"],) * 2]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    found = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert found[:2] == [0, pytest.approx(1)]
    assert found[2:] == [None, None]


def test_nearest_vectors_are_those_of_the_expression(spark):
    rng = random.Random(5)
    rows = [(k, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for k in range(90)] + [(90, None), (91, [1.0]), (92, [float("nan")] * 4)]
    v = spark.createDataFrame(rows, "id long, v array<float>")
    want = {(r.query_id, round(r.sim, 9)) for r in match.vector_argmax(v, v, cosine).collect()}
    for size in (7, 2048):
        assert {(r.query_id, round(r.sim, 9)) for r in match.nearest_vectors(v, v, size).collect()} == want


def test_nearest_vectors_tell_equal_similarities_as_the_sql_does(spark):
    rng = np.random.default_rng(6)
    some = rng.normal(size=(20, 9))
    x = np.concatenate([some, some * 3, -some, some[:6], np.tile(some[7], (12, 1))]).astype(np.float32)
    rows = [(k, [float(e) for e in v]) for k, v in enumerate(x[rng.permutation(len(x))])]

    def sim(a, b):
        dot = squares = others = 0.0
        for p, q in zip(a, b, strict=True):
            dot, squares, others = dot + p * q, squares + p * p, others + q * q
        return max(-1.0, min(dot / math.sqrt(squares * others), 1.0))

    want = {(k, *max(((sim(v, w), -n) for n, w in rows if n != k))) for k, v in rows}
    for kind in ("float", "double"):
        v = spark.createDataFrame(rows, f"id long, v array<{kind}>")
        for data, size in ((v, 30), (v.select("id", "v"), 30), (v, 2048)):
            assert {(r.query_id, r.sim, -r.best_id) for r in match.nearest_vectors(v, data, size).collect()} == want
    tiny = spark.createDataFrame([(0, [1e-200, 0.0]), (1, [3e-200, 3e-200]), (2, [1e200, -2e200]), (3, [float("inf"), 1.0])], "id long, v array<double>")
    assert {(r.query_id, r.best_id, round(r.sim, 6)) for r in match.nearest_vectors(tiny, tiny).collect()} == {(0, 1, 0.707107), (1, 0, 0.707107), (2, 0, 0.447214)}


def test_blocks_of_one_table_meet_once_for_both_directions(spark):
    rng = np.random.default_rng(7)
    v = spark.createDataFrame([(k, [float(e) for e in x]) for k, x in enumerate(rng.normal(size=(60, 3)))], "id long, v array<float>")
    found = match.nearest_vectors(v, v, 20)
    [join] = [line for line in plan_of(found).splitlines() if "Cartesian" in line]
    assert "<=" in join  # each pair of blocks in one order only
    asked = match.nearest_vectors(v.where("id < 30"), v, 20).collect()
    assert {tuple(r) for r in asked} == {tuple(r) for r in found.where("query_id < 30").collect()}


def test_equal_vectors_are_compared_as_two(monkeypatch):
    x = np.concatenate([np.tile(np.ones(4, np.float32), (3000, 1)), np.eye(4, dtype=np.float32)])
    ids = np.append(np.arange(3000), [7000, 7001, 7002, 7003])[::-1]
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x[::-1].ravel()), 4).cast(pa.list_(pa.float32()))
    block = nearest.sides(*nearest.pack(pa.array(ids), lists), 4, np.float32)
    assert [len(side) for side in block] == [6, 2998]
    computed = []
    dots = nearest._dots
    monkeypatch.setattr(nearest, "_dots", lambda a, b: computed.append(len(a)) or dots(a, b))
    found = {q: (b, s) for part in nearest.compare(block, block, True, False) for q, b, s in zip(*part, strict=True)}
    assert found == {0: (1, 1.0), **{k: (0, 1.0) for k in range(1, 3000)}, **{k: (0, 0.5) for k in ids[:4].tolist()}}
    assert sum(computed) < 3 * len(ids)


def test_vectors_of_one_block_meet_once_for_both_directions(monkeypatch):
    rng = np.random.default_rng(9)
    some = rng.normal(size=(2500, 8)).astype(np.float32)
    x = np.concatenate([some, some * 3, some[:1500] * -5])[rng.permutation(6500)]
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 8).cast(pa.list_(pa.float32()))
    block = nearest.sides(*nearest.pack(pa.array(np.arange(len(x))), lists), 8, np.float32)
    products, product = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b, **how: products.append(len(a) * b.shape[1]) or product(a, b, **how))
    found = {}
    for part in nearest.compare(block, block, True, True):
        for q, b, s in zip(*(c.tolist() for c in part), strict=True):
            found[q] = min(found.get(q, (2.0, 0)), (-s, b))
    assert sum(products) < 0.8 * len(x) ** 2  # those multiplied again for the nearest among them
    squares = nearest._squares(x)
    for q in rng.choice(len(x), 300, replace=False).tolist():
        sims = np.clip(nearest._dots(np.tile(x[q], (len(x), 1)), x) / np.sqrt(squares[q] * squares), -1.0, 1.0)
        sims[q] = -np.inf
        assert found[q] == (-sims.max(), sims.argmax())


def test_semantic_threshold_is_that_of_the_sql_among_equal_similarities(spark, tmp_path):
    rng = np.random.default_rng(8)
    some = rng.normal(size=(40, 8))
    x = np.concatenate([some, some * 3, some * 7, some * -5]).astype(np.float32)
    table = spark.createDataFrame([(k, [float(e) for e in v]) for k, v in enumerate(x[rng.permutation(len(x))])], "vec_id long, embedding array<float>")
    table.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    query = __spark_entry__.queries()["semantic_threshold"](spark, str(tmp_path))
    [join] = [line for line in plan_of(query).splitlines() if "Cartesian" in line]
    assert "<=" in join  # the step's blocks meet once
    sql = __spark_entry__.oracle_sql()["semantic_threshold"]
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        assert sorted(map(tuple, query.collect())) == sorted(db.sql(sql).fetchall())


def test_choices(spark):
    df = spark.createDataFrame([("0",), ("9",), ("10",), ("11",), ("x",), ("",), (None,), ("99999999999999999999",)], "c string")
    kinds = [r[0] for r in df.select(text.choice_kind(F.col("c"), F.lit(10))).collect()]
    assert kinds == ["accept", "accept", "none", "invalid", "invalid", "invalid", "invalid", "invalid"]


def test_accuracy_of_nothing_matched(spark):
    [row] = metrics.accuracies(match.unmatched(rec(spark, ("a", "I", "A")))).collect()
    assert (row.accuracy_recommendation, row.accuracy_grade, row.accuracy_level) == (0.0, 0.0, 0.0)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_remarks_go_only_where_they_stand_word_by_word(spark):
    between = "\nNote that some recommendations are conditional, see below\n0, 'keep me', 'strong', 'high'\nLow confidence in estimates of effect."
    df = spark.createDataFrame([(between,), (f"a{tables.BOILERPLATE[2]}b{tables.BOILERPLATE[1]}c",), (None,)], "t string")
    assert [r[0] for r in df.select(text.strip_literals(F.col("t"))).collect()] == [between, "abc", None]


def test_none_of_the_candidates_is_a_judgement(spark):
    gt = rec(spark, ("start the therapy now", "II", "C"), ("give x daily", "I", "A"))
    ext = rec(spark, ("quite unlike", "I", "A"), ("quite unlike it", "I", "A"), ("very unlike", "I", "A"), ("not judged", "I", "A"))
    chosen = spark.createDataFrame([(0, "2"), (1, "7"), (2, "1")], "row_id long, choice string")
    found = by_id(match.cascade(ext, gt, adjudications=chosen))
    assert {k: (r.match_stage, r.manual_validation) for k, r in found.items()} == {0: ("none", True), 1: ("none", False), 2: ("manual", True), 3: ("none", False)}
    assert found[0].matched_text is None
    assert found[0].match_score is None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scorers_with_candidates_lose_no_match(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["", "treatment", "of"]
    make = lambda n: [(" ".join(rng.choices(words, k=rng.randint(1, 9))) + rng.choice(["", "x" * 30]), "I", "A") for _ in range(n)]
    gt = make(60)
    ext = [(t[: rng.randint(1, len(t) + 1)] + t[-rng.randint(1, 5) :] if rng.random() < 0.5 else t, c, e) for t, c, e in rng.choices(gt, k=50)] + make(20) + [("", "I", "A"), (None, "I", "A")]
    e, g = rec(spark, *ext), rec(spark, *gt, (None, "I", "A"), ("", "I", "A"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    for threshold in (60, 80, 95):
        want = rows(match.fuzzy_matches(e, g, lambda a, b: fuzzy.edit_ratio(a, b), threshold))
        assert rows(match.fuzzy_matches(e, g, fuzzy.edit_ratio, threshold)) == want
        assert want
    for threshold in (0.3, 0.6, 1.0):
        want = rows(match.semantic_matches(e, g, lambda a, b: fuzzy.token_jaccard(a, b), threshold))
        assert rows(match.semantic_matches(e, g, fuzzy.token_jaccard, threshold)) == want
        assert want


def test_cascade_makes_no_product_of_all_texts(spark):
    gt = rec(spark, *((f"take {k} pills", "I", "A") for k in range(30)))
    for scorer in (fuzzy.weighted_ratio, fuzzy.edit_ratio):
        plan = match.cascade(gt, gt, scorer, fuzzy.token_jaccard)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
        assert "NestedLoop" not in plan


def test_containing_is_containing(spark):
    rng = random.Random(4)
    bits = ["a", "b", "cc", "d\ne", "", "fgh"]
    docs = [(k, rng.choice([None, "", " ".join(rng.choices(bits, k=rng.randint(0, 25)))])) for k in range(150)]
    items = [(k, " ".join(rng.choices(bits, k=rng.randint(1, 5)))) for k in range(30)] + [(90, None), (91, ""), (92, "h a b"), (93, "zz zz zz")]
    found = match.containing(spark.createDataFrame(docs, "k long, t string"), "k", "t", spark.createDataFrame(items, "i long, t string"), "i", "t")
    assert {tuple(r) for r in found.collect()} == {(k, i) for k, t in docs for i, x in items if t is not None and x is not None and x in t}
    assert found.columns == ["k", "i"]


def test_entry_works_without_what_the_optional_folder_imports():
    import subprocess
    import sys

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; assert 'cascade_match' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    made = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=False)
    assert made.returncode == 0, made.stderr
