"""Operators 1, 2, 4, 5, 9 and 10 against brute force, on awkward rows, and over a driver table."""

from __future__ import annotations

import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from marlstone.llm import decontaminate, licenses, line_dedup, pieces, queries, token_counts, toxicity
from marlstone.llm.common import normal

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, LANG string, source string, n_chars long, ids string, round_trip string, shard int, mls_uid string"


def awkward(spark, extra=()):
    """Nulls in every column, empty and long texts, repeated rows, names that operators use themselves."""
    long = " ".join(f"w{k % 977} word" for k in range(60_000))
    texts = [None, "", "   ", "\n\n", "a", "a", "Ünïcode ﬁ ① 日本 ▁ \x00 tab\t", "x" * 50_000, long, *extra]
    rows = [(k, t, None, None, None, "i", "r", 1, "u") for k, t in enumerate(texts)]
    rows += [rows[4], (None, "a", "en", "s", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


# 1. token counts


def greedy(word: bytes, vocabulary: set[bytes]) -> int:
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary and (word[at] == 32) == (at == 0)), 0)
        if not end:
            return 1
        at, n = end, n + 1
    return n


def test_longest_match_is_greedy():
    rng = random.Random(1)
    for _ in range(60):
        vocabulary = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 14))}
        vocabulary |= {b" " + v for v in list(vocabulary)[::2]} | ({b" "} if rng.random() < 0.5 else set())
        automaton = token_counts.LongestMatch(sorted(vocabulary))
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(80)]
        want = [greedy(b" " + w.encode(), vocabulary) if w else 0 for w in words]
        assert automaton.counts(pa.array(words)).tolist() == want
        assert [automaton.one(b" " + w.encode()) for w in words if w] == [x for x, w in zip(want, words, strict=True) if w]


def test_token_counts_of_a_table(spark):
    df, rows = awkward(spark)
    vocabulary = set(token_counts.byte_vocabulary())
    found = token_counts.token_counts(df).collect()
    assert len(found) == len(rows)
    memo: dict[str, int] = {}

    def count(text):
        return sum(memo.setdefault(w, greedy(b" " + w.encode(), vocabulary)) for w in text.split())

    want = Counter((r[0], None if r[1] is None else len(r[1].split()), None if r[1] is None else count(r[1])) for r in rows if r[0] != 7)
    assert Counter(map(tuple, (f for f in found if f.doc_id != 7))) == want
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op1_token_counts(spark, SF).collect():
        assert (r.n_words, r.n_tokens) == (len(docs[r.doc_id].split()), count(docs[r.doc_id]))


# 9. SentencePiece


def test_pieces_are_the_librarys():
    model = pieces.PieceModel(open(pieces.MODEL, "rb").read())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(5)
    parts = ["a", "b", "th", "e", "er", "ing", " ", "  ", "\n", "é", "日本", "①", "\t", "x", "▁", "Th", "tion", "0", "1", ".", ",", "!!", "́"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert model.encode(text) == library.encode(text)
        assert model.decode(model.encode(text)) == library.decode(library.encode(text))


def test_pairs_fit_as_arrays_and_alone():
    model = pieces.PieceModel(open(pieces.MODEL, "rb").read())
    rng = np.random.default_rng(2)
    live = np.array([i for i in model.ids.values() if model.pieces[i].isascii()])
    a, b = rng.choice(live, 4000), rng.choice(live, 4000)
    assert model._fit(a, b).tolist() == [model.compatible(int(x), int(y)) for x, y in zip(a, b, strict=True)]


def test_encoding_a_table_and_back(spark):
    df, rows = awkward(spark, ["a  b", " lead", "trail ", "line\n\nline", "\n", "one\ntwo three\n four"])
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    made = pieces.encode(df)
    found = made.collect()
    want = Counter((r[0], None if r[1] is None else tuple(library.encode(r[1]))) for r in rows)
    assert Counter((f.doc_id, None if f.ids is None else tuple(f.ids)) for f in found) == want
    for f in found:
        text = next(r[1] for r in rows if r[0] == f.doc_id and (f.ids is None) == (r[1] is None))
        assert f.round_trip == (None if text is None else "▁" not in text)
        assert f.n_ids == (None if text is None else len(f.ids))
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for f in pieces.decode(made).collect():
        if f.doc_id is not None:
            assert f.decoded_text == (texts[f.doc_id].replace("▁", " ") if texts[f.doc_id] is not None else None)
    assert pieces.encode(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op9_sentencepiece(spark, SF).collect():
        assert r.ids == library.encode(docs[r.doc_id])
        assert r.round_trip


# 2. toxicity


def test_toxicity_learns_from_confirmed_and_unlabelled_rows(spark):
    rng = random.Random(4)
    common = [f"word{k}" for k in range(300)]
    bad = ["grumfle", "zoggish", "blarney"]

    def doc(toxic: bool) -> str:
        words = rng.choices(common, k=80)
        for _ in range(3 * toxic):
            words[rng.randrange(80)] = rng.choice(bad) + rng.choice(["", "s", "ed"])
        return " ".join(words)

    truth = [rng.random() < 0.15 for _ in range(900)]
    docs = spark.createDataFrame([(k, doc(t)) for k, t in enumerate(truth)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(t)) for k, t in enumerate(truth[:500])], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert 0.08 < model.prior < 0.25
    found = {r.doc_id: r.toxic for r in toxicity.score(docs, model).collect()}
    held = range(500, 900)
    assert np.mean([found[k] for k in held if truth[k]]) > 0.9
    assert np.mean([found[k] for k in held if not truth[k]]) < 0.03
    df, rows = awkward(spark, ["grumfle zoggish blarney grumfles"])
    scored = toxicity.score(df, model).collect()
    assert len(scored) == len(rows)
    assert all(s.score is None and not s.toxic for s in scored if s.doc_id == 0)
    assert [s.toxic for s in scored if s.doc_id == 9] == [True]
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns
    assert kept.count() == len(rows) - sum(s.toxic for s in scored)
    none = labels.where("toxic = 2")
    assert toxicity.fit(docs, none) is None
    assert toxicity.without_toxic(df, None).count() == len(rows)
    assert not any(r.toxic for r in toxicity.score(df, None).collect())
    assert toxicity.score(df.limit(0), model).count() == 0


def test_risk_and_its_slope_are_the_definitions():
    rng = np.random.default_rng(3)

    def brute(g, positive, prior):
        loss = lambda z: 1 / (1 + math.exp(z))
        p, u = [x for x, y in zip(g, positive, strict=True) if y], [x for x, y in zip(g, positive, strict=True) if not y]
        mean = lambda xs: sum(xs) / len(xs)
        return prior * mean([loss(x) for x in p]), mean([loss(-x) for x in u]) - prior * mean([loss(-x) for x in p])

    kinds = set()
    for shift in (-2.0, 0.0, 2.0):
        positive = np.array([True] * 7 + [False] * 12)
        g = rng.normal(size=19) + np.where(positive, -shift, shift) * 2
        for prior in (0.1, 0.5):
            value, slope = toxicity.risk(g, positive, prior)
            of_p, negative = brute(g, positive, prior)
            kinds.add(negative >= 0)
            assert value == pytest.approx(of_p + max(0.0, negative))
            for k in range(19):
                step = np.zeros(19)
                step[k] = 1e-6
                (a, b), (c, d) = brute(g + step, positive, prior), brute(g - step, positive, prior)
                want = (a + b - c - d) / 2e-6 if negative >= 0 else -(b - d) / 2e-6
                assert slope[k] == pytest.approx(want, abs=1e-6)
    assert kinds == {True, False}


def test_scores_are_sums_over_features():
    rng = random.Random(13)
    weights = np.zeros((1 << toxicity.BITS) + 1, np.float32)
    words = [f"{rng.choice('abc')}{rng.choice('xyz')}{k % 9}tail{k}" for k in range(60)]
    for row in toxicity._features(words[:30]):
        weights[row] = rng.uniform(-1, 1)
    weights[1 << toxicity.BITS] = 0
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(50)]
    got = toxicity._scores(pa.array(texts), weights, 0.25)
    for text, score in zip(texts, got, strict=True):
        own = Counter(int(f) for w in set(text.split()) for f in toxicity._features([w])[0] if f < 1 << toxicity.BITS)
        assert score == pytest.approx(0.25 + sum(float(weights[f]) * math.log1p(n) for f, n in own.items()), abs=1e-5)


def test_scores_are_of_whole_texts():
    weights = np.zeros((1 << toxicity.BITS) + 1, np.float32)
    weights[toxicity._features(["grumfle"])[0, 0]] = 2.0
    texts = ["grumfle", "clean", "", "w " * 40_000 + "GRUMFLE!", None]
    assert np.allclose(toxicity._scores(pa.array(texts), weights, -1.0), [2 * np.log(2) - 1, -1, -1, 2 * np.log(2) - 1, -1])


# 4. licences


def notices(words: list[str], template: licenses.Template, slack: int) -> set[int]:
    """Where notices begin, trying every position."""
    phrases = [licenses.phrase_words(p) for p in template.phrases]

    def ends(at: int, k: int) -> bool:
        if k == len(phrases):
            return True
        reach = [at] if k == 0 else range(at, at + slack + 1)
        return any(words[s : s + len(phrases[k])] == phrases[k] and ends(s + len(phrases[k]), k + 1) for s in reach)

    return {s for s in range(len(words)) if ends(s, 0)}


def test_license_scan_is_brute_force(spark):
    rng = random.Random(6)
    templates = (licenses.Template("A", ("under the X License", "no warranty")), licenses.Template("B", ("the X License",)), licenses.Template("A", ("free software",)), licenses.Template("none", ("...",)))
    bits = ["under", "the", "X", "License,", "no", "Warranty.", "free", "software", "other", "\n", "LICENSE"]
    texts = [" ".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(150)]
    texts += ["under the x license " + "other " * 12 + "no warranty", "under the x license " + "other " * 13 + "no warranty", None, ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    want = set()
    for k, t in enumerate(texts):
        words = [n for w in (t or "").split() if (n := normal(w))]
        for name in ("A", "B"):
            begins = set().union(*(notices(words, x, licenses.SLACK) for x in templates if x.license == name))
            if begins:
                want.add((k, name, min(begins), len(begins)))
    assert {tuple(r) for r in licenses.scan(docs, templates).collect()} == want
    df, _ = awkward(spark, ["Released under the MIT License."])
    assert [tuple(r) for r in licenses.scan(df).collect()] == [(9, "MIT", 1, 1)]
    assert licenses.scan(df.limit(0)).count() == 0


# 5. decontamination


def test_wand_finds_what_a_full_scan_finds():
    rng = random.Random(7)
    words = [f"t{k}" for k in range(400)]
    items = [decontaminate.Item(k, rng.choices(words, weights=[1 / (i + 1) for i in range(400)], k=rng.randint(5, 150)), 3) for k in range(300)]
    index = decontaminate.Index(items)
    for _ in range(100):
        own = rng.choice([words for item in items for words in decontaminate.parts(item)])
        query = sorted({index.terms[w] for w in rng.sample(own, max(1, len(own) * 2 // 3)) + rng.choices(list(index.terms), k=20)})
        for least in (0.1, 0.4, 0.7):
            sums: Counter[int] = Counter()
            for t in query:
                for d, x in zip(index.docs[t], index.impacts[t], strict=True):
                    sums[d] += x
            assert {d for d, _ in index.retrieve(query, least)} == {d for d, x in sums.items() if x >= least - 1e-9}
            able = index.passages(np.array(query), np.array([0, len(query)]), least) if len(query) <= decontaminate.PASSAGE else None
            if able is not None and any(x >= least for x in sums.values()):
                assert [(row, sorted(p)) for row, p in able] == [(0, query)]


def test_leaks(spark):
    item = "Which river flows through the old town of Brumfeld in spring? The river named Ostra flows there."
    single = "An item of one sentence only that has quite a few words"
    long = " ".join(f"long{k} item{k % 7}" for k in range(200)) + ". The answer is forty two of them."
    bench = spark.createDataFrame([(1, item), (2, single), (3, long), (4, None), (5, ""), (None, "x y"), (6, item)], "item_id long, text string")
    filler = " ".join(f"f{k}" for k in range(700))
    texts = [item, filler + " " + item.upper() + " " + filler, item.split("?")[0], filler, "before " + single + " after", filler + long + filler, None, "", item]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(8, item)], "doc_id long, text string")
    found = Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect())
    assert found == Counter({(0, 1): 1, (0, 6): 1, (1, 1): 1, (1, 6): 1, (4, 2): 1, (5, 3): 1, (8, 1): 2, (8, 6): 2})
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()) == [2, 3, 6, 7]
    df, rows = awkward(spark, [item])
    kept = decontaminate.without_leaks(df, bench)
    assert kept.columns == df.columns
    assert kept.count() == len(rows) - 1
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.leaks(df.limit(0), bench).count() == 0


def test_an_index_in_parts_finds_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    text = {r.item_id: r.text for r in bench.collect()}
    assert whole == {(d.doc_id, k) for d in docs.collect() for k, t in text.items() if t in d.text}
    scores = Counter(map(tuple, decontaminate.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 2000)
    assert sum(1 for _ in decontaminate._indexes(bench, 0.5)) > 2
    assert Counter(map(tuple, decontaminate.leaks(docs, bench).collect())) == scores


@pytest.mark.parametrize("share", [0.08, 0.15])
def test_passages_of_common_words_are_found_in_chunks_of_any_size(share):
    rng = random.Random(12)
    words = [f"t{k}" for k in range(60)]
    items = [decontaminate.Item(k, rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=40), 30) for k in range(400)]
    index = decontaminate.Index(items, share)
    text = [" ".join(rng.sample(words[:8], 5)) for _ in range(40)]
    few = list(decontaminate._leaks(index, pa.array(text), share, 0.0, 0.0))
    assert few
    filler = ["t59 " * 130] * 3000  # passages by ranges of items: more than 2**19
    many = list(decontaminate._leaks(index, pa.array(filler + text), share, 0.0, 0.0))
    assert [(row - 3000, *rest) for row, *rest in many if row >= 3000] == few
    want = set()
    for row, t in enumerate(text):
        for e, k in enumerate(index.item_of):
            s = sum(x for w in set(t.split()) for d, x in zip(index.docs[index.terms[w]], index.impacts[index.terms[w]], strict=True) if d == e) if set(t.split()) <= set(index.terms) else 0
            if s >= share:
                want.add((row, k))
    assert {(row, k) for row, k, *_ in few} == want


# 10. line dedup


def brute_lines(docs: list[tuple[int, str | None]], seen: set[str]) -> dict[int, str | None]:
    out = {}
    for k, t in docs:
        kept = []
        for line in t.split("\n") if t is not None else []:
            if not line.strip() or line not in seen:
                kept.append(line)
            seen.add(line)
        out[k] = None if t is None else "\n".join(kept)
    return out


def random_docs(rng: random.Random, low: int, n: int) -> list[tuple[int, str | None]]:
    lines = ["", "  ", "one", "two", "three", "one ", "ONE", *(f"line {k}" for k in range(12))]
    return [(k, None if rng.random() < 0.05 else "\n".join(rng.choices(lines, k=rng.randint(0, 9)))) for k in range(low, low + n)]


def test_lines_come_and_go(spark):
    rng = random.Random(8)
    first, second = random_docs(rng, 0, 40), random_docs(rng, 100, 40)
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    store = line_dedup.LineStore(spark, shard_lines=8)
    seen: set[str] = set()
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(make(first), store).collect()} == brute_lines(first, seen)
    before = sorted(map(tuple, store.counts().collect()))
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(make(second), store).collect()} == brute_lines(second, seen)
    after = sorted(map(tuple, store.counts().collect()))
    line_dedup.dedup_lines(make(second[:5]), store).collect()  # they are there: nothing changes
    assert sorted(map(tuple, store.counts().collect())) == after
    store.delete(make(second))
    assert sorted(map(tuple, store.counts().collect())) == before
    again: set[str] = set()
    brute_lines(first, again)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(make(second), store).collect()} == brute_lines(second, again)
    store.delete(make(first))
    drops = {(r.did, r.pos) for r in store.drops().collect()}
    want = set()
    owners: set[str] = set()
    for k, t in second:
        for pos, line in enumerate(t.split("\n") if t else []):
            if line.strip() and line in owners:
                want.add((k, pos))
            owners.add(line)
    assert drops == want


def test_a_store_is_opened_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(line_dedup, "MERGE", 3)
    rng = random.Random(9)
    path, seen = f"file://{tmp_path}/store", set()
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    given = []
    for k in range(5):
        batch = random_docs(rng, 100 * k, 12) + [(100 * k + 50, f"only {k}\n" + "\n".join(f"{k}:{i}" for i in range(40)))]
        given += batch
        store = line_dedup.LineStore(spark, path, shard_lines=16)  # each time from the folder
        assert store.batch == k
        assert {r.doc_id: r.text for r in line_dedup.dedup_lines(make(batch), store).collect()} == brute_lines(batch, seen)
    assert store.shards >= 8
    count = Counter(line for _, t in given for line in (t or "").split("\n") if line.strip())
    assert sorted(r.n for r in store.counts().collect()) == sorted(count.values())
    # all that is there is in the filters, and little else
    lines = store.lines().select("h1", "h2").distinct()
    assert store._known(lines).count() == lines.count()
    os.makedirs(f"{tmp_path}/store/docs-6/half")  # as if a batch had ended before its record was written
    store = line_dedup.LineStore(spark, path, shard_lines=16)
    store.delete(make(given[:13]))
    assert line_dedup.LineStore(spark, path).batch == 6
    gone = lines.join(line_dedup.LineStore(spark, path).counts(), ["h1", "h2"], "left_anti")
    left = line_dedup.LineStore(spark, path)
    assert gone.count() >= 41
    assert left._known(gone).count() <= 2
    kept = Counter(line for _, t in given[13:] for line in (t or "").split("\n") if line.strip())
    assert sorted(r.n for r in left.counts().collect()) == sorted(kept.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_line_query_is_brute_force(spark, seed):
    docs = random_docs(random.Random(seed), 0, 90)
    found = line_dedup.maintained(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id % 2 <> 0", "doc_id % 4 = 0").collect()
    order = sorted(docs, key=lambda d: (3 if d[0] % 4 == 0 else 2 if d[0] % 2 else 1, d[0]))
    assert {r.doc_id: r.text for r in found} == brute_lines(order, set())
    df, rows = awkward(spark, ["keep\nshared", "shared\nkeep", "shared\n\n"])
    assert line_dedup.maintained(df, "doc_id > 5", "doc_id % 2 = 0").count() == len(rows)
    assert line_dedup.maintained(df.limit(0), "doc_id > 5", "doc_id % 2 = 0").count() == 0


def test_line_dedup_of_awkward_rows(spark):
    df, rows = awkward(spark, ["keep\nshared", "shared\nkeep", "shared\n\n"])
    found = line_dedup.dedup_lines(df).collect()
    assert len(found) == len(rows)
    text = {r.doc_id: r.text for r in found if r.doc_id is not None}
    assert (text[0], text[1], text[3], text[9], text[10], text[11]) == (None, "", "\n\n", "keep\nshared", "", "\n")
    kept = line_dedup.without_repeated_lines(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert {0, 1, 2, 3, 9} <= set(ids)
    assert not {10, 11} & set(ids)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 5000])
def test_cuckoo_filter(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, n)), rng.integers(-(2**63), 2**63 - 1, (2, 20_000))
    made = line_dedup.CuckooFilter(n)
    assert made.insert(a[0], a[1])
    assert made.contains(a[0], a[1]).all()
    assert made.contains(b[0], b[1]).mean() < 0.01
    made = line_dedup.CuckooFilter.of(made.data())
    half = n // 2
    made.delete(a[0, :half], a[1, :half])
    assert made.contains(a[0, half:], a[1, half:]).all()
    made.delete(a[0, half:], a[1, half:])
    assert not made.table.any()


def test_a_filter_that_is_too_full_says_so():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**62, (2, 100))
    assert not line_dedup.CuckooFilter(0).insert(h[0], h[1])
