from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import ngram_lm, queries
from marlstone.llm.common import normal
from tests.llm.test_text_operators import awkward

TEXTS = [
    "The cat sat on the mat. The cat ran.",
    "the dog sat on the mat and the cat sat on the dog",
    "a cat, a dog; a mat!",
    "the cat sat",
    "ran ran ran ran",
    "the dog sat on a mat and the dog ran",
    "on the mat the cat sat on the mat the cat sat",
    "",
    None,
    " ... ",
    "the cat sat on the mat",
    "the cat sat on the mat",
]


def words(text: str | None) -> list[str]:
    return [n for w in (text or "").split() if (n := normal(w))]


def kinds(counts: list[int]) -> tuple[float, float, float]:
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    return ngram_lm.discounts(n)


class Brute:
    """The model with dictionaries, straight from its definition."""

    def __init__(self, texts: list[str | None]) -> None:
        tri: Counter[tuple[str, str, str]] = Counter()
        for text in texts:
            if w := words(text):
                s = ["<s>", "<s>", *w, "</s>"]
                tri.update(zip(s, s[1:], s[2:], strict=False))
        bi = Counter((v, w) for _, v, w in tri)
        uni = Counter(w for _, w in bi)
        self.levels = []
        for counts in (tri, bi, {(w,): c for w, c in uni.items()}):
            d = [0.0, *kinds(list(counts.values()))]
            total: dict[tuple[str, ...], int] = defaultdict(int)
            kept: dict[tuple[str, ...], float] = defaultdict(float)
            share: dict[tuple[str, ...], float] = {}
            for g, c in counts.items():
                total[g[:-1]] += c
            for g, c in counts.items():
                share[g] = (c - d[min(c, 3)]) / total[g[:-1]]
                kept[g[:-1]] += share[g]
            self.levels.append((share, kept, total))
        self.names = sorted({w for t in texts for w in words(t)} | {"</s>", "<unk>"})

    def p(self, *gram: str) -> float:
        base = 1 / len(self.names)
        for (share, kept, _), g in zip(reversed(self.levels), (gram[2:], gram[1:], gram), strict=True):
            base = share.get(g, 0.0) + (1 - kept[g[:-1]]) * base
        return base


def test_same_as_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = ngram_lm.train(docs)
    found = {r.doc_id: r for r in ngram_lm.perplexity(docs, model).collect()}
    brute = Brute(TEXTS)
    assert len(found) == len(TEXTS)
    for k, text in rows:
        w = words(text)
        assert found[k].n_words == len(w)
        if not w:
            assert found[k].perplexity is None
            assert found[k].log_prob is None
            continue
        s = ["<s>", "<s>", *w, "</s>"]
        log = sum(math.log(brute.p(*g)) for g in zip(s, s[1:], s[2:], strict=False))
        assert found[k].log_prob == pytest.approx(log, abs=1e-3)
        assert found[k].perplexity == pytest.approx(math.exp(-log / (len(w) + 1)), rel=1e-3)
    for context in (("the", "cat"), ("<s>", "<s>"), ("nothing", "like")):
        assert sum(brute.p(*context, w) for w in brute.names) == pytest.approx(1)


def test_words_of_other_texts(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    model = ngram_lm.train(docs)
    other = spark.createDataFrame([(1, "zebras graze quietly"), (1, "zebras graze quietly"), (None, "the cat")], "doc_id long, text string")
    found = ngram_lm.perplexity(other, model).collect()
    assert len(found) == 3
    assert all(math.isfinite(r.perplexity) for r in found)
    brute = Brute(TEXTS)
    s = ["<s>", "<s>", "zebras", "graze", "quietly", "</s>"]
    log = sum(math.log(brute.p(*g)) for g in zip(s, s[1:], s[2:], strict=False))
    assert found[0].log_prob == pytest.approx(log, abs=1e-3)


def test_awkward_rows(spark):
    df, rows = awkward(spark, ["one two three " * 9000, "one, two THREE"])
    found = ngram_lm.perplexity(df, ngram_lm.train(df)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words) for r in found) == sorted((r[0] is None, r[0] or 0, len(words(r[1]))) for r in rows)
    assert all((r.log_prob is None) == (r.n_words == 0) for r in found)


def test_query_scores_by_the_whole_model(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.log_prob for r in queries.op6_lm_scoring(spark, str(tmp_path)).collect()}
    brute = Brute(TEXTS)
    for k, text in rows:
        if w := words(text):
            s = ["<s>", "<s>", *w, "</s>"]
            assert found[k] == pytest.approx(sum(math.log(brute.p(*g)) for g in zip(s, s[1:], s[2:], strict=False)), abs=1e-3)


def test_numbers_of_more_than_21_bits(spark, monkeypatch):
    assert ngram_lm.BITS >= 32
    monkeypatch.setattr(ngram_lm, "FIRST", (1 << 31) + 5)  # as if so many words came before
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    model = ngram_lm.train(docs)
    brute = Brute(TEXTS)
    # the even share of the lowest order is over the numbers there are, so only what doesn't rest on it is compared
    context, word, _ = ngram_lm._trigrams(*ngram_lm._numbered(model.folder, model.shelves, pa.array(["the cat sat", "ran ran"])))
    assert len(np.unique(word)) == 5
    contexts, key, _ = ngram_lm._grouped(context, word)
    key = np.unique(key)
    got = dict(zip(zip(contexts[(key >> np.uint64(32)).astype(int)].tolist(), (key & np.uint64(0xFFFFFFFF)).tolist(), strict=True), ngram_lm.probabilities(model, contexts, key), strict=True))
    grams = [g for w in (["the", "cat", "sat"], ["ran", "ran"]) for s in [["<s>", "<s>", *w, "</s>"]] for g in zip(s, s[1:], s[2:], strict=False)]
    for c, w, gram in zip(context.tolist(), word.tolist(), grams, strict=True):
        assert got[c, w] == pytest.approx(brute.p(*gram), abs=0.02)


def test_all_words_have_numbers_of_their_own(spark):
    texts = [*TEXTS, "alone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = ngram_lm.train(docs)
    distinct = {w for t in texts for w in words(t)}
    assert model.words == len(distinct) + ngram_lm.FIRST
    number, _ = ngram_lm._numbered(model.folder, model.shelves, pa.array([" ".join(distinct)]))
    assert len(set(number.tolist())) == len(distinct) + 2
    assert ngram_lm.UNK not in number


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_lm.perplexity(docs, ngram_lm.train(docs)).collect() == []
    only_null = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [r.perplexity for r in ngram_lm.perplexity(only_null, ngram_lm.train(only_null)).collect()] == [None]


def test_blocks_come_back():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64))
    assert (ngram_lm._sorted_unpack(ngram_lm._sorted_pack(keys)) == keys).all()
    assert (ngram_lm._unpack(ngram_lm._pack(keys)) == keys).all()
    huge = np.array([3, (1 << 40) + 1, 0], np.uint64)
    assert (ngram_lm._unpack(ngram_lm._pack(huge)) == huge).all()
    counts = np.array([1, 254, 255, 0, 1 << 40, 7], np.uint64)
    assert ngram_lm._counts(ngram_lm._coded("n", counts), "n", np.array([4, 0, 2, 5, 1, 3])).tolist() == [1 << 40, 1, 255, 7, 254, 0]
    rows = np.array([[1, 1, 0, 0], [1 << 40, 7, 1 << 20, 2], [1, 1, 0, 0]], np.uint64)
    coded = ngram_lm._coded_rows("x", rows)
    assert (coded["x"][coded["x_of"]] == rows).all()
    assert len(ngram_lm._sorted_unpack(b"")) == 0
