"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents and documents of unknown kind are learned from: of the
labelled documents those labelled toxic, and a sample of all of them with their labels
set aside, so that the share of toxic ones among them is the prior. The
risk of a classifier g is p * E+[l(g)] + max(0, Eu[l(-g)] - p * E+[l(-g)]), where p
is the share of toxic documents (Kiryo et al., 2017); l is the sigmoid loss and g is
linear in hashed words and their beginnings, so that inflected forms share weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import chunks, distinct, hashes, map_texts, normal_words

BITS = 18
PREFIXES = (3, 4, 5, 6)
SAMPLE_TOXIC = 2_000  # confirmed toxic documents that are learned from, at most
SAMPLE_UNLABELLED = 4_000  # labelled documents that are learned from as of unknown kind, about, if there are more


@dataclass(frozen=True)
class Model:
    """Weights of the hashed features, a bias, and the share of toxic documents assumed."""

    weights: bytes
    bias: float
    prior: float


def _features(words: list[str]) -> np.ndarray:
    """Hashed features of each word; one more than the last where a word has fewer."""
    mask, none = np.uint64((1 << BITS) - 1), 1 << BITS
    out = np.full((len(words), 1 + len(PREFIXES)), none, np.int32)
    if not words:
        return out
    out[:, 0] = hashes(words) & mask
    array = pa.array(words, pa.string())
    length = pc.utf8_length(array).to_numpy(zero_copy_only=False)
    for k, n in enumerate(PREFIXES, 1):
        coded = pc.utf8_slice_codeunits(array, 0, n).dictionary_encode()
        ids = hashes([f"{n}:{p}" for p in coded.dictionary.to_pylist()]) & mask
        out[:, k] = np.where(length >= n, ids[coded.indices.to_numpy(zero_copy_only=False)], none)
    return out


def _distinct(index: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words, each once for a text, and where each text's begin."""
    n = np.int64(index.max(initial=0)) + 1
    both = distinct(np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets)) * n + index)
    return both % n, np.searchsorted(both, np.arange(len(offsets), dtype=np.int64) * n)


def _scores(text: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The bias, and for each weighted feature its weight by log(1 + distinct words of the text that have it)."""
    index, words, offsets = normal_words(text)
    if not len(index):
        return np.full(len(text), bias)
    of_word = _features(words)
    of_word[weights[of_word] == 0] = 1 << BITS
    telling = (of_word < 1 << BITS).any(axis=1)  # few words have a feature that counts
    index, offsets = _distinct(index, offsets)
    row = np.repeat(np.arange(len(text)), np.diff(offsets))
    row, index = row[telling[index]], index[telling[index]]
    both = (row[:, None] * np.int64((1 << BITS) + 1) + of_word[index]).ravel()
    both, count = np.unique(both[of_word[index].ravel() < 1 << BITS], return_counts=True)
    row, feature = np.divmod(both, (1 << BITS) + 1)
    return np.bincount(row, weights=weights[feature] * np.log1p(count), minlength=len(text)) + bias


def _design(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, in how many distinct words of a row each occurs, and the rows."""
    features, values, sizes = [], [], []
    for low in range(0, len(texts), 256):
        index, words, offsets = normal_words(pa.array(texts[low : low + 256], pa.string()))
        of_word = _features(words)
        index, offsets = _distinct(index, offsets)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            ids, count = np.unique(of_word[index[a:b]], return_counts=True)
            real = ids < 1 << BITS
            features.append(ids[real].astype(np.int32))
            values.append(count[real].astype(np.int32))
            sizes.append(int(real.sum()))
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    return np.concatenate(features), np.concatenate(values), row


def _telling(feature: np.ndarray, row: np.ndarray, positive: np.ndarray, least: float, least_rows: int) -> np.ndarray:
    """Features of at least so many rows whose share among confirmed rows differs from that among unlabelled rows by so many deviations."""
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    of_p = np.bincount(feature[positive[row]], minlength=1 << BITS)
    of_u = np.bincount(feature[~positive[row]], minlength=1 << BITS)
    mean = (of_p + of_u + 1) / (n_p + n_u + 2)
    z = np.abs(of_p / n_p - of_u / n_u) / np.sqrt(mean * (1 - mean) * (1 / n_p + 1 / n_u))
    return np.flatnonzero((z >= least) & (of_p + of_u >= least_rows))


def risk(g: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of scores with the sigmoid loss l(z) = 1 / (1 + exp(z)), and the way down for each row's score.

    Where the risk of negatives, Eu[l(-g)] - p E+[l(-g)], is negative, the way is that of its
    opposite: back from what is overfitted.
    """
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    slope = s * (1 - s)
    of_p = prior * (1 - s[positive]).sum() / n_p
    negative = s[~positive].sum() / n_u - prior * s[positive].sum() / n_p
    if negative >= 0 or positive.all():
        return of_p + max(0.0, negative), np.where(positive, -2 * prior * slope / n_p, slope / n_u)
    return of_p, np.where(positive, prior * slope / n_p, -slope / n_u)


def _fit(
    texts: list[str], toxic: np.ndarray, prior: float, rounds: int, rate: float, decay: float, least: float, least_rows: int
) -> tuple[np.ndarray, float]:
    """Weights and bias of the least non-negative risk, by Adam with a rate that falls to nothing.

    The sigmoid loss has poor minima far from a good start: the first rounds tell
    confirmed rows from unlabelled ones by logistic regression, whose logit is about
    0 for toxic rows; the others go down the non-negative risk.
    """
    feature, value, row = _design(texts)
    positive = toxic.astype(bool)
    chosen = _telling(feature, row, positive, least, least_rows)
    number = np.full(1 << BITS, -1)
    number[chosen] = np.arange(len(chosen))
    keep = number[feature] >= 0
    feature, value, row = number[feature[keep]], np.log1p(value[keep]), row[keep]
    n, k = len(positive), len(chosen)
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    w, bias = np.zeros(k), float(np.log(prior / (1 + prior)))
    for warm in (True, False):
        m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
        bias += 0.0 if warm else 1.0
        for t in range(1, rounds + 1):
            g = np.bincount(row, weights=w[feature] * value, minlength=n) + bias
            if warm:
                s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
                d = np.where(positive, prior * (s - 1) / n_p, s / n_u)
            else:
                _, d = risk(g, positive, prior)
            grad = np.bincount(feature, weights=d[row] * value, minlength=k) + decay * w
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            mb, vb = 0.9 * mb + 0.1 * d.sum(), 0.999 * vb + 0.001 * d.sum() ** 2
            a, b, step = 1 - 0.9**t, 1 - 0.999**t, rate * (1 - (t - 1) / rounds)
            w -= step * (m / a) / (np.sqrt(v / b) + 1e-8)
            bias -= step * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    out = np.zeros((1 << BITS) + 1, np.float32)
    out[chosen] = w
    return out, float(bias)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    prior: float | None = None,
    sample_toxic: int = SAMPLE_TOXIC,
    sample_unlabelled: int = SAMPLE_UNLABELLED,
    rounds: int = 150,
    rate: float = 0.1,
    decay: float = 1e-5,
    least: float = 4.0,
    least_rows: int = 4,
) -> Model | None:
    """A classifier from labelled documents: those confirmed as toxic, and others taken as of unknown kind.

    sample_toxic and sample_unlabelled bound the labelled rows that one task learns from; those
    with the least hashes of doc_id are taken. The prior is the share of toxic ones among all
    labels unless given. A feature has a weight if its shares among the two kinds differ by
    least deviations and it is in at least least_rows rows. Null labels, ids and texts
    are left out; of repeated labels one counts; None if no toxic document is left.
    """
    share = labels.where("toxic is not null").agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    prior = min(max(share or 0.0, 1e-3), 0.9) if prior is None else prior
    confirmed = labels.where("toxic = 1 and doc_id is not null").select("doc_id").distinct()
    confirmed = confirmed.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(sample_toxic)
    unknown = labels.where("doc_id is not null").select("doc_id").distinct()
    part = min(1.0, sample_unlabelled / max(unknown.count(), 1))
    unknown = unknown.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) < int(np.ceil(part * (1 << 30))))
    chosen = confirmed.select("doc_id", F.lit(1).alias("toxic")).unionByName(unknown.select("doc_id", F.lit(0).alias("toxic")))
    # at most about sample_toxic + sample_unlabelled ids: under 100 KB
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (rows := list(batches)):
            return
        table = pa.Table.from_batches(rows).sort_by([("toxic", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        toxic = table["toxic"].to_numpy()
        if toxic.any():
            w, bias = _fit(table["text"].to_pylist(), toxic, prior, rounds, rate, decay, least, least_rows)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([bias])], ["weights", "bias"])

    learned = rows.selectExpr("cast(toxic as int) toxic", "text", "cast(doc_id as bigint) doc_id").repartition(1)
    found_model = learned.mapInArrow(train, "weights binary, bias double").collect()
    return Model(bytes(found_model[0].weights), found_model[0].bias, prior) if found_model else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and toxic of each row; a document is toxic if its score is above 0.

    The score is of the whole text. A null text, and any text without a model, has a
    null score and is not toxic; a text without words has the bias as its score.
    """
    if model is None:
        return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(null as double) score", "false toxic")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(shared.value.weights, np.float32)
        for batch in chunks(batches):
            text = batch.column("text")
            none = pc.is_null(text).to_numpy(zero_copy_only=False)
            s = np.round(_scores(text, weights, shared.value.bias), 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, mask=none), pa.array((s > 0) & ~none)], ["doc_id", "score", "toxic"])

    return map_texts(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id bigint, score double, toxic boolean")


def without_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, with all their columns, that score() doesn't call toxic.

    Rows with a null text stay, and without a model all rows do; empty and wordless texts have
    the bias as their score, repeated rows the same one. Columns of any name are passed on.
    """
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(shared.value.weights, np.float32)
        for batch in chunks(batches):
            text = batch.column("text")
            s = np.round(_scores(text, weights, shared.value.bias), 6)
            yield batch.filter(pc.or_(pc.is_null(text), pa.array(s <= 0)))

    return map_texts(docs, run, docs.schema)
