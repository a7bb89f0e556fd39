"""Perplexity under an interpolated modified Kneser-Ney trigram model.

Words, then trigrams, are counted in Spark over the whole corpus; counts of lower
orders are numbers of distinct words to the left (Chen and Goodman, 1999). Keys and
counts move as compressed blocks of sorted arrays, one for each bucket of a hash, so
that a shuffle has few rows. Words are told apart by a 64-bit hash and have 32-bit
numbers; a trigram is its first two words, by whose hash it is in a bucket, and the
place of its third word among those that follow them. The model is a file of sorted
arrays for each bucket in the shared folder; workers map the files into memory and look
n-grams up by binary search. Every n-gram that occurs is counted and stored.
"""

from __future__ import annotations

import json
import mmap
import os
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import chunks, distinct, hashes, local_path, map_texts, mix, normal_words, shared_folder, written

BITS = 32  # of a word's number
UNK, START, END, FIRST = 0, 1, 2, 3
RANGE = 15  # bits of the numbers whose figures are in one file
BUCKET_TOKENS = 2_000_000  # of the corpus for each bucket of n-grams: a task adds up one at a time
_BLOCK = "bucket int, keys binary, counts binary, of3 string"
_TRIGRAMS = "bucket int, contexts binary, sizes binary, words binary, counts binary"
_HELD = 4_000_000  # keys that a task holds before it adds them up
_MAPS = 16_000  # files that a worker keeps mapped
_WORD = np.uint64((1 << BITS) - 1)
_SHIFT = np.uint64(BITS)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, in as many bytes as the greatest needs, as compressed planes of bytes."""
    if not len(values):
        return b""
    values = np.ascontiguousarray(values.astype(np.min_scalar_type(int(values.max()))))
    planes = values.view(np.uint8).reshape(len(values), -1).T
    return bytes([values.itemsize]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    return np.ascontiguousarray(plain.reshape(data[0], -1).T).view(f"u{data[0]}").ravel().astype(np.uint64)


def _sorted_pack(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _sorted_unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts."""
    if not len(keys):
        return keys, counts.astype(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    first = _firsts(keys)
    return keys[first], np.add.reduceat(counts[order].astype(np.uint64), first)


class _Sums:
    """Counts by key, added up now and then."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > _HELD and len(self.parts) > 1:
            self.parts = [self.total()]
            self.held = len(self.parts[0][0]) // 2

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return _added(np.concatenate([k for k, _ in self.parts]), np.concatenate([c.astype(np.uint64) for _, c in self.parts]))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket that keeps the order within, and of each bucket its name and where it begins and ends in it."""
    narrow = bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket  # 16 bits are sorted by radix
    order = np.argsort(narrow, kind="stable")
    ordered = bucket[order]
    first = _firsts(ordered)
    return order, list(zip(ordered[first].tolist(), first.tolist(), [*first.tolist(), len(order)][1:], strict=True))


def _rows(names: str, rows: list[tuple]) -> pa.RecordBatch:
    """A batch with columns of these names and SQL types, as in a schema."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    columns = [c.split() for c in names.split(", ")]
    values = list(zip(*rows, strict=True)) if rows else [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[kind]) for v, (_, kind) in zip(values, columns, strict=True)], [name for name, _ in columns])


def _blocks(keys: np.ndarray, counts: np.ndarray, buckets: int, of3: str | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each bucket, its keys in order; the first row carries of3."""
    order, parts = _by_bucket(_bucket(keys, buckets))
    keys, counts = keys[order], counts[order]
    for b, i, j in parts:
        yield _rows(_BLOCK, [(b, _sorted_pack(keys[i:j]), _pack(counts[i:j]), of3)])
        of3 = None


def _grouped(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct contexts, trigrams as a place among them and a word, and the order in which they come."""
    order = np.argsort(context)
    context = context[order]
    first = _firsts(context)
    place = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(np.append(first, len(context))))
    return context[first], (place << _SHIFT) | word[order], order


class _Trigrams:
    """Counts by context and word, added up now and then."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, contexts: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((contexts, keys, counts))
        self.held += len(keys)
        if self.held > _HELD and len(self.parts) > 1:
            self.parts = [self.total()]
            self.held = len(self.parts[0][1]) // 2

    def total(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct contexts, keys of places among them and words, and their counts."""
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if len(self.parts) == 1:
            return self.parts[0]
        contexts = distinct(np.concatenate([c for c, _, _ in self.parts]))
        keys = [(np.searchsorted(contexts, c).astype(np.uint64)[(k >> _SHIFT).astype(np.int64)] << _SHIFT) | (k & _WORD) for c, k, _ in self.parts]
        return contexts, *_added(np.concatenate(keys), np.concatenate([n.astype(np.uint64) for _, _, n in self.parts]))


def _trigram_blocks(contexts: np.ndarray, keys: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket, its contexts in order and the words after each in order."""
    place = (keys >> _SHIFT).astype(np.int64)
    sizes = np.bincount(place, minlength=len(contexts))
    bucket = _bucket(contexts, buckets)
    by, parts = _by_bucket(bucket)
    order, _ = _by_bucket(bucket[place])
    words, counts = (keys & _WORD)[order], counts[order]
    contexts, sizes = contexts[by], sizes[by]
    begin = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    for b, i, j in parts:
        k, m = begin[i], begin[j]
        yield _rows(_TRIGRAMS, [(b, _sorted_pack(contexts[i:j]), _pack(sizes[i:j]), _pack(words[k:m]), _pack(counts[k:m]))])


def _merged_trigrams(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sums = _Trigrams()
    for c, s, w, n in zip(*(rows[k].to_pylist() for k in ("contexts", "sizes", "words", "counts")), strict=True):
        contexts = _sorted_unpack(c)
        place = np.repeat(np.arange(len(contexts), dtype=np.uint64), _unpack(s).astype(np.int64))
        sums.parts.append((contexts, (place << _SHIFT) | _unpack(w), _unpack(n)))
    return sums.total()


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = list(zip(rows["keys"].to_pylist(), rows["counts"].to_pylist(), strict=True))
    return _added(np.concatenate([_sorted_unpack(k) for k, _ in parts]), np.concatenate([_unpack(c) for _, c in parts]))


def _save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays as one file, which is there whole or not at all: a task can be run again."""
    part = os.path.join(folder, f".{name}-{os.getpid()}-{os.urandom(4).hex()}")
    at, head = 0, {}
    for key, x in arrays.items():
        head[key] = (x.dtype.str, list(x.shape), at)
        at += -(-x.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    with open(part, "wb") as file:
        file.write(len(text).to_bytes(8, "little") + text)
        for x in arrays.values():
            file.write(np.ascontiguousarray(x).tobytes() + bytes(-x.nbytes % 64))
    os.replace(part, os.path.join(folder, name))


_maps: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()


def _load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file mapped into memory, none if there is no such file; a worker keeps those it used last."""
    path = os.path.join(folder, name)
    if path in _maps:
        _maps.move_to_end(path)
        return _maps[path]
    if len(_maps) >= _MAPS:
        _maps.popitem(last=False)
    found: dict[str, np.ndarray] = {}
    if os.path.exists(path):
        with open(path, "rb") as file:
            data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        size = int.from_bytes(data[:8], "little")
        for key, (kind, shape, at) in json.loads(data[8 : 8 + size]).items():
            found[key] = np.frombuffer(data, kind, int(np.prod(shape)), 8 + size + at).reshape(shape)
    _maps[path] = found
    return found


def _coded(name: str, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of a byte each; 255 stands for the few that are as great or greater, which are kept with their places."""
    large = np.flatnonzero(counts >= 255)
    return {name: np.minimum(counts, 255).astype(np.uint8), f"{name}_at": large, f"{name}_large": counts[large].astype(np.uint64)}


def _counts(have: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    """The counts that _coded made, at these places."""
    out = have[name][at].astype(np.float64)
    if len(large := np.flatnonzero(out == 255)):
        out[large] = have[f"{name}_large"][np.searchsorted(have[f"{name}_at"], at[large])]
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of those wanted are among the sorted keys, and where."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == wanted)
    return hit, at[hit]


def _coded_rows(name: str, rows: np.ndarray) -> dict[str, np.ndarray]:
    """As _coded, for rows of four figures: those below 2**16 are told apart as one number, the few others have a place each."""
    small = (rows < 1 << 16).all(axis=1)
    own = rows[small]
    packed = own[:, 0] | (own[:, 1] << np.uint64(16)) | (own[:, 2] << np.uint64(32)) | (own[:, 3] << np.uint64(48))
    table, back = np.unique(packed, return_inverse=True)
    whole = np.stack([(table >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(4)], axis=1)
    code = np.empty(len(rows), np.int64)
    code[small], code[~small] = back, len(table) + np.arange(int((~small).sum()))
    whole = np.concatenate([whole, rows[~small]])
    return {name: whole, f"{name}_of": code.astype(np.min_scalar_type(max(1, len(whole))))}


def _of_counts(counts: np.ndarray) -> list[int]:
    """How many keys have the counts 1, 2, 3 and 4."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """What is taken from counts 1, 2 and more, from the numbers of counts 1 to 4; set values where those don't tell."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(d) if all(0 <= x <= k for k, x in enumerate(d, 1)) else (0.5, 1.0, 1.5)  # type: ignore[return-value]


def _less(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def _kinds(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of counts, given where it begins: their sum, and how many are 1, 2, more."""
    if not len(first):
        return np.zeros((0, 4), np.uint64)
    parts = [counts, counts == 1, counts == 2, counts >= 3]
    return np.stack([np.add.reduceat(p.astype(np.uint64), first) for p in parts], axis=1)


def _rest(stats: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """The weight of the lower order after contexts with such figures; 1 after contexts that have none."""
    return np.where(stats[:, 0] > 0, stats[:, 1:] @ np.array(d) / np.maximum(stats[:, 0], 1), 1.0)


@dataclass(frozen=True)
class Model:
    """Where the arrays are, in how many buckets of words and of n-grams, how many numbered words,
    each word's even share, the sum of their figures, and the discounts of each order."""

    folder: str
    shelves: int
    buckets: int
    words: int
    even: float
    total: int
    d1: tuple[float, float, float]
    d2: tuple[float, float, float]
    d3: tuple[float, float, float]


def _numbered(folder: str, shelves: int, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers with two starts and an end around each text that has words, and where texts begin."""
    index, words, offsets = normal_words(text)
    h = hashes(words)
    number = np.full(len(h), UNK, np.uint64)
    order, parts = _by_bucket(_bucket(h, shelves))
    for b, i, j in parts:
        have, which = _load(folder, f"word-{b}"), order[i:j]
        if have and len(keys := have["keys"]):
            at = np.minimum(np.searchsorted(keys, h[which]), len(keys) - 1)
            number[which] = np.where(keys[at] == h[which], have["numbers"][at], UNK)
    n = np.diff(offsets)
    size = np.where(n > 0, n + 3, 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(ends[-1]), START, np.uint64)
    out[np.arange(len(index)) + np.repeat(ends[:-1] + 2 - offsets[:-1], n)] = number[index] if len(index) else 0
    out[ends[1:][n > 0] - 1] = END
    return out, ends


def _trigrams(sequence: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and third words of all trigrams within texts, and each text's first."""
    few = len(sequence) < 3
    context = np.zeros(0, np.uint64) if few else (sequence[:-2] << _SHIFT) | sequence[1:-1]
    inside = np.ones(len(context), bool)
    cut = ends[1:-1]
    for back in (1, 2):  # those that reach into the next text
        at = cut[(cut > 0) & (cut < len(sequence))] - back
        inside[at[at < len(context)]] = False
    size = np.maximum(np.diff(ends) - 2, 0)
    return context[inside], sequence[2:][inside] if not few else context, np.concatenate([[0], np.cumsum(size)])


def train(docs: DataFrame) -> Model:
    """Counts the words and trigrams of all texts and writes the model's arrays.

    All words have numbers of their own, and all n-grams are stored; discounts come from
    the numbers of n-grams that occur once to four times. Null and wordless texts add
    nothing, repeated rows count each time, other columns are not read; without words
    the model has the end alone.
    """
    spark = docs.sparkSession
    path = shared_folder(spark, "ngrams")
    folder = local_path(path)
    os.makedirs(folder)
    source = docs.select("text").where("text is not null")
    shelves = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in chunks(batches):
            index, words, _ = normal_words(batch.column("text"))
            counts = np.bincount(index, minlength=len(words))
            sums.add(hashes(words)[counts > 0], counts[counts > 0])  # a word of which nothing is left has none
        yield from _blocks(*sums.total(), shelves)

    def number_words(rows: pa.Table) -> pa.Table:
        # frequent words have low numbers: the k-th of shelf b has number FIRST + k * shelves + b
        b = rows["bucket"][0].as_py()
        keys, counts = _merged(rows)
        if len(keys) * shelves + FIRST + shelves >= 1 << BITS:
            raise ValueError(f"more words than numbers of {BITS} bits")
        ids = np.empty(len(keys), np.uint32)
        ids[np.lexsort((keys, -counts.astype(np.int64)))] = FIRST + b + shelves * np.arange(len(keys))
        _save(folder, f"word-{b}", {"keys": keys, "numbers": ids})
        return pa.table({"n": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    numbered = map_texts(source, count_words, _BLOCK).groupBy("bucket").applyInArrow(number_words, "n bigint, tokens bigint")
    size, tokens = (x or 0 for x in numbered.agg(F.sum("n"), F.sum("tokens")).first())
    # so many that a bucket's trigrams fit a task at any size of the corpus
    buckets = max(shelves, tokens // BUCKET_TOKENS)

    def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Trigrams()
        for batch in chunks(batches):
            context, word, _ = _trigrams(*_numbered(folder, shelves, batch.column("text")))
            contexts, keys, _ = _grouped(context, word)
            sums.add(contexts, *np.unique(keys, return_counts=True))
        yield from _trigram_blocks(*sums.total(), buckets)

    def add_trigrams(rows: pa.Table) -> pa.Table:
        contexts, keys, counts = _merged_trigrams(rows)
        group = (keys >> _SHIFT).astype(np.int64)
        first = _firsts(group)
        words, stats = (keys & _WORD).astype(np.uint32), _kinds(counts, first)
        # most contexts occur once: their one word needs no place, count or figures
        once = stats[:, 0] == 1
        more = ~once[group]
        arrays = {"once": contexts[once], "once_words": words[first[once]], "contexts": contexts[~once], "words": words[more]}
        arrays["begin"] = np.append(_firsts(group[more]), int(more.sum())).astype(np.uint32)
        _save(folder, f"tri-{rows['bucket'][0].as_py()}", arrays | _coded("counts", counts[more]) | _coded_rows("stats", stats[~once]))
        pairs, left = np.unique((contexts[group] << _SHIFT) | (keys & _WORD), return_counts=True)
        return pa.Table.from_batches(list(_blocks(pairs, left, buckets, json.dumps(_of_counts(counts)))))

    # pairs of a word and the next, and how many words come before them
    pairs = map_texts(source, count_trigrams, _TRIGRAMS).groupBy("bucket").applyInArrow(add_trigrams, _BLOCK)
    shape = "bucket int, context binary, stats binary, word binary, types binary, of2 string, of3 string"

    def add_pairs(rows: pa.Table) -> pa.Table:
        keys, counts = _merged(rows)
        b = rows["bucket"][0].as_py()
        # a pair is a context too, in the same bucket, if it isn't a text's end: there its count has the context's place
        have, rest, arrays = _load(folder, f"tri-{b}"), np.ones(len(keys), bool), {}
        for name in ("once", "contexts"):
            own = have.get(name, np.zeros(0, np.uint64))
            hit, at = _find(own, keys)
            of = np.zeros(len(own), np.uint64)
            of[at], rest[hit] = counts[hit], False
            arrays |= _coded(name, of)
        _save(folder, f"bi-{b}", arrays | {"keys": keys[rest]} | _coded("others", counts[rest]))
        first = _firsts(keys >> _SHIFT)
        context, stats = (keys >> _SHIFT)[first], _kinds(counts, first)
        word, types = np.unique(keys & _WORD, return_counts=True)
        ranges = np.unique(np.concatenate([distinct(context >> np.uint64(RANGE)), distinct(word >> np.uint64(RANGE))]))
        cuts = [np.searchsorted(x >> np.uint64(RANGE), np.append(ranges, ranges[-1] + np.uint64(1))) for x in (context, word)]
        of3 = json.dumps(np.sum([json.loads(x) for x in rows["of3"].to_pylist() if x] or [[0] * 4], axis=0).tolist())
        out = []
        for k, r in enumerate(ranges.tolist()):
            (a, b), (c, d) = ((x[k], x[k + 1]) for x in cuts)
            own = (json.dumps(_of_counts(counts)), of3) if k == 0 else (None, None)
            out.append((r, _pack(context[a:b]), _pack(stats[a:b].ravel()), _pack(word[c:d]), _pack(types[c:d]), *own))
        return pa.Table.from_batches([_rows(shape, out)])

    singles = written(pairs.groupBy("bucket").applyInArrow(add_pairs, shape), "singles")

    def add_words_after(rows: pa.Table) -> pa.Table:
        r = rows["bucket"][0].as_py()
        low, width = np.uint64(r << RANGE), 1 << RANGE
        stats, types = np.zeros((width, 4), np.uint64), np.zeros(width, np.uint64)
        for c, s, w, t in zip(*(rows[k].to_pylist() for k in ("context", "stats", "word", "types")), strict=True):
            # a row's words are distinct
            stats[(_unpack(c) - low).astype(np.int64)] += _unpack(s).reshape(-1, 4)
            types[(_unpack(w) - low).astype(np.int64)] += _unpack(t)
        _save(folder, f"one-{r}", {"after": stats.astype(np.min_scalar_type(int(stats.max()))), "types": types.astype(np.min_scalar_type(int(types.max())))})
        return pa.table({"of1": [json.dumps(_of_counts(types))], "total": [int(types.sum())], "more": [int((types >= 3).sum())]})

    after = singles.select("bucket", "context", "stats", "word", "types")
    last = written(after.groupBy("bucket").applyInArrow(add_words_after, "of1 string, total bigint, more bigint"), "types")
    n1, n2, n3 = _total(last, "of1"), _total(singles, "of2"), _total(singles, "of3")
    total, more = (x or 0 for x in last.agg(F.sum("total"), F.sum("more")).first())
    d1, d2, d3 = discounts(n1), discounts(n2), discounts(n3)
    # what is taken from all words goes evenly to all but the start
    taken = (n1[0] * d1[0] + n1[1] * d1[1] + more * d1[2]) / total if total else 1.0
    return Model(folder, shelves, int(buckets), size + FIRST, taken / (size + FIRST - 1), int(total), d1, d2, d3)


def _of_words(folder: str, name: str, numbers: np.ndarray) -> np.ndarray:
    """Figures of words by number; words that have none have zeros."""
    own, back = np.unique(numbers, return_inverse=True)
    out = np.zeros((len(own), 4) if name == "after" else len(own))
    order, ranges = _by_bucket((own >> np.uint64(RANGE)).astype(np.int64))
    for r, i, j in ranges:
        if have := _load(folder, f"one-{r}"):
            out[order[i:j]] = have[name][(own[order[i:j]] - np.uint64(r << RANGE)).astype(np.int64)]
    return out[back]


def _total(rows: DataFrame, name: str) -> list[int]:
    """Sums of four figures that rows have as JSON: one row for each bucket at most, added up in Spark."""
    parts = F.from_json(name, "array<bigint>")
    return [int(x or 0) for x in rows.where(F.col(name).isNotNull()).agg(*(F.sum(parts[k]) for k in range(4))).first()]


def _within(words: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted word is between low and high, where words are in order; -1 if it isn't."""
    low, end = low.astype(np.int64), high.astype(np.int64)
    high = end.copy()
    open_ = np.arange(len(low))
    while len(open_):
        mid = (low[open_] + high[open_]) >> 1
        less = words[mid] < wanted[open_]
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
        open_ = open_[low[open_] < high[open_]]
    found = low < end
    found[found] = words[low[found]] == wanted[found]
    return np.where(found, low, -1)


def _runs(begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of these groups, one after another, and how many each has."""
    n = begin[which + 1] - begin[which]
    return np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), n


def probabilities(model: Model, contexts: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Each trigram's third word's probability after its context; contexts and keys are those of _grouped, keys distinct and sorted."""
    folder = model.folder
    of, w = (key >> _SHIFT).astype(np.int64), key & _WORD
    pairs, back = np.unique(((contexts[of] & _WORD) << _SHIFT) | w, return_inverse=True)
    after, types = _of_words(folder, "after", pairs >> _SHIFT), _of_words(folder, "types", pairs & _WORD)
    p2 = _rest(after, model.d2) * ((types - _less(types, model.d1)) / max(model.total, 1) + model.even)
    order, parts = _by_bucket(_bucket(pairs, model.buckets))
    for b, i, j in parts:
        which, tri, bi = order[i:j], _load(folder, f"tri-{b}"), _load(folder, f"bi-{b}")
        for keys, name in ((tri.get("once"), "once"), (tri.get("contexts"), "contexts"), (bi.get("keys"), "others")):
            if not bi or keys is None:
                continue
            hit, at = _find(keys, pairs[which])
            n, own = _counts(bi, name, at), which[hit]
            own, n = own[n > 0], n[n > 0]
            p2[own] += (n - _less(n, model.d2)) / after[own, 0]
    rest, share3 = np.ones(len(contexts)), np.zeros(len(key))
    # the trigrams of a context stand together
    begin = np.searchsorted(of, np.arange(len(contexts) + 1))
    order, parts = _by_bucket(_bucket(contexts, model.buckets))
    for b, i, j in parts:
        if not (have := _load(folder, f"tri-{b}")):
            continue
        where = order[i:j]
        hit, at = _find(have["once"], contexts[where])
        which = where[hit]
        rest[which] = model.d3[0]
        rows, n = _runs(begin, which)
        same = np.repeat(have["once_words"][at], n) == w[rows]
        share3[rows[same]] = 1 - model.d3[0]
        hit, at = _find(have["contexts"], contexts[where])
        which = where[hit]
        stats = have["stats"][have["stats_of"][at]].astype(np.float64)
        rest[which] = _rest(stats, model.d3)
        rows, n = _runs(begin, which)
        place = _within(have["words"], np.repeat(have["begin"][at], n), np.repeat(have["begin"][at + 1], n), w[rows].astype(np.uint32))
        known = place >= 0
        c = _counts(have, "counts", place[known])
        share3[rows[known]] = (c - _less(c, model.d3)) / np.repeat(stats[:, 0], n)[known]
    return share3 + rest[of] * p2[back]


def perplexity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, log_prob and perplexity of each document.

    Words are in normal form (see common.normal); a document is a sequence of them
    with an end, which counts as a word of log_prob (natural logarithm) and
    perplexity. Texts that are null or have no words have 0 words and null figures.
    Each row of docs gives a row, repeated rows and null ids too; other columns are
    not read. Texts are scored whole, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a path and a few numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in chunks(batches):
            context, word, offsets = _trigrams(*_numbered(model.folder, model.shelves, pc.fill_null(batch.column("text"), "")))
            contexts, key, order = _grouped(context, word)
            own, back = np.unique(key, return_inverse=True)
            logs = np.log(probabilities(model, contexts, own))[back]
            n = np.diff(offsets)
            sums = np.bincount(np.repeat(np.arange(len(n)), n)[order], weights=logs, minlength=len(n))
            none = n == 0
            values = np.exp(-sums / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.maximum(n - 1, 0)), pa.array(np.round(sums, 4), mask=none), pa.array(np.round(values, 4), mask=none)],
                ["doc_id", "n_words", "log_prob", "perplexity"],
            )

    schema = "doc_id bigint, n_words bigint, log_prob double, perplexity double"
    return map_texts(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, schema)
