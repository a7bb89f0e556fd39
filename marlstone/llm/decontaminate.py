"""Benchmark decontamination: BM25 with block-max WAND, then overlap of question and answer.

The index holds the test items. Every passage of every training text is a query: a
window of words that moves on by half its length. For all passages of a chunk of text
together, the maxima of their terms are summed for each block of items; where no
block's sum reaches the threshold nothing in it can. WAND then walks the postings of
the passages that are left, passing over items by the maxima of terms and of blocks of
postings. All items at or above the threshold are retrieved, and each is held
against the document: shared runs of words of its question and of its answer.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlstone.llm.common import chunks, distinct, hashes, map_texts, mix, normal_array, normal_words

PASSAGE = 128
SHARE = 0.5  # of the score that an item gets as its own query
QUESTION, ANSWER = 0.6, 0.6  # of the runs of words
RUN = 3
K1, B = 1.2, 0.75
BLOCK = 64  # postings
RANGE = 2  # items
PIECE = 2 << 20  # bytes of text whose passages a worker looks up at one time
INDEX_BYTES = 4 << 20  # of benchmark text in one index, about 130 MB in a worker; a larger benchmark has several
SCHEMA = "doc_id bigint, item_id bigint, bm25_share double, question_overlap double, answer_overlap double"


@dataclass
class Item:
    """A test item: its terms in order, and how many of them are the question."""

    item_id: int
    words: list[str]
    question: int


def parse(item_id: int, text: str) -> list[Item]:
    """The item, if it has words: its question is all but its last sentence, its answer the last one; a single sentence is both."""
    sentences = [s for line in text.split("\n") for s in line.replace("? ", "?\n").replace(". ", ".\n").replace("! ", "!\n").split("\n")]
    split = [s.split() for s in sentences]
    words = iter(normal_array(pa.array([w for s in split for w in s], pa.string())).to_pylist())
    tokens = [w for s in split if (w := [n for n in (next(words) for _ in s) if n])]
    if not tokens:
        return []
    all_words = [w for s in tokens for w in s]
    question = len(all_words) - len(tokens[-1]) if len(tokens) > 1 else len(all_words)
    return [Item(item_id, all_words, question)]


def parts(item: Item) -> list[list[str]]:
    """What of an item is indexed as one: all of it, or runs that a passage holds whole if it is too long for that."""
    half, n, out = PASSAGE // 2, len(item.words), []
    for low in range(0, n, half):
        if low == 0 or n - low >= half // 2:
            last = n - low - half < half // 2
            out.append(item.words[low:] if last else item.words[low : low + half])
            if last:
                break
    return out


@dataclass
class Statistics:
    """Of a whole benchmark: in how many parts each word stands, the number of parts, and their words."""

    df: Counter[str]
    n: int
    words: int

    @classmethod
    def of(cls, items: list[Item]) -> Statistics:
        found = cls(Counter(), 0, 0)
        found.add(items)
        return found

    def add(self, items: list[Item]) -> None:
        for item in items:
            for words in parts(item):
                self.df.update(set(words))
                self.n += 1
                self.words += len(words)


def _run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of so many words, given by their hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run = mix(h[:n] + np.uint64(size))
    for k in range(1, size):
        run = mix(run * np.uint64(3) + h[k : k + n])
    return distinct(run)


def _runs(words: list[str]) -> tuple[int, np.ndarray]:
    """Words in a run, RUN unless there are fewer, and the hashes of all runs."""
    size = min(RUN, len(words))
    return size, _run_hashes(hashes(words), size)


class Index:
    """Postings by term, impacts as shares of the item's own score, and their maxima by term and by block.

    Frequencies and the mean length are those of the whole benchmark, given as
    statistics, so a part's scores are the same in whichever index it is.
    """

    def __init__(self, items: list[Item], share: float = SHARE, statistics: Statistics | None = None) -> None:
        whole = statistics or Statistics.of(items)
        self.ids = [i.item_id for i in items]
        pieces = [(k, words) for k, item in enumerate(items) for words in parts(item)]
        self.item_of = [k for k, _ in pieces]
        mean = whole.words / max(1, whole.n)
        idf = {w: float(np.log(1 + (whole.n - d + 0.5) / (d + 0.5))) for w in {w for _, words in pieces for w in words} for d in (whole.df[w],)}
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for e, (_, words) in enumerate(pieces):
            tf = Counter(words)
            raw = {w: idf[w] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean)) for w, c in tf.items()}
            own = sum(raw.values())
            for w, x in raw.items():
                postings[w].append((e, x / own))
        self.terms = {w: t for t, w in enumerate(postings)}
        self.docs = [[e for e, _ in p] for p in postings.values()]
        self.impacts = [[x for _, x in p] for p in postings.values()]
        self.upper = np.array([max(x) for x in self.impacts])
        self.block_last = [[d[min(k + BLOCK, len(d)) - 1] for k in range(0, len(d), BLOCK)] for d in self.docs]
        self.block_max = [[max(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)] for x in self.impacts]
        # common terms, as many as together give no item more than half the threshold: a
        # passage needs the rest of it from the others
        common = np.zeros(len(self.docs), bool)
        given = np.zeros(len(pieces))
        for t in sorted(range(len(self.docs)), key=lambda t: -len(self.docs[t])):
            given[self.docs[t]] += self.impacts[t]
            if given.max() > share / 2:
                given[self.docs[t]] -= self.impacts[t]
                break
            common[t] = True
        self.rare = ~common
        self.ranges = -(-len(pieces) // RANGE)
        self.common_most = np.maximum.reduceat(given, np.arange(0, len(given), RANGE)) if len(given) else given
        most: list[dict[int, float]] = [{} for _ in self.docs]  # of each rare term, by range of items
        for t in np.flatnonzero(self.rare):
            for e, x in zip(self.docs[t], self.impacts[t], strict=True):
                most[t][e // RANGE] = max(most[t].get(e // RANGE, 0.0), x)
        self.range_first = np.cumsum([0, *map(len, most)])
        self.range_of = np.array([r for m in most for r in m], np.int64)
        self.range_max = np.array([x for m in most for x in m.values()])
        self.question = [_runs(i.words[: i.question]) for i in items]
        self.answer = [_runs(i.words[i.question :] or i.words) for i in items]

    def retrieve(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """Entries whose impacts for the distinct terms sum to the threshold, by block-max WAND."""
        docs, impacts, upper, eps = self.docs, self.impacts, self.upper, 1e-9
        end = len(self.item_of)
        at = dict.fromkeys(terms, 0)
        head = {t: docs[t][0] for t in terms}
        found = []
        while head:
            order = sorted(head, key=head.__getitem__)
            total, pivot = 0.0, -1
            for k, t in enumerate(order):
                total += upper[t]
                if total >= least - eps:
                    pivot = head[t]
                    while k + 1 < len(order) and head[order[k + 1]] == pivot:
                        k += 1
                    break
            if pivot < 0:
                break
            lead = order[: k + 1]
            blocks, border = 0.0, end
            for t in lead:  # the maxima of the blocks that could hold the pivot
                b = bisect_left(self.block_last[t], pivot, at[t] // BLOCK)
                if b < len(self.block_last[t]):
                    blocks += self.block_max[t][b]
                    border = min(border, self.block_last[t][b] + 1)
            if blocks >= least - eps:
                target = pivot
                if head[order[0]] == pivot:
                    score = sum(impacts[t][at[t]] for t in lead)
                    if score >= least - eps:
                        found.append((pivot, score))
                    target = pivot + 1
            else:  # nothing before the next block, or the next list, can do it
                target = max(pivot + 1, min([border, *(head[t] for t in order[k + 1 : k + 2])]))
            for t in lead:
                if head[t] < target:
                    p = bisect_left(docs[t], target, at[t])
                    if p == len(docs[t]):
                        del head[t]
                    else:
                        at[t], head[t] = p, docs[t][p]
        return found

    def passages(self, terms: np.ndarray, offsets: np.ndarray, least: float) -> Iterator[tuple[int, list[int]]]:
        """Row and distinct terms of each passage in which a range of items can reach the threshold.

        terms: of the words of the texts that the offsets delimit, -1 for none.
        """
        n = np.diff(offsets)
        step = PASSAGE // 2
        windows = np.maximum(1, -(-(n - step) // step))
        base = np.cumsum(windows) - windows
        row = np.repeat(np.arange(len(n)), n)
        at = (np.arange(len(terms)) - offsets[row]) // step
        known = terms >= 0
        row, at, terms = row[known], at[known], terms[known].astype(np.int64)
        here, before = at < windows[row], at > 0
        window = np.concatenate([(base[row] + at)[here], (base[row] + at - 1)[before]])
        both = distinct(window * len(self.docs) + np.concatenate([terms[here], terms[before]]))
        window, terms = np.divmod(both, len(self.docs))
        rare = self.rare[terms]
        w, t = window[rare], terms[rare]
        count = self.range_first[t + 1] - self.range_first[t]
        total = int(count.sum())
        entry = np.arange(total) - np.repeat(np.cumsum(count) - count - self.range_first[t], count)
        key = np.repeat(w, count) * self.ranges + self.range_of[entry]
        # a passage without rare terms of a range has at most half the threshold in it
        keys, back = np.unique(key, return_inverse=True)
        sums = np.bincount(back, weights=self.range_max[entry], minlength=len(keys))
        able = keys[sums + self.common_most[keys % self.ranges] >= least - 1e-6] // self.ranges
        for k in distinct(able):
            low, high = np.searchsorted(window, [k, k + 1])
            yield int(np.searchsorted(base, k, "right")) - 1, terms[low:high].tolist()


def _overlap(runs: tuple[int, np.ndarray], own: dict[int, np.ndarray], words: np.ndarray) -> float:
    """The share of the runs that a document holds, given as its words' hashes; own keeps its runs by their size."""
    size, wanted = runs
    if size not in own:
        own[size] = _run_hashes(words, size)
    return float(np.isin(wanted, own[size], assume_unique=True).mean())


def _leaks(index: Index, text: pa.Array, share: float, question: float, answer: float) -> Iterator[tuple[int, int, float, float, float]]:
    """Row of the text, item, and the three figures, of each item that leaks."""
    numbers, words, offsets = normal_words(text)
    if not len(numbers):
        return
    terms = np.fromiter((index.terms.get(w, -1) for w in words), np.int64, len(words))[numbers]
    best: dict[int, dict[int, float]] = defaultdict(dict)
    for row, passage in index.passages(terms, offsets, share):
        for entry, score in index.retrieve(passage, share):
            item = index.item_of[entry]
            best[row][item] = max(best[row].get(item, 0.0), score)
    hashed = hashes(words) if best else np.zeros(0, np.uint64)
    for row, found in best.items():
        words_of = hashed[numbers[offsets[row] : offsets[row + 1]]]
        own: dict[int, np.ndarray] = {}
        for item, score in sorted(found.items()):
            q = _overlap(index.question[item], own, words_of)
            a = _overlap(index.answer[item], own, words_of)
            if q >= question and a >= answer:
                yield row, index.ids[item], score, q, a


def _indexes(benchmark: DataFrame, share: float) -> Iterator[Index]:
    """Indexes of the whole benchmark, each of so many bytes of text that it can be sent to all workers.

    The driver reads the benchmark's items one after another, twice: to count its words, of
    which it keeps the distinct ones, and to index it.
    """
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    whole = Statistics.of([])
    for row in rows.toLocalIterator():
        whole.add(parse(int(row.item_id), row.text))
    part: list[Item] = []
    size = 0
    for row in rows.toLocalIterator():
        part += parse(int(row.item_id), row.text)
        size += len(row.text)
        if part and size >= INDEX_BYTES:
            yield Index(part, share, whole)
            part, size = [], 0
    if part:
        yield Index(part, share, whole)


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """doc_id, item_id, bm25_share, question_overlap and answer_overlap of each item that a document holds.

    Words are compared in normal form (see common.normal). An item is retrieved if a
    passage's BM25 score is at least share of the score that the item has as its own
    query, and it leaks if the document holds as large a part of the runs of three
    words of its question, and of its answer. Items without words, null texts and null
    item ids find nothing; texts without words hold nothing. Repeated rows of docs each
    give rows, and equal items with different ids do; rows without doc_id have a null id.
    """
    found = None
    spark = docs.sparkSession
    source = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").where("text is not null")
    for index in _indexes(benchmark, share):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in chunks(batches, size=PIECE):
                rows = list(_leaks(shared.value, batch.column("text"), share, question, answer))
                if rows:
                    row, item, score, q, a = map(list, zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(row)), pa.array(item, pa.int64()), *(pa.array(np.round(x, 6)) for x in (score, q, a))],
                        ["doc_id", "item_id", "bm25_share", "question_overlap", "answer_overlap"],
                    )

        part = map_texts(source, run, SCHEMA)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item of the benchmark (see leaks).

    Rows with null, empty or wordless texts stay, as do all rows if the benchmark has no
    item; repeated rows all stay or all go. Columns of any name are passed on.
    """
    for index in _indexes(benchmark, share):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in chunks(batches, size=PIECE):
                keep = np.ones(len(batch), bool)
                keep[[row for row, *_ in _leaks(shared.value, batch.column("text"), share, question, answer)]] = False
                yield batch.filter(pa.array(keep))

        docs = map_texts(docs, run, docs.schema)
    return docs


def _runs_sql(words: str) -> str:
    """Distinct runs of RUN words, or of all if there are fewer, as strings."""
    return (
        f"list_distinct(list_transform(range(1, greatest(len({words}) - {RUN} + 1, least(len({words}), 1)) + 1), "
        f"lambda i: array_to_string({words}[i : i + least({RUN}, len({words})) - 1], ' ')))"
    )


def oracle_sql(share: float = SHARE, question: float = QUESTION, answer: float = ANSWER) -> str:
    """DuckDB's version of leaks(): every passage against every item, without an index."""
    half = PASSAGE // 2
    words = r"list_filter(list_transform(string_split_regex({0}, '[\s\p{{Z}}]+'), lambda w: regexp_replace(lower(w), '[^\p{{L}}\p{{N}}]', '', 'g')), lambda w: w <> '')"
    return rf"""
        WITH sentences AS (
          SELECT item_id, text, list_filter(list_transform(
                   string_split(replace(replace(replace(text, '? ', '?' || chr(10)), '. ', '.' || chr(10)), '! ', '!' || chr(10)), chr(10)),
                   lambda s: {words.format("s")}), lambda s: len(s) > 0) AS s
          FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
        items AS (
          SELECT row_number() OVER (ORDER BY item_id, text) AS k, item_id, flatten(s) AS words,
                 len(flatten(s)) - CASE WHEN len(s) > 1 THEN len(s[-1]) ELSE 0 END AS q
          FROM sentences WHERE len(s) > 0),
        entries AS (
          SELECT row_number() OVER (ORDER BY k, low) AS e, k,
                 CASE WHEN len(words) - low - {half} >= {half // 2} THEN words[low + 1 : low + {half}] ELSE words[low + 1 :] END AS words
          FROM (SELECT k, words, unnest(range(0, len(words), {half})) AS low FROM items)
          WHERE low = 0 OR len(words) - low >= {half // 2}),
        tf AS (SELECT e, w, count(*) AS c FROM (SELECT e, unnest(words) AS w FROM entries) GROUP BY e, w),
        idf AS (SELECT w, ln(1 + ((SELECT count(*) FROM entries) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY w),
        raw AS (
          SELECT e, w, idf * c * {K1 + 1} / (c + {K1} * ({1 - B} + {B} * len(words) / (SELECT avg(len(words)) FROM entries))) AS x
          FROM tf JOIN idf USING (w) JOIN entries USING (e)),
        postings AS (SELECT e, w, x / sum(x) OVER (PARTITION BY e) AS x FROM raw),
        docs AS (
          SELECT d, doc_id, {words.format("text")} AS words
          FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents WHERE text IS NOT NULL)),
        windows AS (
          SELECT d, words, unnest(range(0, greatest(1, CAST(ceil((len(words) - {half}) / {half}) AS BIGINT)))) AS p FROM docs),
        terms AS (SELECT DISTINCT d, p, unnest(words[p * {half} + 1 : p * {half} + {PASSAGE}]) AS w FROM windows),
        found AS (SELECT d, p, e, sum(x) AS score FROM terms JOIN postings USING (w) GROUP BY d, p, e HAVING sum(x) >= {share} - 1e-9),
        best AS (SELECT d, k, max(score) AS score FROM found JOIN entries USING (e) GROUP BY d, k),
        runs AS (
          SELECT k, item_id, {_runs_sql("words[1 : q]")} AS question,
                 {_runs_sql("(CASE WHEN q < len(words) THEN words[q + 1 :] ELSE words END)")} AS answer
          FROM items),
        held AS (
          SELECT doc_id, item_id, score, question, answer, docs.words AS w FROM best JOIN runs USING (k) JOIN docs USING (d)),
        shares AS (
          SELECT doc_id, item_id, score,
                 len(list_filter(question, lambda r: contains(' ' || array_to_string(w, ' ') || ' ', ' ' || r || ' '))) / len(question) AS a,
                 len(list_filter(answer, lambda r: contains(' ' || array_to_string(w, ' ') || ' ', ' ' || r || ' '))) / len(answer) AS b
          FROM held)
        SELECT doc_id, item_id, round(score, 6) AS bm25_share, round(a, 6) AS question_overlap, round(b, 6) AS answer_overlap
        FROM shares WHERE a >= {question} AND b >= {answer}"""
