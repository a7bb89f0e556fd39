"""License scans by a positional index of rare words.

The templates of licence notices are indexed by word: each of a phrase's rarest words, by
inverse document frequency over all files, has a posting with the phrase and the word's
position in it. A file's licence words are looked up from those of the highest frequency
weight on. A posting says where the phrase would begin in the file; the postings of the
phrase's next rarest words must say the same, so that the sets of such places are
intersected, and where all agree the mandatory phrases are verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlstone.llm.common import chunks, distinct, map_texts, normal_array, normal_words

SCHEMA = "doc_id bigint, license string, first_word bigint, n_matches bigint"
SLACK = 12  # words that may stand between two mandatory phrases
DEPTH = 3  # of a phrase's words so many have postings, the rarest ones; all words are verified


@dataclass(frozen=True)
class Template:
    """A licence and the phrases that a notice of it must hold, in this order."""

    license: str
    phrases: tuple[str, ...]


TEMPLATES = (
    Template("MIT", ("under the MIT License",)),
    Template("MIT", ("Permission is hereby granted, free of charge, to any person obtaining a copy", "to deal in the Software without restriction")),
    Template("Apache-2.0", ("under the Apache License, Version 2.0",)),
    Template("GPL-2.0", ("under the GNU General Public License, version 2",)),
    Template("GPL-3.0", ("under the GNU General Public License, version 3",)),
    Template("GPL", ("under the terms of the GNU General Public License", "as published by the Free Software Foundation")),
    Template("LGPL", ("under the GNU Lesser General Public License",)),
    Template("LGPL", ("under the terms of the GNU Lesser General Public License", "as published by the Free Software Foundation")),
    Template("AGPL", ("under the GNU Affero General Public License",)),
    Template("AGPL", ("under the terms of the GNU Affero General Public License", "as published by the Free Software Foundation")),
    Template("BSD", ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that",)),
    Template("BSD", ("under the BSD License",)),
    Template("MPL-2.0", ("subject to the terms of the Mozilla Public License, v. 2.0",)),
    Template("ISC", ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",)),
    Template("Unlicense", ("This is free and unencumbered software released into the public domain",)),
    Template("CC-BY-4.0", ("under CC BY 4.0",)),
    Template("CC-BY-SA-4.0", ("under CC BY-SA 4.0",)),
    Template("CC-BY-NC-4.0", ("under CC BY-NC 4.0",)),
    Template("CC-BY-ND-4.0", ("under CC BY-ND 4.0",)),
    Template("CC-BY-4.0", ("under a Creative Commons Attribution 4.0 International License",)),
    Template("CC-BY-SA-4.0", ("under a Creative Commons Attribution-ShareAlike 4.0 International License",)),
    Template("CC-BY-NC-4.0", ("under a Creative Commons Attribution-NonCommercial 4.0 International License",)),
    Template("CC0-1.0", ("under CC0 1.0 Universal",)),
    Template("CC0-1.0", ("dedicated to the public domain", "CC0")),
)


def phrase_words(phrase: str) -> list[str]:
    """The phrase's words in normal form."""
    return [n for n in normal_array(pa.array(phrase.split(), pa.string())).to_pylist() if n]


class LicenseIndex:
    """Postings (phrase, position) by word, for each phrase's rarest word, the next rarest, and so on to DEPTH."""

    def __init__(self, templates: Sequence[Template], slack: int = SLACK) -> None:
        self.slack = slack
        self.names = [t.license for t in templates]
        phrases = [[w for p in t.phrases if (w := phrase_words(p))] for t in templates]
        self.words = sorted({w for t in phrases for p in t for w in p})
        self.number = {w: k for k, w in enumerate(self.words)}
        self.phrases = [np.array([self.number[w] for w in p], np.int64) for t in phrases for p in t]
        ends = np.cumsum([len(t) for t in phrases]).tolist()
        self.of_template = [range(end - len(t), end) for end, t in zip(ends, phrases, strict=True)]
        self.rank([0] * len(self.words), 1)

    def rank(self, df: Sequence[int], files: int) -> None:
        """Sets the words' inverse document frequencies from the numbers of files that hold them, and the postings."""
        self.idf = np.log((1 + files) / (1 + np.asarray(df, float)))
        rarest = [np.lexsort((np.arange(len(p)), -self.idf[p]))[:DEPTH] for p in self.phrases]
        # at each depth, CSR by word: which phrases have the word as their rarest, second rarest, ..., and where
        self.postings = []
        for depth in range(DEPTH):
            have = [(int(p[r[depth]]), k, int(r[depth])) for k, (p, r) in enumerate(zip(self.phrases, rarest, strict=True)) if depth < len(r)]
            word, phrase, at = np.array(sorted(have), np.int64).reshape(-1, 3).T
            self.postings.append((np.searchsorted(word, np.arange(len(self.words) + 1)), phrase, at))

    def _places(self, depth: int, coded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Keys (place where the phrase would begin, phrase) of all postings at this depth of the words at these places."""
        first, phrase, position = self.postings[depth]
        word = coded[at]
        n = first[word + 1] - first[word]
        some = n > 0
        at, word, n = at[some], word[some], n[some]
        entry = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first[word], n)
        return (np.repeat(at, n) - position[entry]) * len(self.phrases) + phrase[entry]

    def phrases_in(self, coded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and first place of each phrase that stands in a file; files are given one after another as their words' numbers (-1: in no template)."""
        known = np.flatnonzero(coded >= 0)
        found = distinct(self._places(0, coded, known))
        for depth in range(1, DEPTH):
            if not len(found):
                break
            # only files in which a phrase's rarer words stand are looked up further
            file = np.searchsorted(offsets, np.maximum(found // len(self.phrases), 0), "right") - 1
            mine = np.zeros(len(offsets), bool)
            mine[file] = True
            known = known[mine[np.searchsorted(offsets, known, "right") - 1]]
            short = np.array([len(p) <= depth for p in self.phrases])[found % len(self.phrases)]
            found = found[short | np.isin(found, self._places(depth, coded, known))]
        place, phrase = np.divmod(found, max(1, len(self.phrases)))
        keep = place >= 0
        place, phrase = place[keep], phrase[keep]
        size = np.array([len(p) for p in self.phrases] or [0])[phrase]
        inside = place + size <= offsets[np.searchsorted(offsets, place, "right")] if len(place) else np.zeros(0, bool)
        place, phrase = place[inside], phrase[inside]
        stands = np.zeros(len(place), bool)
        for k in np.unique(phrase).tolist():
            which = np.flatnonzero(phrase == k)
            words = self.phrases[k]
            stands[which] = (coded[place[which, None] + np.arange(len(words))] == words).all(axis=1)
        return phrase[stands], place[stands]

    def find(self, coded: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, int, int]]:
        """File, licence, first word and number of notices, for all licences of all files."""
        phrase, place = self.phrases_in(coded, offsets)
        begins: dict[tuple[int, str], set[int]] = {}
        where = {k: set(place[phrase == k].tolist()) for k in np.unique(phrase).tolist()}
        for name, own in zip(self.names, self.of_template, strict=True):
            if not own or any(p not in where for p in own):
                continue
            # from the last phrase to the first: where one begins after which the others follow in reach
            starts = where[own[-1]]
            for p in reversed(own[:-1]):
                size = len(self.phrases[p])
                starts = {s for s in where[p] if any(s + size + gap in starts for gap in range(self.slack + 1))}
            for s in starts:
                file = int(np.searchsorted(offsets, s, "right")) - 1
                if len(own) > 1 and not self._all_within(own, s, where, int(offsets[file + 1])):
                    continue
                begins.setdefault((file, name), set()).add(s - int(offsets[file]))
        return [(file, name, min(b), len(b)) for (file, name), b in sorted(begins.items())]

    def _all_within(self, own: range, start: int, where: dict[int, set[int]], end: int) -> bool:
        """Whether phrases follow from start on that all stand in the same file, which ends at end."""
        reach = {start}
        for p, q in zip(own, own[1:], strict=False):
            size = len(self.phrases[p])
            reach = {s for r in reach for s in range(r + size, r + size + self.slack + 1) if s in where[q] and s + len(self.phrases[q]) <= end}
        return bool(reach)


def _numbers(index: LicenseIndex, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    numbers, words, offsets = normal_words(text)
    coded = np.fromiter((index.number.get(w, -1) for w in words), np.int64, len(words))
    return (coded[numbers] if len(numbers) else np.zeros(0, np.int64)), offsets


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, slack: int = SLACK) -> DataFrame:
    """doc_id, license, first_word and n_matches of each licence that a document names.

    Words are compared in normal form (see common.normal) and counted from 0.
    A notice holds a template's phrases in order, each beginning at most slack words
    after the one before ends; first_word is where the first notice begins, n_matches
    how many places a notice begins at. Texts that are null, empty or without notice
    give no row; repeated rows each give rows, rows without doc_id have a null id.
    Other columns are not read. Templates without words match nothing.
    """
    index = LicenseIndex(templates, slack)
    spark = docs.sparkSession
    source = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").where("text is not null")
    plain = spark.sparkContext.broadcast(index)  # a few KB

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = plain.value
        df, files = np.zeros(len(index.words), np.int64), 0
        for batch in chunks(batches):
            coded, offsets = _numbers(index, batch.column("text"))
            row = np.repeat(np.arange(len(batch), dtype=np.int64), np.diff(offsets))
            known = coded >= 0
            both = distinct(row[known] * len(index.words) + coded[known])
            df += np.bincount(both % max(1, len(index.words)), minlength=len(index.words))
            files += len(batch)
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(df)), -1]), pa.array([*df.tolist(), files])], ["word", "n"])

    if not index.words:
        return spark.createDataFrame([], SCHEMA)
    counted = map_texts(source.select("doc_id", "text"), frequencies, "word bigint, n bigint").groupBy("word").sum("n").collect()
    df = {r[0]: r[1] for r in counted}  # a row for each word of the templates
    index.rank([df.get(k, 0) for k in range(len(index.words))], df.get(-1, 0))
    shared = spark.sparkContext.broadcast(index)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in chunks(batches):
            coded, offsets = _numbers(index, batch.column("text"))
            out = index.find(coded, offsets)
            if out:
                row, name, first, n = map(list, zip(*out, strict=True))
                ids = batch.column("doc_id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(name), pa.array(first, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "license", "first_word", "n_matches"])

    return map_texts(source, find, SCHEMA)


def oracle_sql(templates: Sequence[Template] = TEMPLATES, slack: int = SLACK) -> str:
    """DuckDB's version: a regular expression over all words of every document, for templates of one phrase or more."""
    between = f"(?:[^ ]+ ){{0,{slack}}}"
    rows = ", ".join(f"('{t.license}', '{between.join(' '.join(phrase_words(p)) + ' ' for p in t.phrases)}')" for t in templates)
    return rf"""
        WITH notices(license, pattern) AS (VALUES {rows}),
        normal AS (
          SELECT doc_id, ' ' || list_aggregate(list_filter(list_transform(
                   string_split_regex(text, '[\s\p{{Z}}]+'), lambda w: regexp_replace(lower(w), '[^\p{{L}}\p{{N}}]', '', 'g')),
                   lambda w: w <> ''), 'string_agg', ' ') || ' ' AS words
          FROM documents WHERE text IS NOT NULL),
        matched AS (
          SELECT doc_id, license, regexp_extract(words, '^(.*?) ' || pattern, 1) AS before,
                 len(regexp_extract_all(words, ' ' || pattern)) AS n
          FROM normal, notices WHERE regexp_matches(words, ' ' || pattern))
        SELECT doc_id, license,
               min(CASE WHEN before = '' THEN 0 ELSE len(string_split(trim(before), ' ')) END) AS first_word,
               CAST(sum(n) AS BIGINT) AS n_matches
        FROM matched GROUP BY doc_id, license"""
