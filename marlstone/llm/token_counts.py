"""Token counts by a linear longest-match automaton.

A word's greedy pieces are never built. The vocabulary's trie has a failure link
for each state and, stored with it, how many pieces are popped when the link is
taken; a word's count is the sum over its links (Song et al., 2021). All distinct
words of a chunk of text go through the automaton together, a byte at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from marlstone.llm.common import chunks, map_texts, per_text, split_words

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
SCHEMA = "doc_id bigint, n_words bigint, n_tokens bigint"
_FEW = 24  # as few words are walked one by one


def byte_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The tokens of a byte-level vocabulary file as bytes."""
    with open(path, encoding="utf-8") as file:
        names = json.load(file)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [bytes(of[c] for c in name) for name in names if all(c in of for c in name)]


class LongestMatch:
    """The automaton of a vocabulary of first pieces and of continuations.

    A word is met as a space and its bytes; pieces that begin with a space are
    first pieces, all others continue a word.
    """

    def __init__(self, vocabulary: Iterable[bytes]) -> None:
        children: list[dict[int, int]] = [{}, {}]  # state 0 begins a word, state 1 follows a piece
        whole = {0: False, 1: False}
        for piece in vocabulary:
            if not piece:
                continue
            state = 0 if piece[0] == 32 else 1
            for byte in piece:
                if byte not in children[state]:
                    children[state][byte] = len(children)
                    children.append({})
                state = children[state][byte]
            whole[state] = True
        n = len(children)
        self.link = np.full(n, -1, np.int32)  # -1: no piece fits
        self.popped = np.zeros(n, np.int32)
        order = [0, 1]
        for state in order:
            for byte, child in children[state].items():
                if whole.get(child):
                    self.link[child], self.popped[child] = 1, 1
                else:
                    at, count = int(self.link[state]), int(self.popped[state])
                    while at >= 0 and byte not in children[at]:
                        count += int(self.popped[at])
                        at = int(self.link[at])
                    self.link[child], self.popped[child] = (children[at][byte], count) if at >= 0 else (-1, 0)
                order.append(child)
        rows = [s for s in range(n) if children[s]]
        self.row = np.zeros(n, np.int32)  # row 0 is of states that nothing follows
        self.row[rows] = np.arange(1, len(rows) + 1)
        self.table = np.full((len(rows) + 1, 256), -1, np.int32)
        for k, s in enumerate(rows, 1):
            self.table[k, list(children[s])] = list(children[s].values())
        self.rest = np.zeros(n, np.int64)  # pieces that the end of the word pops; -1: none fits
        for s in order:
            at, count = s, 0
            while at > 1:
                count += int(self.popped[at])
                at = int(self.link[at])
            self.rest[s] = -1 if at != 1 and s > 1 else count

    def one(self, word: bytes) -> int:
        """Pieces of a word given with its first space; 1 if no piece fits somewhere."""
        state = count = 0
        for byte in word:
            while (to := int(self.table[self.row[state], byte])) < 0:
                count += int(self.popped[state])
                state = int(self.link[state])
                if state < 0:
                    return 1
            state = to
        return count + int(self.rest[state]) if self.rest[state] >= 0 else 1

    def counts(self, words: pa.Array) -> np.ndarray:
        """Pieces of each word of an array of strings, each met as a space and its bytes."""
        if not len(words):
            return np.zeros(0, np.int64)
        words = words.cast(pa.large_string())
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        order = np.argsort(ends[:-1] - ends[1:], kind="stable")  # longest first
        start, length = ends[:-1][order], np.diff(ends)[order]
        n = len(order)
        state, count, lost = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
        active, step = n, -1
        while active > _FEW:
            byte = data[start[:active] + step] if step >= 0 else np.full(active, 32, np.uint8)
            at = state[:active]
            to = self.table[self.row[at], byte]
            stuck = np.flatnonzero((to < 0) & ~lost[:active])
            while len(stuck):
                here = at[stuck]
                count[stuck] += self.popped[here]
                here = self.link[here]
                lost[stuck[here < 0]] = True
                stuck, here = stuck[here >= 0], here[here >= 0]
                at[stuck] = here
                next_ = self.table[self.row[here], byte[stuck]]
                to[stuck] = next_
                stuck = stuck[next_ < 0]
            state[:active] = np.maximum(to, 0)
            step += 1
            active = int(np.searchsorted(-length, -step, "left"))
        rest = self.rest[state]
        out = np.where(lost | (rest < 0), 1, count + np.maximum(rest, 0))
        for k in range(active):  # the few that are longer than all others
            out[k] = self.one(b" " + data[start[k] : start[k] + length[k]].tobytes())
        result = np.empty(n, np.int64)
        result[order] = np.where(length > 0, out, 0)
        return result


def token_counts(docs: DataFrame, vocabulary: str | Iterable[bytes] = VOCABULARY) -> DataFrame:
    """Words and greedy tokens of each document: doc_id, n_words, n_tokens.

    A word is what white space separates; it is counted as a space and its UTF-8
    bytes. A word for which no piece fits counts as one unknown token. A null text
    has null counts, an empty or blank one 0. Each row of the input gives one row,
    repeated rows and null ids too; other columns are not read.
    """
    pieces = byte_vocabulary(vocabulary) if isinstance(vocabulary, str) else list(vocabulary)
    # its size follows from the vocabulary alone: about 1 KB for each state that has a successor
    shared = docs.sparkSession.sparkContext.broadcast(LongestMatch(pieces))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in chunks(batches):
            text = batch.column("text")
            index, words, offsets = split_words(text)
            pieces_of = automaton.counts(words)
            filled = (pc.binary_length(words).to_numpy(zero_copy_only=False) > 0).astype(np.int64)
            none = pc.is_null(text).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(per_text(filled[index], offsets), mask=none), pa.array(per_text(pieces_of[index], offsets), mask=none)],
                ["doc_id", "n_words", "n_tokens"],
            )

    return map_texts(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), count, SCHEMA)
