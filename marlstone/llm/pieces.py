"""SentencePiece encoding by a prefix table, and decoding.

In a model of merges every prefix of a text has one encoding, so it has one last
token. The table holds that token for each prefix: of the tokens that end there, as
an automaton of all tokens reports them, it is the one that stays whole beside the
last token of the prefix before it. Reading the table backwards recovers the ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.llm.common import chunks, fresh, map_texts, per_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_CACHED = 400_000  # segments that a worker remembers; it begins anew beyond that
_NEVER = 1 << 60
_PAIRS = 1 << 20  # pairs of tokens that a worker remembers
_TOGETHER = 1 << 14  # words whose tables are filled together
_LONGEST = 96  # bytes of a word that goes with others


class PieceModel:
    """The pieces of a model file of kind BPE, with byte fallback if the model has it."""

    def __init__(self, proto: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(proto)
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.precompiled_charsmap or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model without normalisation is needed")
        self.dummy_prefix = model.normalizer_spec.add_dummy_prefix
        self.trim = model.normalizer_spec.remove_extra_whitespaces
        if self.trim:
            raise ValueError("a model that keeps all white space is needed, or texts can't be recovered")
        self.pieces = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        self.unknown = kinds.index(2)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, kind) in enumerate(zip(self.pieces, kinds, strict=True)) if kind == 6}
        self.ids = {p: i for i, (p, kind) in enumerate(zip(self.pieces, kinds, strict=True)) if kind == 1}
        order = sorted(self.ids.values(), key=lambda i: (-model.pieces[i].score, i))
        self.rank = {i: k for k, i in enumerate(order)}
        self.bytes_of = [b""] * len(self.pieces)
        for p, i in self.ids.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([b])
        self.alphabet = {p for p in self.ids if len(p) == 1}
        # words can be encoded one by one unless a piece goes on beyond a word's end
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.halves: dict[int, tuple[int, int]] = {}  # the last merge that makes a piece
        for p, i in self.ids.items():
            if len(p) > 1:
                parts = self._merged(p, stop=2)
                if len(parts) == 2 and p == self.pieces[parts[0]] + self.pieces[parts[1]]:
                    self.halves[i] = (parts[0], parts[1])
        live = [p for p in self.ids if len(p) == 1 or self.ids[p] in self.halves]  # others are never produced
        self._tables(live)
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _merged(self, text: str, stop: int = 1) -> list[int]:
        """Merging pair by pair, the best rank first and the leftmost of equals; for short texts."""
        parts = [self.ids[c] if c in self.ids else -1 for c in text]
        names = list(text)
        while len(parts) > stop:
            best, at = _NEVER, -1
            for k in range(len(parts) - 1):
                rank = self.rank.get(self.ids.get(names[k] + names[k + 1], -1), _NEVER)
                if rank < best:
                    best, at = rank, k
            if at < 0:
                break
            names[at : at + 2] = [names[at] + names[at + 1]]
            parts[at : at + 2] = [self.ids[names[at]]]
        return parts

    def _tables(self, live: list[str]) -> None:
        """The automaton of all tokens over bytes, and all merges, as arrays."""
        goto: list[dict[int, int]] = [{}]
        own, depth = [-1], [0]
        for piece in live:
            state = 0
            for byte in self.bytes_of[self.ids[piece]]:
                if byte not in goto[state]:
                    goto[state][byte] = len(goto)
                    goto.append({})
                    own.append(-1)
                    depth.append(depth[state] + 1)
                state = goto[state][byte]
            own[state] = self.ids[piece]
        link = np.zeros(len(goto), np.int32)
        ends: list[tuple[tuple[int, int], ...]] = [()] * len(goto)
        order = [0]
        for state in order:
            if state:
                ends[state] = (((depth[state], own[state]),) if own[state] >= 0 else ()) + ends[link[state]]
            for byte, child in goto[state].items():
                at = int(link[state])
                while at and byte not in goto[at]:
                    at = int(link[at])
                link[child] = goto[at].get(byte, 0) if state else 0
                order.append(child)
        rows = [s for s in range(len(goto)) if goto[s]]
        self.b_row = np.zeros(len(goto), np.int32)
        self.b_row[rows] = np.arange(1, len(rows) + 1)
        self.b_goto = np.full((len(rows) + 1, 256), -1, np.int32)
        for k, s in enumerate(rows, 1):
            self.b_goto[k, list(goto[s])] = list(goto[s].values())
        root = self.b_goto[self.b_row[0]]
        root[root < 0] = 0  # the root takes every byte
        self.b_link = link
        self.b_first = np.cumsum([0, *map(len, ends)]).astype(np.int32)
        self.b_length = np.array([e[0] for x in ends for e in x], np.int32)
        self.b_id = np.array([e[1] for x in ends for e in x], np.int32)
        n = len(self.pieces)
        self.a_rank = np.full(n, -1, np.int64)  # -1: it comes from no merge
        self.a_left, self.a_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, (a, b) in self.halves.items():
            self.a_rank[i], self.a_left[i], self.a_right[i] = self.rank[i], a, b
        merges = sorted(
            (self.ids[p[:k]] * n + self.ids[p[k:]], self.rank[i]) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids
        )
        self.m_key = np.array([*(m[0] for m in merges), _NEVER], np.int64)
        self.m_rank = np.array([*(m[1] for m in merges), _NEVER], np.int64)
        self.c_key = np.full(_PAIRS, -1, np.int64)  # pairs met so far and whether they fit; a new pair takes the place of another
        self.c_fit = np.zeros(_PAIRS, bool)

    def _compatible_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() of many pairs."""
        n = len(self.pieces)
        result = np.zeros(len(a), bool)
        here, limit = np.arange(len(a)), np.full(len(a), _NEVER)
        while len(here):
            key = a * n + b
            at = np.searchsorted(self.m_key, key)
            go = np.where(self.m_key[at] == key, self.m_rank[at], _NEVER) >= limit
            here, a, b, limit = here[go], a[go], b[go], limit[go]
            ra, rb = self.a_rank[a], self.a_rank[b]
            done = (ra < 0) & (rb < 0)
            result[here[done]] = True
            left = ra > rb
            a, b = np.where(left, self.a_right[a], a), np.where(left, b, self.a_left[b])
            limit = np.where(left, ra, rb + 1)
            here, a, b, limit = here[~done], a[~done], b[~done], limit[~done]
        return result

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * len(self.pieces) + b
        slot = ((key * 0x9E3779B1) >> 12) & (_PAIRS - 1)
        new = self.c_key[slot] != key
        result = self.c_fit[slot]
        if new.any():
            fresh_keys, back = np.unique(key[new], return_inverse=True)
            fit = self._compatible_many(fresh_keys // len(self.pieces), fresh_keys % len(self.pieces))
            result[new] = fit[back]
            slot = ((fresh_keys * 0x9E3779B1) >> 12) & (_PAIRS - 1)
            slot, one = np.unique(slot, return_index=True)
            self.c_key[slot], self.c_fit[slot] = fresh_keys[one], fit[one]
        return result

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, one after another, and how many each has. A space stands for SPACE.

        The prefix tables of words of like length are filled together, a byte of each
        at a time. Long words, and words with a character that is no piece, are left
        to encode_segment.
        """
        words = words.cast(pa.large_string())
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        length = np.diff(ends)
        order = np.argsort(length, kind="stable")
        size = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, their ids padded, which are ids
        slow: dict[int, list[int]] = {}
        for low in range(0, len(order), _TOGETHER):
            block = order[low : low + _TOGETHER]
            short = block[(length[block] <= _LONGEST) & (length[block] > 0)]
            alone = block[length[block] > _LONGEST]
            if len(short):
                ids, count = self._table_of(data, ends[short], length[short])
                good = count > 0
                size[short[good]] = count[good]
                found.append((short[good], ids[good], np.arange(ids.shape[1]) >= ids.shape[1] - count[good][:, None]))
                alone = np.concatenate([alone, short[~good]])
            for k in alone.tolist():
                slow[k] = list(self.encode_segment(data[ends[k] : ends[k + 1]].tobytes().decode().replace(" ", SPACE)))
                size[k] = len(slow[k])
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        for which, ids, here in found:
            count = size[which]
            out[np.repeat(start[which] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))] = ids[here]
        for k, ids in slow.items():
            out[start[k] : start[k] + len(ids)] = ids
        return out, size

    def _table_of(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, to the right of each row, and their count; 0 where a character is no piece. Lengths ascend."""
        n, width = len(begin), int(length[-1])
        last = np.full((width + 1, n), -1, np.int32)  # the last token of each prefix; its length
        span = np.zeros((width + 1, n), np.int32)
        state = np.zeros(n, np.int32)
        first = 0
        for at in range(1, width + 1):
            first = int(np.searchsorted(length, at))
            s = state[first:]
            byte = data[begin[first:] + at - 1]
            to = self.b_goto[self.b_row[s], byte]
            stuck = np.flatnonzero(to < 0)
            while len(stuck):
                s[stuck] = self.b_link[s[stuck]]
                next_ = self.b_goto[self.b_row[s[stuck]], byte[stuck]]
                to[stuck] = next_
                stuck = stuck[next_ < 0]
            state[first:] = to
            candidate, stop = self.b_first[to], self.b_first[to + 1]
            row = np.flatnonzero(candidate < stop)
            candidate, stop = candidate[row], stop[row]
            row = row + first
            while len(row):
                token, back = self.b_id[candidate], at - self.b_length[candidate]
                before = last[back, row]
                fit = back == 0
                test = np.flatnonzero(~fit & (before >= 0))
                fit[test] = self._fit(before[test], token[test])
                done = row[fit]
                last[at, done], span[at, done] = token[fit], self.b_length[candidate[fit]]
                candidate, stop, row = candidate[~fit] + 1, stop[~fit], row[~fit]
                more = candidate < stop
                candidate, stop, row = candidate[more], stop[more], row[more]
        ids, count = np.zeros((n, width), np.int32), np.zeros(n, np.int64)
        row = np.arange(n)
        at = length.copy()
        good = last[at, row] >= 0
        row, at = row[good], at[good]
        column = width - 1
        while len(row):
            ids[row, column] = last[at, row]
            count[row] += 1
            at = at - span[at, row]
            row, at = row[at > 0], at[at > 0]
            column -= 1
        return ids, count

    def compatible(self, left: int, right: int) -> bool:
        """Whether left and right stay whole when they meet.

        Both are taken apart by their last merges, the later merge first; a merge
        across the border that comes before the one just undone would have broken them.
        """
        key = (left, right)
        if (found := self.fits.get(key)) is not None:
            return found
        rank, halves, ids, pieces = self.rank, self.halves, self.ids, self.pieces
        limit, a, b = _NEVER, left, right
        while True:
            across = rank.get(ids.get(pieces[a] + pieces[b], -1), _NEVER)
            if across < limit:
                result = False
                break
            ra, rb = (rank[x] if x in halves else -1 for x in (a, b))
            if ra < 0 and rb < 0:
                result = True
                break
            if ra > rb:
                limit, a = ra, halves[a][1]  # of equal ranks the left merge comes first
            else:
                limit, b = rb + 1, halves[b][0]
        self.fits[key] = result
        return result

    def _encode_known(self, text: str) -> list[int]:
        """Of a text whose every character is a piece."""
        if (whole := self.ids.get(text)) is not None and (whole in self.halves or len(text) == 1):
            return [whole]
        last: list[tuple[int, int]] = [(0, -1)]  # of each prefix, in bytes: length and id of the last token
        state = at = 0
        for byte in text.replace(SPACE, " ").encode():
            at += 1
            while (to := int(self.b_goto[self.b_row[state], byte])) < 0:
                state = int(self.b_link[state])
            state = to
            found = (0, -1)
            for k in range(self.b_first[state], self.b_first[state + 1]):  # tokens that end here, the longest first
                length, token = int(self.b_length[k]), int(self.b_id[k])
                left = last[at - length][1]
                if at == length or (left >= 0 and self.compatible(left, token)):
                    found = (length, token)
                    break
            last.append(found)
        ids = []
        while at:
            length, token = last[at]
            ids.append(token)
            at -= length
        ids.reverse()
        return ids

    def encode_segment(self, segment: str) -> tuple[int, ...]:
        """Ids of a piece of text with its spaces as SPACE; characters without a piece stand apart."""
        if (known := self.known.get(segment)) is not None:
            return known
        ids: list[int] = []
        low = 0
        for k, c in enumerate(segment):
            if c not in self.alphabet:
                if k > low:
                    ids += self._encode_known(segment[low:k])
                ids += [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unknown]
                low = k + 1
        if low < len(segment):
            ids += self._encode_known(segment[low:] if low else segment)
        if len(segment) <= 64:
            if len(self.known) >= _CACHED:
                self.known.clear()
            self.known[segment] = tuple(ids)
        return tuple(ids)

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        text = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        return _RUNS.findall(text) if self.by_word else [text]

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return list(chain.from_iterable(map(self.encode_segment, self.segments(text))))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts before it."""
        data = b"".join([self.bytes_of[i] for i in ids])
        return (data[1:] if self.dummy_prefix and data[:1] == b" " else data).decode("utf-8", "replace")


_loaded: dict[int, PieceModel] = {}


def _model(proto: bytes) -> PieceModel:
    """One model for each worker, kept between tasks."""
    key = hash(proto)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceModel(proto)
    return _loaded[key]


def _encoded(model: PieceModel, text: pa.Array) -> pa.Array:
    """Lists of ids."""
    none = pc.is_null(text).to_numpy(zero_copy_only=False)
    text = pc.fill_null(text, "")
    plain = np.zeros(len(text), bool)
    if model.by_word and model.dummy_prefix and 10 in model.byte_ids and "\n" not in model.alphabet:
        # a run of spaces, or SPACE itself, can make pieces that a split by single spaces cuts
        plain = ~pc.match_substring_regex(text, f"{SPACE}|  |^ |^$").to_numpy(zero_copy_only=False)
    lines = pc.split_pattern(text.filter(pa.array(plain)), "\n")
    words = pc.split_pattern(lines.flatten(), " ")
    coded = words.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_lines = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    per_line = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    line_at = np.cumsum(per_line) - per_line
    later = np.ones(len(per_line), bool)
    later[(np.cumsum(n_lines) - n_lines).astype(np.int64)] = False  # not a text's first line: its first word follows a line break, not a space
    heads, back = np.unique(index[line_at[later]], return_inverse=True)
    n_words = len(coded.dictionary)
    index[line_at[later]] = n_words + back
    lengths = np.zeros(len(text), np.int64)
    lengths[plain] = per_text(per_line, np.concatenate([[0], np.cumsum(n_lines)]))
    ids, size = model.encode_words(pc.binary_join_element_wise("", coded.dictionary, " "))
    head_words = coded.dictionary.take(pa.array(heads))
    head_ids, head_size = model.encode_words(head_words)
    line_break = model.byte_ids.get(10, 0)
    broken = np.insert(head_ids, np.cumsum(head_size) - head_size, line_break) if len(heads) else head_ids
    known = len(coded.dictionary) + len(head_words)
    parts, counts = [ids, broken.astype(np.int32)], [size, head_size + 1]
    if not plain.all():
        number: dict[str, int] = {}
        slow = [(k, [number.setdefault(s, known + len(number)) for s in model.segments(text[k].as_py())]) for k in np.flatnonzero(~plain).tolist()]
        lengths[[k for k, _ in slow]] = [len(own) for _, own in slow]
        ends = np.cumsum(lengths)
        whole = np.empty(int(ends[-1]), np.int64)
        whole[np.repeat(plain, lengths)] = index
        for k, own in slow:
            whole[ends[k] - len(own) : ends[k]] = own
        index = whole
        rest = [model.encode_segment(s) for s in number]
        parts.append(np.fromiter(chain.from_iterable(rest), np.int32))
        counts.append(np.fromiter(map(len, rest), np.int64, len(rest)))
    flat, size = np.concatenate(parts), np.concatenate(counts)
    start = np.cumsum(size) - size
    each = size[index]
    begins = np.cumsum(each) - each
    out = flat[np.arange(int(each.sum())) - np.repeat(begins - start[index], each)]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.concatenate([[0], np.cumsum(each)])[bounds].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(none, False)) if none.any() else pa.array(ends), pa.array(out))
    return lists


def _decoded(model: PieceModel, lists: pa.Array) -> pa.Array:
    """The bytes of lists of ids, without the space that encoding puts first."""
    found = pa.array(model.bytes_of, pa.large_binary()).take(lists.flatten())
    ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int64)
    data = np.frombuffer(found.buffers()[2] or b"", np.uint8)[: ends[-1]]
    none = pc.is_null(lists).to_numpy(zero_copy_only=False)
    n = np.where(none, 0, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    bounds = ends[np.concatenate([[0], np.cumsum(n, dtype=np.int64)])]
    if model.dummy_prefix and len(data):
        first = bounds[:-1][bounds[1:] > bounds[:-1]]
        first = first[data[first] == 32]
        kept = np.ones(len(data), bool)
        kept[first] = False
        data, bounds = data[kept], bounds - np.searchsorted(first, bounds)
    mask = pa.array(~none).buffers()[1] if none.any() else None
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [mask, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Ids of each document: doc_id, ids, n_ids, round_trip.

    The ids of each text are decoded again; round_trip tells whether that gives the text
    byte for byte: always, but for texts that hold U+2581, which the model takes for a space. A null text has
    null ids, count and round_trip; an empty one no ids, and it does come back. Each
    row of the input gives one row, repeated rows and null ids too; other columns
    are not read. Texts are encoded whole, however long.
    """
    with open(model, "rb") as file:
        # its size is the model file's
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(shared.value)
        for batch in chunks(batches, size=4 << 20):
            text = batch.column("text")
            ids = _encoded(pieces, text)
            same = pc.equal(_decoded(pieces, ids), text.cast(pa.large_string()).cast(pa.large_binary()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pc.list_value_length(ids), same], ["doc_id", "ids", "n_ids", "round_trip"])

    schema = "doc_id bigint, ids array<int>, n_ids int, round_trip boolean"
    return map_texts(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, schema)


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """The table with a column of the ids' texts: decoded_text, or that name with _ if it is taken.

    Null ids give null, no ids the empty text; an id outside the model, or null, fails
    the query. Bytes that are not UTF-8 become U+FFFD.
    """
    with open(model, "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())
    [name] = fresh(encoded, "decoded_text")
    schema = T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(shared.value)
        for batch in batches:
            own = batch.column(ids)
            if own.flatten().null_count:
                raise ValueError("an id is null")
            texts = [None if x is None else x.decode("utf-8", "replace") for x in _decoded(pieces, own).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return map_texts(encoded, run, schema)
