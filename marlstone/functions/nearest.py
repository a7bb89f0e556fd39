"""Blocks of vectors, and the nearest of one block's vectors among another's.

Similarity is cosine in double precision, summed from the first entry to the last and
held between -1 and 1, as DuckDB does it, so that equal similarities are equal to the last bit. A matrix
product in single precision tells which pairs can be the best; only those are computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

HEIGHT, WIDTH = 384, 512  # vectors of either side in one product
CHUNK = 1 << 13  # pairs computed at a time
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Side:
    """Vectors of one length by id: as they are, their squared norms, and at length 1 in single precision."""

    ids: np.ndarray
    x: np.ndarray
    squares: np.ndarray
    unit: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    products = np.ascontiguousarray((a.astype(np.float64) * b).T)
    total = np.zeros(len(a))
    for p in products:
        total += p
    return total


def _squares(x: np.ndarray) -> np.ndarray:
    return np.concatenate([_dots(x[k : k + CHUNK], x[k : k + CHUNK]) for k in range(0, len(x), CHUNK)] or [np.zeros(0)])


def pack(ids: pa.Array, vectors: pa.Array) -> tuple[bytes, bytes, int]:
    """Ids, vectors, and how many of them others can have as their nearest; the vectors are of one length.

    Vectors of zeros or with an entry that is null or no finite number go. Of equal vectors none but the two of
    the least ids can be somebody's nearest: those come first, the rest after them.
    """
    who, flat = ids.to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(who), -1)
    most = np.abs(x).max(axis=1, initial=0)
    good = np.isfinite(most) & (most > 0)
    who, x = who[good], x[good]
    if x.dtype == np.float64:  # squares stay in range; a power of two leaves the similarity as it is
        x = np.ldexp(x, -np.frexp(most[good])[1][:, None])
    if not len(who):
        return b"", b"", 0
    same = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * x.itemsize}").ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((who, same))
    who, x, same = who[order], x[order], same[order]
    new = np.append(True, (np.diff(same) != 0) | (np.diff(who) != 0))
    who, x, same = who[new], x[new], same[new]
    first = np.arange(len(same)) - np.searchsorted(same, same) < 2
    order = np.lexsort((who, ~first))
    return who[order].tobytes(), x[order].tobytes(), int(first.sum())


def sides(ids: bytes, vectors: bytes, first: int, length: int, kind: type) -> tuple[Side, Side]:
    """Those that can be somebody's nearest, and the rest."""
    who, x = np.frombuffer(ids, np.int64), np.frombuffer(vectors, kind).reshape(-1, length)
    squares = _squares(x)
    unit = (x / np.sqrt(squares)[:, None]).astype(np.float32)
    return Side(who[:first], x[:first], squares[:first], unit[:first]), Side(who[first:], x[first:], squares[first:], unit[first:])


class _Best:
    """The nearest of each vector of a side, among those of another.

    Of each vector and each tile of the other side the products keep the greatest similarity only. Tiles that come within
    rounding of the greatest of all, mostly one, are multiplied again, and what comes that near in them is computed.
    """

    def __init__(self, side: Side, other: Side, tile: int, same: bool) -> None:
        self.side, self.other, self.tile, self.same = side, other, tile, same
        self.most = np.full((-(-len(other) // tile), len(side)), -np.inf, np.float32)
        # rounding of the entries and of each sum, for the nearest and for the one taken for it
        self.slack = np.float32(2 * (side.unit.shape[1] + 8) * 2.0**-24)
        self.sim, self.id = np.full(len(side), -np.inf), np.full(len(side), np.iinfo(np.int64).max)

    def _near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that can be the nearest."""
        top = self.most.max(axis=0)
        least = np.where(top > -np.inf, top - self.slack, np.float32(np.inf))
        for k, most in enumerate(self.most):
            low, rows = k * self.tile, np.flatnonzero(most >= least)
            columns, theirs = (x[low : low + self.tile] for x in (self.other.unit, self.other.ids))
            for some in (rows[n : n + WIDTH] for n in range(0, len(rows), WIDTH)):
                tile = np.matmul(self.side.unit[some], columns.T)
                if self.same:
                    tile[self.side.ids[some][:, None] == theirs[None, :]] = -np.inf
                row, at = np.divmod(np.flatnonzero(tile >= least[some][:, None]), len(columns))  # flat, as nonzero is slow in two dimensions
                yield some[row], low + at

    def _compute(self, row: np.ndarray, at: np.ndarray) -> None:
        sim = _dots(self.side.x[row], self.other.x[at]) / np.sqrt(self.side.squares[row] * self.other.squares[at])
        sim, ids = np.clip(sim, -1.0, 1.0), self.other.ids[at]
        order = np.lexsort((ids, -sim, row))
        order = order[np.append(True, np.diff(row[order]) != 0)]
        row, sim, ids = row[order], sim[order], ids[order]
        better = (sim > self.sim[row]) | ((sim == self.sim[row]) & (ids < self.id[row]))
        self.sim[row[better]], self.id[row[better]] = sim[better], ids[better]

    def found(self) -> Found:
        for row, at in self._near():
            for k in range(0, len(row), CHUNK):
                self._compute(row[k : k + CHUNK], at[k : k + CHUNK])
        some = np.isfinite(self.sim)
        return self.side.ids[some], self.id[some], self.sim[some]


def _scan(a: Side, b: Side, same: bool, both: bool) -> Iterator[Found]:
    """The nearest in b of each of a, and if both, the other way too. Equal ids, which there are only in the same block, don't count.

    If both are asked of one block, a and b are equal and each two of their tiles meet once.
    """
    if not len(a) or not len(b):
        return
    best, back = _Best(a, b, WIDTH, same), _Best(b, a, HEIGHT, same) if both else None
    space = np.empty(HEIGHT * WIDTH, np.float32)
    for n, low in enumerate(range(0, len(a), HEIGHT)):
        rows = a.unit[low : low + HEIGHT]
        mine = a.ids[low : low + HEIGHT]
        for m in range(low // WIDTH if same and both else 0, len(best.most)):
            k = m * WIDTH
            columns = b.unit[k : k + WIDTH]
            tile = np.matmul(rows, columns.T, out=space[: len(rows) * len(columns)].reshape(len(rows), len(columns)))
            if same:
                theirs = b.ids[k : k + WIDTH]
                if mine[0] <= theirs[-1] and theirs[0] <= mine[-1]:
                    tile[mine[:, None] == theirs[None, :]] = -np.inf
            np.maximum.reduce(tile, axis=1, out=best.most[m, low : low + HEIGHT])
            if back:
                np.maximum.reduce(tile, axis=0, out=back.most[n, k : k + WIDTH])
    yield best.found()
    if back:
        yield back.found()


def compare(left: tuple[Side, Side], right: tuple[Side, Side], same: bool, both: bool) -> Iterator[Found]:
    """Ids of left's vectors, of the nearest of right's to each and their similarity; if both, right's among left's too.

    If same and both, left and right are one block, and a vector can come twice: its nearest is the better of the two.
    """
    yield from _scan(left[0], right[0], same, both)
    yield from _scan(left[1], right[0], same, False)
    if both and not same:
        yield from _scan(right[1], left[0], same, False)
