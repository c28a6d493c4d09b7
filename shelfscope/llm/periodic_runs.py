"""Maximal periodic runs of words: difference-cover extension queries on a harmonic grid."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MIN_WORDS, MIN_TURNS = 24, 3
# Each difference modulo CYCLE is a difference of two of these (a perfect difference set).
CYCLE, COVER = 31, (1, 5, 11, 24, 25, 27)
# Grid points looked at in one go, and words of a text whose grid is kept.
_BLOCK, _KEPT = 1 << 21, 4096


@cache
def _shift() -> np.ndarray:
    """Least number of words from positions of residues a and b to where both are in the cover."""
    out = np.full((CYCLE, CYCLE), CYCLE)
    for a in range(CYCLE):
        for b in range(CYCLE):
            out[a, b] = min(t for t in range(CYCLE) if (a + t) % CYCLE in COVER and (b + t) % CYCLE in COVER)
    return out


class Extensions:
    """Longest common extensions of positions in one sequence of word numbers (1 and up).

    Only suffixes at cover positions are sorted: by their first ``CYCLE`` words, then by doubling, which
    stays on the cover since all lengths are multiples of ``CYCLE``.  The common lengths of neighbours in that
    order go to a sparse table of range minima.
    """

    def __init__(self, words: np.ndarray):
        n = self.n = len(words)
        self.words = np.concatenate((words, np.zeros(CYCLE, words.dtype)))
        spots = np.flatnonzero(np.isin(np.arange(CYCLE), COVER))
        spots = (np.arange(0, n, CYCLE)[:, None] + spots).ravel()
        spots = spots[spots < n]
        m = len(spots)
        heads = np.ascontiguousarray(self.words[spots[:, None] + np.arange(CYCLE)].astype(">u4"))
        rank = np.unique(heads.view(f"S{4 * CYCLE}").ravel(), return_inverse=True)[1] + 1
        levels, length = [], CYCLE
        while True:
            place = np.zeros(n + 1, np.int64)
            place[spots] = rank
            levels.append((length, place))
            if m == 0 or rank.max() == m:
                break
            rank = np.unique(rank * (m + 1) + place[np.minimum(spots + length, n)], return_inverse=True)[1] + 1
            length *= 2
        self.place = levels[-1][1]
        order = spots[np.argsort(self.place[spots])]
        self.minima = [self._neighbours(order, levels)]
        while (step := 1 << len(self.minima) - 1) < m:
            low = self.minima[-1]
            self.minima.append(np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0])

    def _neighbours(self, order: np.ndarray, levels: list) -> np.ndarray:
        """Common length of each suffix of the order and the one before it (0 for the first)."""
        out = np.zeros(len(order), np.int64)
        if len(order) < 2:
            return out
        a, b = order[:-1].copy(), order[1:].copy()
        for length, place in reversed(levels):
            same = (place[np.minimum(a, self.n)] == place[np.minimum(b, self.n)]) & (np.maximum(a, b) < self.n)
            a[same] += length
            b[same] += length
        out[1:] = a - order[:-1]
        out[1:] += self._compared(a, b, np.full(len(a), CYCLE))
        return out

    def _compared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Number of equal words from a and b on, at most ``most`` (up to ``CYCLE``) of them."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero((np.maximum(a, b) < self.n) & (most > 0))
        for t in range(CYCLE):
            live = live[self.words[a[live] + t] == self.words[b[live] + t]]
            out[live] += 1
            live = live[(most[live] > t + 1) & (np.maximum(a[live], b[live]) + t + 1 < self.n)]
            if not live.size:
                break
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common length of the suffixes at different positions a and b."""
        shift = _shift()[a % CYCLE, b % CYCLE]
        out = self._compared(a, b, shift)
        far = np.flatnonzero((out == shift) & (np.maximum(a, b) + shift < self.n))
        x, y = self.place[a[far] + shift[far]], self.place[b[far] + shift[far]]
        low, high = np.minimum(x, y), np.maximum(x, y)  # neighbours low .. high - 1, counted from 0
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level):
            at = level == k
            table = self.minima[k]
            out[far[at]] += np.minimum(table[low[at]], table[high[at] - (1 << k)])
        return out


def _grid(first: int, last: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Periods from ``first`` to ``last - 1`` and their grid points that lie two periods or more before ``n``."""
    p = np.arange(first, last)
    count = np.maximum(0, (n - 1 - 2 * p) // p + 1)
    period = np.repeat(p, count)
    return period, period * (np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count))


@cache
def _short_grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grid of a text of ``_KEPT`` words by where its points end: a shorter text has the first ones of it."""
    period, at = _grid(1, _KEPT // MIN_TURNS + 1, _KEPT)
    end = at + 2 * period
    order = np.argsort(end, kind="stable")
    return period[order], at[order], end[order]


def _grids(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if n <= _KEPT:
        period, at, end = _short_grid()
        last = np.searchsorted(end, n)
        yield period[:last], at[:last]
        return
    first = 1
    while first <= n // MIN_TURNS:
        last = min(first + max(1, _BLOCK * first // n), n // MIN_TURNS + 1)
        yield _grid(first, last, n)
        first = last


def runs(words: np.ndarray) -> np.ndarray:
    """``start, length, period`` rows of all maximal runs, by start and period.

    A run of period q and three turns or more holds, between two neighbouring multiples of q, only words that
    recur q later.  So a grid point whose own, next and q-th word do not recur is passed over; the others are
    extended both ways.  The same stretch found with multiples of its period keeps the smallest.
    """
    n, found, there = len(words), [np.zeros((0, 3), np.int64)], None
    if n < MIN_WORDS:
        return found[0]
    for period, at in _grids(n):
        spot = np.flatnonzero(words[at] == words[at + period])
        period, at = period[spot], at[spot]
        spot = np.flatnonzero((words[at + period] == words[at + 2 * period]) & (words[at + 1] == words[at + 1 + period]))
        period, at = period[spot], at[spot]
        if not period.size:
            continue
        if there is None:
            there = Extensions(words), Extensions(words[::-1].copy())
        for cut in range(0, len(at), _BLOCK):
            p, i = period[cut: cut + _BLOCK], at[cut: cut + _BLOCK]
            end = i + p + there[0](i, i + p)
            start = i - np.where(i > 0, there[1](n - np.maximum(i, 1), n - np.maximum(i, 1) - p), 0)
            long = end - start >= np.maximum(MIN_WORDS, MIN_TURNS * p)
            some = np.column_stack((start[long], end[long] - start[long], p[long]))
            found.append(_smallest(some))
    return _smallest(np.concatenate(found))


def _smallest(found: np.ndarray) -> np.ndarray:
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    if not len(found):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return b" ".join([words[i] for i in kept])


def find_runs(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Periodic runs of words of each text, and the text with each run cut to its first turn.

    Returns the columns of ``carry`` (None: all), ``n_words``, ``runs`` (``start, length, period`` by start and
    period) and ``collapsed`` (kept words joined by one space), which replace columns of those names.  A run has a
    smallest period q, at least 24 words and three turns, and cannot be longer.  Null, empty and blank texts
    have no words and no runs and collapse to an empty text.  Texts go whole and one at a time; each row stands
    alone, so ids may repeat or be null.
    """
    own = ("n_words", "runs", "collapsed")
    kept = [c for c in (docs.columns if carry is None else carry) if c not in own]
    rows = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(kept)], F.col(text).alias("_text"))
    names = rows.columns[:-1]
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                counts, found, left = [], [], []
                for value in batch.column(len(names)).to_pylist():
                    words = (value or "").encode().split()
                    number: dict[bytes, int] = {}
                    ids = np.array([number.setdefault(w, len(number) + 1) for w in words], np.int64)
                    at_hand = runs(ids)
                    counts.append(len(words))
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in at_hand.tolist()])
                    left.append(_collapsed(words, at_hand).decode())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(found, pa.list_(one)), pa.array(left)],
                    [*names, *own])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != "_text")
    out = rows.mapInArrow(run, kinds + "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, kept)], *own)
