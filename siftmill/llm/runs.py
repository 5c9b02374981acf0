"""Periodic runs of words, found by recompression.

The texts of a batch become one row of word numbers, cut by numbers that occur once. For a run of
period q with at least ``times`` periods, the places whose word equals the one q further form a
stretch of (times - 1) * q or more, so a grid of that step has a point in it: over all periods
that is a harmonic number of points. Points whose neighbourhood differs are dropped; the rest is
extended exactly, both ways, on a run-length grammar of the texts:

* block compression makes one symbol of every stretch of equal symbols, pair compression one of
  every left symbol that a right one follows, sides being dealt by a hash. Both look at symbols
  only, so equal words parse alike but for the ends of a stretch;
* two places are compared by climbing while they agree, at most one step on every level until
  both stand at the start of a parent, then going down to the first difference (backwards on the
  mirrored grammar).

Symbols are numbered exactly, never by hash, so extensions are exact too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.base import slices

BATCH_WORDS = 1 << 17
POINTS = 1 << 20  # grid points that are extended at once
_SIDE = np.uint64(0x9E3779B97F4A7C15)


class _Level:
    """Symbols of one level; the parent of each; the first child of each parent, and the end. ``blocks``: the parents
    are stretches of one symbol, else single symbols and pairs."""

    def __init__(self, sym: np.ndarray, up: np.ndarray, first: np.ndarray, blocks: bool):
        self.sym, self.up, self.first, self.blocks = sym, up, first, blocks

    def mirrored(self) -> _Level:
        n = len(self.sym)
        return _Level(self.sym[::-1], (len(self.first) - 2 - self.up)[::-1], (n - self.first)[::-1], self.blocks)


class Grammar:
    """Levels of a sequence whose first and last symbols occur nowhere else in it."""

    def __init__(self, sym: np.ndarray, enough: int = 64):
        self.levels: list[_Level] = []
        sym = np.unique(sym, return_inverse=True)[1].astype(np.int64)
        free, seed = int(sym.max()) + 1, 0
        while len(sym) > enough and seed < 200:
            starts = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
            size = np.diff(starts, append=len(sym))
            above = sym[starts]
            long = np.flatnonzero(size > 1)
            if len(long):
                kinds, number = np.unique(above[long] * (len(sym) + 1) + size[long], return_inverse=True)
                above[long] = free + number
                free += len(kinds)
            self._add(sym, starts, True)
            sym, seed = above, seed + 1
            side = (((sym.astype(np.uint64) + np.uint64(seed)) * _SIDE) >> np.uint64(40)) & np.uint64(1)
            left = np.flatnonzero((side[:-1] == 0) & (side[1:] == 1))
            keep = np.ones(len(sym), bool)
            keep[left + 1] = False
            starts = np.flatnonzero(keep)
            above = sym.copy()
            if len(left):
                kinds, number = np.unique(sym[left] * free + sym[left + 1], return_inverse=True)
                above[left] = free + number
                free += len(kinds)
            self._add(sym, starts, False)
            sym = above[starts]
        self.top = sym
        self.mirror = [level.mirrored() for level in self.levels]

    def _add(self, sym: np.ndarray, starts: np.ndarray, blocks: bool) -> None:
        at_start = np.zeros(len(sym), np.int64)
        at_start[starts] = 1
        self.levels.append(_Level(sym, np.cumsum(at_start) - 1, np.append(starts, len(sym)), blocks))

    def common(self, i: np.ndarray, j: np.ndarray, backwards: bool = False) -> np.ndarray:
        """How many symbols are equal from places i and j on (backwards: up to them)."""
        levels, top = (self.mirror, self.top[::-1]) if backwards else (self.levels, self.top)
        n = len(levels[0].sym) if levels else len(top)
        a, b = (n - 1 - i, n - 1 - j) if backwards else (i.copy(), j.copy())
        start = a.copy()
        alive, stopped = np.arange(len(a)), []
        for level in levels:
            x, y = a[alive], b[alive]
            same = level.sym[x] == level.sym[y]
            px, py = level.up[x], level.up[y]
            inside = same & ((level.first[px] != x) | (level.first[py] != y))
            if level.blocks:
                step = np.where(inside, np.minimum(level.first[px + 1] - x, level.first[py + 1] - y), 0)
            else:
                step = inside.astype(np.int64)
            x, y = x + step, y + step
            a[alive], b[alive] = x, y
            ends = ~same | (inside & (level.sym[x] != level.sym[y]))
            stopped.append(alive[ends])
            alive = alive[~ends]
            a[alive], b[alive] = level.up[a[alive]], level.up[b[alive]]
        going = alive
        while len(going):
            going = going[top[a[going]] == top[b[going]]]
            a[going] += 1
            b[going] += 1
        below = alive
        for level, ended in zip(reversed(levels), reversed(stopped)):
            x, y = level.first[a[below]], level.first[b[below]]
            same = level.sym[x] == level.sym[y]
            if level.blocks:
                step = np.minimum(level.first[a[below] + 1] - x, level.first[b[below] + 1] - y)
            else:
                step = 1
            a[below], b[below] = x + same * step, y + same * step
            below = np.concatenate([below, ended])
        return a - start


def _points(w: np.ndarray, stops: np.ndarray, sizes: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid points (place, period) that a run may lie on, periods ascending. Texts stand by falling size."""
    place, period, held = [], [], 0
    last = len(w) - 1

    def near() -> tuple[np.ndarray, np.ndarray]:
        i, q = np.concatenate(place), np.concatenate(period)
        reach = (np.maximum(least, times * q) - q - 1) // 2  # this far the words agree on one side at least

        def agrees(sign: int) -> np.ndarray:
            out = np.ones(len(i), bool)
            for t in (np.minimum(reach, 1), reach // 2, reach):
                x = i + sign * t
                out &= w[np.clip(x, 0, last)] == w[np.clip(x + q, 0, last)]
            return out

        keep = agrees(1) | agrees(-1)
        return i[keep], q[keep]

    for q in range(1, int(sizes[0]) // times + 1 if len(sizes) else 1):
        need = max(least, times * q)
        texts = int(np.searchsorted(-sizes, -need, side="right"))
        if not texts:
            break
        end, step = int(stops[texts - 1]), need - q
        hits = np.flatnonzero(w[: end - q : step] == w[q:end:step])
        if len(hits):
            place.append(hits * step)
            period.append(np.full(len(hits), q, np.int64))
            held += len(hits)
            if held >= POINTS:
                yield near()
                place, period, held = [], [], 0
    if held:
        yield near()


def runs_of(texts: list[np.ndarray], least: int = 6, times: int = 4) -> list[np.ndarray]:
    """Rows (start, length, period), by start then period, of all runs of each text (numbers of its words)."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    sizes = np.array([len(texts[k]) for k in order], np.int64)
    none = np.empty((0, 3), np.int64)
    out = [none] * len(texts)
    if not len(texts) or sizes[0] < least:
        return out
    free = max((int(t.max()) for t in texts if len(t)), default=0) + 1
    w = np.full(int(sizes.sum()) + len(texts) + 1, 0, np.int64)
    stops = np.cumsum(sizes + 1)  # the place of the mark behind each text
    w[0] = free
    for rank, k in enumerate(order):
        w[stops[rank] - sizes[rank] : stops[rank]] = texts[k]
        w[stops[rank]] = free + 1 + rank
    grammar = None
    found: dict[tuple[int, int], int] = {}
    for i, q in _points(w, stops, sizes, least, times):
        if not len(i):
            continue
        grammar = grammar or Grammar(w)
        start = i - grammar.common(i - 1, i + q - 1, backwards=True)
        length = i + grammar.common(i, i + q) + q - start
        good = length >= np.maximum(least, times * q)
        for s, n, p in np.unique(np.column_stack([start, length, q])[good], axis=0).tolist():
            if found.get((s, n), p) >= p:  # one stretch may repeat by several periods: the least is the run's
                found[s, n] = p
    if found:
        rows = np.array([(s, n, p) for (s, n), p in found.items()], np.int64)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        text = np.searchsorted(stops, rows[:, 0], side="right")
        rows[:, 0] -= stops[text] - sizes[text]
        cuts = np.flatnonzero(np.diff(text)) + 1
        for part, rank in zip(np.split(rows, cuts), text[np.concatenate([[0], cuts])]):
            out[order[rank]] = part
    return out


def _kept(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run repeats, joined by one space: of each run its first period stays."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row, a narrow map over whole texts.

    Words are runs without ASCII blanks. A run is a stretch of at least ``least`` words and
    ``times`` (2 or more) periods, its period the smallest, that no neighbouring word extends:
    ``runs`` lists (start, length, period) by start, then period. ``collapsed`` is the text without
    the words that some run holds behind its first period, joined by single spaces. A null or empty
    text has no words, no runs and an empty collapsed text. Repeated rows and null keys stay rows of
    their own; other columns are not read.
    """
    if times < 2:
        raise ValueError("a run has at least two periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(keys: list[pa.Array], words: list[list[bytes]]) -> pa.RecordBatch:
            number: dict[bytes, int] = {}
            texts = [np.array([number.setdefault(x, len(number)) for x in own], np.int64) for own in words]
            runs = runs_of(texts, least, times)
            bounds = pa.array(np.cumsum([0, *map(len, runs)], dtype=np.int32))
            every = np.concatenate(runs)
            fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(every[:, c])) for c in range(3)], ["start", "length", "period"])
            kept = pa.array([_kept(own, r) for own, r in zip(words, runs)], pa.binary()).cast(pa.string())
            columns = [pa.concat_arrays(keys), pa.array([len(x) for x in words], pa.int64()), pa.ListArray.from_arrays(bounds, fields), kept]
            return pa.RecordBatch.from_arrays(columns, ["k", "n_words", "runs", "collapsed"])

        keys: list[pa.Array] = []
        words: list[list[bytes]] = []
        held = 0
        for row in slices(batches, 1):
            own = (row.column(1)[0].as_py() or "").encode().split()
            keys.append(row.column(0))
            words.append(own)
            held += len(own)
            if held >= BATCH_WORDS or len(words) >= 4096:
                yield close(keys, words)
                keys, words, held = [], [], 0
        if words:
            yield close(keys, words)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = rows.mapInArrow(run, f"k {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return found.withColumnRenamed("k", key)


def with_longest(found: DataFrame) -> DataFrame:
    """``find_runs`` rows with ``longest``: the run of greatest length (ties: least start, then period), null without runs."""
    worth = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(worth)
    return found.withColumn("longest", F.when(F.size("runs") > 0, F.struct(best["start"].alias("start"), (-best["less"]).alias("length"), best["period"].alias("period"))))
