"""Periodic runs of words. A run is a stretch of words with smallest period q, at least `least` words and `times` * q
long, that no neighbouring word extends with that period.

Longest common extensions of two places come from suffix trees (Ukkonen) of the words and of their reversal: the depth of
the lowest common ancestor is a minimum over an Euler tour, which blocks and a sparse table of block minima answer in
constant time. By the runs theorem each run holds a Lyndon root: the longest Lyndon word at some place, for the order of
the words or its reverse. It ends where the next smaller (or next greater) suffix begins. Each such candidate is extended
to the right and to the left, and counts if it is long enough.

Trees are built for the parts of a document that can hold a run. Every GRAM words inside a run stand at a second place of
that run (GRAM is chosen for that, see gram()), so a run can't hold GRAM words that stand only once; the document is
parted there, and the parts again, until nothing changes. This loses no run, however long the text.

A document is worked on alone in a narrow map: nothing is shuffled. A tree takes about 300 bytes for each word of the
longest part that repeats itself. Null and empty texts have no words and no runs; repeated rows give a row each; a row
without id is left unchanged by periodic(); ties of the best run go to the smaller start, then the smaller period. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 16


class Extensions:
    """Longest common prefixes of the suffixes of a sequence of numbers from 1 up, and the ranks of its suffixes."""

    def __init__(self, sequence: list[int]):
        symbols = [*sequence, 0]
        starts, ends, go, wide = _ukkonen(symbols)
        self._tour(starts, ends, go, wide, len(symbols))

    def _tour(self, starts: list[int], ends: list[int], go: dict[int, int], wide: int, n: int) -> None:
        """Walks the tree in the order of the symbols: a depth for each step, and the step at which each leaf is met."""
        keys = np.fromiter(go.keys(), np.int64, len(go))
        order = np.argsort(keys)
        child = np.fromiter(go.values(), np.int64, len(go))[order].tolist()
        first = np.searchsorted(keys[order] // wide, np.arange(len(starts) + 1)).tolist()
        steps, leaves = [0], []
        path, depth = [(first[0], first[1])], [0]
        while path:
            at, end = path.pop()
            if at == end:
                depth.pop()
                if depth:
                    steps.append(depth[-1])
                continue
            path.append((at + 1, end))
            node = child[at]
            deep = depth[-1] + ends[node] - starts[node]
            if first[node] == first[node + 1]:
                leaves.append((n - deep, len(steps)))
                steps += (deep, depth[-1])
            else:
                steps.append(deep)
                depth.append(deep)
                path.append((first[node], first[node + 1]))
        suffix, met = np.array(leaves, np.int64).T
        self.step, self.rank = np.empty(n, np.int64), np.empty(n, np.int64)
        self.step[suffix], self.rank[suffix] = met, np.arange(n)
        self._minima(np.array(steps, np.int64))

    def _minima(self, steps: np.ndarray) -> None:
        blocks = -(-len(steps) // BLOCK)
        grid = np.full((blocks, BLOCK), np.iinfo(np.int64).max)
        grid.ravel()[: len(steps)] = steps
        self.steps = grid.ravel()
        self.ahead = np.minimum.accumulate(grid, axis=1).ravel()
        self.behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [grid.min(axis=1)]
        while 2 << (len(self.table) - 1) <= blocks:
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes i and j, which differ."""
        low, high = np.minimum(self.step[i], self.step[j]), np.maximum(self.step[i], self.step[j])
        a, b = low // BLOCK, high // BLOCK
        found = np.minimum(self.behind[low], self.ahead[high])
        between = b - a - 1
        level = np.frexp(np.maximum(between, 1).astype(np.float64))[1] - 1
        for k in np.unique(level[between > 0]).tolist():
            some = np.flatnonzero((between > 0) & (level == k))
            inner = np.minimum(self.table[k][a[some] + 1], self.table[k][b[some] - (1 << k)])
            found[some] = np.minimum(found[some], inner)
        same = np.flatnonzero(a == b)
        if len(same):
            place = low[same, None] + np.arange(BLOCK)
            inside = place <= high[same, None]
            found[same] = np.where(inside, self.steps[np.minimum(place, len(self.steps) - 1)], np.iinfo(np.int64).max).min(axis=1)
        return found


def _ukkonen(symbols: list[int]) -> tuple[list[int], list[int], dict[int, int], int]:
    """Suffix tree of symbols, whose last one stands nowhere else: the text range of the edge into each node, and the
    children, keyed by node * wide + first symbol. Node 0 is the root."""
    n, wide = len(symbols), max(symbols) + 1
    starts, ends, link = [0], [0], [0]
    go: dict[int, int] = {}
    node = edge = length = open_ = 0
    for i, symbol in enumerate(symbols):
        open_ += 1
        waiting = 0
        while open_:
            if not length:
                edge = i
            key = node * wide + symbols[edge]
            below = go.get(key)
            if below is None:
                go[key] = len(starts)
                starts.append(i)
                ends.append(n)
                link.append(0)
                if waiting:
                    link[waiting] = node
                    waiting = 0
            else:
                start = starts[below]
                size = min(ends[below], i + 1) - start
                if length >= size:
                    edge, length, node = edge + size, length - size, below
                    continue
                if symbols[start + length] == symbol:
                    length += 1
                    if waiting:
                        link[waiting] = node
                    break
                middle = len(starts)
                starts += (start, i)
                ends += (start + length, n)
                link += (0, 0)
                go[key] = middle
                go[middle * wide + symbol] = middle + 1
                starts[below] = start + length
                go[middle * wide + symbols[start + length]] = below
                if waiting:
                    link[waiting] = middle
                waiting = middle
            open_ -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - open_ + 1
    return starts, ends, go, wide


def _next(rank: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next one of smaller rank and the next one of greater rank. If none is smaller, that is the end
    sign; it is not greater, so a place without a greater one is given itself: a run that ends with the text has its root
    in the first order."""
    n = len(rank)
    smaller, greater = [n] * n, list(range(n))
    low: list[int] = []
    high: list[int] = []
    for i, r in enumerate(rank):
        while low and rank[low[-1]] > r:
            smaller[low.pop()] = i
        low.append(i)
        while high and rank[high[-1]] < r:
            greater[high.pop()] = i
        high.append(i)
    return smaller, greater


def _in_part(words: np.ndarray, least: int, times: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers."""
    n = len(words)
    named = np.unique(words, return_inverse=True)[1] + 1
    right = Extensions(named.tolist())
    rank, place = right.rank[:n].tolist(), np.arange(n)
    ends = np.concatenate([np.array(x, np.int64) for x in _next(rank)])
    at = np.concatenate([place, place])
    fits = (ends > at) & (times * (ends - at) <= n)
    at, period = at[fits], (ends - at)[fits]
    ahead = right.common(at, at + period)  # suffix n is the end sign alone
    del right
    left = Extensions(named[::-1].tolist())
    back = np.where(at > 0, left.common(n - at, np.where(at > 0, n - at - period, 0)), 0)
    length = back + period + ahead
    good = length >= np.maximum(least, times * period)
    return set(zip((at - back)[good].tolist(), length[good].tolist(), period[good].tolist()))


def gram(least: int, times: int) -> int:
    """The most words of which each stretch inside a run stands twice in it. A stretch of g words at place j stands q words
    on or back unless length < 2q + g; as length >= max(least, times * q), g <= least * (times - 2) / times rules that out."""
    return max(1, least * (times - 2) // times) if times > 2 else 0


def _parts(words: np.ndarray, size: int, least: int) -> Iterator[tuple[int, int]]:
    """Ranges of words outside which no run lies."""
    open_ = [(0, len(words))]
    while open_:
        low, high = open_.pop()
        if high - low < least:
            continue
        if not size:
            yield low, high
            continue
        keys = np.zeros(high - low - size + 1, np.uint64)
        for k in range(size):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + words[low + k : high - size + 1 + k].astype(np.uint64)
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        twice = np.concatenate([[False], count[back] > 1, [False]])
        edges = np.flatnonzero(np.diff(twice.astype(np.int8)))
        found = [(low + int(a), low + int(b) + size - 1) for a, b in edges.reshape(-1, 2) if b - a + size - 1 >= least]
        if found == [(low, high)]:
            yield low, high
        else:
            open_ += found


def find(words: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start, then period."""
    if times < 2:
        raise ValueError("a run holds its period twice at least")
    names: dict = {}
    numbers = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    found = {(low + start, length, period) for low, high in _parts(numbers, gram(least, times), least) for start, length, period in _in_part(numbers[low:high], least, times)}
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, deep in zip(words, np.cumsum(edge).tolist()) if not deep]


def periodic(words: list, key: int | None) -> list:
    """The words as the report's rule makes them periodic for a tenth of the ids."""
    if key is None or not words:
        return words
    hashed = zlib.crc32(str(key).encode())
    if hashed % 10:
        return words
    n, g = len(words), hashed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3, change: Callable[[list, int | None], list] | None = None) -> DataFrame:
    """One row per document: its id, `runs` array<struct<start,length,period>> by start and period, `best` (the run with
    the greatest length / period; null without runs) and `collapsed`, its kept words joined by a space. change(words, id)
    may replace the words first."""
    kind = docs.schema[id_col].dataType.simpleString()
    run = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def named(r: tuple[int, int, int]) -> dict:
        return dict(zip(("start", "length", "period"), r))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_runs, best, kept = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()  # bytes part at the six ASCII white spaces
                words = change(words, key) if change else words
                runs = find(words, least, times)
                all_runs.append([named(r) for r in runs])
                best.append(named(max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))) if runs else None)
                kept.append(b" ".join(collapsed(words, runs)))
            arrays = [batch.column(0), pa.array(all_runs, pa.list_(run)), pa.array(best, run), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "runs", "best", "collapsed"])

    one = "struct<start:bigint,length:bigint,period:bigint>"
    made = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(work, f"key {kind}, runs array<{one}>, best {one}, collapsed string")
    return made.withColumnRenamed("key", id_col)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Numbers and digests of the runs of every document, after periodic()."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return scan(docs, id_col, text_col, change=periodic).select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
