"""Benchmark decontamination: benchmark items found in documents within an edit distance of SLACK of their words.

The CGK embedding (Chakraborty, Goldenberg and Koucky 2016) walks over a sequence of words: at each step it puts out the
word it stands at, and a random bit of that word and the step tells whether it goes on to the next. Two sequences a few
edits apart fall into step again after each edit, so their embeddings are near in Hamming distance, and some of the
places that bit-sampling LSH looks at agree. Each of WALKS walks has TABLES tables, and a table's key is the words at
SAMPLED places of the embedding. The items are put into the tables; windows of an item's size look theirs up, and each
item met there is compared by exact edit distance in a band of k words, so there are no false finds. The walks are
independent, and up to 2k + 1 windows overlap a copy, so at the very bound less than 3 % of the copies are missed.

Windows are opened where a match is possible at all: an item of L words and a window within k edits of it share at least
L + 1 - q - k*q of its word q-grams (Ukkonen 1992) within k of their diagonal. That bound loses no pair and tells no
item: the tables do.

Items are a stated query set, sent to the tasks in blocks of BLOCK items, with a pass over the documents for each.

Words are runs between ASCII white space and punctuation, lower-cased. Items or documents that are null or hold no word
match nothing; items with a null id are items like others. Repeated rows each give their rows; other columns are not
read. Texts of any length are read whole. Empty tables give an empty result.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLACK, BLOCK = 0.2, 20_000
WALKS, TABLES, SAMPLED, SEED = 8, 16, 2, 11
#: Cells of embeddings that a task holds at once.
CELLS = 4_000_000
_SPACED = bytes(32 if chr(i) in string.punctuation else i for i in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


def distance(a: list, b: list, most: int) -> int:
    """Edit distance of two lists, or most + 1 if it is larger; a band of 2 * most + 1 cells a row."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        then = [most + 1] * (len(b) + 1)
        then[0] = i
        for j in range(lo, hi + 1):
            then[j] = min(row[j] + 1, then[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        if min(then[lo - 1 : hi + 1]) > most:
            return most + 1
        row = then
    return min(row[-1], most + 1)


def best_end(item: list, text: list, start: int, most: int) -> tuple[int, int]:
    """(distance, end) of the nearest stretch of text from start on; the shortest of equals."""
    part = text[start : start + len(item) + most]
    row = list(range(len(part) + 1))
    for i, x in enumerate(item, 1):
        then = [i]
        for j, y in enumerate(part, 1):
            then.append(min(row[j] + 1, then[j - 1] + 1, row[j - 1] + (x != y)))
        row = then
    d = min(row)
    return d, start + row.index(d)


def within(item: list, text: list, start: int, most: int) -> tuple[int, int] | None:
    """What best_end() tells, in a band of 2 * most + 1 cells a row; None if the distance is over most."""
    n, far = min(len(item) + most, len(text) - start), most + 1
    row = [*range(min(most, n) + 1), far]
    lo = 0  # row holds the cells lo, lo + 1, ...; cells outside the band are over most
    for i, x in enumerate(item, 1):
        new, hi = max(0, i - most), min(n, i + most)
        then, left = [], far
        for j in range(new, hi + 1):
            c = j - lo
            up = row[c] + 1 if c < len(row) else far
            d = i if j == 0 else min(up, left + 1, (row[c - 1] if 0 < c <= len(row) else far) + (x != text[start + j - 1]))
            then.append(d)
            left = d
        if not then or min(then) > most:
            return None
        row, lo = then, new
    d = min(row)
    return d, start + lo + row.index(d)


def _mixed(x: np.ndarray, seeds: np.ndarray | int) -> np.ndarray:
    """Hashes of numbers, by multiplication and shifts."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ seeds
        x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


class Tables:
    """LSH tables for sequences of one length: embeddings of windows, and their keys."""

    def __init__(self, size: int, walks: int = WALKS, tables: int = TABLES, sampled: int = SAMPLED):
        made = np.random.default_rng((SEED, size))
        self.steps, self.walks = 2 * size, walks
        self.seeds = made.integers(0, 2**63, walks, np.int64).astype(np.uint64)
        self.places = made.integers(0, self.steps, (walks, tables, sampled))
        self.items: dict[int, list[int]] = defaultdict(list)

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """(windows, all tables) of keys; windows: rows of word numbers. Key 0 is none."""
        n, size = windows.shape
        words = np.hstack([windows, np.zeros((n, 1), np.int64)])
        at, rows = np.zeros((self.walks, n), np.int64), np.arange(n)
        out = np.empty((self.steps, self.walks, n), np.int64)
        for step in range(self.steps):
            out[step] = words[rows, at]
            bits = _mixed(out[step] * self.steps + step, self.seeds[:, None]) >> np.uint64(63)
            at = np.minimum(at + bits.astype(np.int64), size)
        found = out[self.places, np.arange(self.walks)[:, None, None]]  # walk, table, place, window
        key = np.broadcast_to(np.arange(found.shape[0] * found.shape[1]).reshape(*found.shape[:2], 1), (*found.shape[:2], n))
        for place in range(found.shape[2]):
            key = _mixed(key.astype(np.uint64) ^ _mixed(found[:, :, place], np.uint64(place)), np.uint64(7))
        key[(found == 0).any(2)] = 0  # places after the end, or at words that no item holds
        return key.reshape(-1, n).T.astype(np.int64)


class Items:
    """A block of items: word numbers, q-grams, and LSH tables for each length."""

    def __init__(self, rows: list[tuple[int | None, str]], slack: float = SLACK):
        self.items = [(k, w) for k, t in rows if (w := words(t))]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        self.ids = [[self.number[w] for w in ws] for _, ws in self.items]
        self.most = [int(slack * len(x)) for x in self.ids]
        self.q = [max(1, min(3, len(x) // (k + 1))) for x, k in zip(self.ids, self.most)]
        self.need = [max(1, len(x) + 1 - q - k * q) for x, k, q in zip(self.ids, self.most, self.q)]
        grams: dict[int, dict[int, list[tuple[int, int]]]] = {1: defaultdict(list), 2: defaultdict(list), 3: defaultdict(list)}
        self.tables: dict[int, Tables] = {}
        for n, (x, q) in enumerate(zip(self.ids, self.q)):
            for g, code in enumerate(self.codes_of(np.array(x, np.int64), q).tolist()):
                grams[q][code].append((n, g))
            if len(x) not in self.tables:
                self.tables[len(x)] = Tables(len(x))
            table = self.tables[len(x)]
            for key in table.keys(np.array([x], np.int64))[0].tolist():
                if key:
                    table.items[key].append(n)
        self.grams = {q: dict(v) for q, v in grams.items() if v}
        self.codes = {q: np.array(sorted(v), np.int64) for q, v in self.grams.items()}

    @staticmethod
    def codes_of(ids: np.ndarray, q: int) -> np.ndarray:
        """64-bit hashes of the q-grams; equal hashes of unequal ones would only open more windows."""
        n = len(ids) - q + 1
        code = np.zeros(n, np.uint64)
        for i in range(q):
            code = _mixed(ids[i : i + n], np.uint64(0)) + code * np.uint64(3)
        return code.astype(np.int64)

    def windows(self, ids: np.ndarray) -> dict[int, set[int]]:
        """Starts of windows by their size, where the q-gram bound allows a match."""
        hits: dict[int, list[int]] = defaultdict(list)
        for q, codes in self.codes.items():
            if len(ids) < q:
                continue
            n = len(ids) - q + 1
            full = np.ones(n, bool)
            for i in range(q):
                full &= ids[i : i + n] > 0
            at = full.nonzero()[0]
            if not len(at):
                continue
            code = self.codes_of(ids, q)[at]
            place = np.searchsorted(codes, code)
            good = codes[np.minimum(place, len(codes) - 1)] == code
            for p, c in zip(at[good].tolist(), code[good].tolist()):
                for item, g in self.grams[q][c]:
                    hits[item].append(p - g)
        opened: dict[int, set[int]] = defaultdict(set)
        for item, near in hits.items():
            k = self.most[item]
            if len(near) < self.need[item]:
                continue
            near.sort()  # a window's shared q-grams lie within k of its start, place in the item taken off
            starts = np.unique(np.add.outer(np.unique(near), np.arange(-k, k + 1)))
            starts = starts[(starts >= 0) & (starts < len(ids))]
            enough = np.searchsorted(near, starts + k, "right") - np.searchsorted(near, starts - k) >= self.need[item]
            opened[len(self.ids[item])].update(starts[enough].tolist())
        return opened

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item's place, start, end, distance), words; the nearest window of each item found, the first of equals."""
        get = self.number.get
        ids_list = [get(w, 0) for w in words(text)]
        ids, best = np.array(ids_list, np.int64), {}
        for size, starts in self.windows(ids).items():
            table, met = self.tables[size], defaultdict(set)
            padded = np.concatenate([ids, np.zeros(size, np.int64)])
            order = np.array(sorted(starts))
            many = max(1, CELLS // (table.steps * table.walks))
            for at in range(0, len(order), many):
                part = order[at : at + many]
                for s, keys in zip(part.tolist(), table.keys(padded[part[:, None] + np.arange(size)]).tolist()):
                    for key in keys:
                        for item in table.items.get(key, ()):
                            met[item].add(s)
            for item, places in met.items():
                for s in sorted(places):
                    most = self.most[item] if item not in best else best[item][3] - 1
                    if most < 0:
                        break
                    if near_by := within(self.ids[item], ids_list, s, most):
                        best[item] = (item, s, near_by[1], near_by[0])
        return sorted(best.values())


def _blocks(bench: DataFrame, item_col: str, item_text: str, block: int, **how) -> Iterator:
    """The items in blocks, each sent to the tasks; a block's size has a bound, the number of blocks has none."""
    spark = bench.sparkSession
    bench = bench.select(F.col(item_col).cast("long").alias("k"), F.col(item_text).alias("t")).filter("t is not null")
    blocks = -(-bench.count() // block)
    for b in range(blocks):
        rows = bench.filter(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b).collect() if blocks > 1 else bench.collect()
        yield spark.sparkContext.broadcast(Items(sorted(((r.k, r.t) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])), **how))


def find(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK, **how) -> DataFrame:
    """(id, item, word_start, word_end, distance), a row for each document and item found in it.

    A narrow map over the documents for each block of items; no shuffle."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    out = spark.createDataFrame([], f"`{id_col}` {kind}, `{item_col}` long, word_start long, word_end long, distance long")
    for sent in _blocks(bench, item_col, item_text, block, **how):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                where, cols = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for item, s, e, d in items.find(text):
                        where.append(i)
                        cols.append((items.items[item][0], s, e, d))
                each = list(zip(*cols)) if cols else [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), *(pa.array(c, pa.int64()) for c in each)], [id_col, item_col, "word_start", "word_end", "distance"])

        out = out.union(docs.select(id_col, text_col).mapInArrow(run, out.schema))
    return out


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK, **how) -> DataFrame:
    """The rows of docs that hold no item, all columns kept. A narrow map for each block of items, so no text is shuffled."""
    at = docs.columns.index(text_col)
    for sent in _blocks(bench, item_col, item_text, block, **how):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not sent.value.find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
