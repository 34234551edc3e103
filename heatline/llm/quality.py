"""Document quality by random Fourier features (Rahimi and Recht 2007), ridge regression and isotonic calibration.

Statistics of each text (lengths, character classes, repetition) are standardised and mapped to cosines of random
projections, whose inner products approximate a Gaussian kernel. Each task sums X'X and X'y over its labelled rows; the
sums are added in Spark, and a system of FEATURES + 1 unknowns is solved. Raw scores are then made probabilities by
isotonic regression over sums in BINS bins of equal width, from a fifth of the rows (by a hash of their statistics) that
the ridge isn't fitted on; with too few rows for that, all serve both. All fitting is over sums of fixed size, so every labelled
training row counts and nothing of the input's size leaves Spark.

Null and empty texts have statistics of zero and get a score like others. Rows with a null id are scored, not held out
and not trained on. An id labelled several times counts with its mean label; null labels are ignored. Repeated rows are
scored each on its own; texts of any length are read whole. Without labels all scores are 0.5. Columns besides id and
text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatline.llm.common import Scratch, fold, written

FEATURES, GAMMA, RIDGE, BINS, SEED = 256, 0.02, 1e-3, 512, 7
STATS = 18
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_PLAIN = np.isin(_BYTES, [ord(c) for c in ".,'-"])
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_MARK = (_BYTES >= 33) & (_BYTES < 127) & ~_UPPER & ~_LOWER & ~_DIGIT & ~_PLAIN
_HIGH = _BYTES >= 128


def statistics(text: str | None) -> list[float]:
    """STATS numbers that describe a text, none of which grows faster than its logarithm."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * STATS
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, m = len(raw), len(words)
    letters = max(1, int(hist[_UPPER | _LOWER | _HIGH].sum()))
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lens = np.fromiter(map(len, words), np.int64, m)
    return [
        math.log1p(n), math.log1p(m), math.log1p(len(lines)), float(lens.mean()), float(lens.std()), math.log1p(int(lens.max())),
        float(hist[_UPPER].sum() / letters), float(hist[_DIGIT].sum() / n), float(hist[_PLAIN].sum() / m), float(hist[_MARK].sum() / m), float(hist[_HIGH].sum() / n), float(hist[33] / m), float(hist[124] / m),
        len(counts) / m, counts.most_common(1)[0][1] / m, len(pairs) / max(1, m - 1), len(set(lines)) / len(lines), float(hist[46] / m),
    ]


def _stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], [id_col, "x"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, x array<double>")


class Model:
    """What a score needs: standardisation, projection, weights, and the steps of the calibration."""

    def __init__(self, mean, std, weights, edges, levels):
        self.mean, self.std, self.weights, self.edges, self.levels = mean, std, weights, edges, levels

    def features(self, x: np.ndarray) -> np.ndarray:
        made = np.random.default_rng(SEED)
        w = made.normal(0, math.sqrt(2 * GAMMA), (STATS, FEATURES))
        b = made.uniform(0, 2 * math.pi, FEATURES)
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.hstack([np.cos(z @ w + b) * math.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.levels)


def _arrays(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(-1, STATS)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Non-decreasing fit by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(train: DataFrame) -> Model | None:
    """train(x array<double>, y double) -> the model; None without rows. Two narrow passes that end in sums of fixed size."""
    sums = train.select("x", F.lit(1.0).alias("n"), "y", *(F.col("x")[i].alias(f"x{i}") for i in range(STATS)))
    first = sums.agg(F.sum("n"), *(F.avg(f"x{i}") for i in range(STATS)), *(F.stddev_pop(f"x{i}") for i in range(STATS))).first()
    if not first[0]:
        return None
    mean, std = np.array(first[1 : STATS + 1]), np.maximum(np.array(first[STATS + 1 :]), 1e-6)
    model = Model(mean, std, None, None, None)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            f = model.features(_arrays(batch.column(0)))
            a += f.T @ np.hstack([f, batch.column(1).to_numpy(zero_copy_only=False)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(list(a), pa.list_(pa.float64()))], ["i", "a"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, a in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[i] = sums.get(i, 0) + a.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["i", "a"])

    other = F.pmod(F.xxhash64("x"), F.lit(5)) == 0
    n = sums.agg(F.count_if(other)).first()[0]
    fitted, calibrated = (train.filter(~other), train.filter(other)) if 0 < n < first[0] else (train, train)
    found = fitted.select("x", "y").mapInArrow(normal, "i long, a array<double>").repartition("i").mapInArrow(added, "i long, a array<double>").toArrow()
    a = np.zeros((FEATURES + 1, FEATURES + 2))
    for i, row in zip(found["i"].to_pylist(), found["a"].to_pylist()):
        a[i] = row
    model.weights = np.linalg.solve(a[:, :-1] + RIDGE * a[-1, -2] * np.eye(FEATURES + 1) / FEATURES, a[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((BINS, 2))
        for batch in batches:
            at = np.clip(((model.raw(_arrays(batch.column(0))) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            np.add.at(s, at, np.stack([np.ones(len(at)), batch.column(1).to_numpy(zero_copy_only=False)], 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(s[:, 0]), pa.array(s[:, 1])], ["bin", "n", "y"])

    bins = calibrated.select("x", "y").mapInArrow(binned, "bin long, n double, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).filter("n > 0").orderBy("bin").collect()
    model.edges = (np.array([r.bin for r in bins]) + 0.5) / BINS * 2 - 0.5
    model.levels = np.clip(isotonic(np.array([r.y / r.n for r in bins]), np.array([r.n for r in bins])), 0, 1)
    return model


def train(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str, folds: int, held: int) -> Model | None:
    """The model from the labelled rows of the folds that aren't held out."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.avg(label_col).alias("y"))
    own = stats.filter(F.col(id_col).isNotNull() & ~_held_out(id_col, folds, held))
    return fit(written(own.hint("merge").join(known, id_col).select("x", "y"), "labelled"))


def _held_out(id_col: str, folds: int, held: int):
    return F.coalesce(fold(F.col(id_col), folds) == held, F.lit(False))


def _scores(model: Model | None, x: np.ndarray) -> np.ndarray:
    return model.score(x) if model else np.full(len(x), 0.5)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs, learnt from the labelled rows of the other folds."""
    stats = written(_stats(docs, id_col, text_col), "statistics")
    model = train(stats, labels, id_col, label_col, folds, held)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, _arrays(batch.column(1))))], [id_col, "score"])

    scored = stats.mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.select(id_col, _held_out(id_col, folds, held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that the score accepts, all columns kept. A narrow map, so no text is shuffled."""
    model = train(_stats(docs, id_col, text_col), labels, id_col, label_col, folds, held)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(at).to_pylist()], float).reshape(-1, STATS)
            yield batch.filter(pa.array(_scores(model, x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
