"""Language-model scores by a Brown class-based bigram model (Brown et al. 1992; exchange clustering: Martin et al. 1998).

P(w_i | w_{i-1}) = P(class(w_i) | class(w_{i-1})) * P(w_i | class(w_i)), both smoothed, with an end token per text that
also stands before its first word. Words get their classes by exchange: a word moves to the class that raises the
likelihood of the class bigrams most. The CORE most frequent words exchange until none moves or ROUNDS are done. Then
every other word of the head moves from the rest into the class that is best for it, in Spark: its counts of neighbours
in each class are summed over all training texts by word, and weighed against the small class table (a step of the
distributed exchange of Uszkoreit and Brants 2008). The end token has a class of its own.

Words seen once, whatever the table's size, and words never seen make up one rare class: a word's first further use is best
foretold by words that have been seen once. Good and Turing's estimates share it out: of new tokens, as many are unseen words
as the training texts have words seen once (n1), and 2 * n2 are words seen once (n2: words seen twice). Unseen words together
have one share, as in the base score, so the probabilities of all known words and of an unseen one add up to 1. The head
holds at most HEAD words, all of the highest counts; words seen twice or more beyond it also lie in the rare class, each with
its own count for a share.

Corpus counts cover all training texts. They are summed per task before the shuffle, and stay in Spark as a table; only
the head table (some MB, whatever the corpus; words over LONG bytes stay out of it) goes to the tasks. The other tokens
meet the counts by a merge join. So scores are exact for every token, and nothing of the corpus's size is broadcast.

Null and empty texts are the end token alone. Rows with a null id are scored, never held out and not trained on.
Repeated rows count and score each on its own; texts of any length are read whole; other columns are not read. With no
training text at all, every token is unknown and scores come from the smoothing alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatline.llm.common import Scratch, fold

#: The end token; no word holds white space.
END = b"\n"
HEAD, CORE, CLASSES, ROUNDS, LONG = 200_000, 1000, 40, 8, 1000
#: Distinct words or pairs that a task gathers before it passes them on.
FLUSH = 400_000


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; splits at ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """texts(text) -> (word, n), the end token of each text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens(text))
                counts[END] += 1
                if len(counts) > FLUSH:
                    yield out()
                    counts = Counter()
        if counts:
            yield out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _log(x):
    return x * np.log(np.maximum(x, 1))


def gains(table: np.ndarray, r: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each class k, what the log likelihood of class bigrams gains if a word joins k that isn't in any class of the
    table: r[j] counts it before class j, c[j] after it, own before itself. Leading axes stand for several words."""
    # row k gains r, column k gains c, and the corner r[k] + c[k] + own
    # whichever k is chosen, class j has c[j] more words after it and r[j] more before it
    corner, out, into = np.diagonal(table, axis1=-2, axis2=-1), table.sum(-1) + c, table.sum(-2) + r
    was, own = _log(table), np.asarray(own, float)[..., None]
    rows = (_log(table + r[..., None, :]) - was).sum(-1) - _log(corner + r) + _log(corner)
    cols = (_log(table + c[..., :, None]) - was).sum(-2) - _log(corner + c) + _log(corner)
    both = _log(corner + r + c + own) - _log(corner)
    return rows + cols + both - _log(out + r.sum(-1, keepdims=True) + own) + _log(out) - _log(into + c.sum(-1, keepdims=True) + own) + _log(into)


def exchange(pairs: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Class of each word, from bigram counts; the last row and column stand for all other words, a class apart."""
    m = len(pairs) - 1
    classes = max(1, min(classes, m))
    of = np.append(np.arange(m) % classes, classes)
    one = np.eye(classes + 1)[of]
    right, left = pairs @ one, pairs.T @ one  # counts of word -> class, class -> word
    table = one.T @ right
    for _ in range(rounds):
        moved = 0
        for w in range(m):
            a, own = of[w], pairs[w, w]
            r, c = right[w].copy(), left[w].copy()
            r[a] -= own
            c[a] -= own
            table[a] -= r
            table[:, a] -= c
            table[a, a] -= own
            score = gains(table, r, c, own)
            k = int(np.argmax(score[:classes]))
            if score[k] <= score[a] + 1e-9:
                k = a
            table[k] += r
            table[:, k] += c
            table[k, k] += own
            if k != a:
                moved += 1
                right[:, a] -= pairs[:, w]
                right[:, k] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, k] += pairs[w]
                of[w] = k
        if not moved:
            break
    return of[:m]


def assign(texts: DataFrame, core: dict[bytes, int], head: dict[bytes, int], table: np.ndarray) -> dict[bytes, int]:
    """Classes of the head words outside the core. core: word -> class; head: all head words -> their numbers; table:
    class bigrams of the core words, with all other words as the last class.

    The texts are read once; each task sums its counts of (word, neighbour's class), and Spark sums those by word."""
    words, rest = list(head), len(table) - 1
    of = np.array([core.get(w, rest) for w in words] + [rest], np.int64)
    sent = texts.sparkSession.sparkContext.broadcast((head, of, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, of, table = sent.value
        rest, slots = len(table) - 1, 2 * len(table) + 1  # after it, before it, beside itself
        get, found, size = _numbered(head, -1).__getitem__, [], 0
        end = head.get(END, -1)

        def out():
            keys, n = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            sums = np.bincount(n, np.concatenate([v for _, v in found])).astype(np.int64)
            return keys, sums

        def batch_of(keys, sums):
            return pa.RecordBatch.from_arrays([pa.array(keys // slots), pa.array((keys % slots).astype(np.int32)), pa.array(sums)], ["word", "slot", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = np.fromiter(map(get, tokens(text)), np.int64)
                ids = np.concatenate(([end], ids, [end]))
                a, b = ids[:-1], ids[1:]
                same = a == b
                loose = (a >= 0) & (of[a] == rest)
                x = a[loose] * slots + np.where(same[loose], slots - 1, of[b[loose]])
                loose = (b >= 0) & (of[b] == rest) & ~same
                y = b[loose] * slots + len(table) + of[a[loose]]
                keys = np.concatenate([x, y])
                found.append((keys, np.ones(len(keys), np.int64)))
                size += len(keys)
                if size > 4 * FLUSH:
                    keys, sums = out()
                    found, size = [(keys, sums)], len(keys)
                    if size > 2 * FLUSH:
                        yield batch_of(keys, sums)
                        found, size = [], 0
        if size:
            yield batch_of(*out())

    sums = texts.mapInArrow(run, "word long, slot int, n long").repartition("word").groupBy("word", "slot").agg(F.sum("n").alias("n"))
    rows = sums.groupBy("word").agg(F.collect_list(F.struct("slot", "n")).alias("x")).select("word", "x.slot", "x.n")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value[2]
        rest = len(table) - 1
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x = np.zeros((part.num_rows, 2 * len(table) + 1))
                for i, (slot, n) in enumerate(zip(part.column(1), part.column(2))):
                    x[i, slot.values.to_numpy()] = n.values.to_numpy()
                chosen = place(table, x[:, : rest + 1], x[:, rest + 1 : -1], x[:, -1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(chosen, pa.int64())], ["word", "class"])

    got = rows.mapInArrow(best, "word long, class long").toArrow()
    return {words[w]: k for w, k in zip(got["word"].to_pylist(), got["class"].to_pylist())}


def place(table: np.ndarray, r: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The best class for each word of those that so far count among the rest, the table's last class."""
    left, rest = np.repeat(table[None], len(r), 0), len(table) - 1
    left[:, rest] -= r
    left[:, :, rest] -= c
    left[:, rest, rest] -= own
    return np.argmax(gains(np.maximum(left, 0), r, c, own)[:, :rest], 1)


def _numbered(words: dict[bytes, int], other: int) -> dict[bytes, int]:
    class Numbers(dict):
        def __missing__(self, word):
            return other

    return Numbers(words)


def pair_counts(texts: DataFrame, number: dict[bytes, int], size: int) -> np.ndarray:
    """Counts of neighbouring numbers in the texts, END at both ends; words without one have size - 1. At most size^2
    sums, whatever the corpus."""
    sent = texts.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _numbered(sent.value, size - 1).__getitem__
        counts, end = np.zeros(size * size, np.int64), sent.value.get(END, size - 1)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = np.fromiter(map(get, tokens(text)), np.int64)
                ids = np.concatenate(([end], ids, [end]))
                np.add.at(counts, ids[:-1] * size + ids[1:], 1)
        at = counts.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["pair", "n"])

    found = texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, head: int = HEAD, core: int = CORE, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row."""
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col, F.coalesce(fold(F.col(id_col), folds) == held, F.lit(False)).alias("held_out"))
    train = docs.filter(F.col(id_col).isNotNull() & ~F.col("held_out")).select(text_col)
    scratch = Scratch(spark, "brown")
    vocab = scratch.write(word_counts(train), "words")
    total, size = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()

    # Levels of count, eight to a doubling: the head is all words of the highest levels that hold at most `head` words; words
    # seen once never are in it, the end token always is.
    is_end = F.col("word") == F.lit(END)
    level = F.when((F.octet_length("word") <= LONG) & (F.col("n") > 1), F.floor(F.log2("n") * 8)).otherwise(-1)
    least, kept = 1 << 20, 0
    for n, k in vocab.groupBy(level.alias("level")).count().filter("level >= 0").orderBy(F.desc("level")).collect():
        if kept + k > head:
            break
        least, kept = n, kept + k
    in_head = is_end | (level >= least)
    table = vocab.filter(in_head).toArrow()
    order = sorted(zip(table["n"].to_pylist(), table["word"].to_pylist()), key=lambda x: (-x[0], x[1]))
    words, counts = [w for _, w in order], np.array([n for n, _ in order], np.int64)
    once, twice = vocab.filter(~is_end).agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    rare_tokens = total - int(counts.sum())
    # shares of the rare class: one for all unseen words, one for each word seen once, its count for each other word
    unseen, single = once + 1, min(1.0, (2 * twice + 1) / (once + 1))
    rare_whole = unseen + once * single + rare_tokens - once

    frequent = [w for w in words if w != END][:core]
    pairs = pair_counts(train, {w: i for i, w in enumerate(frequent)}, len(frequent) + 1)
    cluster = dict(zip(frequent, exchange(pairs, classes, rounds).tolist())) if frequent else {}
    first = max(cluster.values(), default=-1) + 1
    if len(words) > len(frequent) + (END in words) and first:
        one = np.eye(first + 1)[[*cluster.values(), first]]
        cluster |= {w: k for w, k in assign(train, cluster, {w: i for i, w in enumerate(words)}, one.T @ pairs @ one).items() if w != END}
    of = np.array([first if w == END else cluster[w] for w in words], np.int64)
    rare = first + 1
    moves = pair_counts(train, {w: int(c) for w, c in zip(words, of)}, rare + 1)

    n_class = np.bincount(of, counts, rare + 1)
    n_class[rare] = rare_tokens
    share = (n_class + 1) / (n_class + 1).sum()
    step = np.log10((moves + share) / (moves.sum(1, keepdims=True) + 1))
    emit = np.log10(counts / n_class[of]) if len(of) else np.zeros(0)
    base = np.log10((counts + 1) / (total + size + 1)) if len(of) else np.zeros(0)
    sent = spark.sparkContext.broadcast((words, of, emit, base, step, first, rare))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, of, emit, base, step, end, rare = sent.value
        number = {w: i for i, w in enumerate(words)}
        get, end_at = _numbered(number, -1).__getitem__, number.get(END, -1)
        of, emit, base = np.append(of, rare), np.append(emit, 0.0), np.append(base, 0.0)  # place -1: not in the head
        for batch in batches:
            sums, rest, times = [], [], []
            for text in batch.column(1).to_pylist():
                own = tokens(text)
                at = np.fromiter(map(get, own), np.int64, len(own))
                missed = (at < 0).nonzero()[0]
                ids = np.append(at, end_at)
                kinds = of[ids]
                kinds[-1] = end
                prior = np.append(end, kinds[:-1])
                sums.append((len(own) + 1, int((ids >= 0).sum()), float(base[ids].sum()), float(emit[ids].sum() + step[prior, kinds].sum())))
                tail = Counter([own[i] for i in missed.tolist()])
                if end_at < 0:
                    tail[END] += 1
                rest.append(list(tail))
                times.append(list(tail.values()))
            cols = list(zip(*sums)) if sums else [[]] * 4
            arrays = [batch.column(0), batch.column(2), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64())))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(rest, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))], [id_col, "held_out", "n_tokens", "n_head", "base", "model", "rest", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    half = docs.select(id_col, text_col, "held_out").mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_head long, base double, model double, rest array<binary>, times array<long>")
    half = scratch.write(half.withColumn("row", F.monotonically_increasing_id()), "half")
    rest = half.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("k"))
    n = F.coalesce("n", F.lit(0))
    within = F.when(n == 0, F.lit(float(unseen))).when(n == 1, F.lit(single)).otherwise(n)
    met = rest.hint("merge").join(vocab.filter(~in_head), "word", "left").groupBy("row").agg(F.sum(F.when(n > 0, F.col("k")).otherwise(0)).alias("known"), F.sum("k").alias("k"), F.sum(F.col("k") * F.log10(n + 1)).alias("logs"), F.sum(F.col("k") * F.log10(within)).alias("rare"))
    flat, flat_rare = math.log10(total + size + 1), math.log10(rare_whole)
    both = half.drop("rest", "times").hint("merge").join(met, "row", "left")
    k, logs = F.coalesce("k", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    scored = both.select(id_col, "held_out", "n_tokens", (F.col("n_head") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + logs - k * flat).alias("base_score"), (F.col("model") + F.coalesce("rare", F.lit(0.0)) - k * flat_rare).alias("score"))
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
