"""Near-duplicates by Jaccard similarity of word shingles: every pair at or above the bound, none below it.

Two ways find pairs, and each pair is verified by its whole sets. First, covering LSH over SimHash fingerprints of the
shingles (see simhash.py) links texts that lie within two bits, and their components make groups. At a similarity of 0.8
fingerprints lie up to 16 bits apart, and masks that cover 16 bits would need 2^17 - 1 tables, so that alone isn't whole.
Therefore a prefix filter finds the pairs that the groups leave: two sets of similarity t or more share an element among
the first n - ceil(t*n) + 1 of each, in any order that all sets agree on, so pairs of different groups meet at those
elements alone; sizes and places in the order rule out most of them (Xiao et al. 2008). No pair is lost. The order is by
hash, with shingles that are common in a sixteenth of the texts last: which ones those are changes the cost, not the
result. Equal sets are collapsed before all this.

At an element of more than SMALL sets, each is first compared with the least of its size; only pairs that the links
found so far leave in different groups are compared after that. No element is capped.

Null and empty texts have the empty set and are copies of each other. Rows with a null id are copies of nothing. Ids are
integers; an id repeated with different texts ties its groups. An empty table gives an empty result; other columns are
not read, and texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatline.llm.common import Scratch
from heatline.llm.simhash import components, links, majority

#: Sets at an element up to which its pairs are compared one by one; how many common shingles are sent to the tasks.
SMALL, COMMON = 32, 500_000
#: Shingles are counted in so many buckets; the lesser counts bound what two sets share, before the sets themselves move.
BUCKETS = 512


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted hashes of a text's word shingles; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(line, 42)], np.uint64).view(np.int64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    return np.unique(np.array([xxh64_intdigest(line[a : b - 1], 42) for a, b in zip(starts, ends[width - 1 :])], np.uint64).view(np.int64))


def prefix(found: np.ndarray, least: Fraction, common: np.ndarray) -> np.ndarray:
    """The first elements, one of which any set of that similarity shares; common ones come last in the order."""
    if len(found) and len(common):
        late = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.concatenate([found[~late], found[late]])
    return found[: len(found) - math.ceil(least * len(found)) + 1]


def counts(found: np.ndarray) -> bytes:
    """How many elements fall into each bucket; 255 stands for that many or more."""
    return np.minimum(np.bincount(found & (BUCKETS - 1), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def _mapped(docs: DataFrame, make, cols: str) -> DataFrame:
    """(id, text) -> (id, *make(text))."""
    names, types = [c.split()[0] for c in cols.split(", ")], [{"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}[c.split()[1]] for c in cols.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = list(zip(*(make(t) for t in part.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(made, types))], ["id", *names])

    return docs.mapInArrow(run, f"id long, {cols}")


def _common(rows: DataFrame, width: int, scratch: Scratch) -> np.ndarray:
    """Shingles that many texts hold, as a sixteenth of the texts tells; COMMON of them at most, of the highest counts."""
    some = _mapped(rows.filter(F.pmod(F.xxhash64("id"), F.lit(16)) == 0), lambda t: (shingles(t, width),), "s array<long>")
    level = F.floor(F.log2("n") * 8)
    counts = scratch.write(some.select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("n")).filter("n >= 4").select("s", level.alias("level")), "common")
    least, kept = 1 << 20, 0
    for n, k in counts.groupBy("level").count().orderBy(F.desc("level")).collect():
        if kept + k > COMMON:
            break
        least, kept = n, kept + k
    found = np.sort(counts.filter(F.col("level") >= least).select("s").toArrow()["s"].to_numpy())
    scratch.drop("common")
    return found


def _near(rows: DataFrame, pairs: DataFrame, least: Fraction, width: int, scratch: Scratch, name: str) -> DataFrame:
    """pairs(a, b) of ids whose sets have the similarity."""
    pairs = scratch.write(pairs.distinct(), f"{name}-pairs")
    ids = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-candidates")
    sets = scratch.write(_mapped(rows.join(ids, "id", "left_semi"), lambda t: ((found := shingles(t, width)), counts(found), len(found)), "s array<long>, counts binary, n long"), f"{name}-sets")
    short = sets.select("id", "counts", "n")
    both = pairs.hint("merge").join(short.toDF("a", "counts", "n"), "a").hint("merge").join(short.toDF("b", "counts2", "n2"), "b")

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, BUCKETS) for c in ("counts", "counts2"))
                most = np.minimum(x, y).sum(1, dtype=np.int64)  # no more elements than these are shared
                p, q, n = least.numerator, least.denominator, np.array(part.column("n").to_pylist()) + np.array(part.column("n2").to_pylist())
                keep = (most * (p + q) >= n * p) | ((x == 255) & (y == 255)).any(1)
                yield part.filter(pa.array(keep)).select(["a", "b"])

    pairs = scratch.write(both.select("a", "b", "counts", "n", "counts2", "n2").mapInArrow(may, "a long, b long"), f"{name}-likely")
    ids = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-likely_ids")
    sets = sets.select("id", "s").join(ids, "id", "left_semi")
    both = pairs.hint("merge").join(sets.toDF("a", "s"), "a").hint("merge").join(sets.toDF("b", "s2"), "b")
    shared = F.size(F.array_intersect("s", "s2"))
    found = scratch.write(both.filter(shared * least.denominator >= (F.size("s") + F.size("s2") - shared) * least.numerator).select("a", "b").distinct(), name)
    scratch.drop(*(f"{name}-{x}" for x in ("pairs", "candidates", "sets", "likely", "likely_ids")))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: str = "0.8", width: int = 5) -> DataFrame:
    """(id, component_id) for each row with an id; component_id is the smallest id reachable over pairs of that similarity."""
    least, spark = Fraction(similarity), docs.sparkSession
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scratch = Scratch(spark, "copies")
    sent = spark.sparkContext.broadcast(_common(rows, width, scratch))

    def make(text):
        from xxhash import xxh3_128_digest

        found = shingles(text, width)
        k1, k2 = np.frombuffer(xxh3_128_digest(found.tobytes()), np.int64).tolist()
        return k1, k2, majority(found), len(found), prefix(found, least, sent.value)

    made = scratch.write(_mapped(rows, make, "k1 long, k2 long, fp long, n long, first array<long>"), "shingles")
    nodes = scratch.write(made.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.any_value("fp").alias("fp")), "nodes")
    prints = scratch.write(nodes.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    equal = nodes.hint("merge").join(prints, "fp").filter("node > least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    linked = _near(rows, links(prints.select(F.col("least").alias("node"), "fp"), scratch).union(equal), least, width, scratch, "linked")
    scratch.drop("buckets", "prints")
    groups = scratch.write(components(linked, scratch, "first"), "first_groups")

    ones = made.hint("merge").join(nodes.select("k1", "k2", F.col("node").alias("id")), ["k1", "k2", "id"], "left_semi")
    ones = ones.withColumnRenamed("id", "node").hint("merge").join(groups, "node", "left")
    keys = scratch.write(ones.select("node", "n", F.coalesce("component", "node").alias("c"), F.posexplode("first").alias("i", "key")), "keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("x"), F.max("c").alias("y")).filter("x < y").select("key", "m")
    met = scratch.write(keys.hint("merge").join(sizes, "key"), "met")
    scratch.drop("keys", "first_groups")

    def fit(n, i, n2, i2):
        """Sizes allow the similarity, and so do the elements left after this one."""
        p, q = least.numerator, least.denominator
        return (F.least(n, n2) * q >= F.greatest(n, n2) * p) & (F.least(n - i, n2 - i2) * (p + q) >= (n + n2) * p)

    def pairs(left, right):
        two = right.select("key", F.col("node").alias("b"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("c").alias("c2"))
        return left.hint("merge").join(two, "key").filter(fit(F.col("n"), F.col("i"), F.col("n2"), F.col("i2"))).filter("c != c2")

    small = met.filter(F.col("m") <= SMALL)
    found = pairs(small, small).filter("node > b").select(F.col("node").alias("a"), "b")
    large = met.filter(F.col("m") > SMALL).withColumn("band", F.floor(F.log("n") / math.log(1 / float(least))))
    hubs = large.groupBy("key", "band").agg(F.min(F.struct("node", "c")).alias("hub"))
    stars = large.hint("merge").join(hubs, ["key", "band"]).filter("node > hub.node and c != hub.c").select(F.col("node").alias("a"), F.col("hub.node").alias("b"))
    # An id with several texts ties their groups.
    ids = made.groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("x"), F.max(F.struct("k1", "k2")).alias("y")).filter("x < y").select("id")
    ties = made.join(ids, "id", "left_semi").hint("merge").join(nodes, ["k1", "k2"]).filter("id > node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    edges = _near(rows, found.union(stars), least, width, scratch, "near").union(linked).union(ties).distinct()
    groups = scratch.write(components(edges, scratch, "second"), "groups")
    if not large.isEmpty():
        own = large.drop("c").hint("merge").join(groups, "node", "left").withColumn("c", F.coalesce("component", "node")).select("key", "node", "n", "i", "c")
        by = own.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("most"), F.count("*").alias("groups")).filter("groups > 1")
        split = scratch.write(own.hint("merge").join(by, "key"), "split")
        rest = split.filter("c != most")  # each pair of two groups has one outside the largest
        left = pairs(rest.select("key", "node", "n", "i", "c"), split.select("key", "node", "n", "i", "c"))
        more = _near(rows, left.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")), least, width, scratch, "more")
        scratch.drop("split")
        groups = components(edges.union(more).distinct(), scratch, "third")
    scratch.drop("met")
    roots = nodes.hint("merge").join(groups, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component_id"))
    return made.select("id", "k1", "k2").hint("merge").join(roots, ["k1", "k2"]).select(F.col("id").alias(id_col), "component_id")
