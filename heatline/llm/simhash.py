"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bits gets a nonzero code of radius+1 bits; the mask of code word v keeps the bits whose code has odd
overlap with v. The up to `radius` bits in which two fingerprints differ have codes that leave some v orthogonal to
all of them, so the pair is equal under that mask: every pair within the radius meets in one of the 2^(radius+1)-1
tables. Equal fingerprints are collapsed first.

Inside a bucket small enough, pairs are compared. A larger bucket is linked through midpoints instead: for radius 2
each fingerprint emits itself and its 64 one-bit neighbours; those that share one are all within two bits of each
other, and any two within two bits share one, so tying each to the least of them gives the same components from
65 rows a fingerprint in place of all pairs. No bucket is capped.

Null and empty texts have fingerprint zero and link like any other; texts of any length are read whole. Ids are integers. Rows with a null id get a fingerprint and a null
component. Repeated ids are one node each. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatline.llm.common import Scratch

#: Fingerprints in a bucket up to which its pairs are compared one by one.
SMALL = 32


def fingerprint(text: str | None, width: int = 3) -> int:
    """The signed 64-bit SimHash of a text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends]
        hashes = [xxh64_intdigest(line[a : b - 1], 42) for a, b in zip(starts, ends[width - 1 :])]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The signed number of the bits that are set in over half of 64-bit hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        block = hashes[at : at + 4096].view(np.uint64).astype(">u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def masks(radius: int, bits: int = 64) -> list[int]:
    """Signed masks, one for each nonzero code word; bit i has code i mod (2^(radius+1)-1) + 1."""
    words = 2 ** (radius + 1) - 1
    found = []
    for v in range(1, words + 1):
        m = sum(1 << i for i in range(bits) if bin((i % words + 1) & v).count("1") % 2)
        found.append(m - (1 << 64) if m >> 63 else m)
    return found


def links(nodes: DataFrame, scratch: Scratch, radius: int = 2) -> DataFrame:
    """nodes(node long, fp long), fp distinct -> (a, b) with a > b: links whose components are those of all pairs within
    the radius (1 or 2)."""
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    tables = nodes.select("node", "fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)))).alias("t", "key"))
    sizes = tables.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = scratch.write(tables.hint("merge").join(sizes, ["t", "key"]), "buckets")
    small = met.filter(F.col("n") <= SMALL).drop("n")
    other = small.select("t", "key", F.col("node").alias("node2"), F.col("fp").alias("fp2"))
    pairs = small.hint("merge").join(other, ["t", "key"]).filter((F.col("node") > F.col("node2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)).select(F.col("node").alias("a"), F.col("node2").alias("b"))
    one_bit = [F.lit(0), *(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64))]
    large = met.filter(F.col("n") > SMALL).select("node", "fp").distinct()
    if radius == 2:
        near = large.select("node", F.explode(F.array(*(F.col("fp").bitwiseXOR(b) for b in one_bit))).alias("mid"))
        least = near.groupBy("mid").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
        stars = near.hint("merge").join(least, "mid").filter("node > b").select(F.col("node").alias("a"), "b")
    else:  # a pair one bit apart is a fingerprint and a one-bit neighbour of the other
        near = large.select("node", F.explode(F.array(*(F.col("fp").bitwiseXOR(b) for b in one_bit[1:]))).alias("mid"))
        stars = near.hint("merge").join(large.select(F.col("node").alias("other"), F.col("fp").alias("mid")), "mid").select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b"))
    return pairs.union(stars).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "edges", rounds: int = 100) -> DataFrame:
    """edges(a, b) with a > b -> (node, component): the least node that each can reach.

    Alternating large-star and small-star steps (Kiveris et al. 2014). Each is a grouped minimum and a merge join, which
    splits hub nodes; each round is written to the shared folder, and its forerunner deleted. Ends when no edge changes."""
    now = scratch.write(edges, f"{name}0")
    for k in range(rounds):
        both = now.union(now.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.hint("merge").join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.hint("merge").join(least, "a")
        then = scratch.write(met.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.toDF("a", "b")).distinct(), f"{name}{k + 1}")
        mix = lambda df: df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if mix(then) == mix(now):
            break
        scratch.drop(f"{name}{k}")
        now = then
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for each row; component_id is the smallest id reachable over links."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = scratch.write(prints.filter(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).cast("long").alias("node")), "nodes")
    # An id repeated with different texts ties its fingerprints together.
    ids = prints.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("fp").alias("fp"), F.max("fp").alias("most")).filter("fp < most").select(id_col)
    repeated = prints.join(ids, id_col, "left_semi").distinct().hint("merge").join(nodes, "fp").groupBy(id_col, "node").count()
    tied = repeated.hint("merge").join(repeated.groupBy(id_col).agg(F.min("node").alias("b")), id_col).filter("node > b").select(F.col("node").alias("a"), "b")
    found = components(links(nodes, scratch, radius).union(tied).distinct(), scratch)
    scratch.drop("buckets")
    roots = nodes.hint("merge").join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.hint("merge").join(roots, "fp", "left").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))
