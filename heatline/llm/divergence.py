"""How the sources of a language differ: each source's term shares against every other source's and the language's own.

Identical texts of a language are collapsed first: one text moves for each digest, together with how often each source
has it, and is tokenized once. A task adds counts and document frequencies, weighted by these multiplicities, in memory of
bounded size, and passes on one row per term and source. Terms in at least `least` documents of the language are kept.

A divergence between two sources is a sum over all kept terms, most of which neither or only one of them has. With p0 and
q0, the shares of a term that does not occur there, the sum over all terms splits into
  sum f(p, q0) over a's own counts + sum (f(p0, q) - f(p0, q0)) over b's own counts
  + sum (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)) over terms that both have.
The first two need only how many terms have which count in a source, and the third the terms that two sources share, so
no term is looked at for a source that lacks it. All numbers are whole; products that pass 64 bits are decimals.

Null text, lang and source read as ''. Empty texts count as documents without terms; a source without terms is a group
like any other; repeated rows count each; an empty table gives no rows; other columns are not read. A text's row lists
the sources that have it, and a term's row those that use it; rows never list documents. Sums of f must fit a long, as
the report's columns do, else the query fails rather than wraps.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatline.llm.common import Scratch

SCALE = 1_000_000_000
#: Terms that a task gathers before it passes their counts on.
GATHERED = 600_000
#: Groups (lang and source) up to which their table is broadcast.
FITS = 20_000
#: Bytes to the bytes of terms: ASCII letters in lower case, bytes of other characters as they are, all else a space.
_TERM = bytes(b if b >= 0x80 else b | 0x20 if chr(b).isalpha() else 0x20 for b in range(256))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)); null without terms."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.when(terms > 0, F.lit(1) + F.call_function("div", above, (total + terms).cast("decimal(19,0)")))


def differ(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def counted(texts: DataFrame) -> DataFrame:
    """texts(lang, weights array<struct<idx,n>>, text) -> (lang, term, idx, n, docs): occurrences of a term in the texts of
    source idx and documents with it. Counts are partial: a term and source may stand in several rows."""

    def emit(held: dict[tuple[str, int], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, idx), (terms, docs) in held.items():
            arrays = [pa.array([lang] * len(terms), pa.string()), pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array([idx] * len(terms), pa.int32()), pa.array(list(terms.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "term", "idx", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for batch in batches:
            for lang, weights, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                words = text.translate(_TERM).split()
                size += len(words)
                if len(weights) == 1 and weights[0]["n"] == 1:
                    terms, docs = held[lang, weights[0]["idx"]]
                    terms.update(words)
                    docs.update(set(words))
                else:
                    own = Counter(words)
                    for idx, n in [(w["idx"], w["n"]) for w in weights]:
                        terms, docs = held[lang, idx]
                        for term, count in own.items():
                            terms[term] += n * count
                            docs[term] += n
                if size > GATHERED:
                    size = sum(len(terms) for terms, _ in held.values())
                    if size > GATHERED:
                        yield from emit(held)
                        held.clear()
                        size = 0
        yield from emit(held)

    return texts.select("lang", "weights", "text").mapInArrow(run, "lang string, term string, idx int, n long, docs long")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank). Part pair: each other source of the lang by divergence. Part term: the
    source's terms that are commoner than in the lang, by their part of the divergence from it, `top` at most."""
    scratch = Scratch(docs.sparkSession, "divergence")
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    in_lang = Window.partitionBy("lang").orderBy("source")
    groups = scratch.write(rows.select("lang", "source").distinct().withColumn("idx", F.row_number().over(in_lang) - 1), "groups")
    how = "broadcast" if groups.count() <= FITS else "merge"

    keyed = rows.withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    copies = keyed.groupBy("digest", "lang", "source").agg(F.count("*").alias("n"))
    weights = copies.join(groups.hint(how), ["lang", "source"]).groupBy("digest", "lang").agg(F.collect_list(F.struct("idx", "n")).alias("weights"))
    once = keyed.groupBy("digest", "lang").agg(F.first("text").alias("text"))
    parts = counted(once.hint("merge").join(weights, ["digest", "lang"]))
    # tasks have summed before the shuffle, and dealing by term serves both aggregations
    sums = parts.repartition("lang", "term").groupBy("lang", "term", "idx").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = scratch.write(
        sums.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("idx", "n")).alias("counts"))
        .filter(F.col("docs") >= least),
        "kept",
    )

    single = kept.select("lang", F.explode("counts").alias("c")).select("lang", "c.idx", "c.n").groupBy("lang", "idx", "n").agg(F.count("*").alias("terms"))
    single = scratch.write(single, "counts")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_total"))
    totals = single.groupBy("lang", "idx").agg(F.sum(F.col("n") * F.col("terms")).alias("total"), F.sum("terms").alias("terms"))
    zero = F.lit(0).cast("long")
    sized = groups.hint("merge").join(totals, ["lang", "idx"], "left").hint("merge").join(langs, "lang", "left").select("lang", "source", "idx", *(F.coalesce(c, zero).alias(c) for c in ("total", "terms", "v", "lang_total")))
    sized = scratch.write(sized.withColumn("p0", share(zero, F.col("total"), F.col("v"))), "sized")
    bases = scratch.write(sized.groupBy("lang", "v", "lang_total").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "total", "p0"))), lambda s: F.struct(s["total"], s["p0"])).alias("bases")), "bases")

    base = lambda c: F.get("bases", c["idx"])
    rated = kept.join(bases.hint(how), "lang").select("lang", "term", share(F.col("total"), F.col("lang_total"), F.col("v")).alias("q"), F.transform("counts", lambda c: F.struct(c["idx"].alias("idx"), share(c["n"], base(c)["total"], F.col("v")).alias("p"), base(c)["p0"].alias("p0"))).alias("counts"))
    a, b = F.col("a"), F.col("b")
    both = rated.select("lang", "counts", F.explode("counts").alias("a")).select("lang", "a", F.explode("counts").alias("b")).filter("a.idx <> b.idx")
    shared = both.select("lang", F.col("a.idx").alias("x"), F.col("b.idx").alias("y"), (differ(a["p"], b["p"]) - differ(a["p"], b["p0"]) - differ(a["p0"], b["p"]) + differ(a["p0"], b["p0"])).alias("value"))

    missing = sized.filter("v > terms").select("lang", "idx", zero.alias("n"), (F.col("v") - F.col("terms")).alias("terms"))
    total, p0 = sized.select("lang", "idx", "total", "p0", "v"), sized.select("lang", F.col("idx").alias("other"), F.col("p0").alias("q0"))
    levels = single.unionByName(missing).join(total.hint(how), ["lang", "idx"]).select("lang", "idx", "n", "terms", "p0", share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    met = levels.join(p0.hint(how), "lang").filter("idx <> other")
    p, q0 = F.col("p"), F.col("q0")
    of_a = met.select("lang", F.col("idx").alias("x"), F.col("other").alias("y"), (differ(p, q0) * F.col("terms")).alias("value"))
    of_b = met.filter("n > 0").select("lang", F.col("other").alias("x"), F.col("idx").alias("y"), ((differ(q0, p) - differ(q0, F.col("p0"))) * F.col("terms")).alias("value"))
    pairs = total.join(p0.hint(how), "lang").filter("idx <> other").select("lang", F.col("idx").alias("x"), F.col("other").alias("y"), zero.alias("value"))
    sum_ = F.sum(F.col("value").cast("decimal(20,0)")).cast("long")
    values = shared.union(of_a).union(of_b).union(pairs).groupBy("lang", "x", "y").agg(sum_.alias("value"))
    name = lambda idx, as_: sized.select("lang", F.col("idx").alias(idx), F.col("source").alias(as_)).hint(how)
    pair = values.join(name("x", "source"), ["lang", "x"]).join(name("y", "item"), ["lang", "y"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.withColumn("rank", F.row_number().over(ranked))

    own = rated.select("lang", "term", "q", F.explode("counts").alias("c")).select("lang", F.col("c.idx").alias("idx"), F.col("term").alias("item"), F.col("c.p").alias("p"), "q").filter("p > q")
    best = Window.partitionBy("lang", "idx").orderBy(F.desc("value"), "item")
    own = own.select("lang", "idx", "item", differ(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    term = own.join(name("idx", "source"), ["lang", "idx"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pair.union(term)
