"""Search: a batch of queries against the card pool.

A query hits a card if any of its words is a substring of any field. A word of three characters or more has its first
three as anchor; the pieces of three characters that a card's fields offer meet it by an equi-join, and the pairs found
are verified. Shorter words have one or two characters for an anchor and meet the pieces of that length. The batch is
the stated query set: its anchors are broadcast behind a check of their number, and beyond it the join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatline.functions.lexicon import fits
from heatline.functions.scores import FIELD_WEIGHTS, relevance, words_in
from heatline.functions.text import highlight, query_words, title_key

#: Characters of an anchor.
PIECE = 3
#: Shares that the cards of one title are dealt to.
SHARES = 16


def pool(models: DataFrame, news: DataFrame, history: DataFrame, words: DataFrame) -> DataFrame:
    """Models, current news, history and words as one table; of equal ids the first side's row. Words have ids of their own."""
    from heatline.operators.boards import keep_first

    out = None
    for side, df in enumerate((models, news, history, words)):
        own = df.withColumn("side", F.lit(side))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    space = F.when(F.col("kind") == "word", F.lit("w")).otherwise(F.lit("c"))
    return keep_first(out, F.when(F.col("id").isNotNull(), F.concat(space, F.lit(":"), "id")), "side")


def pieces(fields: list[Column], lengths: list[int]) -> Column:
    """Distinct pieces of the given lengths of the lower-cased fields; none reaches over the end of a field."""
    text = F.lower(F.concat_ws("\u0001", *fields))
    none = F.array().cast("array<string>")

    def cut(n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(none)

    return F.array_distinct(F.concat(none, *map(cut, lengths)))


def search(cards: DataFrame, queries: DataFrame, n: int = 20, words: int = 3) -> DataFrame:
    """cards(kind, id, ...) and queries(qid, q) -> (qid, section, rank, kind, id, score, fields, ...): cards by score, one for each title among news;
    word cards apart, the first `words`."""
    names = [c for c in FIELD_WEIGHTS if c in cards.columns]
    asked = queries.withColumn("words", query_words(F.col("q"))).filter(F.size("words") > 0)
    key = F.when(F.col("kind") == "news", F.coalesce(*(title_key(F.col(c)) for c in ("title_zh", "title_en", "title") if c in cards.columns)))
    cards = cards.withColumn("_k", F.coalesce(key, F.concat(F.lit("\u0000"), "kind", F.lit(":"), "id"))).withColumn("_s", F.pmod(F.xxhash64("kind", "id"), F.lit(SHARES)))
    each = asked.withColumn("_all", F.array_distinct(F.transform("words", lambda w: F.substring(w, 1, PIECE))))
    anchors = each.select("qid", F.posexplode("_all").alias("_p", "anchor"), "_all")
    lengths = [r.n for r in anchors.select(F.length("anchor").alias("n")).distinct().collect()]  # PIECE of them at most
    offered = F.explode(pieces([F.col(c) for c in names], lengths)).alias("anchor")
    if fits(anchors):
        # of a query's anchors that a card has the first one stands for the pair
        own = cards.filter("kind is not null and id is not null").repartition("_k", "_s").withColumn("_text", F.lower(F.concat_ws("\u0001", *names)))
        firsts = each.select(*asked.columns, F.posexplode("_all").alias("_p", "anchor"), "_all").select(*asked.columns, "anchor", F.slice("_all", F.lit(1), F.col("_p")).alias("_before"))
        met = own.select("*", offered).join(F.broadcast(firsts), "anchor")
        met = met.filter(~F.exists("_before", lambda a: F.col("_text").contains(a))).drop("anchor", "_before", "_text")
    else:
        pairs = cards.select("kind", "id", offered).hint("merge").join(anchors.select("qid", "anchor"), "anchor").select("kind", "id", "qid").distinct()
        met = cards.hint("merge").join(pairs, ["kind", "id"]).hint("merge").join(asked, "qid")
    met = met.withColumns({f"_{c}": F.lower(F.coalesce(c, F.lit(""))) for c in names})
    met = met.withColumns({f"_{c}": words_in(F.col("words"), F.col(f"_{c}")) for c in names})
    met = met.filter(" or ".join(f"`_{c}` > 0" for c in names))
    score, fields = relevance(F.size("words"), {c: (F.col(c), F.col(f"_{c}")) for c in names}, F.coalesce(F.nullif("hot", F.lit(0)), F.lit(0)))
    out = met.withColumns({"score": score, "fields": fields}).filter("score is not null").drop(*(f"_{c}" for c in names))
    word = F.col("kind") == "word"
    order = [F.desc("score"), F.col("kind"), F.col("id")]
    most = {"main": max(1, min(n, 100)), "word": words}
    out = out.withColumn("section", F.when(word, "word").otherwise("main"))
    # The first rows of each share hold those of the whole: a row that others of its share keep out has as many better titles
    # before it. So the hits are ranked where their cards lie, and few rows of each share move.
    for share in (["_s"], []):
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "_k", *share).orderBy(*order))).filter("_n = 1")
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "section", *share).orderBy(*order))).filter(F.col("rank") <= max(most.values()))
    return out.filter(F.col("rank") <= F.when(word, most["word"]).otherwise(most["main"])).drop("_k", "_s", "_n", "side")


def history_hits(found: DataFrame) -> DataFrame:
    return found.groupBy("qid").agg(F.count_if("from_history").alias("history_hits"))


def marked(found: DataFrame, *names: str) -> DataFrame:
    """Hits with their words in <mark>."""
    return found.withColumns({f"highlight_{c}": highlight(F.col(c), F.col("q")) for c in names})


def substring_search(cards: DataFrame, q: str, n: int = 200, fields: tuple[str, ...] = ("title", "title_zh", "title_en", "summary_zh", "summary_en", "source", "keywords_text")) -> DataFrame:
    """Cards with the text in a field, any case, wild cards plain; by score and date."""
    low = q.strip().lower()
    hit: Column = F.lit(False)
    for c in fields:
        if c in cards.columns:
            hit |= F.coalesce(F.lower(F.col(c)).contains(low), F.lit(False))
    return cards.filter(hit & F.lit(bool(low))).orderBy(F.desc("score"), F.desc("published"), "url").limit(n)
