"""Term aggregates as changes: partial sums by term, day and dimension, kept up to date by signed deltas.

A refresh that aggregates all links of all cards again costs as much as the history is long. Here a cycle moves only the
links that changed: those of the cards that it touched, and those of terms whose representative changed, as twins that meet
or part count a card once between them. A link's row is (url, canon, published, dimension, score) under its representative,
distinct; what was there goes with sign -1 and what is there now comes with sign 1, so an old value is retracted however
often it changed. from_days() gives the same numbers as terms.aggregate() over everything, for any clock: the sums keep days,
so nothing has to be redone as the window moves on.

Null days and dimensions are groups like others (a null dimension counts as "other"); null scores count as 0. A table of sums
may hold several rows of one key, from several cycles: apply() folds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatline.functions import scores
from heatline.operators.terms import WINDOW_DAYS, to_rep

KEYS = ("canon", "published", "dimension")


def facts(links: DataFrame, cards: DataFrame, reps: DataFrame) -> DataFrame:
    """links(url, canon) of cards(url, published, dimension, score) -> the distinct rows that count, under representatives."""
    shown = cards.select("url", "published", F.coalesce("dimension", F.lit("other")).alias("dimension"), F.coalesce("score", F.lit(0)).cast("long").alias("score"))
    return to_rep(links.select("url", "canon"), reps).distinct().hint("merge").join(shown, "url")


def touched_urls(urls: DataFrame, old_links: DataFrame, new_links: DataFrame, old_reps: DataFrame, new_reps: DataFrame) -> DataFrame:
    """(url): the cycle's own, and those linked to a term that has another representative than before. reps(canon, rep)."""
    then = old_reps.select("canon", F.col("rep").alias("then"))
    met = then.hint("merge").join(new_reps.select("canon", F.col("rep").alias("now")), "canon", "full")
    moved = met.filter(~F.coalesce("then", "canon").eqNullSafe(F.coalesce("now", "canon"))).select("canon")
    linked = old_links.select("url", "canon").union(new_links.select("url", "canon")).hint("merge").join(moved, "canon", "left_semi")
    return urls.select("url").union(linked.select("url")).distinct()


def deltas(touched: DataFrame, old: tuple[DataFrame, DataFrame, DataFrame], new: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """Signed sums (canon, published, dimension, n, score) of what changed. old and new: links, cards and reps before and after
    the cycle; only rows of touched(url) are looked at."""

    def side(links: DataFrame, cards: DataFrame, reps: DataFrame, sign: int) -> DataFrame:
        near = lambda df: df.hint("merge").join(touched, "url", "left_semi")
        rows = facts(near(links), near(cards), reps)
        return rows.select(*KEYS, F.lit(sign).cast("long").alias("n"), (F.col("score") * sign).alias("score"))

    both = side(*old, -1).unionByName(side(*new, 1))
    return both.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("score").alias("score")).filter("n <> 0 or score <> 0")


def apply(sums: DataFrame | None, changes: DataFrame) -> DataFrame:
    """Sums after the changes; keys that nothing counts for any more go."""
    rows = changes if sums is None else sums.unionByName(changes)
    return rows.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("score").alias("score")).filter("n <> 0 or score <> 0")


def from_days(sums: DataFrame, as_of: Column) -> DataFrame:
    """One row a term, as terms.aggregate() gives it but for the counters of the current cycle."""
    today = F.to_date(as_of)
    inside = F.col("published") >= F.date_sub(today, WINDOW_DAYS)
    by_dim = sums.groupBy("canon", "dimension").agg(F.sum("n").alias("n")).filter("n <> 0")
    order = by_dim.groupBy("canon").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("dimension").alias("d")))).alias("x")).select("canon", F.transform("x", lambda x: x["d"]).alias("dims"))
    days = sums.groupBy("canon", "published").agg(F.sum("n").alias("n"), F.sum("score").alias("score")).filter("n <> 0")
    made = days.groupBy("canon").agg(
        F.sum("n").alias("mentions"), F.coalesce(F.sum(F.when(inside, F.col("score") * scores.recency_weight(F.col("published"), today))), F.lit(0.0)).alias("heat"),
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("win7"), F.min("published").alias("earliest"), F.max("published").alias("latest"), F.array_sort(F.collect_set("published")).alias("days"),
    )
    return made.hint("merge").join(order, "canon")


def daily_mentions(sums: DataFrame) -> DataFrame:
    """(canon, published, mentions): a term's cards of each day and the WINDOW_DAYS before it."""
    from pyspark.sql import Window

    by = sums.groupBy("canon", "published").agg(F.sum("n").alias("n")).filter("n <> 0")
    own = Window.partitionBy("canon").orderBy(F.unix_date("published")).rangeBetween(-WINDOW_DAYS, 0)
    return by.select("canon", "published", F.sum("n").over(own).alias("mentions"))
