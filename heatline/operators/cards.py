"""The card table: rows from items, and its upsert.

Plain Parquet has no update in place, so upsert() computes the next version of a whole table, and upsert_buckets() the next
version of the buckets that a batch touches; both are written beside the old ones, and readers take the newest commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatline.functions import scores
from heatline.functions.text import blank_to_null, decode_text, decode_url, keyword_key, title_key, url_key
from heatline.sources import store

KEYWORDS = 8
CARD = "url title title_zh title_en summary_zh summary_en dimension source region published hn_points reddit_score reddit_comments score trend hot keywords first_seen_at last_refresh_at active".split()


def item_cards(items: DataFrame, as_of: Column, home: str = "home", weights: dict[str, int] | None = None) -> DataFrame:
    """Items with signals -> cards: texts decoded, both language slots default to the title, both scores."""
    slot = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.col("title")).otherwise(decode_text(F.col(c)))
    out = items.withColumns({"title": decode_text(F.col("title")), "url": decode_url(F.col("url")), "source": decode_text(F.col("source")), "region": decode_text(F.col("region"))})
    out = out.withColumns({"title_zh": slot("title_zh"), "title_en": slot("title_en"), "summary_zh": decode_text(F.col("summary_zh")), "summary_en": decode_text(F.col("summary_en"))})
    out = out.withColumns({"_signal": scores.community(F.col("hn_points"), F.col("reddit_score"), F.col("reddit_comments")), "_age": scores.age_hours(F.col("published"), as_of), "_noise": scores.buzz(F.col("url")), "_weight": scores.source_weight(F.col("region"), F.col("source"), home, weights or {})})
    parts = [F.col(c) for c in ("_signal", "_age", "_weight", "_noise")]
    out = out.withColumns({"score": scores.heat(*parts), "trend": scores.momentum(*parts)})
    return out.withColumn("hot", F.col("score")).drop("_signal", "_age", "_noise", "_weight")


def stored(cards: DataFrame, now: Column, other: str = "other") -> DataFrame:
    """Cards as rows of the table: key, numbers from text, default dimension, keyword keys (at most KEYWORDS)."""
    keys = F.slice(F.array_distinct(F.array_compact(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), keyword_key))), 1, KEYWORDS)
    number = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0))
    return cards.withColumns({"url": url_key(F.coalesce(blank_to_null(F.col("url")), F.col("title"))), "dimension": F.coalesce(blank_to_null(F.col("dimension")), F.lit(other)), "keywords": keys, **{c: number(c) for c in ("hn_points", "reddit_score", "reddit_comments", "score", "trend", "hot")}, "first_seen_at": now, "last_refresh_at": now, "active": F.lit(True)}).select(*CARD)


def shown(rows: DataFrame) -> DataFrame:
    """Rows as cards: a missing or zero heat shows the score."""
    return rows.withColumn("hot", F.coalesce(F.nullif("hot", F.lit(0)), "score"))


def project(cards: DataFrame, lang: str) -> DataFrame:
    """Title and summary in the wanted language, else in the other; any other language counts as zh."""
    a, b = ("en", "zh") if lang == "en" else ("zh", "en")
    pick = lambda *cs: F.coalesce(*(blank_to_null(F.col(c)) for c in cs), F.lit(""))
    return cards.withColumns({"title": pick(f"title_{a}", "title"), "summary": pick(f"summary_{a}", f"summary_{b}")})


def merge_duplicates(rows: DataFrame, key: Column | None = None) -> DataFrame:
    """One row per key: the row that has the key already, else the one with keywords and the highest score, of equals the
    last by url; keywords of all in that order, first seen earliest, refreshed latest.

    Keywords are first brought down to one row for each key and word, with its best place, and the first KEYWORDS of a key
    are ranked; so a page with very many copies puts neither its rows nor its words into one value."""
    key = url_key(F.col("url")) if key is None else key
    k = rows.withColumn("_k", key)
    rank = F.struct((F.col("url") == F.col("_k")).alias("own"), (F.size("keywords") > 0).alias("has"), "score", F.col("url").alias("u"), F.col("last_refresh_at"))
    rest = [c for c in rows.columns if c not in ("url", "keywords", "first_seen_at", "last_refresh_at")]
    out = k.groupBy("_k").agg(F.max_by(F.struct(*rest), rank).alias("x"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_refresh_at").alias("last_refresh_at"))
    each = k.select("_k", rank.alias("r"), F.posexplode("keywords").alias("p", "word"))
    each = each.groupBy("_k", "word").agg(F.max(F.struct("r", (-F.col("p")).alias("p"))).alias("at"))
    first = Window.partitionBy("_k").orderBy(F.desc("at"), "word")
    words = each.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= KEYWORDS).groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("keywords"))
    met = out.hint("merge").join(words, "_k", "left")
    union = F.coalesce("keywords", F.array().cast("array<string>"))
    return met.select(F.col("_k").alias("url"), *(F.col(f"x.{c}").alias(c) for c in rest), union.alias("keywords"), "first_seen_at", "last_refresh_at").select(*rows.columns)


def keeps_old(new: Column, old: Column) -> Column:
    """A nonempty proper subset of the stored keywords doesn't replace them."""
    return (F.size(new) > 0) & (F.size(F.array_except(new, old)) == 0) & (F.size(F.array_distinct(new)) < F.size(F.array_distinct(old)))


def upsert(table: DataFrame, batch: DataFrame) -> DataFrame:
    """The next version of the card table: both sides one row per key, full outer join; first_seen_at stays, keywords are
    guarded, and cards that the batch doesn't have are no longer active."""
    fresh = F.col("n.last_refresh_at").isNotNull()
    return _merged(merge_duplicates(table), merge_duplicates(batch), {"active": F.coalesce(fresh, F.lit(False))}).select(*CARD)


def _merged(old: DataFrame, new: DataFrame, others: dict[str, Column]) -> DataFrame:
    """old o and new n, each with one row per url -> one row per url: what is new wins, but for what must stay."""
    met = old.alias("o").hint("merge").join(new.alias("n"), "url", "full")
    fresh = F.col("n.last_refresh_at").isNotNull()
    cols = {c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in CARD if c not in ("url", "active")}
    cols["first_seen_at"] = F.coalesce("o.first_seen_at", "n.first_seen_at")
    cols["keywords"] = F.when(~fresh | (F.col("o.keywords").isNotNull() & keeps_old(F.col("n.keywords"), F.col("o.keywords"))), F.col("o.keywords")).otherwise(F.col("n.keywords"))
    return met.select("url", *(v.alias(c) for c, v in (cols | others).items()))


#: Columns of the bucketed table: cards that the newest cycle met are the active ones.
STAMPED = [*(c for c in CARD if c != "active"), "cycle"]


def bucket(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def upsert_buckets(commit: store.Commit, batch: DataFrame, cycle: str, buckets: int = 256, name: str = "cards") -> list[int]:
    """Merges a batch into the bucketed card table of a store's commit and returns the buckets that it touched: only those are
    read and written. Instead of marking absent cards as inactive, which would rewrite them all, cards carry the cycle that
    last met them; active() compares it with the newest."""
    spark = batch.sparkSession
    new = merge_duplicates(batch).withColumn("_b", bucket(F.col("url"), buckets))
    touched = sorted(r[0] for r in new.select("_b").distinct().collect())  # `buckets` numbers at most
    old = store.table(spark, commit.path, commit.before, name, [str(b) for b in touched])
    if old is None:
        rows = new.select(*(F.col(c) for c in STAMPED if c != "cycle"), F.lit(cycle).alias("cycle"))
    else:
        stamp = F.when(F.col("n.last_refresh_at").isNotNull(), F.lit(cycle)).otherwise(F.col("o.cycle"))
        rows = _merged(old, new.drop("_b"), {"cycle": stamp}).select(*STAMPED)
    commit.put_parts(name, rows.withColumn("_b", bucket(F.col("url"), buckets)), "_b")
    return touched


def active(rows: DataFrame, cycle: str) -> DataFrame:
    """Rows of the bucketed table as cards: active are those that the newest cycle met."""
    return rows.withColumn("active", F.col("cycle") == cycle).select(*CARD)


def migrate_dimension(rows: DataFrame, moves: dict[str, str]) -> DataFrame:
    """Old dimension names to new ones; null keywords to none."""
    table = F.create_map(*(F.lit(x) for kv in moves.items() for x in kv))
    return rows.withColumns({"dimension": F.coalesce(F.try_element_at(table, "dimension"), "dimension"), "keywords": F.coalesce("keywords", F.array().cast("array<string>"))})


def with_signals(items: DataFrame, signals: DataFrame) -> DataFrame:
    """Items with their community signals, 0 where there are none."""
    named = ("hn_points", "reddit_score", "reddit_comments")
    met = items.drop(*named).join(signals.select("url", *named), "url", "left")
    return met.withColumns({c: F.coalesce(c, F.lit(0)) for c in named})


def history(rows: DataFrame, as_of: Column, active: bool | None = None, days: int | None = None, n: int | None = 400) -> DataFrame:
    """Stored cards by score and date, optionally active ones, of the last days, the first n."""
    if active is not None:
        rows = rows.filter(F.col("active") == active)
    if days is not None:
        rows = rows.filter(F.col("published") >= F.date_sub(as_of, days))
    return rows if n is None else rows.orderBy(F.desc("score"), F.desc("published"), "url").limit(n)


def pool(current: DataFrame, past: DataFrame) -> DataFrame:
    """Current cards, then stored ones that aren't among them."""
    key = lambda df: df.withColumn("_k", url_key(F.col("url")))
    rest = key(past).join(key(current).select("_k"), "_k", "left_anti").drop("_k")
    return current.withColumn("from_history", F.lit(False)).unionByName(rest.withColumn("from_history", F.lit(True)), allowMissingColumns=True)


def first_of_titles(cards: DataFrame, *order: Column, by: tuple[str, ...] = (), titles: tuple[str, ...] = ("title_zh", "title_en", "title")) -> DataFrame:
    """Of cards with equal title keys the first in order; cards without a title key all stay."""
    keyed = cards.withColumn("_t", F.coalesce(*(title_key(F.col(c)) for c in titles)))
    solo = F.when(F.col("_t").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    first = Window.partitionBy(*by, "_t", "_s").orderBy(*order)
    return keyed.withColumn("_s", solo).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_t", "_s", "_n")


def hn_signal(hits: DataFrame) -> DataFrame:
    """hits(url, title, points, hit_url, hit_title) -> (url, hn_points): the most points of relevant hits, else of all.

    Relevant: hosts that end in one another, or two content words shared."""
    from heatline.functions.text import content_words, url_host

    a, b = url_host(F.col("url")), url_host(F.col("hit_url"))
    near = (a != "") & (b != "") & (a.endswith(b) | b.endswith(a))
    shared = F.size(F.array_intersect(content_words(F.col("title")), content_words(F.col("hit_title")))) >= 2
    points = F.coalesce("points", F.lit(0))
    out = hits.groupBy("url").agg(F.max(F.when(near | shared, points)).alias("rel"), F.max(points).alias("any"))
    return out.select("url", F.coalesce(F.nullif("rel", F.lit(0)), "any").alias("hn_points"))
