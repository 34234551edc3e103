"""Ranked boards and their reads: dedupe by identity, fixed tie-breaks, sort before cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatline.functions.scores import number
from heatline.functions.text import base_model_key, blank_to_null, paper_family, quote

KEYS = {"hot": "hot", "rise": "rise", "new": "novelty"}


def identity(kind: Column, *columns: Column) -> Column:
    """(kind, first of the columns that isn't empty) as text; null without one."""
    first = F.coalesce(*(blank_to_null(c.cast("string")) for c in columns))
    return F.when(first.isNotNull(), F.concat(F.coalesce(kind, F.lit("")), F.lit("\u0001"), first))


def keep_first(df: DataFrame, key: Column, *order: Column | str) -> DataFrame:
    """First row of each key in the order; rows with a null key all stay. Null keys get one each, so they don't gather in
    one task."""
    own = F.coalesce(key.cast("string"), F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string")))
    first = Window.partitionBy("_k").orderBy(*order)
    return df.withColumn("_k", own).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_k", "_n")


def top_per_dimension(cards: DataFrame, n: int = 10) -> DataFrame:
    best = Window.partitionBy("dimension").orderBy(F.desc("score"), F.desc("published"), "url")
    return cards.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def dimension_members(dims: Column, dimension: Column, other: str = "other") -> Column:
    """Distinct dimensions of a card: its list, else its one."""
    one = F.array(F.coalesce(blank_to_null(dimension), F.lit(other)))
    return F.array_distinct(F.when(F.size(dims) > 0, F.transform(dims, lambda d: F.coalesce(blank_to_null(d), F.lit(other)))).otherwise(one))


def dimension_counts(cards: DataFrame) -> DataFrame:
    """cards(members) -> (dimension, n) and, under a null dimension, the number of cards."""
    by = cards.select(F.explode("members").alias("dimension")).groupBy("dimension").agg(F.count("*").alias("n"))
    return by.unionByName(cards.agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("dimension"), "n"))


def dimension_order(counts: DataFrame, base: list[str]) -> DataFrame:
    """Dimensions of base in their order, then others as they were first seen; counts(dimension, pos)."""
    spark = counts.sparkSession
    known = spark.createDataFrame([(d, i) for i, d in enumerate(base)], "dimension string, ord int")
    met = counts.groupBy("dimension").agg(F.min("pos").alias("pos")).join(known, "dimension", "full")
    return met.select("dimension", F.coalesce(F.col("ord").cast("long"), 1000 + F.col("pos")).alias("ord"))


def word_board(words: DataFrame, by: str = "hot", n: int = 60) -> DataFrame:
    """Word cards by key, heat and id: one top-k, no full sort."""
    once = keep_first(words, F.col("id"), F.desc("hot"))
    return once.orderBy(F.desc(number(F.col(KEYS.get(by, by)))), F.desc(number(F.col("hot"))), "id").limit(n)


def word_title(lang: str) -> Column:
    return F.coalesce(blank_to_null(F.col("display_en" if lang == "en" else "display_zh")), "term")


def news_flow(cards: DataFrame, by: str = "score") -> DataFrame:
    """Current cards by the key, then stored ones by date; ties by identity."""
    return cards.orderBy("from_history", F.desc(F.when(~F.col("from_history"), F.col(by))), F.desc("published"), "kind", "url")


def stream(models: DataFrame, news: DataFrame) -> DataFrame:
    """Models, then news, one of each identity; pos is the place within each side."""
    both = models.withColumn("side", F.lit(0)).unionByName(news.withColumn("side", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, identity(F.col("kind"), F.col("id")), "side", "pos")


def base_models(models: DataFrame) -> DataFrame:
    """One variant of each base model, the most trending (the earlier of equals), at the place of its first variant."""
    own = Window.partitionBy("base")
    rows = models.withColumn("base", base_model_key(F.col("full_id"))).withColumns({"place": F.min("pos").over(own), "_n": F.row_number().over(own.orderBy(F.desc("trending_score"), "pos"))})
    return rows.filter("_n = 1").drop("_n")


def model_board(models: DataFrame, by: str = "trending_score", n: int = 100) -> DataFrame:
    return models.orderBy(F.desc(number(F.col(by))), "pos").limit(n)


def model_lookup(names: DataFrame, models: DataFrame) -> DataFrame:
    """names(name) -> the first model in pool order whose name or id it is, or whose name it begins.

    Exact and prefix matches are equi-joins on the first three characters (names shorter than that on what they have)."""
    low = lambda c: F.lower(F.col(c))
    own = models.withColumns({"_name": F.lower(F.element_at(F.split("full_id", "/"), -1)), "_id": low("full_id")})
    forms = own.select("*", F.explode(F.array_distinct(F.array("_name", "_id"))).alias("_f"))
    forms = forms.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.concat(k.cast("string"), F.substring("_f", F.lit(1), k)))).alias("_p"))
    asked = names.filter("name <> ''").withColumns({"_q": low("name"), "_p": F.concat(F.least(F.length("name"), F.lit(3)).cast("string"), F.substring(low("name"), 1, 3))})
    met = asked.hint("merge").join(forms, "_p").filter((F.col("_q") == F.col("_f")) | F.col("_name").startswith(F.col("_q")))
    return keep_first(met, F.col("name"), "pos").select("name", *models.columns)


def papers_of(models: DataFrame, papers: DataFrame, heads: int = 8, most: int = 3) -> DataFrame:
    """(full_id, papers): for the first `heads` models, papers whose title has the family at word boundaries and whose
    categories, if any, are of computing; one of each title, `most` at most.

    The anchor join of operators.match finds the titles."""
    from heatline.operators.match import matches

    first = models.orderBy("pos").limit(heads).select("full_id", paper_family(F.col("term")).alias("canon")).filter("canon is not null")
    ok = (F.size("categories") == 0) | F.exists("categories", lambda c: c.rlike(r"^(cs\.|eess\.|stat\.ML)"))
    kept = papers.filter(ok)
    found = matches(kept, first.select("canon", F.col("canon").alias("surface")).distinct(), "url", "title")
    rows = first.hint("merge").join(found, "canon").hint("merge").join(kept, "url")
    one = Window.partitionBy("full_id", F.lower("title")).orderBy("pos", "url")
    rows = rows.withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("full_id").orderBy("pos", "url"))).filter(F.col("_n") <= most)
    return rows.groupBy("full_id").agg(F.array_sort(F.collect_list(F.struct("_n", "title", "url", "published", "authors"))).alias("x")).select("full_id", F.transform("x", lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["published"].alias("published"), x["authors"].alias("authors"))).alias("papers"))


# Search pages that a term is linked to, by language.
COMMUNITY = {
    "en": [("Hacker News", "https://hn.algolia.com/?q="), ("Reddit", "https://www.reddit.com/search/?q="), ("GitHub", "https://github.com/search?q="), ("X", "https://x.com/search?q=")],
    "zh": [("知乎", "https://www.zhihu.com/search?q="), ("B站", "https://search.bilibili.com/all?keyword="), ("微博", "https://s.weibo.com/weibo?q=")],
}


def community_links(term: Column, lang: str = "zh") -> Column:
    return F.array(*(F.struct(F.lit(site).alias("site"), F.concat(F.lit(url), quote(term)).alias("url")) for site, url in COMMUNITY["en" if lang == "en" else "zh"]))


def unified_models(models: DataFrame) -> DataFrame:
    return models.withColumns({"kind": F.lit("model"), "id": F.col("full_id"), "score": F.col("likes"), "hot": F.col("likes"), "trend": F.col("trending_score")})


def term_news(links: DataFrame, cards: DataFrame, n: int = 50) -> DataFrame:
    """Related news of all terms: heat (else score) and date, one of each title, n a term, counted after the dedupe."""
    from heatline.operators.cards import first_of_titles

    heat = F.coalesce(F.nullif("hot", F.lit(0)), "score", F.lit(0))
    rows = links.distinct().hint("merge").join(cards, "url").withColumn("heat", heat)
    once = first_of_titles(rows, F.desc("heat"), F.desc("published"), F.col("url"), by=("canon",))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("canon").orderBy(F.desc("heat"), F.desc("published"), "url"))).filter(F.col("rank") <= n)


def profiles(terms: DataFrame, news: DataFrame, trends: DataFrame, models: DataFrame, explained: DataFrame) -> DataFrame:
    """One row per term: its row, related news, activity, model block and explanation. All sides are grouped by term."""
    n = news.groupBy("canon").agg(F.array_sort(F.collect_list(F.struct("rank", "url", "title", "heat"))).alias("news"))
    t = trends.groupBy(F.col("term").alias("canon")).agg(F.array_sort(F.collect_list(F.struct("date", "win7_cnt", "share"))).alias("activity"))
    m = models.groupBy("canon").agg(F.max_by(F.struct("full_id", "likes", "downloads"), F.struct("trending_score", "full_id")).alias("model"))
    out = terms
    for side in (n, t, m, explained):
        out = out.hint("merge").join(side, "canon", "left")
    return out


def flattened(lists: DataFrame, items: str = "items") -> DataFrame:
    """lists(dimension, items) -> (dimension, pos, item): one row for each element, places from 0."""
    return lists.select("dimension", F.posexplode(items).alias("pos", "item"))
