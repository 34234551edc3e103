"""Refresh cycles: landed items to the card table, and the card table to the term pool.

One plan of DataFrames each. Sides that are used several times are written to the shared folder, so that they are computed
once, survive lost executors and show joins their true sizes; Pool.clear() deletes them.

Translators and explainers work between cycles. A refresh leaves requests (cycle, kind, canon, display, titles, zh, en,
rank) of kind translate and explain, bounded by their budgets; whoever answers appends rows (cycle, kind, canon, zh, en)
that name the request's cycle. A later refresh applies the newest answer to a request of an earlier cycle, once: the pool
keeps for each term up to which cycle it took answers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatline.functions import lexicon as L
from heatline.functions.text import base_model_key
from heatline.operators import cards as C
from heatline.operators import match
from heatline.operators import terms as T
from heatline.sources.scratch import Scratch, written

cut = written

MODEL = "struct<full_id:string,likes:bigint,trending_score:bigint,downloads:bigint,official_url:string,author:string,tags:array<string>>"
#: The stored pool: a term's names, scores and model, its explanation, and the cycles up to which answers are in.
POOL = {
    "term": "string", "display": "string", "display_zh": "string", "display_en": "string", "origin": "string", "first_seen_at": "timestamp", "last_seen_at": "timestamp",
    "mentions": "bigint", "win7": "bigint", "hf": MODEL, "hot": "double", "rise": "double", "novelty": "double", "dims": "array<string>",
    "explain_zh": "string", "explain_en": "string", "explain_updated_at": "timestamp", "translated_cycle": "string", "explained_cycle": "string",
}
SNAPSHOT = "term string, cycle string, news_cnt long, win7_cnt long, score_sum long, signal_sum double"
REQUEST = "cycle string, kind string, canon string, display string, titles array<string>, zh string, en string, rank int"
ANSWER = "cycle string, kind string, canon string, zh string, en string"


def schema(fields: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in fields.items())


@dataclass
class Pool:
    """What a term refresh leaves: the pool, snapshots with this cycle's, the word cards, and the requests of the cycle."""

    terms: DataFrame
    snapshots: DataFrame
    words: DataFrame
    requests: DataFrame
    #: Days (day) whose snapshots differ from the stored ones: this cycle's, and those of terms that moved or went.
    days: DataFrame
    scratch: Scratch = field(repr=False)

    def clear(self) -> None:
        """Deletes what the tables above are computed from: call it when they are written."""
        self.scratch.clear()


def refresh_cards(table: DataFrame, items: DataFrame, signals: DataFrame, as_of: Column, home: str = "home", weights: dict[str, int] | None = None) -> DataFrame:
    """Next version of the card table from a cycle's items."""
    batch = C.stored(C.item_cards(C.with_signals(items, signals), as_of, home, weights), as_of)
    return C.upsert(table, batch)


def pool_rows(stored: DataFrame) -> DataFrame:
    """Rows of a stored pool with all its columns; those of older versions that lack some have nulls there."""
    return stored.select(*(F.col(c).cast(t).alias(c) if c in stored.columns else F.lit(None).cast(t).alias(c) for c, t in POOL.items()))


def _model(models: DataFrame) -> Column:
    """The model record that the pool keeps, of the columns that there are."""
    fields = dict(f.split(":", 1) for f in MODEL[7:-1].split(","))
    return F.struct(*((F.col(c) if c in models.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()))


def refresh_terms(cards: DataFrame, current: DataFrame, models: DataFrame, old: DataFrame, snapshots: DataFrame, lexicon: DataFrame, as_of: Column, cycle: str, stopwords: list[str], media: list[str], glossary: DataFrame | None = None, static: DataFrame | None = None, requests: DataFrame | None = None, answers: DataFrame | None = None) -> Pool:
    """One cycle of the term pool.

    cards: the card table; current(url, signal): this cycle's cards; models(full_id, term, likes, trending_score, pos, ...);
    old: the stored pool (POOL; columns may be missing); snapshots: stored ones; glossary(name, en): official English names;
    static(canon, zh, en): explanations that no one is asked for; requests and answers: those of earlier cycles.
    Terms that the cycle doesn't meet stay in the pool with scores of 0; names of outlets go."""
    spark = cards.sparkSession
    scratch = Scratch(spark, "refresh")
    cut = scratch.write
    empty = lambda df, shape: L.listed(spark, [], shape) if df is None else df
    glossary, static = empty(glossary, "name string, en string"), empty(static, "canon string, zh string, en string")
    requests, answers = empty(requests, REQUEST), empty(answers, ANSWER)
    outlets = L.listed(spark, [(m,) for m in media], "canon string")
    stops = L.listed(spark, [(w,) for w in stopwords], "word string")
    old = pool_rows(old)

    # the canonical form of every word of this cycle, once; models by canonical name, the best variant of each
    named = models.withColumn("word", base_model_key(F.col("full_id")))
    every = cards.select(F.explode("keywords").alias("word")).union(named.select("word")).union(old.select("term"))
    table = cut(L.canonical(every, lexicon))
    words = cut(T.without_stopwords(table, stops))
    best = cut(T.best_models(named.hint("merge").join(words, "word").drop("word")))

    # all surfaces meet the titles once: the dictionary's, the models', and those of every term
    shape = lambda df, kind: df.select("canon", "surface", F.lit(kind).alias("kind"))
    surfaces = shape(lexicon, "dictionary").union(shape(match.model_surfaces(best), "model")).union(shape(match.term_surfaces(words.select("canon").union(lexicon.select("canon")).distinct(), lexicon), "term"))
    hits = cut(match.title_matches(cards, cut(surfaces), by=("canon", "kind"), cut=cut))
    of = lambda kind: hits.filter(F.col("kind") == kind).select("url", "canon")

    # links of cards and terms: keywords, dictionary terms in titles where there are none, model names in titles
    by_keyword = cut(T.without_media(T.keyword_links(cards, words), cards, outlets, lexicon))
    by_title = T.without_stopwords(of("dictionary").hint("merge").join(by_keyword.select("url").distinct(), "url", "left_anti"), stops)
    keyword_links = by_keyword.unionByName(by_title).distinct()
    links = keyword_links.unionByName(of("model")).distinct()

    # twins share one representative before anything is counted, so that counts stay exact
    stored = table.hint("merge").join(old, F.col("word") == F.col("term")).withColumn("canon", F.coalesce("canon", "term")).drop("word")
    known = stored.select("canon").distinct().withColumn("known", F.lit(True))
    ruled = L.governed(lexicon).withColumn("governed", F.lit(True))
    sizes = links.groupBy("canon").agg(F.count("*").alias("mentions")).hint("merge").join(best.select("canon"), "canon", "full").hint("merge").join(known, "canon", "full").hint("merge").join(ruled, "canon", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    reps = L.small(cut(T.twins(sizes.select("canon", flag("governed"), flag("known"), F.coalesce("mentions", F.lit(0)).alias("mentions")))))
    links = cut(T.to_rep(links, reps).distinct())
    news = cut(T.top_news(T.to_rep(keyword_links, reps), cards))
    best = T.best_models(T.to_rep(best, reps))
    pool = cut(T.merge_old(T.to_rep(stored, reps)))

    # aggregates; models without news stand with zeros
    sums = T.aggregate(links, cards, current, as_of)
    all_ = sums.hint("merge").join(best.select("canon", _model(best).alias("model"), F.col("term").alias("model_name")), "canon", "full")
    zero = lambda c, v=0: F.coalesce(c, F.lit(v)).alias(c)
    all_ = all_.select("canon", zero("mentions"), zero("heat", 0.0), zero("win7"), "earliest", "latest", F.coalesce("days", F.array().cast("array<date>")).alias("days"), zero("cur_cnt"), zero("cur_score"), zero("cur_signal", 0.0), F.coalesce("dims", F.array().cast("array<string>")).alias("dims"), "model", "model_name", F.col("model").isNotNull().alias("is_model"))
    kept_of_old = ("first_seen_at", "display_zh", "explain_zh", "explain_en", "explain_updated_at", "translated_cycle", "explained_cycle")
    old_pool = pool.select("canon", *kept_of_old, F.col("display").alias("old_display"), F.col("display_en").alias("stored_en"), F.col("hf").alias("old_model"), F.lit(True).alias("known"))
    all_ = all_.hint("merge").join(old_pool, "canon", "left").hint("merge").join(ruled, "canon", "left").withColumns({"known": flag("known"), "lexical": flag("governed")}).drop("governed")
    kept = cut(T.admit(all_))

    # title hits that no keyword gave add to the mentions of kept terms, before the scores, as rarity uses them
    titled = T.to_rep(of("term"), reps).distinct().hint("merge").join(links, ["url", "canon"], "left_anti").groupBy("canon").agg(F.count("*").alias("more"))
    rows = kept.hint("merge").join(titled, "canon", "left").withColumn("mentions", F.col("mentions") + F.coalesce("more", F.lit(0))).drop("more")

    unwanted = outlets.hint("merge").join(kept.select("canon"), "canon", "left_anti")
    of_terms = snapshots.withColumnRenamed("term", "canon")
    history = cut(T.move_snapshots(T.without_outlets(of_terms, unwanted).withColumnRenamed("canon", "term"), reps))
    changed = of_terms.hint("merge").join(reps.filter("canon <> rep").select("canon").union(unwanted).distinct(), "canon", "left_semi")
    days = changed.select(F.substring("cycle", 1, 10).alias("day")).union(L.listed(spark, [(cycle[:10],)], "day string")).distinct()
    rows = rows.withColumn("hf", F.coalesce("model", "old_model")).withColumn("likes", F.coalesce("hf.likes", F.lit(0)))
    scored = T.scored(rows.hint("merge").join(T.previous(history, cycle), "canon", "left"), as_of)

    # names: as this cycle's cards spell them, else as the titles of the top news do
    spelled = current.select("url").hint("merge").join(cards.select("url", "title", F.explode("keywords").alias("word")), "url").hint("merge").join(words, "word")
    seen = lambda word, title: F.when(T.trusted(match.original_case(word, title), title), match.original_case(word, title))
    spelled = T.to_rep(spelled, reps).groupBy("canon").agg(F.array_sort(F.collect_set(seen(F.col("word"), F.col("title")))).alias("surfaces"))
    in_news = news.select("canon", F.array_distinct(F.array_compact(F.flatten(F.transform("top_news", lambda n: F.array(seen(F.col("canon"), n["title_zh"]), seen(F.col("canon"), n["title_en"])))))).alias("in_news"))
    rule = lexicon.filter("ord = 1 and is_ascii").select("canon", F.col("surface").alias("rule"))
    scored = scored.hint("merge").join(spelled, "canon", "left").hint("merge").join(in_news, "canon", "left").hint("merge").join(rule, "canon", "left").hint("merge").join(T.chinese_alias(lexicon), "canon", "left")
    none = F.array().cast("array<string>")
    surfaces = F.when(F.col("lexical"), none).when(F.size(F.coalesce("surfaces", none)) > 0, F.col("surfaces")).otherwise(F.coalesce("in_news", none))
    before = F.when(F.col("lexical"), F.col("rule")).otherwise(F.when(F.col("old_display").rlike(r"\p{Lu}"), F.col("old_display")))
    scored = scored.withColumns({"display": T.display_name(F.col("canon"), F.col("model_name"), surfaces, before), "display_zh": F.coalesce(F.nullif("display_zh", F.lit("")), "zh")})

    # answers that came since, each applied once
    due = cut(T.due_answers(answers, requests, pool, cycle, reps))
    mine = lambda kind: due.filter(F.col("kind") == kind)
    marks = [mine(kind).select("canon", F.col("cycle").alias(f"_{kind}")) for kind in ("translate", "explain")]
    scored = T.english_names(scored, glossary, mine("translate").select("canon", "en"), "canon")
    scored = T.apply_explanations(scored, mine("explain").select("canon", "zh", "en"), as_of)
    for mark in marks:
        scored = scored.hint("merge").join(mark, "canon", "left")
    scored = scored.withColumns({"translated_cycle": F.coalesce("_translate", "translated_cycle"), "explained_cycle": F.coalesce("_explain", "explained_cycle"), "last_seen_at": as_of})
    terms = cut(scored.select("canon", *(F.col(c).cast(t).alias(c) for c, t in POOL.items() if c != "term"), "latest", "cur_cnt", "cur_score", "cur_signal", "from_glossary"))

    now = terms.select(F.col("canon").alias("term"), F.lit(cycle).alias("cycle"), F.col("cur_cnt").alias("news_cnt"), F.col("win7").alias("win7_cnt"), F.col("cur_score").alias("score_sum"), F.bround("cur_signal", 1).alias("signal_sum"))
    stored_cols = ["canon", *(c for c in POOL if c != "term")]
    gone = T.without_outlets(pool.hint("merge").join(terms.select("canon"), "canon", "left_anti"), outlets).select(*stored_cols)
    whole = T.absent_at_zero(terms.select(*stored_cols).unionByName(gone), terms.select("canon"), ("hot", "rise", "novelty"))

    with_news = cut(terms.hint("merge").join(news, "canon", "left"))
    board = with_news.select(F.lit("word").alias("kind"), F.col("canon").alias("id"), F.col("canon").alias("term"), "display", "display_zh", "display_en", "origin", F.col("mentions").alias("news_cnt"), "hot", "rise", "novelty", "first_seen_at", F.col("latest").alias("published"), F.coalesce(F.get("dims", F.lit(0)), F.lit("other")).alias("dimension"), "dims", "top_news", "hf")
    return Pool(whole.withColumnRenamed("canon", "term"), T.put_snapshots(history, now), board.orderBy(F.desc("hot"), "id").limit(T.BOARD), queues(with_news, static, as_of, cycle), days, scratch)


def queues(terms: DataFrame, static: DataFrame, as_of: Column, cycle: str) -> DataFrame:
    """The cycle's requests (REQUEST): Chinese names that the glossary doesn't have, for the translator, and the hottest terms
    without a fresh explanation, for the explainer, with the titles of their top news and what there is already."""
    titles = F.coalesce(F.transform("top_news", lambda n: F.coalesce(F.nullif(n["title_zh"], F.lit("")), n["title_en"])), F.array().cast("array<string>"))
    named = terms.filter(~F.col("from_glossary"))
    translate = T.to_translate(named.withColumn("stored_en", F.col("display_en")))
    place = lambda *order: F.row_number().over(Window.orderBy(*order)).cast("int").alias("rank")  # noqa: E731  of a bounded queue
    nothing = F.lit(None).cast("string")
    first = translate.select(F.lit(cycle).alias("cycle"), F.lit("translate").alias("kind"), "canon", "display", F.array().cast("array<string>").alias("titles"), nothing.alias("zh"), nothing.alias("en"), place("queue", "canon"))
    explain = T.to_explain(terms.withColumn("titles", titles), as_of, static)
    return first.unionByName(explain.select(F.lit(cycle).alias("cycle"), F.lit("explain").alias("kind"), "canon", "display", "titles", F.col("explain_zh").alias("zh"), F.col("explain_en").alias("en"), place(F.desc("hot"), "canon")))
