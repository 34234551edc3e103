"""Smaller operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatline.functions import text as X
from heatline.functions.scores import rounded
from heatline.operators import boards as B
from heatline.operators import cards as C
from heatline.operators import match
from heatline.operators import terms as T
from heatline.operators import traffic as TR
from heatline.plans.standins import as_of, cards, models, read, scored_cards, slots, sql, visits
from heatline.plans.term_queries import _links, _sums

Q, O = {}, {}


def add(name, body, *views):
    def put(f):
        Q[name] = f
        if body:
            O[name] = sql(body, *views)
        return f

    return put


@add("f12_dimension_slice", "select url, score from scored where dimension = 'd2'", "scored")
def _(spark, sf):
    return scored_cards(spark, sf).filter("dimension = 'd2'").select("url", "score")


@add("f16_executable_urls", "select url, case when doc_id % 3 = 0 then '' else url end as safe from cards", "cards")
def _(spark, sf):
    c = cards(spark, sf)
    return c.select("url", X.decode_url(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" JavaScript : "), "url")).otherwise(F.col("url"))).alias("safe"))


@add("f17_look_back", "select date, count(*) as n from visits where date >= date '2024-01-24' group by date", "visits")
def _(spark, sf):
    return TR.recent(visits(spark, sf), as_of(), 7).groupBy("date").agg(F.count("*").alias("n"))


@add("f20_trusted_surfaces", "select url, regexp_matches(source, '[A-Z]') as plain, regexp_matches(title, '[a-z]|[^\\x00-\\x7F]') as shouted from cards", "cards")
def _(spark, sf):
    return cards(spark, sf).select("url", T.trusted(F.col("source"), F.col("title")).alias("plain"), T.trusted(F.lit("GOAI"), F.col("title")).alias("shouted"))


@add("f21_point_lookups", "select slot_id, name from slots where slot_id::bigint % 10 = 3", "slots")
def _(spark, sf):
    keys = slots(spark, sf).filter(F.col("slot_id").cast("long") % 10 == 3).select("slot_id")
    return slots(spark, sf).join(keys, "slot_id", "left_semi").select("slot_id", "name")


@add("p3_shown_heat", "select url, score as hot from scored", "scored")
def _(spark, sf):
    c = scored_cards(spark, sf).withColumn("hot", F.when(F.col("doc_id") % 2 == 0, 0).otherwise(None).cast("long"))
    return C.shown(c).select("url", "hot")


@add("p4_stored_rows", "select url, case when doc_id % 2 = 0 then 'other' else dimension end as dimension, len(list_filter(keywords, lambda k: k <> ''))::int as words, hn_points::bigint as hn_points from scored", "scored")
def _(spark, sf):
    c = scored_cards(spark, sf)
    c = c.withColumns({"dimension": F.when(F.col("doc_id") % 2 == 1, F.col("dimension")).otherwise(""), "hn_points": F.col("hn_points").cast("string")})
    return C.stored(c, as_of()).select("url", "dimension", F.size("keywords").alias("words"), "hn_points")


@add("p7_word_titles", "select canon, case when mentions % 2 = 0 then 'Z' || canon else canon end as title from sums", "sums")
def _(spark, sf):
    s = _sums(spark, sf).select("canon", F.col("canon").alias("term"), F.when(F.col("mentions") % 2 == 0, F.concat(F.lit("Z"), "canon")).otherwise("").alias("display_zh"), F.lit("en").alias("display_en"))
    return s.select("canon", B.word_title("zh").alias("title"))


@add("p8_members", "select url, array_to_string(list_distinct([dimension]), ',') as members from cards", "cards")
def _(spark, sf):
    c = cards(spark, sf)
    return c.select("url", F.array_join(B.dimension_members(F.array("dimension", "dimension"), F.col("dimension")), ",").alias("members"))


@add("p9_pool_decoration", "select url as id, 'news' as kind, score as hot, source as official_label, doc_id % 2 = 1 as from_history from scored", "scored")
def _(spark, sf):
    c = scored_cards(spark, sf)
    pool = C.pool(c.filter("doc_id % 2 = 0"), c)
    return C.shown(pool).select(F.col("url").alias("id"), F.lit("news").alias("kind"), "hot", F.col("source").alias("official_label"), "from_history")


@add("c12_display_names", "select canon, case when mentions % 3 = 0 then 'Model ' || canon when mentions % 3 = 1 then upper(canon) else upper(left(canon, 1)) || substr(canon, 2) end as display from sums", "sums")
def _(spark, sf):
    s = _sums(spark, sf)
    model = F.when(F.col("mentions") % 3 == 0, F.concat(F.lit("Model "), "canon")).otherwise("")
    surfaces = F.when(F.col("mentions") % 3 == 1, F.array(F.upper("canon"), "canon")).otherwise(F.array("canon"))
    return s.select("canon", T.display_name(F.col("canon"), model, surfaces, F.lit(None).cast("string")).alias("display"))


@add("c35_clipped", "select url, case when length(t) <= 40 then t when contains(h, ' ') then regexp_replace(h, ' +[^ ]*$', '') || '…' else h || '…' end as clipped from (select url, t, rtrim(left(t, 39)) as h from (select url, trim(regexp_replace(title, '\\s+', ' ', 'g')) as t from cards))", "cards")
def _(spark, sf):
    return cards(spark, sf).select("url", X.clip_words(F.col("title"), 40).alias("clipped"))


@add("c38_percentages", "select canon, round_even(cur_cnt * 100.0::double / mentions, 1) as pct from sums", "sums")
def _(spark, sf):
    return _sums(spark, sf).select("canon", rounded(F.col("cur_cnt") * 100.0 / F.col("mentions"), 1).alias("pct"))


@add("c40_signals", "select url, signal from scored", "scored")
def _(spark, sf):
    from heatline.functions.scores import community

    return cards(spark, sf).select("url", community(F.col("hn_points"), F.col("reddit_score"), F.col("reddit_comments")).alias("signal"))


@add("c41_merged_old_rows", "select canon, min(date '2024-01-01' + (mentions % 9)::int)::date as first_seen, upper(canon) as display from sums group by canon", "sums")
def _(spark, sf):
    s = _sums(spark, sf).select("canon", "mentions")
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), c.cast("int")).cast("timestamp")
    a = s.select("canon", F.col("canon").alias("term"), F.col("canon").alias("display"), day(F.col("mentions") % 9 + 3).alias("first_seen_at"))
    b = s.select("canon", F.concat("canon", F.lit("-x")).alias("term"), F.upper("canon").alias("display"), day(F.col("mentions") % 9).alias("first_seen_at"))
    return T.merge_old(a.unionByName(b)).select("canon", F.to_date("first_seen_at").alias("first_seen"), "display")


@add("a12_twins_counted_once", "select left(canon, 3) as canon, count(distinct url) as mentions from links group by 1", "links")
def _(spark, sf):
    links = _links(spark, sf)
    reps = links.select("canon").distinct().withColumn("rep", F.substring("canon", 1, 3))
    return T.to_rep(links, reps).distinct().groupBy("canon").agg(F.count("*").alias("mentions"))


@add("a18_history_rows", "select count(*) as n from cards", "cards")
def _(spark, sf):
    return cards(spark, sf).agg(F.count("*").alias("n"))


@add("u5_model_lists", "select full_id, likes, side from (select *, row_number() over (partition by full_id order by side, pos) as n from (select full_id, likes, 0 as side, pos from models where pos % 2 = 0 union all select full_id, likes + 1, 1, pos from models)) where n = 1", "models")
def _(spark, sf):
    m = models(spark, sf)
    both = m.filter("pos % 2 = 0").withColumn("side", F.lit(0)).unionByName(m.withColumns({"side": F.lit(1), "likes": F.col("likes") + 1}))
    return B.keep_first(both, F.col("full_id"), "side", "pos").select("full_id", "likes", "side")


@add("u8_flattened_lists", "select dimension, pos, doc_id from (select dimension, row_number() over (partition by dimension order by doc_id)::int - 1 as pos, doc_id from (select distinct dimension, doc_id from cards))", "cards")
def _(spark, sf):
    lists = cards(spark, sf).groupBy("dimension").agg(F.array_sort(F.collect_list("doc_id")).alias("items"))
    return B.flattened(lists).select("dimension", "pos", F.col("item").alias("doc_id"))


@add("u6_unseen", "select url from cards where doc_id % 4 <> 0", "cards")
def _(spark, sf):
    c = cards(spark, sf)
    return c.join(c.filter("doc_id % 4 = 0").select("url"), "url", "left_anti").select("url")


@add("j8_model_titles", "select distinct url, lower(w) as canon from (select distinct regexp_extract(text, ' ([A-Za-z]{3,}) ', 1) as w from benchmark) m join cards on regexp_matches(lower(title), '(^|[^a-z0-9])' || lower(w) || '([^a-z0-9.]|\\.[^0-9]|\\.?$)') where w <> ''", "cards")
def _(spark, sf):
    m = read(spark, sf, "benchmark").select(F.regexp_extract("text", " ([A-Za-z]{3,}) ", 1).alias("w")).filter("w <> ''").distinct()
    m = m.select(F.lower("w").alias("canon"), F.col("w").alias("term"), F.concat(F.lit("x/"), "w").alias("full_id"))
    return match.title_matches(cards(spark, sf), match.model_surfaces(m))


@add("w11_survivors", "select url, max(score) as score from scored group by url", "scored")
def _(spark, sf):
    rows = C.stored(scored_cards(spark, sf), as_of())
    return C.merge_duplicates(rows.unionByName(rows.withColumns({"url": F.concat("url", F.lit("#x")), "score": F.col("score") - 1}))).select("url", "score")
