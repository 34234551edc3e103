"""The term pool on the driver's tables: terms are the words that titles begin with."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from heatline.functions import lexicon as L
from heatline.functions import scores
from heatline.functions import text as X
from heatline.operators import boards as B
from heatline.operators import match
from heatline.operators import term_days as D
from heatline.operators import terms as T
from heatline.plans.refresh import cut
from heatline.plans.standins import _TITLE_KEY, SQL, as_of, models, read, scored_cards, sql

Q, O = {}, {}
#: Lines that one task counts: their tables of distinct orders stay small, whatever the input's size.
LINES = 250_000

#: Window functions and dictionaries are not part of these views: terms are plain keywords.
SQL["links"] = "select distinct url, unnest(keywords) as canon from scored"
SQL["sums"] = """select canon, count(*) as mentions, coalesce(sum(case when published >= date '2024-01-24' then score * (case when date '2024-01-31' - published <= 1 then 3.0 when date '2024-01-31' - published <= 3 then 1.5 else 1.0 end)::double end), 0) as heat,
  count(*) filter (where published >= date '2024-01-24') as win7, min(published) as earliest, max(published) as latest,
  count(*) filter (where doc_id % 3 = 0) as cur_cnt, coalesce(sum(score) filter (where doc_id % 3 = 0), 0)::bigint as cur_score, coalesce(sum(signal) filter (where doc_id % 3 = 0), 0) as cur_signal
  from links join scored using (url) group by canon"""
SQL["snaps"] = "select l_suppkey::varchar as term, strftime(l_shipdate, '%Y-%m-%d') || case when l_linenumber % 2 = 0 then '-08' else '-20' end as cycle, count(*) as news_cnt, count(distinct l_orderkey) as win7_cnt from lineitem group by all"
_NEEDS = {"links": ["lab", "cards", "scored"], "sums": ["lab", "cards", "scored", "links"]}
from heatline.plans import standins as _standins  # noqa: E402

_standins.NEEDS.update(_NEEDS)


def add(name, body, *views):
    def put(f):
        Q[name] = f
        if body:
            O[name] = sql(body, *views)
        return f

    return put


def _links(spark, sf, cards=None):
    return (scored_cards(spark, sf) if cards is None else cards).select("url", F.explode("keywords").alias("canon")).distinct()


def _current(spark, sf, cards=None):
    c = (scored_cards(spark, sf) if cards is None else cards).filter("doc_id % 3 = 0")
    return c.select("url", scores.community(F.col("hn_points"), F.col("reddit_score"), F.col("reddit_comments")).alias("signal"))


def _sums(spark, sf):
    cards = cut(scored_cards(spark, sf))  # three sides use it
    return T.aggregate(_links(spark, sf, cards), cards, _current(spark, sf, cards), as_of())


def _parts(line):
    """How many tasks count the lines; Parquet's footers tell their number."""
    return max(line.sparkSession.sparkContext.defaultParallelism, math.ceil(line.count() / LINES))


def _snaps(spark, sf, by=("term",)):
    """Snapshots, dealt by `by` in tasks of LINES lines or so before anything is counted: nearly every line is a group of its
    own, so sums before the shuffle only fill memory, and what is grouped by the same columns later needs no other shuffle."""
    line = read(spark, sf, "lineitem")
    cycle = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.when(F.col("l_linenumber") % 2 == 0, "-08").otherwise("-20"))
    rows = line.select(F.col("l_suppkey").cast("string").alias("term"), cycle.alias("cycle"), "l_orderkey").repartition(_parts(line), *by)
    return rows.groupBy("term", "cycle").agg(F.count("*").alias("news_cnt"), F.count_distinct("l_orderkey").alias("win7_cnt"))


@add("j6_keyword_links", "select url, canon from links", "links")
def _(spark, sf):
    c = cut(scored_cards(spark, sf))
    words = c.select(F.explode("keywords").alias("word")).distinct().withColumn("canon", F.col("word"))
    return T.keyword_links(c, words)


@add("a10_term_aggregate", "select canon, mentions, heat, win7, earliest, latest, cur_cnt, cur_score, cur_signal from sums", "sums")
def _(spark, sf):
    return _sums(spark, sf).select("canon", "mentions", "heat", "win7", "earliest", "latest", "cur_cnt", "cur_score", "cur_signal")


@add("a11_dimensions", "select canon, string_agg(dimension, ',' order by n desc, dimension) as dims from (select canon, dimension, count(*) as n from links join scored using (url) group by all) group by canon", "links")
def _(spark, sf):
    return _sums(spark, sf).select("canon", F.array_join("dims", ",").alias("dims"))


@add("c25_c26_c28_scores", """select canon, round_even(greatest(-1, least(10, case when prev is null then case when win7 > 0 then ln(1 + win7) else 0 end else (win7 - prev) / greatest(prev, 0.5) end)), 4) as rise,
  round_even((case when age <= 2 then 2 else exp(-age / 10) end) / (1 + ln(1 + mentions)), 4) as novelty, heat + mentions as hot
  from (select *, case when mentions % 3 = 0 then null else (mentions % 5)::double end as prev, (date '2024-01-31' - earliest)::double as age from sums)""", "sums")
def _(spark, sf):
    s = _sums(spark, sf).withColumns({"prev": F.when(F.col("mentions") % 3 != 0, (F.col("mentions") % 5).cast("double")), "likes": F.col("mentions"), "is_model": F.lit(False), "first_seen_at": F.lit(None).cast("timestamp")})
    return T.scored(s, as_of()).select("canon", F.col("rise").cast("double").alias("rise"), F.col("novelty").cast("double").alias("novelty"), "hot")


@add("f5_f6_w9_admission", "(select canon from sums where length(canon) > 7) union all (select canon from sums where length(canon) <= 7 and not (mentions <= 1 and length(canon) < 4) order by mentions desc, heat desc, canon limit 150)", "sums")
def _(spark, sf):
    s = _sums(spark, sf).withColumns({"lexical": F.length("canon") > 7, "is_model": F.lit(False), "known": F.lit(False)})
    return T.admit(s).select("canon")


@add("w10_j10_twins", "select canon, first_value(canon) over (partition by replace(canon, '-', '') order by mentions desc, canon) as rep from (select canon, mentions from sums union all select left(canon, 2) || '-' || substr(canon, 3), mentions + 1 from sums where length(canon) > 6)", "sums")
def _(spark, sf):
    s = _sums(spark, sf).select("canon", "mentions")
    both = s.union(s.filter(F.length("canon") > 6).select(F.concat(F.substring("canon", 1, 2), F.lit("-"), F.substring("canon", F.lit(3), F.length("canon"))), F.col("mentions") + 1))
    return T.twins(both.withColumns({"governed": F.lit(False), "known": F.lit(False)}))


@add("w4_top_news", f"select canon, rank, url from (select canon, url, row_number() over (partition by canon order by score desc, published desc, url)::int as rank from (select *, row_number() over (partition by canon, coalesce({_TITLE_KEY.format('title')}, url) order by score desc, published desc, url) as m from links join scored using (url)) where m = 1) where rank <= 3", "links")
def _(spark, sf):
    c = cut(scored_cards(spark, sf))
    top = T.top_news(_links(spark, sf, c), c)
    return top.select("canon", F.posexplode("top_news").alias("p", "c")).select("canon", (F.col("p") + 1).alias("rank"), F.col("c.official_url").alias("url"))


@add("t9_term_news", f"select canon, rank, url from (select canon, url, row_number() over (partition by canon order by score desc, published desc, url)::int as rank from (select *, row_number() over (partition by canon, coalesce({_TITLE_KEY.format('title')}, url) order by score desc, published desc, url) as m from links join scored using (url)) where m = 1) where rank <= 50", "links")
def _(spark, sf):
    c = cut(scored_cards(spark, sf))
    return B.term_news(_links(spark, sf, c), c).select("canon", "rank", "url")


#: Twins of the second state: words that share all but their first letter's neighbour stand under the first of them.
_TWIN = "left(canon, 1) || substr(canon, 3)"


@add("a10_a12_deltas", f"""with r as (select canon, min(canon) over (partition by {_TWIN}) as rep from (select distinct canon from links))
  select rep as canon, count(*) as mentions, coalesce(sum(case when published >= date '2024-01-24' then score * (case when date '2024-01-31' - published <= 1 then 3.0 when date '2024-01-31' - published <= 3 then 1.5 else 1.0 end)::double end), 0) as heat,
    count(*) filter (where published >= date '2024-01-24') as win7, min(published) as earliest, max(published) as latest
  from (select distinct url, rep from links join r using (canon)) join scored using (url) group by rep""".replace("with r as (", "select * from (with r as (", 1) + ")", "links")
def _(spark, sf):
    """Sums of a first state, in which half of the cards are there, a third of these with other days and scores, and no terms
    are twins; then the deltas to the whole state, in which words are."""
    c = cut(scored_cards(spark, sf).select("url", "doc_id", "published", "dimension", "score", "keywords"))
    links = cut(_links(spark, sf, c))
    old_cards = c.filter("doc_id % 2 = 0").withColumns({"published": F.when(F.col("doc_id") % 3 == 0, F.date_sub("published", 40)).otherwise(F.col("published")), "score": F.when(F.col("doc_id") % 3 == 0, F.lit(1)).otherwise(F.col("score"))})
    old_links = links.hint("merge").join(old_cards.select("url"), "url", "left_semi")
    names = links.select("canon").distinct()
    none, key = names.withColumn("rep", F.col("canon")), F.concat(F.substring("canon", 1, 1), F.substring("canon", F.lit(3), F.length("canon")))
    twins = names.withColumn("rep", F.min("canon").over(Window.partitionBy(key)))
    before = cut(D.apply(None, D.deltas(old_cards.select("url"), (links.limit(0), c.limit(0), none), (old_links, old_cards, none))))
    batch = c.filter("doc_id % 2 = 1 or doc_id % 3 = 0").select("url")
    touched = cut(D.touched_urls(batch, old_links, links, none, twins))
    now = D.apply(before, D.deltas(touched, (old_links, old_cards, none), (links, c, twins)))
    return D.from_days(now, as_of()).select("canon", "mentions", "heat", "win7", "earliest", "latest")


@add("j12_current_counters", "select canon, cur_cnt, cur_score from sums where cur_cnt > 0", "sums")
def _(spark, sf):
    return _sums(spark, sf).filter("cur_cnt > 0").select("canon", "cur_cnt", "cur_score")


@add("j11_previous", "select term as canon, max_by(win7_cnt, cycle) as prev from snaps where cycle < '1997-01-01-00' group by term", "snaps")
def _(spark, sf):
    return T.previous(_snaps(spark, sf), "1997-01-01-00")


@add("w7_growth", "select term, cycle, round_even(greatest(-1, least(10, case when p is null then ln(1 + win7_cnt) else (win7_cnt - p) / greatest(p, 0.5)::double end)), 4) as rise from (select *, lag(win7_cnt) over (partition by term order by cycle) as p from snaps)", "snaps")
def _(spark, sf):
    return T.growth(_snaps(spark, sf)).select("term", "cycle", F.col("rise").cast("double").alias("rise"))


@add("w5_w6_a23_trend", "select term, date, news_cnt, win7_cnt, win7_cnt / top as share from (select *, count(*) over (partition by term) as n, max(win7_cnt) over (partition by term) as top from (select *, row_number() over (partition by term order by date desc) as m from (select term, left(cycle, 10) as date, max_by(news_cnt, cycle) as news_cnt, max_by(win7_cnt, cycle) as win7_cnt from snaps group by all)) where m <= 7) where n >= 2 and top > 0", "snaps")
def _(spark, sf):
    return T.trend(_snaps(spark, sf))


@add("a15_m7_moved_snapshots", "select (term::bigint // 2 * 2)::varchar as term, cycle, sum(news_cnt)::bigint as news_cnt, sum(win7_cnt)::bigint as win7_cnt from snaps group by all", "snaps")
def _(spark, sf):
    line = read(spark, sf, "lineitem")
    parts = _parts(line)
    s = _snaps(spark, sf).withColumns({"score_sum": F.lit(0), "signal_sum": F.lit(0.0)})
    reps = line.select(F.col("l_suppkey").cast("string").alias("canon")).distinct().repartition(parts, "canon")  # as the snapshots are dealt
    reps = reps.withColumn("rep", (F.floor(F.col("canon").cast("long") / 2) * 2).cast("string"))
    return T.move_snapshots(s, reps, parts).select("term", "cycle", "news_cnt", "win7_cnt")


@add("m11_put_snapshots", "select term, cycle, case when term::bigint % 2 = 0 then 0 else win7_cnt end as win7_cnt from snaps", "snaps")
def _(spark, sf):
    s = _snaps(spark, sf, by=("term", "cycle")).select("term", "cycle", "win7_cnt")  # as both sides meet
    return T.put_snapshots(s, s.filter(F.col("term").cast("long") % 2 == 0).withColumn("win7_cnt", F.lit(0).cast("long")))


@add("w12_sliding_mentions", "select canon, published, sum(n) over (partition by canon order by published range between interval 7 days preceding and current row)::bigint as mentions from (select canon, published, count(*) as n from links join scored using (url) group by all)", "links")
def _(spark, sf):
    c = cut(scored_cards(spark, sf))
    return T.sliding_mentions(_links(spark, sf, c), c)


@add("a19_best_models", "select base as canon, full_id, likes from (select *, row_number() over (partition by base order by trending_score desc, pos) as n from (select *, regexp_replace(lower(split_part(full_id, '/', -1)), '-(gguf|fp8|fp16|bf16|mlx|awq|gptq|int8|int4|uncensored|obli?(terat)?ed|instruct|chat|base)(-.*)?$', '') as base from models)) where n = 1", "models")
def _(spark, sf):
    return T.best_models(models(spark, sf).withColumn("canon", X.base_model_key(F.col("full_id")))).select("canon", "full_id", "likes")


@add("j9_origin", "select coalesce(s.canon, m.canon) as canon, case when m.canon is not null and s.canon is not null then 'both' when m.canon is not null then 'hf' else 'news' end as origin from sums s full join (select distinct lower(split_part(term, '-', 1)) as canon from models) m on s.canon = m.canon", "sums", "models")
def _(spark, sf):
    m = models(spark, sf).select(F.lower(F.element_at(F.split("term", "-"), 1)).alias("canon")).distinct().withColumn("is_model", F.lit(True))
    both = _sums(spark, sf).select("canon", "mentions").join(m, "canon", "full")
    return both.select("canon", T.origin(F.coalesce("mentions", F.lit(0)), F.coalesce("is_model", F.lit(False))).alias("origin"))


@add("f7_t6_index", "select canon, mentions, heat as hot from sums where mentions >= 2 and heat >= 0 order by hot desc, mentions desc, canon limit 500", "sums")
def _(spark, sf):
    s = _sums(spark, sf).withColumns({"hot": F.col("heat"), "origin": F.lit("news"), "full_id": F.lit(None).cast("string")})
    return T.index(s).select("canon", "mentions", "hot")


@add("t1_s28_word_board", "select canon as id, heat as hot from sums order by heat desc, canon limit 60", "sums")
def _(spark, sf):
    s = _sums(spark, sf).select(F.col("canon").alias("id"), F.col("heat").alias("hot"))
    return B.word_board(s.unionByName(s.withColumn("hot", F.lit(0.0))))


@add("f4_m8_media", "select l.url, l.canon from links l join scored s using (url) where length(l.canon) > 5 or regexp_matches(lower(s.title), '(^|[^a-z0-9])' || l.canon || '([^a-z0-9.]|\\.[^0-9]|\\.?$)')", "links")
def _(spark, sf):
    c, lex = cut(scored_cards(spark, sf)), L.load(spark)
    links = _links(spark, sf, c)
    media = links.filter(F.length("canon") <= 5).select("canon").distinct()
    return T.without_media(links, c, media, lex)
