"""Cards, texts, boards and search on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatline.functions import scores
from heatline.functions import text as X
from heatline.operators import boards as B
from heatline.operators import cards as C
from heatline.operators import match, search
from heatline.plans.refresh import cut
from heatline.plans.standins import _TITLE_KEY, as_of, cards, models, read, scored_cards, sql
from heatline.sources import store
from heatline.sources.scratch import Scratch

Q, O = {}, {}


def add(name, body, *views):
    def put(f):
        Q[name] = f
        if body:
            O[name] = sql(body, *views)
        return f

    return put


# --- text keys

_URL = "regexp_replace(replace(url, '&amp;', '&'), '#.*$', '')"
_KEPT = "list_filter(string_split(split_part(u, '?', 2), '&'), lambda p: p <> '' and not starts_with(lower(p), 'utm_'))"


@add("c3_url_keys", f"select page_id, case when not contains(u, '?') then u when len({_KEPT}) = 0 then split_part(u, '?', 1) else split_part(u, '?', 1) || '?' || array_to_string({_KEPT}, '&') end as key from (select page_id, {_URL} as u from pages)")
def _(spark, sf):
    return read(spark, sf, "pages").select("page_id", X.url_key(F.col("url")).alias("key"))


@add("m2_duplicate_pages", f"""with keyed as (select page_id, raw, case when not contains(u, '?') then u when len({_KEPT}) = 0 then split_part(u, '?', 1) else split_part(u, '?', 1) || '?' || array_to_string({_KEPT}, '&') end as key from (select page_id, url as raw, {_URL} as u from pages))
  select key as url, arg_max(page_id, (raw = key, page_id % 3 > 0, page_id % 5, raw, page_id)) as page, date '2024-01-01' + min(page_id % 9)::int as first_seen, date '2024-01-01' + max(page_id % 9)::int as refreshed from keyed group by key""")
def _(spark, sf):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 9).cast("int")).cast("timestamp")
    words = F.when(F.col("page_id") % 3 > 0, F.array(F.lit("k"))).otherwise(F.array().cast("array<string>"))
    rows = read(spark, sf, "pages").select("url", words.alias("keywords"), (F.col("page_id") % 5).alias("score"), "page_id", day.alias("first_seen_at"), day.alias("last_refresh_at"))
    rows = rows.groupBy("url").agg(F.max_by(F.struct("keywords", "score", "page_id"), F.struct(F.col("page_id") % 3 > 0, "score", "page_id")).alias("x"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_refresh_at").alias("last_refresh_at")).select("url", "x.*", "first_seen_at", "last_refresh_at")
    made = C.merge_duplicates(rows)
    return made.select("url", F.col("page_id").alias("page"), F.to_date("first_seen_at").alias("first_seen"), F.to_date("last_refresh_at").alias("refreshed"))


@add("c4_title_keys", f"select url, {_TITLE_KEY.format('title')} as key from cards", "cards")
def _(spark, sf):
    return cards(spark, sf).select("url", X.title_key(F.col("title")).alias("key"))


@add("w8_mirror_titles", f"select url, score from (select url, score, row_number() over (partition by coalesce({_TITLE_KEY.format('title')}, url) order by score desc, published desc, url) as n from scored) where n = 1", "scored")
def _(spark, sf):
    return C.first_of_titles(scored_cards(spark, sf), F.desc("score"), F.desc("published"), F.col("url")).select("url", "score")


#: The references that titles of pages hold; each of the two passes goes over all of them.
_PASS = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&')"


@add("c1_decode_page_titles", f"select page_id, trim(regexp_replace({_PASS.format(_PASS.format('t'))}, '[\\s\\x{{a0}}]+', ' ', 'g')) as title from (select page_id, regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 's') as t from pages)")
def _(spark, sf):
    raw = F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1)
    return read(spark, sf, "pages").select("page_id", X.squeeze(X.decode_text(raw)).alias("title"))


@add("c34_content_words", "select doc_id, md5(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}'), lambda w: w not in ('the', 'a', 'an', 'of', 'for', 'and', 'to', 'in', 'on', 'with', 'is', 'are', 'new', 'via', 'from', 'how', 'why', 'what')))), ' ')) as words from documents")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(F.array_join(F.array_sort(X.content_words(F.col("text"))), " ")).alias("words"))


@add("c16_clean_queries", "select doc_id, case when regexp_matches(t, '[\\x{4e00}-\\x{9fff}]') then left(t, 6) else array_to_string(list_slice(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> ''), 1, 12), ' ') end as q from (select doc_id, trim(case when doc_id % 3 = 0 then text || ' 新闻' when doc_id % 5 = 0 then '新闻 新闻 ' || text else text end, ' ' || chr(9) || chr(10) || chr(13)) as t from documents)")
def _(spark, sf):
    d = read(spark, sf, "documents")
    k = F.col("doc_id")
    named = F.when(k % 3 == 0, F.concat("text", F.lit(" 新闻"))).when(k % 5 == 0, F.concat(F.lit("新闻 新闻 "), "text")).otherwise(F.concat(F.lit("Breaking : "), "text"))
    return d.select("doc_id", X.clean_query(named).alias("q"))


@add("f14_mixed_translations", "select doc_id, case when lang = 'en' then length(title) > 15 and length(regexp_replace(title, '[^A-Za-z]', '', 'g')) / length(title) > 0.6 else false end as mixed from (select doc_id, lang, text as title from documents) where title <> ''")
def _(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", "en").otherwise("zh").alias("native"), F.col("text").alias("title")).filter("title <> ''")
    return d.select("doc_id", X.is_mixed(F.col("title"), F.col("native")).alias("mixed"))


@add("c31_highlight", "select doc_id, md5(replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(text, ''), '(and|the)', chr(1) || '\\1' || chr(2), 'gi'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;'), chr(1), '<mark>'), chr(2), '</mark>')) as marked from documents")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(X.highlight(F.col("text"), F.lit("And THE"))).alias("marked"))


@add("s1_page_links", "select page_id, len(regexp_extract_all(html, '<a[^>]*href=\"([^\"]+)\"'))::int as links, len(regexp_extract_all(html, '<p[^>]*>'))::int as paragraphs from pages")
def _(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]+)"'), 0)).alias("links"), F.size(F.regexp_extract_all("html", F.lit("<p[^>]*>"), 0)).alias("paragraphs"))


# --- scores

@add("c19_buzz", "select url, (('0x' || left(md5(url), 8))::bigint % 1000) / 1000.0::double as buzz from cards", "cards")
def _(spark, sf):
    return cards(spark, sf).select("url", scores.buzz(F.col("url")).alias("buzz"))


@add("c22_c23_scores", "select url, score, trend from scored", "scored")
def _(spark, sf):
    return scored_cards(spark, sf).select("url", "score", "trend")


@add("c24_recency", "select url, (case when date '2024-01-31' - published <= 1 then 3 when date '2024-01-31' - published <= 3 then 1.5 else 1 end)::double as w from cards", "cards")
def _(spark, sf):
    return cards(spark, sf).select("url", scores.recency_weight(F.col("published"), F.to_date(as_of())).cast("double").alias("w"))


# --- boards

@add("w1_top_per_dimension", "select dimension, rank, url, score from (select dimension, url, score, row_number() over (partition by dimension order by score desc, published desc, url)::int as rank from scored) where rank <= 10", "scored")
def _(spark, sf):
    return B.top_per_dimension(scored_cards(spark, sf)).select("dimension", "rank", "url", "score")


@add("a13_dimension_counts", "select dimension, count(*) as n from (select unnest(list_distinct([dimension, 'd' || (doc_id % 4)])) as dimension from cards) group by dimension union all select null, count(*) from cards", "cards")
def _(spark, sf):
    c = cards(spark, sf).withColumn("members", B.dimension_members(F.array("dimension", F.concat(F.lit("d"), (F.col("doc_id") % 4).cast("string"))), F.col("dimension")))
    return B.dimension_counts(c)


@add("t12_dimension_order", "select dimension, case dimension when 'd3' then 0 when 'd1' then 1 when 'zz' then 2 else 1000 + min(doc_id) end as ord from (select dimension, doc_id from cards union all select 'zz', null) group by dimension", "cards")
def _(spark, sf):
    return B.dimension_order(cards(spark, sf).select("dimension", F.col("doc_id").alias("pos")), ["d3", "d1", "zz"])


@add("t2_news_flow", "select url, from_history, score from (select *, published < date '2024-01-20' as from_history from scored) order by from_history, case when not from_history then score end desc nulls last, published desc, url limit 200", "scored")
def _(spark, sf):
    c = scored_cards(spark, sf).withColumns({"kind": F.lit("news"), "from_history": F.col("published") < F.lit("2024-01-20")})
    return B.news_flow(c).limit(200).select("url", "from_history", "score")


@add("f8_t10_history", "select url, score from scored where published >= date '2024-01-21' order by score desc, published desc, url limit 400", "scored")
def _(spark, sf):
    return C.history(scored_cards(spark, sf), as_of(), days=10).select("url", "score")


@add("u3_j18_pool", "select url, from_history from (select url, doc_id % 2 = 1 as from_history from cards)", "cards")
def _(spark, sf):
    c = cards(spark, sf)
    return C.pool(c.filter("doc_id % 2 = 0"), c).select("url", "from_history")


@add("p2_projection", "select url, title, summary from (select url, title, case when lang = 'en' then 'about en' else 'about ' || lang end as summary from cards)", "cards")
def _(spark, sf):
    return C.project(cards(spark, sf), "zh").select("url", "title", "summary")


@add("w2_base_models", "select full_id, base, place from (select full_id, base, min(pos) over (partition by base) as place, row_number() over (partition by base order by trending_score desc, pos) as n from (select *, regexp_replace(lower(split_part(full_id, '/', -1)), '-(gguf|fp8|fp16|bf16|mlx|awq|gptq|int8|int4|uncensored|obli?(terat)?ed|instruct|chat|base)(-.*)?$', '') as base from models)) where n = 1", "models")
def _(spark, sf):
    return B.base_models(models(spark, sf)).select("full_id", "base", "place")


@add("t3_model_board", "select full_id, likes from models order by likes desc, pos limit 100", "models")
def _(spark, sf):
    return B.model_board(models(spark, sf), "likes").select("full_id", "likes")


@add("p5_p6_models", "select full_id, likes as score, trending_score as trend, 'https://www.reddit.com/search/?q=' || term as link from models", "models")
def _(spark, sf):
    m = B.unified_models(models(spark, sf)).withColumn("c", B.community_links(F.col("term"), "en"))
    return m.select("full_id", "score", "trend", F.col("c")[1]["url"].alias("link"))


@add("j16_model_lookup", "select name, full_id from (select name, full_id, row_number() over (partition by name order by pos) as n from (select distinct left(lower(term), 5) as name from models) q join models m on lower(split_part(full_id, '/', -1)) = name or lower(full_id) = name or starts_with(lower(split_part(full_id, '/', -1)), name)) where n = 1", "models")
def _(spark, sf):
    m = models(spark, sf)
    return B.model_lookup(m.select(F.substring(F.lower("term"), 1, 5).alias("name")).distinct(), m).select("name", "full_id")


@add("c32_families", "select full_id, case when length(f) >= 3 then f end as family from (select full_id, regexp_replace(regexp_replace(split_part(full_id, '/', -1), '(?i)-(gguf|fp8|fp16|bf16|mlx|awq|gptq|int8|int4|uncensored|instruct|chat|base|abliterated|ridge|fixed|dev|schnell)(-.*)?$', ''), '-\\d+(\\.\\d+)?[A-Za-z]*$', '') as f from models)", "models")
def _(spark, sf):
    return models(spark, sf).select("full_id", X.paper_family(F.element_at(F.split("full_id", "/"), -1)).alias("family"))


# --- card table

@add("a14_m1_upsert", "select url, case when doc_id % 3 = 0 then score else 1 end as score, case when doc_id % 3 = 0 then trend else 7 end as trend, doc_id % 3 = 0 as active, case when doc_id % 2 = 0 then date '2024-01-10' else date '2024-01-31' end as first_seen, case when doc_id % 3 = 0 then date '2024-01-31' else date '2024-01-10' end as refreshed, array_to_string(keywords, ',') as keywords from scored where doc_id % 2 = 0 or doc_id % 3 = 0", "scored")
def _(spark, sf):
    c = cut(scored_cards(spark, sf))
    old = C.stored(c.filter("doc_id % 2 = 0").withColumns({"score": F.lit(1), "trend": F.lit(7)}), F.lit("2024-01-10").cast("timestamp"))
    new = C.stored(c.filter("doc_id % 3 = 0"), as_of())
    made = C.upsert(old, new.unionByName(new.withColumn("url", F.concat("url", F.lit("?utm_source=x")))))
    return made.select("url", "score", "trend", "active", F.to_date("first_seen_at").alias("first_seen"), F.to_date("last_refresh_at").alias("refreshed"), F.array_join("keywords", ",").alias("keywords"))


@add("m1_j5_bucketed_upsert", "select url, case when doc_id % 3 = 0 then score else 1 end as score, case when doc_id % 3 = 0 then trend else 7 end as trend, doc_id % 3 = 0 as active, case when doc_id % 2 = 0 then date '2024-01-10' else date '2024-01-31' end as first_seen, case when doc_id % 3 = 0 then date '2024-01-31' else date '2024-01-10' end as refreshed, array_to_string(keywords, ',') as keywords from scored where doc_id % 2 = 0 or doc_id % 3 = 0", "scored")
def _(spark, sf):
    """The merge above by two commits of a bucketed table."""
    scratch = Scratch(spark, "cards")
    c = scratch.write(scored_cards(spark, sf))
    old = C.stored(c.filter("doc_id % 2 = 0").withColumns({"score": F.lit(1), "trend": F.lit(7)}), F.lit("2024-01-10").cast("timestamp"))
    new = C.stored(c.filter("doc_id % 3 = 0"), as_of())
    for cycle, batch in (("2024-01-10-00", old), ("2024-01-31-00", new.unionByName(new.withColumn("url", F.concat("url", F.lit("?utm_source=x")))))):
        commit = store.Commit(spark, f"{scratch.path}/store")
        C.upsert_buckets(commit, batch, cycle, buckets=16)
        made = C.active(store.table(spark, commit.path, commit.publish(), "cards"), cycle)
    return made.select("url", "score", "trend", "active", F.to_date("first_seen_at").alias("first_seen"), F.to_date("last_refresh_at").alias("refreshed"), F.array_join("keywords", ",").alias("keywords"))


@add("u7_keyword_guard", "select url, len(list_filter(keywords, lambda k: k <> keywords[1]))::int as n_new, len(keywords) > 1 as kept from cards where len(keywords) > 0", "cards")
def _(spark, sf):
    c = cards(spark, sf).filter(F.size("keywords") > 0)
    new = F.filter("keywords", lambda k: k != F.col("keywords")[0])
    return c.select("url", F.size(new).alias("n_new"), C.keeps_old(new, F.col("keywords")).alias("kept"))


@add("m3_migration", "select url, case dimension when 'd0' then 'x0' when 'd5' then 'x0' else dimension end as dimension from cards", "cards")
def _(spark, sf):
    return C.migrate_dimension(cards(spark, sf), {"d0": "x0", "d5": "x0"}).select("url", "dimension")


@add("j23_signals", "select url, hn_points from cards", "cards")
def _(spark, sf):
    c = cards(spark, sf)
    return C.with_signals(c, c.filter("hn_points > 0")).select("url", "hn_points")


@add("j14_a17_hn_signal", "select url, coalesce(nullif(max(case when rel then points end), 0), max(points)) as hn_points from (select q.url, q.doc_id % 7 as points, q.doc_id % 3 = 0 or len(list_intersect(cw, list_distinct(list_filter(regexp_extract_all(lower(case when doc_id % 2 = 0 then title else split_part(title, ' ', 1) end), '[a-z]{3,}'), lambda w: w not in ('the', 'and', 'for', 'are', 'with', 'new', 'via', 'from', 'how', 'why', 'what'))))) >= 2 as rel from (select *, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z]{3,}'), lambda w: w not in ('the', 'and', 'for', 'are', 'with', 'new', 'via', 'from', 'how', 'why', 'what'))) as cw from cards) q) group by url", "cards")
def _(spark, sf):
    c = cards(spark, sf)
    hits = c.select("url", "title", (F.col("doc_id") % 7).alias("points"), F.when(F.col("doc_id") % 3 == 0, "http://H.example/a").otherwise("http://other.org").alias("hit_url"), F.when(F.col("doc_id") % 2 == 0, F.col("title")).otherwise(F.element_at(F.split("title", " "), 1)).alias("hit_title"))
    return C.hn_signal(hits)


# --- matching and search

_ITEM = "select item_id, regexp_extract(text, '([A-Za-z]{3,})', 1) as surface from benchmark"


@add("j7_title_matches", f"select distinct url, surface as canon from cards join (select distinct surface from ({_ITEM}) where surface <> '') on regexp_matches(lower(title), '(^|[^a-z0-9])' || lower(surface) || '([^a-z0-9.]|\\.[^0-9]|\\.?$)')", "cards")
def _(spark, sf):
    items = read(spark, sf, "benchmark").select(F.regexp_extract("text", "([A-Za-z]{3,})", 1).alias("surface")).filter("surface <> ''").distinct()
    return match.matches(cards(spark, sf).select("url", "title"), items.withColumn("canon", F.col("surface")), "url", "title")


@add("f9_substring_search", "select url, score from scored where contains(lower(title), 'thon') or contains(lower(source), 'thon') order by score desc, published desc, url limit 200", "scored")
def _(spark, sf):
    return search.substring_search(scored_cards(spark, sf).drop("summary_zh", "summary_en"), "ThOn").select("url", "score")


_WORDS_SQL = "list_filter(string_split_regex(lower(q), '\\s+'), lambda w: w <> '')"
_HITS = "len(list_filter(ws, lambda w: contains(lower({0}), w)))"
_PART = "{1} * (" + _HITS + " / len(ws)) * (case when length({0}) < 80 then 1.0 else 0.8 end)::double"


@add(
    "j22_c30_t4_search",
    f"""select qid, rank, id, score from (select *, row_number() over (partition by qid order by score desc, id)::int as rank from (
      select *, row_number() over (partition by qid, coalesce({_TITLE_KEY.format('title')}, 'k' || id) order by score desc, id) as m from (
        select qid, url as id, title, round_even({_PART.format('title', 25)} + {_PART.format('source', 8)} + ln(greatest(hot, 0) + 1) * 1.5, 2) as score
        from (select *, {_WORDS_SQL} as ws from (select item_id as qid, array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') as q from benchmark)) join (select url, title, source, score as hot from scored) on {_HITS.format('title')} + {_HITS.format('source')} > 0)) where m = 1) where rank <= 20""",
    "scored",
)
def _(spark, sf):
    c = cut(scored_cards(spark, sf).select(F.lit("news").alias("kind"), F.col("url").alias("id"), "title", "source", "hot"))
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("q"))
    return search.search(c, q).select("qid", "rank", "id", "score")
