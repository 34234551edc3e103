"""The whole term refresh on the driver's tables: a cycle over all cards, with a stored pool, snapshots, models, a glossary,
requests and answers that are derived from the titles' words by rules on the words.

Words of six letters are stored terms; words of nine are stored with a hyphen, as twins of what the cards say, under Chinese
names; words of twelve are stored models. Words of five letters are also models. Terms of nations are stored and not met.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from heatline.functions import lexicon as L
from heatline.plans import refresh as R
from heatline.plans.standins import SQL, NEEDS, as_of, models, read, scored_cards, sql
from heatline.plans.term_queries import _current

Q, O = {}, {}
CYCLE, ASKED = "2024-01-31-08", "2024-01-30-20"


def _words(cards):
    return cards.select(F.explode("keywords").alias("w")).distinct().withColumn("k", F.ascii("w"))


def _zoo(spark, sf, words):
    own = words.filter("length(w) = 5").select(F.concat(F.lit("lab/"), "w", F.when(F.col("k") % 2 == 0, "-chat").otherwise("")).alias("full_id"), F.col("w").alias("term"), (F.col("k") * 10).cast("long").alias("likes"), (F.col("k") % 7).cast("long").alias("trending_score"), (F.col("k") + 1_000_000).cast("long").alias("pos"))
    return models(spark, sf).select("full_id", "term", "likes", "trending_score", "pos").union(own)


def _old(spark, sf, words):
    w, k, n = F.col("w"), F.col("k"), F.length("w")
    hyphen = F.concat(F.substring("w", 1, 2), F.lit("-"), F.substring(w, F.lit(3), n))
    at = lambda day: F.lit(f"2024-01-{day}").cast("timestamp")
    told = k % 3 == 0
    rows = words.filter(n.isin(6, 9, 12)).select(
        F.when(n == 9, hyphen).otherwise(w).alias("term"),
        F.when(n == 6, w).when(n == 9, F.concat(F.lit("热"), F.upper(F.substring("w", 1, 1)), F.substring(w, F.lit(2), n))).otherwise(F.upper("w")).alias("display"),
        F.when(k % 2 == 0, F.concat(F.lit("Stored "), w)).alias("display_en"),
        (at("01 06:00:00") + F.make_dt_interval(k % 9)).alias("first_seen_at"),
        F.lit(5).cast("long").alias("mentions"),
        F.lit(7).cast("long").alias("win7"),
        F.when(n == 12, F.struct(F.concat(F.lit("old/"), w).alias("full_id"), n.cast("long").alias("likes"), F.lit(1).cast("long").alias("trending_score"), *(F.lit(None).cast(t).alias(c) for c, t in (("downloads", "long"), ("official_url", "string"), ("author", "string"), ("tags", "array<string>"))))).alias("hf"),
        F.lit(2.0).alias("hot"),
        F.when(told, F.concat(F.lit("zh "), w)).alias("explain_zh"),
        F.when(told, F.concat(F.lit("en "), w)).alias("explain_en"),
        F.when(told, F.when(k % 2 == 0, at("30 12:00:00")).otherwise(at("28 12:00:00"))).alias("explain_updated_at"),
        F.when(told, "2024-01-29-08").alias("explained_cycle"),
    )
    lost = read(spark, sf, "nation").select(F.concat(F.lit("gone-"), F.regexp_replace(F.lower("n_name"), "[^a-z0-9]", "")).alias("term"), F.col("n_name").alias("display"), F.lit(3.0).alias("hot"), F.lit(4).cast("long").alias("mentions"))
    outlet = read(spark, sf, "region").select(F.lit("daily-wire").alias("term"), F.lit("Daily Wire").alias("display")).limit(1)
    return R.pool_rows(rows.unionByName(lost, True).unionByName(outlet, True))


def _snapshots(words):
    w, n = F.col("w"), F.length("w")
    hyphen = F.concat(F.substring("w", 1, 2), F.lit("-"), F.substring(w, F.lit(3), n))
    some = words.filter(n.isin(6, 9))
    rows = some.select(w.alias("term"), "k").union(some.filter("length(w) = 9").select(hyphen, "k"))
    cycles = F.explode(F.array(*(F.lit(c) for c in ("2024-01-29-08", ASKED, CYCLE)))).alias("cycle")
    return rows.select("term", cycles, (F.col("k") % 5).cast("long").alias("news_cnt"), (F.col("k") % 6).cast("long").alias("win7_cnt"), F.col("k").cast("long").alias("score_sum"), F.lit(0.5).alias("signal_sum"))


def _asked(old):
    kinds = F.explode(F.array(F.lit("translate"), F.lit("explain"))).alias("kind")
    return old.filter("term not like 'gone-%'").select(F.lit(ASKED).alias("cycle"), kinds, F.col("term").alias("canon"), "display", F.array().cast("array<string>").alias("titles"), F.lit(None).cast("string").alias("zh"), F.lit(None).cast("string").alias("en"), F.lit(1).alias("rank"))


def _answers(asked):
    k, kind = F.ascii("canon"), F.col("kind")
    zh = F.when(kind == "explain", F.concat(F.lit("新 "), "canon"))
    en = F.when(kind == "translate", F.when(k % 4 == 0, F.concat(F.lit(" Now "), "canon")).when(k % 4 == 1, "回显")).otherwise(F.when(k % 5 == 0, F.concat(F.lit("new "), "canon")).otherwise(""))
    given = asked.filter((kind == "explain") | (k % 4 != 3)).select("cycle", "kind", "canon", zh.alias("zh"), en.alias("en"))
    unasked = given.withColumns({"cycle": F.lit("2024-01-31-00"), "en": F.lit("nobody asked")})
    return given.union(unasked).union(given)


def refreshed(spark, sf) -> R.Pool:
    c = R.cut(scored_cards(spark, sf))
    words = R.cut(_words(c))
    old = R.cut(_old(spark, sf, words))
    asked = _asked(old)
    glossary = old.filter("display like '热%' and ascii(substring(display, 2, 1)) % 7 = 0").select(F.col("display").alias("name"), F.concat(F.lit("Official "), "term").alias("en"))
    static = words.filter("w like 's%'").select(F.col("w").alias("canon"), F.lit("").alias("zh"), F.lit("said").alias("en"))
    return R.refresh_terms(c, _current(spark, sf, c), _zoo(spark, sf, words), old, _snapshots(words), L.load(spark), as_of(), CYCLE, L.STOPWORDS, L.MEDIA, glossary, static, asked, _answers(asked))


_values = lambda rows: "(values " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"
_HYPHEN = "left(w, 2) || '-' || substr(w, 3)"
_HIT = "contains(lower(title), lower(surface)) and (regexp_matches(surface, '[^\\x00-\\x7F]') or regexp_matches(title, '(?i)(^|[^a-z0-9])' || surface || '([^a-z0-9.]|\\.[^0-9]|\\.?$)'))"
_SPELL = "regexp_extract(t, '(?i)(^|[^a-z0-9])(' || regexp_replace(word, '[- ]', '[- ]', 'g') || ')([^a-z0-9.]|\\.[^0-9]|\\.?$)', 2)"
_TRUSTED = "regexp_matches(s, '[A-Z]') and (regexp_matches(s, '[a-z]') or regexp_matches(t, '[a-z]|[^\\x00-\\x7F]'))"
_CJK = "'[\\x{4e00}-\\x{9fff}]'"
_VIEWS = {
    "lex": f"select canon, surface, ord from {_values([(c, s, i) for c, forms in L.SEED.items() for i, s in enumerate(dict.fromkeys([c, *forms]))])} x(canon, surface, ord)",
    "acro": f"select * from {_values(L.ACRONYMS.items())} x(a, b)",
    "stops": f"select * from {_values([(w,) for w in L.STOPWORDS])} x(w)",
    "ruled": "select distinct canon from (select canon from lex union all select b from acro)",
    "alias": "select a, arg_min(canon, (ord, canon)) as canon from (select regexp_replace(regexp_replace(lower(surface), '[\\s_]+', '-', 'g'), '^-+|-+$', '', 'g') as a, canon, ord from lex) group by a",
    "w": "select distinct unnest(keywords) as w from scored",
    "wk": "select w, unicode(w) as k, length(w) as n from w",
    "zoo": "select full_id, term, likes, trending_score, pos from models union all select 'lab/' || w || case when k % 2 = 0 then '-chat' else '' end, w, k * 10, k % 7, k + 1000000 from wk where n = 5",
    "named": "select *, regexp_replace(lower(split_part(full_id, '/', -1)), '-(gguf|fp8|fp16|bf16|mlx|awq|gptq|int8|int4|uncensored|instruct|chat|base)(-.*)?$', '') as word from zoo",
    "old": f"""select case when n = 9 then {_HYPHEN} else w end as term, case n when 6 then w when 9 then '热' || upper(left(w, 1)) || substr(w, 2) else upper(w) end as display, null as display_zh,
      case when k % 2 = 0 then 'Stored ' || w end as display_en, timestamp '2024-01-01 06:00:00' + to_days((k % 9)::int) as first_seen_at, null::timestamp as last_seen_at, null as origin, 5 as mentions, 7 as win7, case when n = 12 then n end as likes, 2.0::double as hot,
      case when k % 3 = 0 then 'zh ' || w end as explain_zh, case when k % 3 = 0 then 'en ' || w end as explain_en, case when k % 3 = 0 then case when k % 2 = 0 then timestamp '2024-01-30 12:00:00' else timestamp '2024-01-28 12:00:00' end end as explain_updated_at, null as translated_cycle, case when k % 3 = 0 then '2024-01-29-08' end as explained_cycle
      from wk where n in (6, 9, 12)
      union all select 'gone-' || regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g'), n_name, null, null, null, null, null, 4, null, null, 3.0, null, null, null, null, null from nation
      union all select 'daily-wire', 'Daily Wire', null, null, null, null, null, null, null, null, null, null, null, null, null, null""",
    "every": "select w as word from w union select word from named union select term from old",
    "shaped": "select word, regexp_replace(lower(word), '^[[:punct:]]+|[[:punct:]]+$', '', 'g') as t from every",
    "canons": """select word, coalesce(r.canon, c) as canon from (select word, coalesce(b, found) as c from (select word, coalesce(x.canon, y.canon, t) as found from shaped left join alias x on x.a = t left join alias y on length(t) >= 4 and t not like '%ss' and t like '%s' and y.a = left(t, length(t) - 1)) left join acro on a = found)
      left join ruled r on c like '%-%' and r.canon = replace(c, '-', '')""",
    "words": "select word, canon from canons where canon is not null and lower(canon) not in (select w from stops)",
    "best": "select canon, arg_max(full_id, (trending_score, -pos)) as full_id, arg_max(term, (trending_score, -pos)) as term, arg_max(likes, (trending_score, -pos)) as likes, max((trending_score, -pos))[1] as trending_score, -max((trending_score, -pos))[2] as pos from named join words using (word) group by canon",
    "forms": "select canon, surface from (select canon, canon as surface from (select canon from words union select canon from lex) union select canon, surface from lex)",
    "surfaces": """select distinct * from (select canon, surface, 'dictionary' as kind from lex
      union all select canon, unnest([term, split_part(full_id, '/', -1), canon]), 'model' from best
      union all select canon, unnest(case when regexp_matches(surface, '[^\\x00-\\x7F]') then [surface] else [surface, replace(surface, '-', ' '), replace(surface, '-', ''), replace(surface, ' ', '-')] end), 'term' from forms)""",
    "hits": f"select distinct url, canon, kind from scored join surfaces on {_HIT}",
    "by_keyword": "select distinct url, canon from (select url, unnest(keywords) as word from scored) join words using (word)",
    "keyword_links": "select url, canon from by_keyword union select url, canon from hits where kind = 'dictionary' and url not in (select url from by_keyword) and lower(canon) not in (select w from stops)",
    "raw_links": "select * from keyword_links union select url, canon from hits where kind = 'model'",
    "stored": "select coalesce(canon, term) as canon, old.* from old join canons on word = term",
    "sizes": "select canon, bool_or(known) as known, max(m) as mentions, canon in (select canon from ruled) as governed from (select canon, false as known, count(*) as m from raw_links group by canon union all select canon, false, 0 from best union all select canon, true, 0 from stored) group by canon",
    "reps": "select canon, first_value(canon) over (partition by case when regexp_matches(canon, '^[\\x00-\\x7F]+$') then replace(lower(canon), '-', '') else chr(1) || canon end order by governed desc, known desc, mentions desc, canon) as rep from sizes",
    "links": "select distinct url, rep as canon from raw_links join reps using (canon)",
    "zoo_best": "select rep as canon, arg_max(full_id, (trending_score, -pos)) as full_id, arg_max(term, (trending_score, -pos)) as model_name, arg_max(likes, (trending_score, -pos)) as model_likes from best join reps using (canon) group by rep",
    "pool": """select canon, min(first_seen_at) as first_seen_at, last(display order by cased, own, term) as old_display, """ + ", ".join(f"last({c} order by own, term) filter (where {c} is not null) as {n}" for c, n in (("display_zh", "display_zh"), ("display_en", "stored_en"), ("likes", "old_likes"), ("mentions", "old_mentions"), ("win7", "old_win7"), ("explain_zh", "explain_zh"), ("explain_en", "explain_en"), ("explain_updated_at", "explain_updated_at"), ("translated_cycle", "translated_cycle"), ("explained_cycle", "explained_cycle"))) + """
      from (select rep as canon, s.* exclude (canon), term = rep as own, regexp_matches(display, '[A-Z]') as cased from stored s join reps using (canon)) group by canon""",
    "all_": """select canon, coalesce(s.mentions, 0) as mentions, coalesce(heat, 0) as heat, coalesce(s.win7, 0) as win7, earliest, coalesce(cur_cnt, 0) as cur_cnt, coalesce(cur_score, 0) as cur_score, coalesce(cur_signal, 0) as cur_signal, full_id, model_name, model_likes, full_id is not null as is_model,
      p.* exclude (canon), p.canon is not null as known, canon in (select canon from ruled) as lexical from sums s full join zoo_best using (canon) left join pool p using (canon)""",
    "kept": """select * from all_ where lexical or is_model or known union all
      (select * from all_ where not (lexical or is_model or known) and not (mentions <= 1 and regexp_matches(canon, '^[\\x00-\\x7F]*$') and length(canon) < 4) order by mentions desc, heat desc, canon limit 150)""",
    "titled": "select canon, count(*) as more from (select distinct url, rep as canon from hits join reps using (canon) where kind = 'term') anti join links using (url, canon) group by canon",
    "snaps0": f"select term, unnest(['2024-01-29-08', '{ASKED}', '{CYCLE}']) as cycle, k % 5 as news_cnt, k % 6 as win7_cnt, k as score_sum, 0.5 as signal_sum from (select w as term, k from wk where n in (6, 9) union all select {_HYPHEN}, k from wk where n = 9)",
    "history": "select coalesce(rep, term) as term, cycle, sum(news_cnt)::bigint as news_cnt, sum(win7_cnt)::bigint as win7_cnt, sum(score_sum)::bigint as score_sum, sum(signal_sum)::double as signal_sum from snaps0 left join reps on canon = term group by all",
    "seen_words": f"select canon, s from (select rep as canon, t, coalesce(nullif({_SPELL}, ''), word) as s from (select url, title as t, unnest(keywords) as word from scored where doc_id % 3 = 0) join words using (word) join reps using (canon)) where {_TRUSTED}",
    "ranked": f"select canon, url, title, row_number() over (partition by canon order by score desc, published desc, url) as n from (select *, row_number() over (partition by canon, coalesce(nullif(regexp_replace(lower(title), '[!?,.;:()\\[\\]\"'' \t]', '', 'g'), ''), url) order by score desc, published desc, url) as m from (select distinct url, rep as canon from keyword_links join reps using (canon)) join scored using (url)) where m = 1 qualify n <= 3",
    "seen_news": f"select canon, s from (select canon, title as t, canon as word, coalesce(nullif({_SPELL}, ''), canon) as s from ranked) where {_TRUSTED}",
    "spelled": "select canon, first(s order by length(s) desc, s) as s from (select * from seen_words union all select * from seen_news where canon not in (select canon from seen_words)) group by canon",
    "asked": f"select '{ASKED}' as cycle, unnest(['translate', 'explain']) as kind, term as canon from old where term not like 'gone-%'",
    "told": "select cycle, kind, canon, case when kind = 'explain' then '新 ' || canon end as zh, case when kind = 'translate' then case unicode(canon) % 4 when 0 then 'Now ' || canon when 1 then '回显' end else case when unicode(canon) % 5 = 0 then 'new ' || canon else '' end end as en from asked where kind = 'explain' or unicode(canon) % 4 <> 3",
    "due": f"select kind, rep as canon, arg_max(cycle, (cycle, en, zh)) as cycle, arg_max(zh, (cycle, coalesce(en, ''), coalesce(zh, ''))) as zh, arg_max(en, (cycle, coalesce(en, ''), coalesce(zh, ''))) as en from told join reps using (canon) join pool on pool.canon = rep where cycle > coalesce(case when kind = 'explain' then explained_cycle else translated_cycle end, '') group by kind, rep",
    "facts": f"""select k.* exclude (mentions), k.mentions + coalesce(more, 0) as mentions, coalesce(model_likes, old_likes, 0) as likes,
      (select arg_max(win7_cnt, cycle) from history h where h.term = k.canon and cycle < '{CYCLE}') as prev,
      coalesce(model_name, case when lexical then (select surface from lex where lex.canon = k.canon and ord = 1) else s end, case when not lexical and regexp_matches(old_display, '\\p{{Lu}}') then old_display end, case when lower(k.canon) <> k.canon then k.canon end,
        array_to_string(list_transform(string_split(k.canon, '-'), lambda p: upper(left(p, 1)) || substr(p, 2)), ' ')) as display,
      coalesce(display_zh, (select arg_min(surface, ord) from lex where lex.canon = k.canon and regexp_matches(surface, {_CJK}))) as zh_name,
      case when first_seen_at is not null and first_seen_at::date in (select published from links join scored using (url) where links.canon = k.canon) then first_seen_at end as anchored
      from kept k left join titled using (canon) left join spelled using (canon)""",
    "timed": "select *, case when earliest is not null and (anchored is null or earliest < anchored::date) then earliest::timestamp else coalesce(anchored, timestamp '2024-01-31') end as seen from facts",
    "told_now": "select f.*, t.cycle as t_cycle, e.cycle as e_cycle, e.zh as e_zh, e.en as e_en, case when t.en <> '' and not regexp_matches(t.en, " + _CJK + ") then t.en end as t_en, coalesce(e.zh <> '' and e.en <> '', false) as explained from timed f left join due t on t.canon = f.canon and t.kind = 'translate' left join due e on e.canon = f.canon and e.kind = 'explain'",
    "gloss": f"select display as name, 'Official ' || term as en from old where display like '热%' and unicode(substr(display, 2, 1)) % 7 = 0",
    "final": f"""select canon as term, display, zh_name as display_zh, coalesce(case when regexp_matches(display, {_CJK}) then coalesce(g.en, gz.en) end, t_en, stored_en) as display_en, regexp_matches(display, {_CJK}) and coalesce(g.en, gz.en) is not null as from_glossary,
      case when is_model and mentions > 0 then 'both' when is_model then 'hf' else 'news' end as origin, strftime(seen, '%Y-%m-%d %H:%M') as first_seen, mentions, win7, likes, heat + likes as hot,
      round_even(greatest(-1, least(10, case when prev is null then case when win7 > 0 then ln(1 + win7) else 0 end else (win7 - prev) / greatest(prev, 0.5) end)), 4) as rise,
      round_even(case when floor(date_diff('second', seen, timestamp '2024-01-31') / 86400) <= 2 then 2 else exp(-floor(date_diff('second', seen, timestamp '2024-01-31') / 86400) / 10) end / (1 + ln(1 + mentions)), 4) as novelty,
      case when explained then left(e_zh, 200) else explain_zh end as explain_zh, case when explained then left(e_en, 300) else explain_en end as explain_en, case when explained then timestamp '2024-01-31' else explain_updated_at end as explained_at,
      coalesce(t_cycle, translated_cycle) as translated_cycle, coalesce(e_cycle, explained_cycle) as explained_cycle, cur_cnt, cur_score, cur_signal
      from told_now left join gloss g on g.name = display left join gloss gz on gz.name = zh_name""",
    "lost": "select canon, old_display as display, display_zh, stored_en, strftime(first_seen_at, '%Y-%m-%d %H:%M') as first_seen, old_mentions, old_win7, coalesce(old_likes, 0) as likes, explain_zh, explain_en, explain_updated_at, translated_cycle, explained_cycle from pool where canon not in (select term from final) and canon <> 'daily-wire'",
}
_ORDER = ["lab", "cards", "scored", "models", *list(_VIEWS)[: list(_VIEWS).index("links") + 1], "sums", *list(_VIEWS)[list(_VIEWS).index("links") + 1 :]]
_ALL = SQL | _VIEWS


def add(name, body):
    def put(f):
        Q[name] = f
        O[name] = "with " + ", ".join(f"{n} as {'materialized ' if n in ('hits', 'reps', 'kept', 'facts', 'canons') else ''}({_ALL[n]})" for n in _ORDER) + " " + body
        return f

    return put


@add("m4_refresh_terms", """select term, display, display_zh, display_en, origin, first_seen, mentions, win7, likes, hot, rise, novelty, explain_zh, explain_en, strftime(explained_at, '%Y-%m-%d %H:%M') as explained_at, translated_cycle, explained_cycle from final
  union all select canon, display, display_zh, stored_en, null, first_seen, old_mentions, old_win7, likes, 0, 0, 0, explain_zh, explain_en, strftime(explain_updated_at, '%Y-%m-%d %H:%M'), translated_cycle, explained_cycle from lost""")
def _(spark, sf):
    t = refreshed(spark, sf).terms
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return t.select("term", "display", "display_zh", "display_en", "origin", at("first_seen_at").alias("first_seen"), "mentions", "win7", F.coalesce("hf.likes", F.lit(0).cast("long")).alias("likes"), "hot", "rise", "novelty", "explain_zh", "explain_en", at("explain_updated_at").alias("explained_at"), "translated_cycle", "explained_cycle")


@add("m4_m7_snapshots", f"""select term, cycle, news_cnt, win7_cnt, score_sum, signal_sum from history where cycle <> '{CYCLE}' or term not in (select term from final)
  union all select term, '{CYCLE}', cur_cnt, win7, cur_score, round_even(cur_signal, 1) from final""")
def _(spark, sf):
    return refreshed(spark, sf).snapshots.select("term", "cycle", "news_cnt", "win7_cnt", "score_sum", "signal_sum")


@add("m4_requests", f"""select * from (select 'translate' as kind, term as canon, display, ''::varchar as titles, null::varchar as zh, null::varchar as en, row_number() over (order by coalesce(display_en, '') <> '' and not regexp_matches(display_en, {_CJK}), term)::int as rank from final where regexp_matches(display, {_CJK}) and not from_glossary) where rank <= 100
  union all select * from (select 'explain', term, display, coalesce((select string_agg(title, '|' order by n) from ranked where canon = term), ''), explain_zh, explain_en, row_number() over (order by hot desc, term)::int as rank from final
    where term not in (select w from w where w like 's%') and (explained_at is null or explained_at < timestamp '2024-01-30' or coalesce(explain_zh, '') = '' or coalesce(explain_en, '') = '')) where rank <= 60""")
def _(spark, sf):
    return refreshed(spark, sf).requests.select("kind", "canon", "display", F.array_join("titles", "|").alias("titles"), "zh", "en", "rank")


@add("m4_word_board", "select term as id, display, origin, hot, mentions as news_cnt, coalesce((select string_agg(url, ' ' order by n) from ranked where canon = term), '') as news from final order by hot desc, term limit 200")
def _(spark, sf):
    w = refreshed(spark, sf).words
    return w.select("id", "display", "origin", "hot", "news_cnt", F.coalesce(F.array_join(F.transform("top_news", lambda n: n["official_url"]), " "), F.lit("")).alias("news"))
