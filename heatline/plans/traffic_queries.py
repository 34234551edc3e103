"""Traffic reports on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatline.functions.text import client_ip, flag, region_of
from heatline.operators import traffic as T
from heatline.plans.standins import as_of, clicks, read, searches, slot_log, slots, sql, user_events, visits
from heatline.sources import traffic as S

Q, O = {}, {}


def add(name, body, *views):
    def put(f):
        Q[name] = f
        if body:
            O[name] = sql(body, *views)
        return f

    return put


@add("a1_overview", "select count(*) as total_pv, count(distinct ip) as total_uv, count(*) filter (where date = date '2024-01-31') as today_pv, count(distinct case when date = date '2024-01-31' then ip end) as today_uv from visits where date >= date '2024-01-01'", "visits")
def _(spark, sf):
    return T.overview(visits(spark, sf), as_of())


@add("a2_regions", "select country, count(distinct ip) as visitors, round_even(count(distinct ip) * 100.0::double / sum(count(distinct ip)) over (), 1) as pct from visits where date >= date '2024-01-01' group by country", "visits")
def _(spark, sf):
    return T.regions(visits(spark, sf), as_of())


@add("a3_daily", "select date, count(*) as pv, count(distinct ip) as uv from visits where date >= date '2024-01-01' group by date", "visits")
def _(spark, sf):
    return T.daily(visits(spark, sf), as_of())


@add("a4_search_totals", "select count(*) as total, count(distinct query) as queries, count(*) filter (where date = date '2024-01-31') as today from searches where date >= date '2024-01-01'", "searches")
def _(spark, sf):
    return T.search_totals(searches(spark, sf), as_of())


@add("a5_top_queries", "select query, count(*) as n from searches where date >= date '2024-01-01' group by query order by n desc, query limit 20", "searches")
def _(spark, sf):
    return T.top_queries(searches(spark, sf), as_of())


@add("a6_events_by_type", "select event_type, count(*) as n from user_events where date >= date '2024-01-01' group by rollup (event_type)", "user_events")
def _(spark, sf):
    return T.events_by_type(user_events(spark, sf), as_of())


@add("a7_events_by_day", "select date, count(*) as n from user_events where date >= date '2024-01-01' group by date", "user_events")
def _(spark, sf):
    return T.events_by_day(user_events(spark, sf), as_of())


@add("a9_slot_counters", "select slot_id, date, impressions, clicks from slot_stats", "slot_stats")
def _(spark, sf):
    return T.slot_counters(slot_log(spark, sf))


@add("j1_slot_report", "select slot_id, name, coalesce(sum(impressions), 0)::bigint as impressions, coalesce(sum(clicks), 0)::bigint as clicks from slots left join slot_stats st using (slot_id) where st.date is null or st.date >= date '2024-01-01' group by slot_id, name", "slots", "slot_stats")
def _(spark, sf):
    return T.slot_report(slots(spark, sf), T.slot_counters(slot_log(spark, sf)), as_of())


_FUNNEL = "select query, s.n as searches, coalesce(c.n, 0) as clicks, round_even(coalesce(c.n, 0) * 100.0::double / s.n, 1) as rate from (select query, count(*) as n from searches where date >= date '2024-01-01' and query <> '' group by query) s left join (select query, count(*) as n from clicks where date >= date '2024-01-01' and query <> '' group by query) c using (query)"


@add("j2_funnel", _FUNNEL, "searches", "clicks")
def _(spark, sf):
    return T.funnel(searches(spark, sf), clicks(spark, sf), as_of())


@add("j2_top_funnel", f"select * from ({_FUNNEL}) order by searches desc, query limit 15", "searches", "clicks")
def _(spark, sf):
    return T.top_funnel(searches(spark, sf), clicks(spark, sf), as_of())


@add("a21_funnel_totals", f"select coalesce(sum(searches), 0)::bigint as total_searches, coalesce(sum(clicks), 0)::bigint as total_clicks from ({_FUNNEL})", "searches", "clicks")
def _(spark, sf):
    return T.funnel_totals(searches(spark, sf), clicks(spark, sf), as_of())


@add("t5_latest_visits", "select id, ip, country, path from visits order by id desc limit 30", "visits")
def _(spark, sf):
    return T.latest(visits(spark, sf), 30, "ip", "country", "path")


@add("t8_suggest", "select query, count(*) as n from searches where date >= date '2024-01-01' and contains(lower(query), 'th') group by query order by starts_with(lower(query), 'th') desc, n desc, query limit 8", "searches")
def _(spark, sf):
    return T.suggest(searches(spark, sf), "Th", as_of())


@add("t8_suggestion_table", """select typed, rank, query, n from (select typed, query, n, row_number() over (partition by typed order by starts_with(lower(query), typed) desc, n desc, query)::int as rank
  from (select distinct query, n, trim(substr(lower(query), i, k)) as typed from (select query, count(*) as n from searches where date >= date '2024-01-01' and query <> '' group by query), unnest(range(1, 81)) as a(i), unnest(range(1, 13)) as b(k) where i + k - 1 <= length(query)) where typed <> '') where rank <= 8""", "searches")
def _(spark, sf):
    return T.suggestions(searches(spark, sf), as_of())


@add("f1_t7_active_slots", "select slot_id, name, region, sort_order from slots where active and region in ('cn', 'all') and (start_date is null or start_date <= date '2024-01-31') and (end_date is null or end_date >= date '2024-01-31')", "slots")
def _(spark, sf):
    return T.active_slots(slots(spark, sf), as_of(), "cn").select("slot_id", "name", "region", "sort_order")


@add("f2_s18_events", "select id, event_type, left(event_data, 2000) as event_data, 'Unknown' as country from user_events where event_type in ('page_view', 'click', 'search', 'word_expand', 'word_detail', 'view_switch', 'lang_switch', 'sort_switch', 'cat_filter', 'link_click', 'search_click', 'hf_entry_click')", "user_events")
def _(spark, sf):
    return S.events(user_events(spark, sf)).select("id", "event_type", "event_data", "country")


@add("st1_judged_lines", """select case when event_type = 'error' then null else id end as id, case when event_type in ('click', 'search') then 'accepted' else 'rejected' end as status,
  case when event_type = 'error' then 'malformed' when event_type not in ('click', 'search') then 'event type' end as reason, case when event_type <> 'error' then date end as date, event_type <> 'error' and event_type not in ('click', 'search') as kept_raw from user_events""", "user_events")
def _(spark, sf):
    """Events as landed lines of JSON; the lines of errors were cut off in the middle."""
    e = user_events(spark, sf)
    line = F.to_json(F.struct("id", "event_type", "event_data", "session_id", "path", "country", "ts"))
    lines = e.select(F.when(F.col("event_type") == "error", F.substring(line, 1, 20)).otherwise(line).alias("value"))
    out = S.judged(lines, "events", "id long, event_type string, event_data string, session_id string, path string, country string, ts timestamp")
    return out.select("id", "status", "reason", "date", (F.coalesce("raw", F.lit("")).endswith("}")).alias("kept_raw"))


@add("st9_a3_corrections", """select date, count(*) filter (where path <> 'click') as pv_stream, count(distinct ip) filter (where path <> 'click') as uv_stream, count(*) filter (where path = 'click') as pv_late,
  count(distinct ip) - count(distinct ip) filter (where path <> 'click') as uv_late from visits group by date""", "visits")
def _(spark, sf):
    """Clicks as the rows that came late: their deltas correct the days that the others had closed."""
    v = visits(spark, sf).withColumn("_late", F.col("path") == "click")
    stream, known = T.day_deltas(v.filter("not _late"))
    late, _new = T.day_deltas(v.filter("_late"), known)
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(c))), F.lit(0)).alias(f"{c}_{k}") for k in ("stream", "late") for c in ("pv", "uv")]
    return stream.withColumn("kind", F.lit("stream")).union(late.withColumn("kind", F.lit("late"))).groupBy("date").agg(*sums)


@add("s19_visits", "select id, ip, country from visits where ip <> ''", "visits")
def _(spark, sf):
    return S.visits(visits(spark, sf)).select("id", "ip", "country")


@add("s20_searches", "select id, left(q, 80) as query from (select conv_id * 100 + turn as id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as q from conversations where role = 'user') where q <> '' and not contains(q, '{') and not contains(q, '}')")
def _(spark, sf):
    raw = read(spark, sf, "conversations").filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("query"), F.lit(None).cast("string").alias("country"))
    return S.searches(raw).select("id", "query")


@add("s21_clicks", "select id, left(q, 80) as query, left('https://h.example/' || q, 500) as url from (select conv_id * 100 + turn as id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as q from conversations) where q <> ''")
def _(spark, sf):
    raw = read(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("query"), F.concat(F.lit("https://h.example/"), F.regexp_replace("text", r"\A\s+|\s+\z", "")).alias("url"), F.lit("x").alias("country"))
    return S.clicks(raw).select("id", "query", "url")


@add("c39_event_data", "select id, json_extract_string(event_data, '$.k') as k from user_events", "user_events")
def _(spark, sf):
    return user_events(spark, sf).select("id", F.try_variant_get(S.parsed_data(F.col("event_data")), "$.k", "string").alias("k"))


@add("c36_c37_c43_clients", "select id, user_id::varchar || '.1' as ip, case when event_id % 2 = 0 then 'zh' else 'global' end as lang, event_id % 3 = 0 as flag from (select event_id as id, * from events)")
def _(spark, sf):
    e = read(spark, sf, "events")
    hop = F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(".1 , 10.0.0.1"))
    return e.select(F.col("event_id").alias("id"), client_ip(F.when(F.col("event_id") % 5 != 0, hop), F.concat(F.col("user_id").cast("string"), F.lit(".1"))).alias("ip"), region_of(F.when(F.col("event_id") % 2 == 0, "zh-CN,en").otherwise("en-US")).alias("lang"), flag(F.when(F.col("event_id") % 3 == 0, " Yes").otherwise("0")).alias("flag"))


@add("j13_country", "select id, coalesce(case when event_id % 10 = 0 then 'FR' end, n_name, 'Unknown') as country from (select event_id as id, event_id, user_id * 3001 as ip_num from events) e left join nation on ip_num // 17000 = n_nationkey")
def _(spark, sf):
    e = read(spark, sf, "events")
    rows = e.select(F.col("event_id").alias("id"), (F.col("user_id") * 3001).cast("long").alias("ip_num"), F.when(F.col("event_id") % 10 == 0, "fr").when(F.col("event_id") % 10 == 1, "XX").otherwise("").alias("header"))
    k = F.col("n_nationkey").cast("long")
    ranges = read(spark, sf, "nation").select((k * 17000).alias("lo"), (k * 17000 + 16999).alias("hi"), F.col("n_name").alias("country"))
    return T.country_of(rows, ranges).select("id", "country")


@add("m10_slot_changes", "select slot_id, case when s_suppkey % 5 = 1 then 'new ' || slot_id else name end as name, case when s_suppkey % 5 = 1 then false when s_suppkey % 5 = 2 then not active else active end as active from (select * from slots join (select s_suppkey, s_suppkey::varchar as slot_id from supplier) using (slot_id)) where s_suppkey % 5 <> 3", "slots")
def _(spark, sf):
    s = slots(spark, sf)
    k = F.col("slot_id").cast("long") % 5
    at = lambda t: F.lit(t).cast("timestamp")
    cols = [c for c in s.columns if c != "slot_id"]
    up = s.filter(k == 1).withColumns({"ts": at("2024-01-02"), "op": F.lit("upsert"), "name": F.concat(F.lit("new "), "slot_id"), "active": F.lit(False)})
    older = up.withColumns({"ts": at("2024-01-01"), "name": F.lit("old")})
    toggles = s.filter(k == 2).withColumns({"ts": at("2024-01-03"), "op": F.lit("toggle")})
    gone = s.filter(k == 3).withColumns({"ts": at("2024-01-03"), "op": F.lit("delete")})
    changes = older.unionByName(up).unionByName(toggles).unionByName(gone).select("slot_id", "ts", "op", *cols)
    return T.apply_slot_changes(s, changes).select("slot_id", "name", "active")


@add("st3_rate_limit", """with recursive h as (select user_id::varchar as key, ts::timestamp as ts from events), begun as (
    select key, min(ts) as s from h group by key
    union all select key, n from (select begun.key, min(h.ts) as n from begun join h on h.key = begun.key and h.ts >= begun.s + interval 6 hour group by begun.key) where n is not null
  ), told as (select h.key, h.ts, begun.s, row_number() over (partition by h.key, begun.s order by h.ts) as n from h asof join begun on h.key = begun.key and h.ts >= begun.s)
  select 'event' as bucket, key, ts, n <= 3 as allowed, case when n <= 3 then 0 else greatest(1, floor(21600 - epoch_us(ts - s) / 1000000.0)::int + 1) end as retry_after from (select *, ts - s as d from told)""".replace("epoch_us(ts - s)", "(epoch_us(ts) - epoch_us(s))"))
def _(spark, sf):
    e = read(spark, sf, "events")
    hits = e.select(F.lit("event").alias("bucket"), F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return T.rate_limit(hits, 3, 6 * 3600)


@add("a8_page_views", "select count(*) as views from visits where date >= date '2024-01-24' union all select count(*) from visits where date >= date '2030-01-01'", "visits")
def _(spark, sf):
    v = visits(spark, sf)
    return T.page_views(v, as_of(), 7).unionByName(T.page_views(v.filter("date >= '2030-01-01'"), as_of(), 7))


@add("a9_page_view_counters", "select date, count(*) as views from visits group by date", "visits")
def _(spark, sf):
    return T.page_view_counters(visits(spark, sf))


@add("s22_slots_or_file", "select slot_id, name from slots union all select 'x' || slot_id, name from slots", "slots")
def _(spark, sf):
    s = slots(spark, sf).select("slot_id", "name")
    file = s.withColumn("slot_id", F.concat(F.lit("x"), "slot_id"))
    return T.slots_or(s, file).unionByName(T.slots_or(s.limit(0), file))
