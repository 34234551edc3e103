"""The domain tables as views of the driver's tables, and the same views in SQL.

Days run to 2024-01-31, just after the last event, so every look-back has a fixed end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatline.functions.text import keyword_key

AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def visits(spark, sf):
    nation = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("country"))
    e = read(spark, sf, "events")
    return e.join(F.broadcast(nation), e.user_id % 26 == nation.k, "left").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("ip"), F.coalesce("country", F.lit("Unknown")).alias("country"), F.col("event_type").alias("path"), "ts", F.to_date("ts").alias("date"))


def user_events(spark, sf):
    e = read(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), "event_type", F.col("props").alias("event_data"), F.col("user_id").cast("string").alias("ip"), (F.col("user_id") % 7).cast("string").alias("session_id"), F.col("event_type").alias("path"), F.lit("").alias("country"), "ts", F.to_date("ts").alias("date"))


def _turns(spark, sf):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 31).cast("int"))
    word = F.lower(F.regexp_extract("text", r"([A-Za-z]+)", 1))
    return read(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "conv_id", "turn", "role", word.alias("word"), day.alias("date"))


def searches(spark, sf):
    t = _turns(spark, sf)
    return t.filter("role = 'user'").select("id", F.col("word").alias("query"), "date")


def clicks(spark, sf):
    from pyspark.sql import Window

    t = _turns(spark, sf)
    asked = F.last(F.when(F.col("role") == "user", F.col("word")), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.withColumn("query", asked).filter("role = 'assistant' and query is not null").select("id", "query", "date")


def slots(spark, sf):
    s = read(spark, sf, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.cast("string").alias("slot_id"), F.col("s_name").alias("name"), F.when(k % 3 == 0, "all").when(k % 3 == 1, "cn").otherwise("en").alias("region"), (k % 4 != 0).alias("active"), (k % 5).cast("int").alias("sort_order"), F.when(k % 7 == 0, F.lit("2024-02-05").cast("date")).alias("start_date"), F.when(k % 11 == 0, F.lit("2024-01-15").cast("date")).alias("end_date"), F.lit("2024-01-01").cast("date").alias("created_at"))


def slot_log(spark, sf):
    """Impressions are the lines shipped, clicks those returned; days are moved into January 2024."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.day("l_shipdate").cast("int") - 1)
    line = read(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("slot_id"), day.alias("date"), F.lit("impression").alias("kind"), "l_returnflag")
    return line.drop("l_returnflag").unionByName(line.filter("l_returnflag = 'R'").select("slot_id", "date", F.lit("click").alias("kind")))


def cards(spark, sf):
    """Documents as cards, with community signals from the labels."""
    d, lab = read(spark, sf, "documents"), read(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    line = F.substring_index("text", "\n", 1)  # no need to split whole texts
    title = F.substring(line, 1, 200)
    found = F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit("([A-Za-z]{4,})"), 1), lambda w: F.lower(w)))
    words = F.transform(F.slice(found, 1, 3), keyword_key)  # the key of such a word is its lower case, and never null
    first = d.select("doc_id", F.concat(F.lit("https://h.example/"), F.col("doc_id").cast("string")).alias("url"), title.alias("title"), title.alias("title_zh"), title.alias("title_en"), F.lit("").alias("summary_zh"), F.concat(F.lit("about "), "lang").alias("summary_en"), F.concat(F.lit("d"), (F.col("doc_id") % 6).cast("string")).alias("dimension"), "source", F.when(F.col("lang") == "en", "away").otherwise("home").alias("region"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("published"), words.alias("keywords"))
    return first.join(lab, "doc_id", "left").withColumns({"hn_points": F.coalesce(F.col("q") * 12, F.lit(0)), "reddit_score": F.lit(0), "reddit_comments": F.coalesce(F.col("t"), F.lit(0))}).drop("q", "t")


def scored_cards(spark, sf):
    from heatline.operators.cards import item_cards

    return item_cards(cards(spark, sf), as_of(), "home", {"src0": 45, "src1": 40, "src2": 35, "src3": 30})


def models(spark, sf):
    p = read(spark, sf, "part")
    name = F.regexp_replace("p_name", r"\s+", "-")
    return p.select(F.concat("p_brand", F.lit("/"), name, F.when(F.col("p_partkey") % 3 == 0, "-GGUF").when(F.col("p_partkey") % 3 == 1, "-Instruct-FP8").otherwise("")).alias("full_id"), name.alias("term"), (F.col("p_size").cast("long") * 10).alias("likes"), F.col("p_partkey").cast("long").alias("downloads"), F.col("p_size").cast("long").alias("trending_score"), F.col("p_partkey").cast("long").alias("pos"))


SQL = {
    "visits": "select event_id as id, user_id::varchar as ip, coalesce(n_name, 'Unknown') as country, event_type as path, ts, ts::date as date from events left join nation on user_id % 26 = n_nationkey",
    "user_events": "select event_id as id, event_type, props as event_data, user_id::varchar as ip, ts, ts::date as date from events",
    "turns": "select conv_id * 100 + turn as id, conv_id, turn, role, lower(regexp_extract(text, '([A-Za-z]+)', 1)) as word, (date '2024-01-01' + (conv_id % 31)::int)::date as date from conversations",
    "searches": "select id, word as query, date from turns where role = 'user'",
    "clicks": "select id, query, date from (select *, last_value(case when role = 'user' then word end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as query from turns) where role = 'assistant' and query is not null",
    "slots": "select s_suppkey::varchar as slot_id, s_name as name, case s_suppkey % 3 when 0 then 'all' when 1 then 'cn' else 'en' end as region, s_suppkey % 4 <> 0 as active, (s_suppkey % 5)::int as sort_order, case when s_suppkey % 7 = 0 then date '2024-02-05' end as start_date, case when s_suppkey % 11 = 0 then date '2024-01-15' end as end_date, date '2024-01-01' as created_at from supplier",
    "slot_stats": "select l_suppkey::varchar as slot_id, (date '2024-01-01' + (day(l_shipdate) - 1)::int)::date as date, count(*) as impressions, count(*) filter (where l_returnflag = 'R') as clicks from lineitem group by all",
    "lab": "select doc_id, max(quality) as q, max(toxic) as t from labels group by doc_id",
    "cards": """select d.doc_id, 'https://h.example/' || d.doc_id as url, left(split_part(text, chr(10), 1), 200) as title, 'd' || (d.doc_id % 6) as dimension, source, lang,
      case when lang = 'en' then 'away' else 'home' end as region, (date '2024-01-01' + (d.doc_id % 30)::int)::date as published, coalesce(q * 12, 0) as hn_points, coalesce(t, 0) as reddit_comments,
      list_filter(list_transform(list_slice(list_distinct_keep(list_transform(regexp_extract_all(split_part(text, chr(10), 1), '([A-Za-z]{4,})', 1), lambda w: lower(w))), 1, 3), lambda w: w), lambda w: length(w) >= 2) as keywords
      from documents d left join lab using (doc_id)""",
    "scored": """select *, round_even(case when signal >= 1 then signal / pow(age + 2, 1.5) else weight * (1 / (ln(age / 24 + 1) + 1)) * (0.3 + 0.7 * buzz) * 100 end * 100, 0)::bigint as score,
      round_even(case when signal >= 1 then signal / pow(age + 2, 2.2) * (case when age <= 24 then 1.6 when age <= 48 then 1.2 else 1 end) else weight / (ln(age / 24 + 1) + 1) * (1 + 1.5 * exp(-age / 24 / 3)) * (1 - 0.7 * buzz) * 1000 end * 100, 0)::bigint as trend
      from (select *, hn_points * 10 + reddit_comments * 0.5::double as signal, (date_diff('day', published, date '2024-01-31') * 24)::double as age, (('0x' || left(md5(url), 8))::bigint % 1000) / 1000.0::double as buzz,
        (case when region = 'away' then 25 when source = 'src0' then 45 when source = 'src1' then 40 when source = 'src2' then 35 else 30 end)::double as weight from cards)""",
    "models": "select p_brand || '/' || regexp_replace(p_name, '\\s+', '-', 'g') || case p_partkey % 3 when 0 then '-GGUF' when 1 then '-Instruct-FP8' else '' end as full_id, regexp_replace(p_name, '\\s+', '-', 'g') as term, p_size::bigint * 10 as likes, p_partkey::bigint as downloads, p_size::bigint as trending_score, p_partkey::bigint as pos from part",
}
#: What each view is built on.
NEEDS = {"searches": ["turns"], "clicks": ["turns"], "cards": ["lab"], "scored": ["lab", "cards"]}
_DISTINCT = "list_transform(list_filter(list_zip({0}, range(1, len({0}) + 1)), lambda p: list_position({0}, p[1]) = p[2]), lambda p: p[1])"
_WORDS = "list_transform(regexp_extract_all(split_part(text, chr(10), 1), '([A-Za-z]{4,})', 1), lambda w: lower(w))"
SQL["cards"] = SQL["cards"].split("list_filter(list_transform(list_slice")[0] + f"list_slice({_DISTINCT.format(_WORDS)}, 1, 3) as keywords\n      from documents d left join lab using (doc_id)"

#: The key of text.title_key.
_MARKS = "[' || '!！?？,，.。;；:：、()（）\\[\\]【】\"“”''‘’…~～「」『』' || ']"
_TITLE_KEY = "nullif(regexp_replace(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[·・]', ' ', 'g'), '" + _MARKS + "|\\s', '', 'g'), '')"


def sql(body: str, *views: str) -> str:
    """body with the views it names in a WITH clause."""
    names = list(dict.fromkeys(n for v in views for n in [*NEEDS.get(v, []), v]))
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names) + " " + body if names else body
