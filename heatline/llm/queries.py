"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatline.llm import bpe, brown, chat, divergence, leaks, licences, lines, packing, pii, quality, runs, simhash, topk
from heatline.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    both = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    rows = turns.unionByName(extra).withColumn("parts", chat.text_part(F.col("text")))
    made = chat.format_chats(rows).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.masked(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "expanded_tokens")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"), from_files=True).select("doc_id", "text", F.col("n_dropped").cast("long"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontaminate, op2_pii, op3_brown, op4_chat, op5_simhash, op6_packing, op7_topk, op8_licences, op9_lines, op10_quality, op11_divergence, op12_bpe, op13_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": OP4, "op7_topk": OP7, "op11_divergence": OP11}


#: The turns and loss digests follow from the input alone; what the template makes of them is counted from its rules.
OP4 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, length(role) + length(text) + 23
    + len(regexp_extract_all(role, '(<|\[)\\*(/?s>|/?INST\]|\|[A-Za-z_]+(:[0-9]+)?\|>)'))
    + len(regexp_extract_all(text, '(<|\[)\\*(/?s>|/?INST\]|\|[A-Za-z_]+(:[0-9]+)?\|>)')) as n from turns
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(n)::bigint as formatted_chars, 0::bigint as expanded_tokens
from sized group by conv_id
"""

OP7 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""

OP11 = r"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, row_number() over () as id from documents
), w as (
  select lang, source, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), kept as (
  select lang, term, count(*) as total from w group by lang, term having count(distinct id) >= 3
), langs as (
  select lang, count(*) as v, sum(total) as n from kept group by lang
), c as (
  select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by lang, source, term
), g as (
  select lang, source, coalesce(sum(n), 0) as n from (select distinct lang, source from d) left join c using (lang, source) group by lang, source
), p as (
  select lang, source, term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.n::hugeint + v) as p,
    1 + (1000000000::hugeint * (total + 1)) // (langs.n::hugeint + v) as q
  from g join langs using (lang) join kept using (lang) left join c using (lang, source, term)
), pairs as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source
), every as (
  select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
), terms as (
  select lang, source, term as item, (((p - q) * (p - q)) // q)::bigint as value from p where n > 0 and p > q
), ranked as (
  select lang, source, 'pair' as part, item, value from every union all select lang, source, 'term', item, value from terms
)
select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from ranked
qualify part = 'pair' or rank <= 200
"""
