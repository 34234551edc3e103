"""Small dictionary tables: canonical terms with their spellings, and the lists that go with them.

The seed rows are this project's own; load() takes a fuller glossary from JSON. All tables are dimension tables of
bounded size, joined with a broadcast hint only where load() has checked the size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: canonical term -> spellings
SEED = {
    "machine-learning": ["machine learning", "机器学习"],
    "large-language-model": ["large language model", "大语言模型"],
    "open-source": ["open source", "开源"],
    "speech-recognition": ["speech recognition", "语音识别"],
    "self-driving": ["self driving", "autonomous driving", "自动驾驶"],
    "robotics": ["robotics", "robot", "机器人"],
    "quantum": ["quantum computing", "量子"],
    "apache-spark": ["apache spark", "spark"],
}
STOPWORDS = ["ai", "model", "news", "data", "tech", "report", "the", "and"]
MEDIA = ["daily-wire", "tech-weekly", "news-desk"]
# How abbreviations are written.
ACRONYMS = {x.lower(): x for x in "API AR AWS CD CI CLI CNN CSS CV DevOps DL GAN GCP GPU gRPC HF HTML HTTP HTTPS IaaS IDE IoT JSON ML MR NLP NoSQL NPU OSS PaaS REST RL RNN SaaS SDK SQL TPU UI URL VR XR YAML".split()}
#: Rows up to which a dictionary is broadcast.
SMALL = 100_000


def listed(spark: SparkSession, rows: list[tuple], shape: str) -> DataFrame:
    """Few rows of the program as a table. They come as one Arrow table, which the plan holds as literal rows; a list of
    tuples would start Python workers in every stage that reads it."""
    fields = [f.split(maxsplit=1) for f in shape.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields]))


def load(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(canon, surface, ord, is_ascii, no): a glossary file is one JSON object canon -> [surfaces]; keys with _ are comments.
    no is the place of the term in the dictionary, ord that of the spelling within the term."""
    if path:
        raw = glossary(spark, path).filter("problem is null").select(F.posexplode("terms").alias("no", "canon", "forms"))
        raw = raw.filter(~F.col("canon").startswith("_"))
    else:
        raw = listed(spark, [(i, *kv) for i, kv in enumerate(SEED.items())], "no int, canon string, forms array<string>")
    return spelled(raw)


def spelled(terms: DataFrame) -> DataFrame:
    """terms(no, canon, forms) -> (canon, surface, ord, is_ascii, no)."""
    rows = terms.select("no", "canon", F.posexplode(F.array_distinct(F.array_union(F.array("canon"), F.col("forms")))).alias("ord", "surface"))
    return rows.select("canon", "surface", "ord", F.col("surface").rlike(r"^[\x00-\x7F]+$").alias("is_ascii"), "no")


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """(file, terms map<string,array<string>>, problem): each file of a glossary, read whole. problem says why a file gives
    no terms, so a damaged one is reported and not lost: load() takes the others."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "map<string,array<string>>").alias("terms"), "value")
    problem = F.when(F.trim("value") == "", "empty file").when(F.col("terms").isNull(), "no JSON object of lists")
    return raw.select("file", "terms", problem.alias("problem"))


def fits(df: DataFrame) -> bool:
    """Whether df has SMALL rows at most; only a count comes to the driver."""
    return df.select(F.lit(1)).limit(SMALL + 1).count() <= SMALL


def small(df: DataFrame, known: bool | None = None) -> DataFrame:
    """df with a broadcast hint if it fits, and with a merge hint beyond. known: what fits() told of it before."""
    return df.hint("broadcast" if (fits(df) if known is None else known) else "merge")


def governed(lexicon: DataFrame) -> DataFrame:
    """(canon): terms whose name the dictionary or the list of abbreviations rules."""
    short = listed(lexicon.sparkSession, [(x,) for x in ACRONYMS.values()], "canon string")
    return lexicon.select("canon").union(short).distinct()


def aliases(lexicon: DataFrame) -> DataFrame:
    """(alias, canon), one row for each normalised spelling; the first canonical in order wins."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim("surface")), r"[\s_]+", "-"), "^-+|-+$", "")
    return lexicon.select(key.alias("alias"), "canon", "ord").groupBy("alias").agg(F.min(F.struct("ord", "canon")).alias("x")).select("alias", F.col("x.canon").alias("canon"))


def canonical(words: DataFrame, lexicon: DataFrame, column: str = "word") -> DataFrame:
    """words(column) -> (column, canon) for the distinct words; canon is null where a word is no term.

    The rule works on distinct words, so the dictionary joins see each once; callers join the result back."""
    shaped = words.select(column).distinct()
    t = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(F.col(column), r"(?U)\A\s+|\s+\z", "")), r"(?U)[\s_]+", "-"), r"-{2,}", "-")
    shaped = shaped.withColumn("t", F.regexp_replace(t, r"\A[\p{Punct}]+|[\p{Punct}]+\z", ""))
    shaped = shaped.withColumn("one", F.when(F.col("t").rlike(r"^[\x00-\x7F]{4,}$") & F.col("t").endswith("s") & ~F.col("t").endswith("ss"), F.substring("t", F.lit(1), F.length("t") - 1)))
    table = aliases(lexicon)
    fit = fits(lexicon)  # aliases and governed terms have no more rows
    own = lambda key, to: small(table.select(F.col("alias").alias(key), F.col("canon").alias(to)), fit)
    met = shaped.join(own("t", "a"), "t", "left").join(own("one", "b"), "one", "left")
    found = F.coalesce("a", "b", "t")
    met = met.select(column, F.when((F.length(found) >= 2) & ~found.rlike("^[0-9]+$"), found).alias("c"))
    met = met.withColumn("c", F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ACRONYMS.items() for x in kv)), "c"), "c"))
    # a hyphen variant of a term that the dictionary governs folds into it
    ruled = governed(lexicon).select(F.col("canon").alias("compact"), F.col("canon").alias("folded"))
    met = met.withColumn("compact", F.when(F.col("c").contains("-") & F.col("c").rlike(r"^[\x00-\x7F]+$"), F.replace("c", F.lit("-"), F.lit(""))))
    return met.join(small(ruled, fit), "compact", "left").select(column, F.coalesce("folded", "c").alias("canon"))
