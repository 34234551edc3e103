"""A training corpus from raw documents: quality, repeated lines, near-duplicates, leaked benchmarks, packing.

Each stage is one operator over all that the one before kept, and is written as Parquet before the next begins.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any
name, and keeps the columns as they are (but for the last, which gives pieces). A null text counts as an empty one and
stays null. Rows with a null doc_id are judged by their text, are copies of no other document, and stay if it does. Of
rows that repeat an id, near_dedup keeps or drops all together. The stage after an empty one gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatline.llm import copies, leaks, lines, packing, quality
from heatline.llm.common import delete, owned, shared_dir, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts, and n_chars follows; the documents stay."""
    made = lines.dedup(docs, from_files=True, count_col=None)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, similarity 0.8) the document with the smallest id stays: SimHash
    groups by covering LSH, and an exact join for the pairs that those leave."""
    found = copies.near_duplicates(docs)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.hint("merge").join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids."""
    return packing.pack(docs)


STAGES = [("quality", keep_good), ("line_dedup", drop_lines), ("near_dedup", drop_copies), ("decontaminate", drop_leaks), ("pack", pack)]

#: SQL can't express the classifier or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, top = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/heatline/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        with owned():  # what the stage's plan reads goes when the stage is written
            stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
        if k:
            delete(spark, f"{top}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
