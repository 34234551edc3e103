"""Classifier output back onto its items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatline.functions.text import blank_to_null, is_mixed, strip, strip_source_suffix


def apply_classified(items: DataFrame, made: DataFrame, dimensions: list[str], words: int = 3) -> DataFrame:
    """items(batch_id, idx, title, lang, default_dim) with made(batch_id, idx, ...) -> titles and summaries in both
    languages, dimension, keywords, and whether the output was accepted.

    Output counts if the slots of the foreign language are there and in that language. The native title stays the feed's.
    An unknown dimension becomes the default; rejected rows keep their title in both slots and no summary."""
    met = items.hint("merge").join(made, ["batch_id", "idx"], "left")
    zh = F.col("lang") == "zh"
    foreign = lambda c: F.when(zh, F.col(f"{c}_en")).otherwise(F.col(f"{c}_zh"))
    missing = (F.coalesce(strip(foreign("title")), F.lit("")) == "") | (F.coalesce(strip(foreign("summary")), F.lit("")) == "")
    ok = ~missing & ~is_mixed(foreign("title"), F.col("lang")) & ~F.coalesce(zh & is_mixed(foreign("summary"), F.col("lang")), F.lit(False))
    title = lambda c, native: F.when(native | ~ok, F.col("title")).otherwise(F.substring(strip_source_suffix(F.col(c)), 1, 200))
    text = lambda c, n: F.when(ok, F.substring(F.coalesce(blank_to_null(strip(F.col(c))), F.lit("")), 1, n)).otherwise("")
    out = met.withColumn("accepted", ok)
    return out.select("batch_id", "idx", "title", "lang", "accepted", F.when(ok & F.col("dimension").isin(dimensions), F.col("dimension")).otherwise(F.col("default_dim")).alias("dimension"), title("title_zh", zh).alias("title_zh"), title("title_en", ~zh).alias("title_en"), text("summary_zh", 60).alias("summary_zh"), text("summary_en", 80).alias("summary_en"), F.when(ok, F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, words)).otherwise(F.array().cast("array<string>")).alias("keywords"))


def rejected(applied: DataFrame) -> DataFrame:
    """Items for the next round of the classifier."""
    return applied.filter(~F.col("accepted")).select("batch_id", "idx", "title", "lang")
