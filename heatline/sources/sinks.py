"""Tables on plain Parquet: versions in directories of their own, and the newest whole one is read.

A version is complete once Spark's commit marker (_SUCCESS) is in it, so a failed job leaves nothing that a reader takes.
Everything goes through Hadoop's file system API, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at, jvm


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions, oldest first."""
    fs, at, jvm = _fs(spark, path)
    if not fs.exists(at):
        return []
    names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(int(n[1:]) for n, p in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> int:
    """Writes df as the next version and returns its number."""
    spark = df.sparkSession
    n = max(versions(spark, path), default=0) + 1
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/v{n}")
    return n


def publish_once(spark: SparkSession, path: str, number: int, make) -> None:
    """Writes make() as version `number`, unless that version or a later one is whole already."""
    if max(versions(spark, path), default=0) < number:
        make().write.mode("overwrite").parquet(f"{path}/v{number}")


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/v{found[-1]}") if found else None


def put_cycle(snapshots: DataFrame, path: str) -> None:
    """Snapshots by day of their cycle; the days of this batch replace those stored."""
    day = snapshots.withColumn("cycle_date", F.substring("cycle", 1, 10))
    day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cycle_date").parquet(path)


def write_board(words: DataFrame, path: str, n: int = 200) -> None:
    """The n hottest words as one ranked file."""
    words.orderBy(F.desc("hot"), "id").limit(n).coalesce(1).write.mode("overwrite").json(path)


def publish_pool(cards: DataFrame, path: str) -> int:
    """The neutral pool: cards without the columns that depend on a reader's language, by dimension."""
    return publish(cards.drop("title", "summary"), path, ("dimension",))


def publish_tops(ranked: DataFrame, path: str) -> int:
    """The first cards of each dimension, as top_per_dimension() ranks them, in a folder for each."""
    return publish(ranked, path, ("dimension",))
