"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. A session on one machine may name none, as
    in tests, and gets a temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-heatline-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


class Scratch:
    """Intermediate tables of one run, in a folder of their own. Losing an executor costs no recomputation of them, and a
    join on them sees true sizes. clear() deletes them, once what was made from them is written; what a lazy result still
    reads goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, f"{shared_dir(spark)}/heatline/{name}-{uuid.uuid4().hex}", 0
        _left[self.path] = spark

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        at = f"{self.path}/{self.count}"
        df.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def clear(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        _left.pop(self.path, None)


def written(df: DataFrame) -> DataFrame:
    """df as an intermediate table that stays until the driver ends."""
    return Scratch(df.sparkSession, "table").write(df)


@atexit.register
def _clear_all() -> None:
    for path, spark in list(_left.items()):
        with contextlib.suppress(Exception):  # the session may have ended before
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _left.pop(path, None)
