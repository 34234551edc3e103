"""What the corpus operators share: reading tables, and intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the end of a paragraph of words is split at: ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_left: dict[str, SparkSession] = {}
_owner: contextvars.ContextVar[list | None] = contextvars.ContextVar("owner", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Intermediate tables of one run, in a folder of their own. Losing an executor costs no recomputation of them, and a
    join on them sees true sizes. Shuffle files of a write go when it ends, and a table when drop() names it; the tables
    that a lazy result still reads go with owned(), or when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/heatline/{name}-{uuid.uuid4().hex}"
        _left[self.path] = spark
        if (mine := _owner.get()) is not None:
            mine.append(self.path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        was = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        finally:
            self.spark.conf.set(_CLEANUP, was)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.path}/{name}")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    if not path.startswith(f"{shared_dir(spark)}/heatline/"):
        raise ValueError(f"{path} is not an intermediate table")
    _delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as an intermediate table of its own."""
    return Scratch(df.sparkSession, name).write(df, "table")


@contextlib.contextmanager
def owned() -> Iterator[None]:
    """Deletes at its end the intermediate tables of the runs that were begun inside it, and of no others: for a caller who
    writes their results inside."""
    mine: list[str] = []
    token = _owner.set(mine)
    try:
        yield
    finally:
        _owner.reset(token)
        _drop_runs(mine)


def _drop_runs(paths: list[str]) -> None:
    for path in paths:
        spark = _left.pop(path, None)
        with contextlib.suppress(Exception):  # the session may have ended before
            if spark:
                _delete(spark, path)


@atexit.register
def clear() -> None:
    """Deletes the intermediate tables of all runs so far."""
    _drop_runs(list(_left))


def fold(key: Column, parts: int) -> Column:
    """The fold of a row: crc32 of its key as text, modulo parts; null stays null."""
    return F.crc32(key.cast("string")) % parts
