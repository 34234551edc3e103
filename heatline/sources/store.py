"""Several tables that change together: one manifest names the folders of all of them, and is published by one rename.

A commit writes the new folders beside the old ones and then the manifest `_manifests/<number>.json`. Readers take the
newest manifest and pin it: whatever is written later, they see the tables of one commit. A job that dies between two
writes leaves folders that no manifest names, which retire() deletes. A table is a set of parts (buckets, days, cycles),
each a folder; a commit replaces the parts it has anew and keeps the others as they are, so its cost is that of the parts it
touches. A manifest holds one line for each part, and parts are bounded by the layout (buckets) or by the calendar.

Renames are atomic on HDFS and local disks. On an object store a rename copies one small object, which readers see whole
or not at all. There must be one writer; two that commit the same number at once don't both succeed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heatline.sources.sinks import _fs


@dataclass
class Manifest:
    """The tables of one commit: for each the schema and the folder of each part, relative to the store."""

    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)
    #: What the writer notes of the commit, such as its batch and cycle.
    notes: dict = field(default_factory=dict)


def _read(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests, oldest first."""
    fs, at, jvm = _fs(spark, f"{path}/_manifests")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def newest(spark: SparkSession, path: str) -> Manifest:
    """The newest commit; number 0 without tables if there is none."""
    found = numbers(spark, path)
    return manifest(spark, path, found[-1]) if found else Manifest()


def manifest(spark: SparkSession, path: str, number: int) -> Manifest:
    return Manifest(**json.loads(_read(spark, f"{path}/_manifests/{number:012d}.json")))


def table(spark: SparkSession, path: str, at: Manifest, name: str, parts: list[str] | None = None) -> DataFrame | None:
    """A table (or some of its parts) as of a commit; None if the commit doesn't have it."""
    if name not in at.tables:
        return None
    known, shape = at.tables[name]["parts"], StructType.fromJson(at.tables[name]["schema"])
    folders = [f"{path}/{folder}" for part, folder in known.items() if parts is None or part in parts]
    return spark.read.schema(shape).parquet(*folders) if folders else spark.createDataFrame([], shape)


class Commit:
    """Collects the new folders of a commit: put() writes a table, publish() makes all of them visible at once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.before = spark, path, newest(spark, path)
        self.next = Manifest(self.before.number + 1, {k: {"schema": v["schema"], "parts": dict(v["parts"])} for k, v in self.before.tables.items()})
        self.run = uuid.uuid4().hex[:12]

    def put(self, name: str, df: DataFrame, part: str = "all") -> None:
        """Writes df as one part of the table, in place of what that part was."""
        folder = f"{name}/v{self.next.number}-{self.run}/{len(self.next.tables.get(name, {}).get('parts', {}))}"
        df.write.parquet(f"{self.path}/{folder}")
        self._enter(name, df.schema, {part: folder})

    def put_parts(self, name: str, df: DataFrame, by: str, keep: bool = True) -> None:
        """Writes df with a part for each value of the column by (which is no longer a column of the table). Parts that df
        has no rows of stay as they were, or go with keep=False. One shuffle, on the column."""
        rest = df.drop(by)
        folder = f"{name}/v{self.next.number}-{self.run}/parts"
        df.withColumn("_part", F.col(by).cast("string")).drop(by).repartition("_part").write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        fs, at, _ = _fs(self.spark, f"{self.path}/{folder}")
        found = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
        if not keep and name in self.next.tables:
            self.next.tables[name]["parts"] = {}
        self._enter(name, rest.schema, {n.split("=", 1)[1]: f"{folder}/{n}" for n in found})

    def drop_parts(self, name: str, parts: list[str]) -> None:
        for part in parts:
            self.next.tables.get(name, {"parts": {}})["parts"].pop(part, None)

    def _enter(self, name: str, shape: StructType, parts: dict[str, str]) -> None:
        entry = self.next.tables.setdefault(name, {"parts": {}})
        entry["schema"] = json.loads(shape.json())
        entry["parts"] |= parts

    def publish(self, **notes) -> Manifest:
        self.next.notes = notes
        fs, at, jvm = _fs(self.spark, f"{self.path}/_manifests/{self.next.number:012d}.json")
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifests/.{self.run}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(self.next.__dict__), "utf-8"))
        finally:
            out.close()
        if fs.exists(at) or not fs.rename(draft, at):
            raise RuntimeError(f"{self.path}: another writer has made commit {self.next.number}")
        return self.next


def retire(spark: SparkSession, path: str, keep: int = 3) -> None:
    """Deletes manifests but the newest `keep`, and folders that none of these names. Readers that pinned an older commit
    lose it, and so does a commit under way: call it from the writer, after a commit."""
    found = numbers(spark, path)
    fs, _, jvm = _fs(spark, path)
    hadoop = jvm.org.apache.hadoop.fs.Path
    kept = [manifest(spark, path, n) for n in found[-keep:]]
    for n in found[:-keep]:
        fs.delete(hadoop(f"{path}/_manifests/{n:012d}.json"), False)
    used = {folder for m in kept for t in m.tables.values() for folder in t["parts"].values()}
    runs = {"/".join(folder.split("/")[:2]) for folder in used}
    for name in {t for m in kept for t in m.tables} | {s.getPath().getName() for s in fs.listStatus(hadoop(path)) if s.isDirectory() and s.getPath().getName()[:1] != "_"}:
        at = hadoop(f"{path}/{name}")
        for run in fs.listStatus(at) if fs.exists(at) else []:
            where = f"{name}/{run.getPath().getName()}"
            if where not in runs:
                fs.delete(run.getPath(), True)
            elif fs.exists(hadoop(run.getPath(), "parts")):
                for part in fs.listStatus(hadoop(run.getPath(), "parts")):
                    if part.isDirectory() and f"{where}/parts/{part.getPath().getName()}" not in used:
                        fs.delete(part.getPath(), True)
