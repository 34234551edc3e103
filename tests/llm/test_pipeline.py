"""The pipeline's stages, each against brute force on what it was given."""

import importlib

from pyspark.sql import functions as F

from heatline.llm import leaks, quality
from heatline.llm.common import table


def test_stages(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    kept = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        made = spark.read.parquet(f"{tmp_path}/{k}")
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        if k < 4:
            assert made.columns == docs.columns and made.count() == made.select("doc_id").distinct().count()
            after = {r.doc_id: r.text for r in made.select("doc_id", "text").collect()}
            assert set(after) <= set(before)
        if name == "quality":
            accepted = {r.doc_id for r in quality.score(docs, table(spark, sf, "labels")).filter("predicted = 1").collect()}
            assert set(after) == accepted and 0.5 < len(after) / len(before) < 1
        if name == "line_dedup":
            seen = set()
            for d in sorted(after):  # every line left is new, and every first line that is not near another is left
                own = [" ".join(x.split()) for x in after[d].split("\n") if x.split()]
                assert not seen & set(own)
                seen |= set(own)
            assert all(r.n_chars == len(r.text) for r in made.collect())
        if name == "near_dedup":
            assert min(before) in after
        if name == "decontaminate":
            items = leaks.Items([(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()])
            assert set(after) == {d for d, t in before.items() if not items.find(t)}
        kept.append(made.count())
        docs = made
    pieces = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(pieces) == kept[3] and all(r.n == r.m for r in pieces)
    assert kept[0] == kept[1] >= kept[2] >= kept[3]


def test_run(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def odd_documents():
    """Nulls in each column, empty and very long texts, ties, repeated rows, and columns named as the stages name theirs."""
    good = "This is a fine text of several words that reads well, and it goes on for a while. " * 8
    rows = [(i, f"{good}\nnumber {i} of the texts has its own line with words w{i} x{i} y{i} z{i}", "en", "src", 10, "a", i, "b") for i in range(30)]
    rows += [(None, good, None, None, None, None, None, None), (40, None, "en", "s", 0, "a", 1, "b"), (41, "", "en", "s", 0, None, None, None), (3, rows[3][1], "en", "src", 10, "a", 3, "b")]
    return [*rows, (50, "long " * 200_000, "de", "s", 1, "a", 1, "b"), (51, "line of five words here\n" * 40_000, "de", "s", 1, "a", 1, "b")]


ODD = "doc_id long, text string, lang string, source string, n_chars long, n_dropped string, f long, component_id string"


def test_stages_on_odd_rows(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame(odd_documents(), ODD)
    docs.write.parquet(f"{tmp_path}/d")
    for given in (docs, spark.read.parquet(f"{tmp_path}/d"), docs.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, given, sf)
            if name == "pack":
                assert out.select("doc_id").distinct().count() == given.select("doc_id").distinct().count()
                continue
            assert out.columns == given.columns, name
            rows = {(r.doc_id, r.text) for r in out.collect()}
            if name == "line_dedup" and rows:
                assert len(rows) >= 34 and (40, None) in rows and (51, "line of five words here") in {(d, t.split("\n")[0]) for d, t in rows if t}
            if name == "near_dedup" and rows:
                assert {40, None} <= {d for d, _ in rows} and 41 not in {d for d, _ in rows}
            if name == "decontaminate":
                assert len(rows) == given.distinct().count()
