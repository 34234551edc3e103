"""Queries against their SQL on small tables with rows that the driver's smallest tables lack."""

import datetime
import importlib

import pytest

duckdb = pytest.importorskip("duckdb")


def differences(spark, folder, name):
    """Rows of the query that its SQL doesn't have, and the reverse."""
    entry = importlib.import_module("__spark_entry__")
    rows = entry.queries()[name](spark, str(folder))
    with duckdb.connect() as con:
        con.execute("set timezone = 'UTC'")
        for f in folder.iterdir():
            con.execute(f"create view {f.stem} as from read_parquet('{f}/*.parquet')")
        asked = con.execute(f"select {', '.join(rows.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    made = [tuple(r) for r in rows.collect()]
    assert made
    return [r for r in made if r not in asked], [r for r in asked if r not in made]


def documents(spark, folder, texts):
    spark.createDataFrame([(i, t, "de", f"src{i % 4}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")


def test_feed_items_without_a_plain_title(spark, tmp_path):
    """document 2 is in an aggregated feed and has no plain title."""
    documents(spark, tmp_path, ["One\nx", "!!", "é!", "Four", "", None, "Seven", "", None])
    assert differences(spark, tmp_path, "s1_s2_c17_feed_items") == ([], [])


@pytest.mark.parametrize("name", ["w4_top_news", "t9_term_news", "p10_profiles"])
def test_titles_that_differ_in_sharp_s(spark, tmp_path, name):
    """ß and its capitals SS are one title, so only the better card of 0 and 1 stands."""
    documents(spark, tmp_path, ["Lange straße hier", "LANGE STRASSE HIER", "Lange wege", "Andere straße"])
    spark.createDataFrame([(0, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "lange red", "Brand#1", 3)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert differences(spark, tmp_path, name) == ([], [])
