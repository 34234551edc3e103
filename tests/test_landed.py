"""Landed payloads: feeds, papers, models, boards, classifier output."""

import json

import pytest

from pyspark.sql import functions as F

from heatline.sources import landed as L
from heatline.sources import sinks, traffic

RSS = """<rss><channel>
<item><title> <![CDATA[ One &amp;amp; two - Daily Wire ]]> </title><link>https://a.b/1?x=1&amp;y=2#abs</link><pubDate>Thu, 20 Aug 2026 10:00:00 GMT</pubDate></item>
<item><title></title><link>https://a.b/2</link></item>
<item><title>No link</title></item>
<item><title>Bad</title><link>javascript:x</link></item>
<item><title>Five</title><link>https://a.b/5</link></item>
<item><title>Six</title><link>https://a.b/6</link></item>
<item><title>Seven</title><link>https://a.b/7</link></item></channel></rss>"""
ATOM = """<feed><entry><title type="html">Entry</title><link rel="x" href="https://c.d/e"/><updated>2026-08-21T01:02:03Z</updated></entry></feed>"""


def test_feeds(spark):
    raw = spark.createDataFrame([("agg", RSS, True), ("atom", ATOM, False), ("junk", "<<<", False), ("none", None, False)], "source string, body string, aggregated boolean")
    items = L.feed_items(raw)
    out = {(r.source, r.url): r for r in items.collect()}
    assert set(out) == {("agg", "https://a.b/1?x=1&y=2"), ("agg", "https://a.b/5"), ("agg", "https://a.b/6"), ("atom", "https://c.d/e")}
    one = out["agg", "https://a.b/1?x=1&y=2"]
    assert (one.title, one.label, one.published) == ("One & two", "Daily Wire", "2026-08-20")
    assert out["atom", "https://c.d/e"].published == "2026-08-21" and out["atom", "https://c.d/e"].label == "atom"
    feeds = spark.createDataFrame([("agg", 1, "away"), ("atom", 0, "home")], "source string, ord int, region string")
    twice = items.unionByName(items.filter("source = 'agg'").withColumn("source", F.lit("atom")))
    merged = L.merge_feeds(twice, feeds).collect()
    assert len(merged) == 4 and {r.region for r in merged} == {"home"}


def test_papers_and_models(spark):
    body = "<entry><title>A\n  B</title><id>http://x/1</id><published>2026-01-02T</published><name>p</name><name>q</name><name>r</name><name>s</name><category term=\"cs.LG\"/></entry><entry><title>no id</title></entry>"
    (p,) = L.papers(spark.createDataFrame([("q", body)], "query string, body string")).collect()
    assert (p.title, p.authors, p.categories, p.published) == ("A B", ["p", "q", "r"], ["cs.LG"], "2026-01-02")
    raw = spark.createDataFrame([(json.dumps({"id": "me/Name-7B", "likes": None, "tags": ["a", None, *"bcdefg"], "createdAt": "2026-01-02T03"}),), ('{"id": "solo"}',)], "j string").select(F.from_json("j", L.MODEL).alias("m")).select("m.*")
    a, b = L.model_cards(raw).collect()
    assert (a.term, a.author, a.likes, a.created_at, a.tags) == ("Name-7B", "me", 0, "2026-01-02", list("abcdef"))
    assert (b.term, b.full_id, b.author) == ("solo", "solo", "solo")


def test_boards(spark):
    bodies = {
        "baidu": json.dumps({"data": {"cards": [{"content": [{"word": "w", "hotScore": 5, "desc": "d" * 100}, {"query": "q", "url": "u"}, {"desc": "none"}]}]}}),
        "bilibili": json.dumps({"data": {"list": [{"title": "t", "bvid": "B1", "stat": {"view": 7}, "owner": {"name": "o"}, "tname": "n"}]}}),
        "toutiao": json.dumps({"data": [{"Title": "t", "HotValue": "9", "Url": "u"}]}),
        "hackernews": json.dumps([{"id": i, "title": f"s{i}", "score": i, "by": "x"} for i in range(12)]),
        "github": '<h2 class="x">\n <a class="y" href="/o/r"></a></h2><h2><a href="/o/r"></a></h2><h2><a href="/p/q"></a></h2>',
        "zhihu": json.dumps({"data": [{"detail_text": "785 万热度", "target": {"title": "t", "id": 3, "excerpt": "e"}}, {"target": {"title": ""}}]}),
        "douyin": json.dumps({"word_list": [{"word": "a b", "hot_value": 3}]}),
        "weibo": json.dumps({"data": {"cards": [{"card_group": [{"desc": ""}]}]}}),
    }
    raw = spark.createDataFrame([(s, b) for s, b in bodies.items()], "source string, body string").withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    out = {}
    for r in L.boards(raw).orderBy("source", "pos").collect():
        out.setdefault(r.source, []).append((r.title, r.hot, r.url, r.extra))
    assert out["baidu"] == [("w", "5", "https://www.baidu.com/s?wd=w", "d" * 80), ("q", None, "u", "")]
    assert out["bilibili"] == [("t", "7", "https://www.bilibili.com/video/B1", "UP: o · n")]
    assert [t for t, *_ in out["hackernews"]] == [f"s{i}" for i in range(9, -1, -1)]
    assert [t for t, *_ in out["github"]] == ["o/r", "p/q"] and out["zhihu"] == [("t", "785", "https://www.zhihu.com/question/3", "e")]
    assert out["douyin"][0][2].endswith("a%20b") and "weibo" not in out and out["toutiao"][0][1] == "9"
    status = {r.source: (r.ok, r.n) for r in L.board_status(raw).collect()}
    assert status["weibo"] == (False, 0) and status["hackernews"] == (True, 10) and len(status) == 8


def test_classified(spark):
    text = 'sure: [{"idx": 1, "dimension": "d", "title_zh": "z", "keywords": ["k"]}, [2, "e", "a", "b", "c", "d", ["x", "y"]], [3, "short"], {"dimension": "no idx"}] ok'
    out = {r.idx: r for r in L.classified(spark.createDataFrame([(7, text), (8, "nothing"), (9, "[broken")], "batch_id long, text string")).collect()}
    assert set(out) == {1, 2} and out[1].keywords == ["k"] and (out[2].dimension, out[2].summary_en, out[2].keywords) == ("e", "d", ["x", "y"])


def test_posts(spark):
    body = json.dumps({"data": {"children": [{"data": {"score": 3, "num_comments": 9}}, {"data": {"score": 5}}]}})
    out = {r.url: (r.reddit_score, r.reddit_comments) for r in L.best_posts(spark.createDataFrame([("u", body), ("v", "{}")], "url string, body string")).collect()}
    assert out == {"u": (5, 9), "v": (0, 0)}
    hits = json.dumps({"hits": [{"points": 4, "url": "h", "title": "t"}]})
    assert L.hn_hits(spark.createDataFrame([("u", "t", hits)], "url string, title string, body string")).first().points == 4


def test_event_ingest(spark):
    raw = spark.createDataFrame([([("click", "x" * 3000), ("evil", "y"), *[("search", "z")] * 60], "", "s" * 99)], "events array<struct<event_type:string,event_data:string>>, country string, session_id string").withColumn("path", F.lit(None).cast("string"))
    out = traffic.event_batches(raw).collect()
    assert len(out) == 49 and len(out[0].event_data) == 2000 and len(out[0].session_id) == 64 and out[0].country == "Unknown" and out[0].path == ""
    s = traffic.searches(spark.createDataFrame([("  a{b}",), (" " + "q" * 99,), (None,), ("　",)], "query string").withColumn("country", F.lit(None).cast("string"))).collect()
    assert [(r.query, r.country) for r in s] == [("q" * 80, "Unknown")]


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert sinks.latest(spark, path) is None
    assert sinks.publish(spark.range(3), path) == 1 and sinks.publish(spark.range(5), path) == 2
    (tmp_path / "t" / "v3").mkdir()  # a version that was begun only
    assert sinks.versions(spark, path) == [1, 2] and sinks.latest(spark, path).count() == 5
    snaps = spark.createDataFrame([("a", "2024-01-01-08", 1), ("a", "2024-01-02-08", 2)], "term string, cycle string, n int")
    sinks.put_cycle(snaps, f"{tmp_path}/s")
    sinks.put_cycle(snaps.filter("n = 2").withColumn("n", F.lit(9)), f"{tmp_path}/s")
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/s").collect()) == [1, 9]
    sinks.write_board(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, hot double"), f"{tmp_path}/b", 1)
    assert spark.read.json(f"{tmp_path}/b").first().id == "b"


def test_glossary_file(spark, tmp_path):
    from heatline.functions import lexicon as L

    (tmp_path / "g.json").write_text(json.dumps({"_note": ["x"], "deep-sea": ["deep sea", "深海"], "ice": []}), encoding="utf-8")
    rows = {(r.canon, r.surface, r.ord, r.is_ascii) for r in L.load(spark, str(tmp_path / "g.json")).collect()}
    assert rows == {("deep-sea", "deep-sea", 0, True), ("deep-sea", "deep sea", 1, True), ("deep-sea", "深海", 2, False), ("ice", "ice", 0, True)}


def test_cycles_are_read_by_day(spark, tmp_path):
    """A look at one day reads that day's folder only, and a batch replaces its own days."""
    from heatline.sources import sinks

    snaps = lambda n: spark.createDataFrame([("a", f"2024-01-0{d}-08", n) for d in (1, 2, 3)], "term string, cycle string, news_cnt int")
    sinks.put_cycle(snaps(1), f"{tmp_path}/s")
    sinks.put_cycle(snaps(2).filter("cycle like '2024-01-02%'"), f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert {(r.cycle, r.news_cnt) for r in back.collect()} == {("2024-01-01-08", 1), ("2024-01-02-08", 2), ("2024-01-03-08", 1)}
    one = back.filter("cycle_date = date '2024-01-02'")
    assert "PartitionFilters: [isnotnull(cycle_date" in one._jdf.queryExecution().toString() and one.count() == 1


def test_pool_and_top_sinks(spark, tmp_path):
    from heatline.sources import sinks

    rows = spark.createDataFrame([("u1", "t", "s", "d1", 3), ("u2", "t", "s", "d2", 5)], "url string, title string, summary string, dimension string, score int")
    assert sinks.publish_pool(rows, f"{tmp_path}/pool") == 1
    pool = sinks.latest(spark, f"{tmp_path}/pool")
    assert set(pool.columns) == {"url", "dimension", "score"} and pool.filter("dimension = 'd2'").first().url == "u2"
    assert sinks.publish_tops(rows.withColumn("rank", F.lit(1)), f"{tmp_path}/tops") == 1 and sinks.latest(spark, f"{tmp_path}/tops").count() == 2


def test_damaged_glossary_files_are_reported(spark, tmp_path):
    from heatline.functions import lexicon as L

    files = {"a.json": '{"deep-sea": ["deep sea"]}', "b.json": '{"ice": ["i', "c.json": " ", "d.json": "[1]"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    told = {r.file.split("/")[-1]: r.problem for r in L.glossary(spark, str(tmp_path)).collect()}
    assert told == {"a.json": None, "b.json": "no JSON object of lists", "c.json": "empty file", "d.json": "no JSON object of lists"}
    assert {r.canon for r in L.load(spark, str(tmp_path)).collect()} == {"deep-sea"}


def test_commits_of_several_tables(spark, tmp_path):
    """Readers see the tables of one commit, whatever dies in between; parts that a commit doesn't touch stay where they are."""
    from heatline.sources import store

    path = f"{tmp_path}/s"
    rows = lambda *xs: spark.createDataFrame(list(xs), "k string, v int")
    see = lambda name, at=None: sorted(map(tuple, store.table(spark, path, at or store.newest(spark, path), name).collect()))
    one = store.Commit(spark, path)
    one.put("a", rows(("x", 1)))
    one.put_parts("b", rows(("p", 1), ("q", 1), (None, 1)).withColumn("_k", F.col("k")), "_k")
    assert store.newest(spark, path).number == 0 and store.table(spark, path, store.newest(spark, path), "a") is None
    one.publish(batch=1)
    pinned = store.newest(spark, path)
    died = store.Commit(spark, path)  # dies after its first table
    died.put("a", rows(("x", 99)))
    assert see("a") == [("x", 1)]
    two = store.Commit(spark, path)
    two.put("a", rows(("x", 2)))
    two.put_parts("b", rows(("q", 2), ("r", 2)).withColumn("_k", F.col("k")), "_k")
    two.publish(batch=2)
    assert see("a") == [("x", 2)] and see("a", pinned) == [("x", 1)]
    assert sorted(map(str, store.table(spark, path, store.newest(spark, path), "b").collect())) == sorted(map(str, rows(("p", 1), (None, 1), ("q", 2), ("r", 2)).collect()))
    assert store.newest(spark, path).tables["b"]["parts"]["p"] == pinned.tables["b"]["parts"]["p"]
    with pytest.raises(RuntimeError):  # begun before the second commit
        died.publish(batch=9)
    store.retire(spark, path, keep=1)
    assert store.numbers(spark, path) == [2] and see("a") == [("x", 2)]
    assert len(list((tmp_path / "s" / "a").iterdir())) == 1  # the dead writer's folder is gone
    three = store.Commit(spark, path)
    three.put_parts("b", rows().withColumn("_k", F.col("k")), "_k", keep=False)
    three.publish()
    assert see("b") == [] and store.newest(spark, path).notes == {}


def test_every_landed_line_is_accepted_or_rejected(spark):
    line = json.dumps
    day = "2024-01-03T10:00:00"
    lines = [line({"ip": "1", "country": "", "ts": day}), line({"ip": "", "ts": day}), "{broken", "", None, line({"ip": 5, "ts": "never"}), "[]"]
    out = traffic.judged(spark.createDataFrame([(x,) for x in lines], "value string"), "visits", "ip string, country string, ts timestamp").collect()
    assert sorted((r.status, r.reason) for r in out) == [("accepted", None), *[("rejected", "malformed")] * 5, ("rejected", "no ip")]
    assert all((r.raw is None) == (r.status == "accepted") for r in out) and {r.country for r in out if r.ip == "1"} == {"Unknown"}
    batch = {"session_id": "s", "path": "/", "country": None, "ts": day, "events": [{"event_type": "click", "event_data": "{}"}] * 60 + [{"event_type": "hack"}]}
    shape = "session_id string, path string, country string, ts timestamp, events array<struct<event_type string, event_data string>>"
    out = traffic.judged(spark.createDataFrame([(line(batch),), (line(batch | {"events": []}),)], "value string"), "batches", shape).groupBy("status", "reason").count().collect()
    assert {(r.status, r.reason, r["count"]) for r in out} == {("accepted", None, 50), ("rejected", "over the batch's limit", 11), ("rejected", "no events", 1)}
    kept = traffic.event_batches(spark.createDataFrame([batch | {"ts": None}], shape)).count()
    assert kept == 50
