"""Traffic operators and their streaming twins."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from heatline.operators import traffic as T
from heatline.streaming import traffic as S



def as_of():
    return F.lit("2024-01-31").cast("timestamp")



def brute_limit(times, limit, window):
    start, n, out = None, 0, []
    for t in sorted(times):
        if start is None or t - start >= window:
            start, n = t, 1
            out.append((t, True, 0))
        elif n >= limit:
            out.append((t, False, max(1, int(window - (t - start)) + 1)))
        else:
            n += 1
            out.append((t, True, 0))
    return out


def hits(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    times = {"a": [0, 1, 2, 3, 59, 60, 61, 62, 63], "b": [5, 200], "": [1, 1, 1, 1, 1]}
    return times, spark.createDataFrame([("e", k, at(s)) for k, v in times.items() for s in v], "bucket string, key string, ts timestamp")


def test_rate_limit(spark):
    times, df = hits(spark)
    base = datetime.datetime(2024, 1, 1)
    out = {}
    for r in T.rate_limit(df, 3).collect():
        out.setdefault(r.key, []).append(((r.ts - base).total_seconds(), r.allowed, r.retry_after))
    for k in ("a", "b"):
        assert sorted(out[k]) == brute_limit(times[k], 3, 60)
    assert all(ok for _, ok, _ in out[""])
    assert T.rate_limit(df, 0).filter("not allowed").count() == 0


def land(spark, tmp_path, df, parts=3):
    df.repartition(parts).write.parquet(f"{tmp_path}/in")
    return S.read_landed(spark, f"{tmp_path}/in", df.schema, files=100)


def run(query, tmp_path, name, mode="append"):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp_{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return query.sparkSession.table(name)


def visits(spark):
    rows = [(i, f"ip{i % 5}", datetime.datetime(2024, 1, 1 + i % 3, 10), f"p{i % 2}", f"s{i % 4}") for i in range(60)]
    return spark.createDataFrame(rows + [(99, "late", datetime.datetime(2024, 1, 20), "p", "s9")], "id long, ip string, ts timestamp, path string, session_id string")


def test_streams_equal_batches(spark, tmp_path):
    df = visits(spark)
    stream = land(spark, tmp_path, df)
    views = run(S.daily_views(stream), tmp_path, "views")
    want = {(r.date, r.pv) for r in S.daily_views(df).collect() if r.date.day < 19}
    assert {(r.date, r.pv) for r in views.collect()} == want and want
    uniq = run(S.daily_visitors(stream), tmp_path, "uniq")
    assert {(r.date.day, r.uv) for r in uniq.collect()} >= {(1, 5), (2, 5), (3, 5)}
    trails = run(S.sessions(stream), tmp_path, "trails")
    assert trails.filter("session_id <> 's9'").agg(F.sum("events")).first()[0] == 60
    act = run(S.term_activity(stream.select(F.col("ip").alias("term"), "ts")), tmp_path, "act")
    assert act.filter("day = '2024-01-03' and term = 'ip0'").first().n == 12
    assert S.with_cycle(df).first().cycle.endswith("-10")


def test_slot_stream(spark, tmp_path):
    df = visits(spark).select(F.col("ip").alias("slot_id"), "ts", F.when(F.col("id") % 2 == 0, "click").otherwise("impression").alias("kind"))
    out = run(S.slot_counters(land(spark, tmp_path, df)), tmp_path, "slot_counts", "update")
    assert out.agg(F.sum("clicks")).first()[0] >= 30


def test_refresh_stream(spark, tmp_path):
    df = spark.range(20).select(F.col("id"))
    stream = land(spark, tmp_path, df)
    q = S.refresh_on_batches(stream, f"{tmp_path}/out", lambda old, new: new if old is None else old.unionByName(new), f"{tmp_path}/cp")
    assert q.awaitTermination(120)
    from heatline.sources.sinks import latest

    assert latest(spark, f"{tmp_path}/out").count() == 20


def test_replayed_batch_is_published_once(spark, tmp_path):
    from heatline.sources.sinks import latest, publish_once, versions

    path, made = f"{tmp_path}/t", []
    for number, rows in ((1, 3), (1, 9), (2, 5), (1, 7)):  # the second and last are replays
        publish_once(spark, path, number, lambda rows=rows: made.append(rows) or spark.range(rows))
    assert versions(spark, path) == [1, 2] and made == [3, 5] and latest(spark, path).count() == 5


ITEMS = "url string, title string, title_zh string, title_en string, summary_zh string, summary_en string, dimension string, source string, region string, published date, hn_points long, reddit_score long, reddit_comments long, keywords array<string>, fetched_at timestamp"


def item(i, word, hour):
    day = datetime.date(2024, 1, 30)
    return (f"https://h/{i}?utm_source=a", f"About {word} {i}", None, None, "", "", f"d{i % 2}", "s", "away", day, i, 0, 0, [word, "common"], datetime.datetime(2024, 1, 31, hour, 5))


def test_refresh_cycles_stream(spark, tmp_path, monkeypatch):
    """Three hours in two files, the second begun after a crash between two tables: one commit for each hour, a rise between
    them, and answers that came in between."""
    from heatline.functions import lexicon as L
    from heatline.plans import refresh as R
    from heatline.sources import store

    path = f"{tmp_path}/out"
    land = lambda rows: spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    land([item(i, f"word{i % 3}", 8) for i in range(12)])
    models = spark.createDataFrame([("org/word1-chat", "word1-chat", 5, 2, 0)], "full_id string, term string, likes long, trending_score long, pos long")
    said = [("2024-01-31-08", "explain", "common", "常", "usual")]
    answers = lambda s: s.createDataFrame(said, R.ANSWER)
    start = lambda: S.refresh_cycles(S.read_landed(spark, f"{tmp_path}/in", ITEMS, files=1), path, f"{tmp_path}/cp", models, L.load(spark), ["ai"], [], answers=answers, buckets=8)
    q = start()
    assert q.awaitTermination(600) and q.exception() is None
    see = lambda name: store.table(spark, path, store.newest(spark, path), name)
    assert store.newest(spark, path).notes["cycle"] == "2024-01-31-08" and see("cards").count() == 12

    land([item(i, f"word{i % 3}", 9) for i in range(10, 16)] + [item(i, "late", 7) for i in (90,)] + [item(i, "more", 10) for i in range(30, 32)])
    put, calls = store.Commit.put, []

    def dies(self, name, df, part="all"):
        calls.append(name)
        if len(calls) == 5:  # inside the second hour of the batch
            raise OSError("the machine is gone")
        return put(self, name, df, part)

    monkeypatch.setattr(store.Commit, "put", dies)
    q = start()
    with pytest.raises(Exception):
        q.awaitTermination(600)
    half = store.newest(spark, path)
    assert half.notes["hour"] == "2024-01-31-07" and half.notes["cycle"] == "2024-01-31-08"
    assert store.table(spark, path, half, "cards").count() == 13 == store.table(spark, path, half, "terms").filter("term = 'common'").first().mentions
    monkeypatch.setattr(store.Commit, "put", put)
    q = start()
    assert q.awaitTermination(600) and q.exception() is None
    last = store.newest(spark, path)
    assert (last.number, last.notes["hour"], last.notes["cycle"]) == (4, "2024-01-31-10", "2024-01-31-10")
    cards = see("cards")
    assert cards.count() == 19 and cards.filter("cycle = '2024-01-31-10'").count() == 2 and all("utm" not in r.url for r in cards.collect())
    terms = {r.term: r for r in see("terms").collect()}
    assert terms["common"].mentions == 19 and terms["common"].explain_en == "usual" and terms["common"].explained_cycle == "2024-01-31-08"
    assert terms["common"].rise == round((19 - 17) / 17, 4) and "word1" in terms
    assert {r.cycle for r in see("snapshots").filter("term = 'common'").collect()} == {f"2024-01-31-{h}" for h in ("08", "09", "10")}
    assert {r.id: r.news_cnt for r in see("words").collect()}["common"] == 19
    assert {r.cycle for r in see("requests").collect()} == {"2024-01-31-08", "2024-01-31-09", "2024-01-31-10"}
    pool = see("news_pool")
    assert pool.filter("not from_history").count() == 2 and pool.count() == 19 and see("tops").filter("rank = 1").count() == 2


def test_ingest_after_a_restart(spark, tmp_path):
    """Landed lines = accepted + rejected, each once, whatever was restarted; the accepted ones as the batch reader gives them."""
    import json

    from heatline.sources import traffic

    shape = "query string, country string, ts timestamp"
    lines = [json.dumps({"query": q, "ts": f"2024-01-0{i % 3 + 1} 00:00:00"}) for i, q in enumerate(["spark", " ", "a{b}", "x" * 99] * 10)] + ["{", "nothing"]
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines[k * 20 : k * 20 + 20] if k == 0 else lines[20:]))
        stream = spark.readStream.schema("value string").format("text").load(f"{tmp_path}/in")
        q = S.ingest(stream, "searches", shape, f"{tmp_path}/out", f"{tmp_path}/cp")
        assert q.awaitTermination(120) and q.exception() is None
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == len(lines) == 42 and out.filter("status = 'rejected'").groupBy("reason").count().count() == 3
    batch = traffic.searches(spark.read.schema(shape).json(f"{tmp_path}/in").filter("ts is not null")).select("query", "country", F.to_date("ts").alias("date"))
    assert sorted(map(tuple, out.filter("status = 'accepted'").select("query", "country", "date").collect())) == sorted(map(tuple, batch.collect()))
    assert out.filter("status = 'rejected' and raw is null").count() == 0


def test_late_rows_are_corrections(spark, tmp_path):
    """Stream plus corrections = one batch over all rows, and a closed day changes by a correction only."""
    made = random.Random(7)
    day = lambda d: datetime.datetime(2024, 1, d) + datetime.timedelta(seconds=made.randrange(86400))
    files = [[(str(made.randrange(6)), day(d)) for d in (1, 1, 2)] for _ in range(3)] + [[("9", day(9)), (None, day(8))], [("1", day(1)), ("new", day(1)), ("new", day(2)), ("2", day(9))], [("new", day(1)), ("8", day(10))]]
    path = f"{tmp_path}/days"
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "ip string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = S.count_days(S.read_landed(spark, f"{tmp_path}/in", "ip string, ts timestamp", files=1), path, f"{tmp_path}/cp")
        assert q.awaitTermination(120) and q.exception() is None
        if k == 3:
            before = {r.date: (r.pv, r.uv) for r in S.day_counters(spark, path).collect()}
        if k == 4:
            closed = {r.date: (r.pv, r.uv) for r in S.day_counters(spark, path).collect()}
            assert all(closed[d] == before[d] for d in before if d.day < 8)
            assert S.correct_days(spark, path) > 0
    assert S.correct_days(spark, path) > 0 and S.correct_days(spark, path) == 0
    got = {r.date: (r.pv, r.uv) for r in S.day_counters(spark, path).collect()}
    every = [r for rows in files for r in rows]
    want = {d: (sum(t.date() == d for _, t in every), len({ip for ip, t in every if t.date() == d and ip is not None})) for d in {t.date() for _, t in every}}
    assert got == want
    rows = spark.createDataFrame([(datetime.date(2024, 1, 1), "new")], "date date, ip string")
    back, _ = T.day_deltas(rows, rows.limit(0), sign=-1)
    assert [tuple(r)[1:] for r in back.collect()] == [(-1, -1)]


def test_rate_limit_of_a_hot_key(spark):
    made = random.Random(2)
    at = sorted(made.choice([0, 40, 400]) + made.random() * 3000 for _ in range(900))
    base = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("b", "hot", base + datetime.timedelta(seconds=round(t, 3))) for t in at], "bucket string, key string, ts timestamp").repartition(4)
    got = sorted((round((r.ts - base).total_seconds(), 3), r.allowed, r.retry_after) for r in T.rate_limit(df, 4, 30).collect())
    assert got == [(round(t, 3), a, w) for t, a, w in brute_limit([round(t, 3) for t in at], 4, 30)]


def test_country_of_overlaps_and_repeats(spark):
    rows = [(1, 70_000, ""), (1, 70_000, ""), (2, None, "xx"), (3, 5, "de"), (4, 10**9, None), (5, 140_000, "T1")]
    df = spark.createDataFrame(rows, "id long, ip_num long, header string")
    ranges = spark.createDataFrame([(60_000, 150_000, "AA"), (65_000, 75_000, "BB")], "lo long, hi long, country string")
    out = sorted((r.id, r.country) for r in T.country_of(df, ranges).collect())
    assert out == [(1, "AA"), (1, "AA"), (2, "Unknown"), (3, "DE"), (4, "Unknown"), (5, "AA")]


def test_limit_stream(spark, tmp_path):
    times, df = hits(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = run(S.rate_limit(land(spark, tmp_path, df, 1), 3), tmp_path, "limits")
        base = datetime.datetime(2024, 1, 1)
        got = sorted(((r.ts - base).total_seconds(), r.allowed, r.retry_after) for r in out.filter("key = 'a'").collect())
        assert got == brute_limit(times["a"], 3, 60)
        assert out.filter("key = '' and not allowed").count() == 0
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_overview_with_sketch(spark):
    df = visits(spark).withColumn("date", F.to_date("ts"))
    exact, about = T.overview(df, as_of()).first(), T.overview(df, as_of(), exact=False).first()
    assert exact.total_pv == 61 and exact.total_uv == 6 == about.total_uv and exact.today_pv == 0


def test_active_slots(spark):
    d = datetime.date
    rows = [("a", "n", "all", True, 2, None, None, d(2024, 1, 1)), ("b", "n", "cn", True, 1, d(2024, 1, 31), d(2024, 1, 31), d(2024, 1, 1)), ("c", "n", "en", True, 0, None, None, d(2024, 1, 1)), ("d", "n", "cn", False, 0, None, None, d(2024, 1, 1)), ("e", "n", "cn", True, 0, d(2024, 2, 1), None, d(2024, 1, 1))]
    s = spark.createDataFrame(rows, "slot_id string, name string, region string, active boolean, sort_order int, start_date date, end_date date, created_at date")
    assert [r.slot_id for r in T.active_slots(s, as_of(), "cn").collect()] == ["b", "a"]
    assert T.drop_deleted(spark.createDataFrame([("a",), ("zz",)], "slot_id string"), s).count() == 1


def test_suggestions_for_all_that_can_be_typed(spark):
    made = random.Random(3)
    rows = [("".join(made.choices("abA é", k=made.randrange(1, 7))).strip(), datetime.date(2024, 1, made.choice([1, 20]))) for _ in range(120)] + [("", datetime.date(2024, 1, 20)), (None, None)]
    df = spark.createDataFrame(rows, "query string, date date").coalesce(1)
    table = {}
    for r in T.suggestions(df, as_of(), n=3, longest=3).orderBy("typed", "rank").collect():
        table.setdefault(r.typed, []).append((r.query, r.n))
    for typed in made.sample(sorted(table), 12):
        assert table[typed] == [tuple(r) for r in T.suggest(df, typed, as_of(), 3).collect()], typed
    assert all(len(t) <= 3 for t in table) and "" not in table


def test_slot_files_report_what_is_damaged(spark, tmp_path):
    import json

    good = {"slot_id": "a", "name": "A", "region": "all", "active": True, "sort_order": 2, "start_date": "2024-01-01", "created_at": "2024-01-01"}
    lines = [json.dumps(good), json.dumps(good | {"slot_id": "b", "sort_order": 1}), json.dumps(good | {"slot_id": "c", "active": False}), json.dumps(good | {"slot_id": " "}), json.dumps(good | {"sort_order": "first"}), '{"slot_id": "d', ""]
    (tmp_path / "slots.json").write_text("\n".join(lines))
    assert [r.slot_id for r in T.fallback_slots(spark, f"{tmp_path}/slots.json", as_of(), "en").collect()] == ["b", "a"]
    told = [(r.problem, r.line) for r in T.slot_files(spark, f"{tmp_path}/slots.json").filter("problem is not null").collect()]
    assert sorted(told) == sorted([("no id", lines[3]), ("no JSON of a slot", lines[4]), ("no JSON of a slot", lines[5])])


@pytest.mark.parametrize("parts", [1, 7])
def test_country_sweep_against_every_pair(spark, parts):
    """Overlaps, one range over everything, equal begins and ends, gaps, over many partition borders; longs and IPv6."""
    import ipaddress

    made = random.Random(parts)
    ranges = [(lo := made.randrange(1000), lo + made.choice([0, 1, 5, 80, 400]), made.choice(["AA", "BB", "CC"])) for _ in range(60)] + [(500, 500, "DD"), (500, 501, "AA"), (900, 899, "never")]
    asked = [made.randrange(1500) for _ in range(300)] + [None]

    def want(x, held):
        inside = sorted((lo, c) for lo, hi, c in held if x is not None and lo <= x <= hi)
        return inside[0][1] if inside else "Unknown"

    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for held in (ranges, [*ranges, (0, 10**6, "ZZ")], []):
            rows = spark.createDataFrame([(x, "") for x in asked], "ip_num long, header string")
            out = T.country_of(rows, spark.createDataFrame(held, "lo long, hi long, country string")).collect()
            assert sorted((str(r.ip_num), r.country) for r in out) == sorted((str(x), want(x, held)) for x in asked)
        six = lambda x: ipaddress.ip_address(2**100 + x).packed
        rows = spark.createDataFrame([(six(x), "") for x in asked if x is not None], "ip_num binary, header string")
        out = T.country_of(rows, spark.createDataFrame([(six(lo), six(hi), c) for lo, hi, c in ranges], "lo binary, hi binary, country string")).collect()
        assert sorted((bytes(r.ip_num), r.country) for r in out) == sorted((six(x), want(x, ranges)) for x in asked if x is not None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
