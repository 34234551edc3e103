"""Work that grew faster than need be: what plans hold, and that rows are the same."""

import datetime

from pyspark.sql import functions as F

from heatline.functions import lexicon as L
from heatline.operators import match
from heatline.operators import terms as T


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_listed_rows_start_no_python(spark):
    """dictionaries are literal rows of the plan."""
    lexicon = L.load(spark)
    assert "LogicalRDD" not in plan(lexicon) and "LogicalRDD" not in plan(L.governed(lexicon))
    empty = L.listed(spark, [], "kind string, titles array<string>, rank int")
    assert "LogicalRDD" not in plan(empty) and empty.collect() == [] and empty.dtypes[2] == ("rank", "int")


def test_surfaces_of_one_run_need_no_text(spark):
    """a text's anchors are made once, and surfaces of one run are found by them alone."""
    texts = spark.createDataFrame([(1, "GPT v2.5 and gpt.5"), (2, "gpt. 5, v2"), (3, "xgpt"), (4, "gpt.5 then GPT"), (5, "新gpt模型 😀a"), (6, None), (7, "gpt-5")], "k int, text string")
    forms = spark.createDataFrame([("gpt", "GPT"), ("v2", "v2"), ("five", "gpt-5"), ("zh", "新g"), ("smile", "😀a")], "canon string, surface string")
    made = []

    def cut(df):
        made.append(df.collect())
        return spark.createDataFrame(made[-1], df.schema)

    got = sorted((r.k, r.canon) for r in match.matches(texts, forms, "k", cut=cut).collect())
    assert got == [(1, "gpt"), (2, "gpt"), (2, "v2"), (4, "gpt"), (5, "gpt"), (5, "smile"), (5, "zh"), (7, "five"), (7, "gpt")]
    assert len(made) == 1 and {(r.k, r.anchor, r.whole) for r in made[0] if r.k == 4} == {(4, "gpt", True), (4, "then", True), (4, "5", True)}
    assert {(r.anchor, r.whole) for r in made[0] if r.k == 1 and not r.whole} == {("v2", False)}


def _cards(spark):
    day = datetime.date(2024, 1, 30)
    rows = [(f"u{i}", f"Title {i // 2}", None, None, day - datetime.timedelta(i), 10 - i, "d1" if i % 3 else None) for i in range(6)]
    return spark.createDataFrame(rows, "url string, title string, title_zh string, title_en string, published date, score long, dimension string")


def test_aggregate_joins_links_once(spark):
    """order of dimensions and sums come from one pass."""
    links = spark.createDataFrame([(f"u{i}", c) for i in range(6) for c in ("a", "b") if c == "a" or i > 3] + [("u0", "a")], "url string, canon string")
    current = spark.createDataFrame([("u1", 2.5), ("u3", 1.0)], "url string, signal double")
    made = T.aggregate(links, _cards(spark), current, F.lit("2024-01-31").cast("timestamp"))
    assert plan(made).count("Join ") == 2
    a, b = sorted(made.collect(), key=lambda r: r.canon)
    assert (a.mentions, a.heat, a.win7, a.dims, a.cur_cnt, a.cur_score, a.cur_signal) == (6, 3 * 10 + 1.5 * (9 + 8) + 7 + 6 + 5, 6, ["d1", "other"], 2, 16, 3.5)
    assert a.days == sorted(set(a.days)) and len(a.days) == 6 and (a.earliest, a.latest) == (a.days[0], a.days[-1])
    assert (b.mentions, b.dims, b.cur_cnt, b.cur_score, b.cur_signal) == (2, ["d1"], 0, 0, 0.0)


def test_top_news_ranks_narrow_rows(spark):
    """cards meet only the links that stay, so no title goes through the windows but in its key."""
    links = spark.createDataFrame([(f"u{i}", "a") for i in range(6)], "url string, canon string")
    top = T.top_news(links, _cards(spark), 2)
    (row,) = top.collect()
    assert [c.official_url for c in row.top_news] == ["u0", "u2"] and [c.title_zh for c in row.top_news] == ["Title 0", "Title 1"]
    windows = [line for line in plan(top).splitlines() if "Window [" in line]
    assert len(windows) == 2 and "Join" in plan(top).split("Window [")[0]


def _lines(spark, folder, monkeypatch):
    """Lines of a few suppliers, several of one order and day, with so small a share of a task that there are many."""
    from heatline.plans import term_queries as Q

    rows = [(i // 3, i % 5, i % 4 + 1, datetime.datetime(1996, 1, 1 + i % 9)) for i in range(400)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    monkeypatch.setattr(Q, "LINES", 20)
    return Q, rows


def _dealt(df):
    """Numbers of parts of a plan's exchanges, but for broadcasts."""
    import re

    text = df._jdf.queryExecution().executedPlan().toString()
    return sorted(int(n) for n in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", text))


def test_trend_counts_lines_in_parts_of_known_size(spark, tmp_path, monkeypatch):
    """F8: one shuffle, of as many parts as the lines ask for, and no sums before it."""
    Q, rows = _lines(spark, tmp_path, monkeypatch)
    made = Q.Q["w5_w6_a23_trend"](spark, str(tmp_path))
    assert _dealt(made) == [20]
    want = {}
    for order, term, line, day in rows:
        want.setdefault((str(term), str(day.date())), {}).setdefault("-08" if line % 2 == 0 else "-20", []).append(order)
    for r in made.collect():
        last = max((k, v) for k, v in want[r.term, r.date].items())[1]
        assert (r.news_cnt, r.win7_cnt) == (len(last), len(set(last)))
    assert made.count() == 5 * 7


def test_moved_snapshots_are_added_in_parts_of_known_size(spark, tmp_path, monkeypatch):
    """snapshots meet their representatives as they are dealt, and are added in as many parts."""
    Q, rows = _lines(spark, tmp_path, monkeypatch)
    made = Q.Q["a15_m7_moved_snapshots"](spark, str(tmp_path))
    assert _dealt(made) == [4, 20, 20, 20]  # terms for their representatives, and again as dealt; lines; what is added
    want = {}
    for order, term, line, day in rows:
        want.setdefault((str(term // 2 * 2), f"{day.date()}{'-08' if line % 2 == 0 else '-20'}"), []).append((term, order))
    assert {(r.term, r.cycle): (r.news_cnt, r.win7_cnt) for r in made.collect()} == {k: (len(v), len(set(v))) for k, v in want.items()}


def test_put_snapshots_meet_as_they_are_dealt(spark, tmp_path, monkeypatch):
    """both sides are dealt once, by term and cycle, in parts of known size."""
    Q, rows = _lines(spark, tmp_path, monkeypatch)
    made = Q.Q["m11_put_snapshots"](spark, str(tmp_path))
    assert set(_dealt(made)) == {20} and "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
    want = {}
    for order, term, line, day in rows:
        want.setdefault((str(term), f"{day.date()}{'-08' if line % 2 == 0 else '-20'}"), set()).add(order)
    assert {(r.term, r.cycle): r.win7_cnt for r in made.collect()} == {k: len(v) if int(k[0]) % 2 else 0 for k, v in want.items()}
    assert made.count() == len(want)
