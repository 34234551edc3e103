"""Card table, matching, term pool, boards and search."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from heatline.functions import lexicon as L
from heatline.operators import boards, cards, match, search, term_days, terms
from heatline.operators import cards as C
from heatline.plans import refresh
from heatline.plans.refresh import refresh_terms
from heatline.sources import store



def as_of():
    return F.lit("2024-01-31 12:00:00").cast("timestamp")

DAY = datetime.date


def card(url, title="t", score=1, published="2024-01-30", keywords=(), **more):
    return {"url": url, "title": title, "title_zh": title, "title_en": title, "summary_zh": "", "summary_en": "", "dimension": "d", "source": "s", "region": "away", "published": DAY.fromisoformat(published), "hn_points": 0, "reddit_score": 0, "reddit_comments": 0, "score": score, "trend": 0, "hot": score, "keywords": list(keywords)} | more


CARDS = "url string, title string, title_zh string, title_en string, summary_zh string, summary_en string, dimension string, source string, region string, published date, hn_points long, reddit_score long, reddit_comments long, score long, trend long, hot long, keywords array<string>"


def table(spark, rows, now):
    return cards.stored(spark.createDataFrame(rows, CARDS), F.lit(now).cast("timestamp"))


def test_upsert(spark):
    old = table(spark, [card("http://a/1", keywords=["kk", "zz"], score=5), card("http://a/1?utm_x=1", keywords=["yy"], score=9), card("http://a/2", keywords=["pp"]), card("http://a/3", keywords=["mm", "nn"])], "2024-01-01")
    new = table(spark, [card("http://a/1", keywords=["kk"], score=7), card("http://a/2#f", keywords=["qq"]), card("http://a/3", keywords=[]), card("http://a/4")], "2024-01-02")
    out = {r.url: r for r in cards.upsert(old, new).collect()}
    assert set(out) == {f"http://a/{i}" for i in (1, 2, 3, 4)}
    assert sorted(out["http://a/1"].keywords) == ["kk", "yy", "zz"] and out["http://a/1"].score == 7  # a proper subset doesn't replace
    assert out["http://a/2"].keywords == ["qq"] and out["http://a/3"].keywords == []
    assert out["http://a/1"].first_seen_at.day == 1 and out["http://a/4"].first_seen_at.day == 2 and all(r.active for r in out.values())
    later = {r.url: r.active for r in cards.upsert(cards.upsert(old, new), table(spark, [card("http://a/4")], "2024-01-03")).collect()}
    assert later == {"http://a/1": False, "http://a/2": False, "http://a/3": False, "http://a/4": True}


def test_titles_and_pool(spark):
    rows = [card("http://a/1", "Same!", 5), card("http://a/2", "same", 9), card("http://a/3", "！", 1), card("http://a/4", "！", 2)]
    df = spark.createDataFrame(rows, CARDS)
    assert {r.url for r in cards.first_of_titles(df, F.desc("score"), F.col("url")).collect()} == {"http://a/2", "http://a/3", "http://a/4"}
    got = {(r.url, r.from_history) for r in cards.pool(df.limit(2), df).collect()}
    assert sum(h for _, h in got) == 2 and len(got) == 4


def python_hit(text, surface):
    if surface.isascii():
        return bool(re.search(r"(?<![a-z0-9])" + re.escape(surface) + r"(?!\.\d)(?![a-z0-9])", text, re.I))
    return surface.lower() in text.lower()


def test_matches_equal_brute_force(spark):
    made = random.Random(7)
    bits = ["gpt", "5", "-", " ", ".", "GPT-5", "ai", "量子", "计算", "x", "C++", "é", "用", "50", "_"]
    surfaces = ["gpt-5", "gpt 5", "gpt", "ai", "量子", "量", "c++", "++", "5", "量子计算", "é", "x é", "gpt-5.5"]
    texts = ["".join(made.choices(bits, k=made.randint(0, 9))) for _ in range(1500)]
    want = {(i, s) for i, t in enumerate(texts) for s in surfaces if python_hit(t, s)}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id long, text string")
    sf = spark.createDataFrame([(s, s) for s in surfaces], "canon string, surface string")
    got = {(r.id, r.canon) for r in match.matches(df, sf, "id").collect()}
    assert got == want and len(want) > 500


def test_canonical(spark):
    lex = L.load(spark)
    words = ["Machine Learning", "machine_learning", "机器学习", "robots", "Robot", "gpu", "GPUs", "7", "x", "new-thing", "(new-thing)", "ab-c", "classes"]
    out = {r.word: r.canon for r in L.canonical(spark.createDataFrame([(w,) for w in words], "word string"), lex).collect()}
    assert out["Machine Learning"] == out["machine_learning"] == out["机器学习"] == "machine-learning"
    assert out["robots"] == out["Robot"] == "robotics" and out["gpu"] == "GPU" and out["7"] is None and out["x"] is None
    assert out["(new-thing)"] == "new-thing" and out["ab-c"] == "ab-c"


def test_original_case(spark):
    rows = [("gpt-6-astra", "The GPT-6 Astra model"), ("gpt-5", "about GPT-5.5"), ("量子", "量子"), ("a+b", "x A+B")]
    out = [r.o for r in spark.createDataFrame(rows, "k string, t string").select(match.original_case(F.col("k"), F.col("t")).alias("o")).collect()]
    assert out == ["GPT-6 Astra", "gpt-5", "量子", "A+B"]


def test_media(spark):
    df = spark.createDataFrame([card("u1", "Daily Wire says", keywords=["daily-wire"]), card("u2", "other", keywords=["daily-wire", "quantum"])], CARDS)
    links = df.select("url", F.explode("keywords").alias("canon"))
    out = {(r.url, r.canon) for r in terms.without_media(links, df, spark.createDataFrame([("daily-wire",)], "canon string"), L.load(spark)).collect()}
    assert out == {("u1", "daily-wire"), ("u2", "quantum")}


def test_refresh(spark):
    rows = [card("u1", "OpenThing ships", 10, "2024-01-31", ["openthing"]), card("u2", "open-thing again", 20, "2024-01-29", ["open-thing"]), card("u3", "old news", 50, "2024-01-01", ["open-thing"]), card("u4", "quantum computing rises", 5, "2024-01-30", []), card("u5", "OpenThing in a title", 1, "2024-01-30", ["other-topic"])]
    df = spark.createDataFrame(rows, CARDS)
    current = df.filter("url in ('u1', 'u5')").select("url", F.lit(10.0).alias("signal"))
    models = spark.createDataFrame([("me/NewModel-7B-GGUF", "NewModel-7B-GGUF", 30, 3, 0), ("me/NewModel-7B", "NewModel-7B", 40, 9, 1)], "full_id string, term string, likes long, trending_score long, pos long")
    at = datetime.datetime(2024, 1, 29)
    old = spark.createDataFrame([("open-thing", "open-thing", None, None, at, 2.0), ("gone-term", "Gone", None, "Gone", at, 3.0)], "term string, display string, display_zh string, display_en string, first_seen_at timestamp, hot double")
    snaps = spark.createDataFrame([("open-thing", "2024-01-30-08", 1, 1, 1, 0.0), ("openthing", "2024-01-30-08", 1, 1, 1, 0.0)], "term string, cycle string, news_cnt long, win7_cnt long, score_sum long, signal_sum double")
    pool = refresh_terms(df, current, models, old, snaps, L.load(spark), as_of(), "2024-01-31-08", L.STOPWORDS, L.MEDIA)
    t = {r.term: r for r in pool.terms.collect()}
    assert "openthing" not in t and t["open-thing"].mentions == 4 and t["open-thing"].win7 == 2
    assert t["open-thing"].hot == 10 * 3.0 + 20 * 1.5 and float(t["open-thing"].rise) == 0.0  # two in the window now and in the twins' last cycle
    assert t["open-thing"].first_seen_at.date() == DAY(2024, 1, 1)
    assert t["newmodel-7b"].hot == 40.0 and t["newmodel-7b"].origin == "hf" and t["gone-term"].hot == 0.0
    assert t["quantum"].mentions == 1
    s = {(r.term, r.cycle): r.win7_cnt for r in pool.snapshots.collect()}
    assert s["open-thing", "2024-01-30-08"] == 2 and s["open-thing", "2024-01-31-08"] == 2
    w = pool.words.collect()
    assert w[0].id == "open-thing" and [n.official_url for n in w[0].top_news] == ["u3", "u2", "u1"]
    assert w[0].display == "OpenThing"
    assert {r.day for r in pool.days.collect()} == {"2024-01-30", "2024-01-31"}
    pool.clear()


def test_requests_and_answers_over_cycles(spark):
    """Requests of one cycle, answers in the next, applied once; explanations stay with terms and go to a twin's representative."""
    rows = [card("u1", "智象 ships", 10, "2024-01-31", ["智象"]), card("u2", "fast-lane opens", 9, "2024-01-30", ["fast-lane"]), card("u3", "the fastlane report", 8, "2024-01-30", ["fastlane"])]
    df = spark.createDataFrame(rows, CARDS)
    current = df.select("url", F.lit(1.0).alias("signal"))
    models = spark.createDataFrame([], "full_id string, term string, likes long, trending_score long, pos long")
    lexicon = L.load(spark)
    snaps = spark.createDataFrame([], refresh.SNAPSHOT)

    def cycle(at, old, requests, answers, hours=0):
        now = F.lit("2024-01-31 08:00:00").cast("timestamp") + F.make_dt_interval(hours=F.lit(hours))
        made = refresh_terms(df, current, models, old, snaps, lexicon, now, at, L.STOPWORDS, [], requests=requests, answers=answers)
        return refresh.cut(made.terms), refresh.cut(made.requests)

    old = refresh.pool_rows(spark.createDataFrame([("fastlane", "fastlane", "旧", "old", datetime.datetime(2024, 1, 30, 9))], "term string, display string, explain_zh string, explain_en string, explain_updated_at timestamp"))
    terms1, asked1 = cycle("2024-01-31-08", old, None, None)
    t = {r.term: r for r in terms1.collect()}
    assert t["fastlane"].explain_zh == "旧" and "fast-lane" not in t  # the known twin represents both
    assert {(r.kind, r.canon) for r in asked1.collect()} == {("translate", "智象"), ("explain", "智象")}
    asked1 = asked1.union(spark.createDataFrame([("2024-01-31-08", "explain", "fast-lane", "x", [], None, None, 9)], asked1.schema))
    said = [("2024-01-31-08", "translate", "智象", None, " Zhixiang "), ("2024-01-31-08", "explain", "智象", "象", "an elephant"), ("2024-01-31-08", "explain", "fast-lane", "新", "new"), ("2024-01-31-00", "translate", "fastlane", None, "not asked")]
    answers = spark.createDataFrame(said * 2, refresh.ANSWER)
    assert {r.display_en for r in cycle("2024-01-31-08", terms1, asked1, answers)[0].collect()} == {None}  # the same cycle doesn't take its own answers
    terms2, asked2 = cycle("2024-01-31-12", terms1, asked1, answers, 4)
    t = {r.term: r for r in terms2.collect()}
    assert t["智象"].display_en == "Zhixiang" and t["智象"].explain_en == "an elephant" and t["fastlane"].explain_en == "new" and t["fastlane"].display_en is None
    assert t["智象"].translated_cycle == "2024-01-31-08" and t["fastlane"].explain_updated_at.hour == 12
    assert [(r.kind, r.canon) for r in asked2.collect()] == [("translate", "智象")]  # asked again for a better name
    edited = terms2.withColumn("explain_en", F.lit("edited"))
    terms3, _ = cycle("2024-01-31-16", edited, asked1.union(asked2), answers, 8)
    assert {r.explain_en for r in terms3.collect()} == {"edited"}  # no answer is applied twice


def test_stopwords_and_aliases(spark):
    words = spark.createDataFrame([("x", "AI"), ("y", "rust"), ("z", None)], "word string, canon string")
    assert [r.word for r in terms.without_stopwords(words, spark.createDataFrame([("ai",)], "word string")).collect()] == ["y"]
    lex = L.spelled(spark.createDataFrame([(0, "robotics", ["robot", "机器人", "机械"]), (1, "rust", [])], "no int, canon string, forms array<string>"))
    assert [tuple(r) for r in terms.chinese_alias(lex).collect()] == [("robotics", "机器人")]
    table = {r.word: r.canon for r in L.canonical(spark.createDataFrame([("Robots",), ("rusts",), ("Dev-Ops",), ("json",)], "word string"), lex).collect()}
    assert table == {"Robots": "robotics", "rusts": "rust", "Dev-Ops": "dev-ops", "json": "JSON"}


def test_buckets_equal_the_whole_merge(spark, tmp_path):
    cols = "url string, title string, title_zh string, title_en string, summary_zh string, summary_en string, dimension string, source string, region string, published string, hn_points long, reddit_score long, reddit_comments long, score long, trend long, hot long, keywords array<string>"
    made = random.Random(1)
    row = lambda i: (f"https://h/{i}", f"t{i}", "", "", "", "", "d", "s", "r", "2024-01-01", 0, 0, 0, made.randrange(99), 0, 0, made.sample(["a1", "b1", "c1", "d1"], made.randrange(4)))
    whole, path = None, f"{tmp_path}/store"
    for n, urls in enumerate([range(300), [3, 5, 3, 7], range(290, 320), []]):
        batch = C.stored(spark.createDataFrame([row(i) for i in urls], cols), F.lit(f"2024-01-0{n + 1}").cast("timestamp"))
        batch = refresh.cut(batch)
        whole = refresh.cut(C.upsert(batch.limit(0) if whole is None else whole, batch))
        commit = store.Commit(spark, path)
        touched = C.upsert_buckets(commit, batch, f"2024-01-0{n + 1}", buckets=64)
        at = commit.publish()
        assert len(touched) <= len(set(urls)) and (n != 1 or len(touched) <= 3)
        changed = {b for b, folder in at.tables["cards"]["parts"].items() if commit.before.tables.get("cards", {"parts": {}})["parts"].get(b) != folder}
        assert changed == {str(b) for b in touched}
        got = C.active(store.table(spark, path, at, "cards"), f"2024-01-0{n + 1}")
        assert sorted(map(tuple, got.select(C.CARD).collect()), key=str) == sorted(map(tuple, whole.select(C.CARD).collect()), key=str)


def test_ten_cycles_of_deltas_equal_full_aggregates(spark):
    """Cards come, change and go, links change, and twins meet and part; after each cycle the sums give the full refresh."""
    made = random.Random(6)
    names = ["ai-x", "aix", "b-b", "bb", "c"]
    cards_of, links_of, reps_of, sums = {}, set(), {n: n for n in names}, None
    frame = lambda rows, shape: spark.createDataFrame(rows, shape).coalesce(1)
    state = lambda: (frame(sorted(links_of), "url string, canon string"), frame([(u, *c) for u, c in sorted(cards_of.items())], "url string, published date, dimension string, score long"), frame(sorted(reps_of.items()), "canon string, rep string"))
    before = state()
    for k in range(10):
        batch = made.sample(range(14), 4)
        for u in (f"u{i}" for i in batch):
            links_of -= {x for x in links_of if x[0] == u}
            cards_of.pop(u, None)
            if made.random() < 0.8:
                cards_of[u] = (DAY(2024, 1, 20) + datetime.timedelta(days=made.randrange(12)), made.choice(["d1", "d2", None]), made.choice([None, 1, 5, 9]))
                links_of |= {(u, n) for n in made.sample(names, made.randrange(4))}
        reps_of = {n: n for n in names} | made.choice([{}, {"aix": "ai-x"}, {"ai-x": "aix", "bb": "b-b"}])
        after = state()
        touched = term_days.touched_urls(frame([(f"u{i}",) for i in batch], "url string"), before[0], after[0], before[2], after[2])
        sums = refresh.cut(term_days.apply(sums, term_days.deltas(touched, before, after)).coalesce(1))
        full = terms.aggregate(terms.to_rep(after[0], after[2]).distinct(), after[1], frame([], "url string, signal double"), as_of())
        cols = ["canon", "mentions", "heat", "win7", "earliest", "latest", "days", "dims"]
        got, want = (sorted(map(tuple, df.select(cols).collect())) for df in (term_days.from_days(sums, as_of()), full))
        assert got == want, k
        before = after
    flow = sorted(map(tuple, terms.sliding_mentions(terms.to_rep(after[0], after[2]).distinct(), after[1]).collect()))
    assert sorted(map(tuple, term_days.daily_mentions(sums).collect())) == flow


def test_rarest_anchor_loses_no_match(spark):
    made = random.Random(4)
    words = ["the", "verge", "a", "x1", "Σx", "机器", "器人", "9", "c++", ".", "-", "Ab"]
    texts = [(i, made.choice(["", " "]).join(made.choices(words, k=made.randrange(1, 8)))) for i in range(200)]
    forms = sorted({made.choice(["", " ", "-"]).join(made.choices(words, k=made.randrange(1, 4))) for _ in range(150)} | {"the verge", "+", "机"})
    t, f = spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame([(s, s) for s in forms], "canon string, surface string")
    got = {tuple(r) for r in match.matches(t, f, "key").collect()}
    every = t.crossJoin(f.filter("trim(surface) <> ''")).filter(match.hit(F.col("text"), F.col("surface"))).select("key", "canon")
    assert got == {tuple(r) for r in every.collect()} and len(got) > 300
    offered = spark.createDataFrame([("the",)] * 5 + [("verge",)], "anchor string")
    best = {r.surface: r.anchor for r in match.rarest_anchors(spark.createDataFrame([("the verge",), ("the moon",), ("the",)], "surface string"), offered).collect()}
    assert best == {"the verge": "verge", "the": "the"}


@pytest.mark.parametrize("parts", [1, 16])
def test_trend(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = [("a", "2024-01-02-08", 1, 2), ("a", "2024-01-02-20", 3, 4), ("a", "2024-01-01-00", 5, 8), ("b", "2024-01-01-08", 1, 1), ("c", "2024-01-01-08", 0, 0), ("c", "2024-01-02-08", 0, 0)]
    out = [(r.term, r.date, r.news_cnt, r.share) for r in terms.trend(spark.createDataFrame(rows, "term string, cycle string, news_cnt long, win7_cnt long")).orderBy("date").collect()]
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert out == [("a", "2024-01-01", 5, 1.0), ("a", "2024-01-02", 3, 0.5)]


def test_names_and_explanations(spark):
    t = spark.createDataFrame([("a", "智象", None, None), ("b", "外滩", None, "Bund"), ("c", "并购", None, None), ("d", "Plain", None, "Old")], "canon string, display string, display_zh string, stored_en string")
    out = {r.canon: r.display_en for r in terms.english_names(t, spark.createDataFrame([("智象", "Zhixiang")], "name string, en string"), spark.createDataFrame([("并购", "并购"), ("外滩", "The Bund"), ("智象", "wrong")], "display string, en string")).collect()}
    assert out == {"a": "Zhixiang", "b": "The Bund", "c": None, "d": "Old"}
    assert [r.canon for r in terms.to_translate(t, 2).collect()] == ["a", "c"]
    now = datetime.datetime(2024, 1, 31, 10)
    e = spark.createDataFrame([("a", 5.0, None, None, None, 1, 1), ("b", 9.0, "z", "e", now, 1, 1), ("s", 9.0, None, None, None, 1, 1), ("o", 1.0, "z", "e", datetime.datetime(2024, 1, 29), 1, 1)], "canon string, hot double, explain_zh string, explain_en string, explain_updated_at timestamp, mentions long, win7 long")
    static = spark.createDataFrame([("s", None, "said")], "canon string, zh string, en string")
    assert [r.canon for r in terms.to_explain(e, as_of(), static).collect()] == ["a", "o"]
    levels = {r.canon: (r.level, r.explanation) for r in terms.explanation(e, static).collect()}
    assert levels["s"] == ("static", "said") and levels["b"] == ("pool", "z") and levels["a"][0] == "template"
    done = {r.canon: r for r in terms.apply_explanations(e, spark.createDataFrame([("a", "新", "new"), ("o", "", "x")], "canon string, zh string, en string"), as_of()).collect()}
    assert done["a"].explain_zh == "新" and done["a"].explain_updated_at.hour == 12 and done["o"].explain_updated_at.day == 29


def test_boards(spark):
    w = spark.createDataFrame([(f"w{i:02d}", float(i % 7), float(i)) for i in range(75)] + [("w00", 1.0, 0.0)], "id string, hot double, rise double")
    out = [r.id for r in boards.word_board(w, "hot").collect()]
    assert len(out) == 60 == len(set(out)) and out[0] == "w06"
    m = spark.createDataFrame([("a/X-GGUF", 1, 0), ("b/Y", 5, 1), ("a/X", 9, 2)], "full_id string, trending_score long, pos long")
    assert [(r.full_id, r.place) for r in boards.base_models(m).orderBy("place").collect()] == [("a/X", 0), ("b/Y", 1)]
    names = spark.createDataFrame([("x",), ("b/y",), ("zz",)], "name string")
    assert {(r.name, r.full_id) for r in boards.model_lookup(names, m).collect()} == {("x", "a/X-GGUF"), ("b/y", "b/Y")}
    s = boards.stream(m.select(F.lit("model").alias("kind"), F.col("full_id").alias("id"), "pos"), spark.createDataFrame([("news", "n", 0), ("news", "n", 1), ("news", None, 2), ("news", None, 3)], "kind string, id string, pos long"))
    assert s.count() == 6


def test_papers(spark):
    m = spark.createDataFrame([("a/Foo-7B", "Foo-7B", 0), ("b/Bar-1B", "Bar-1B", 1)], "full_id string, term string, pos int")
    p = spark.createDataFrame([("On Foo", "u1", "d", [], ["cs.LG"], 0), ("on foo", "u2", "d", [], [], 1), ("Foo heat", "u3", "d", [], ["physics.gen"], 2), ("Foobar", "u4", "d", [], [], 3)], "title string, url string, published string, authors array<string>, categories array<string>, pos int")
    out = {r.full_id: [x.url for x in r.papers] for r in boards.papers_of(m, p).collect()}
    assert out == {"a/Foo-7B": ["u1"]}


def test_search(spark):
    rows = [("news", "1", "Quantum leap", 100, "x"), ("news", "2", "quantum leap!", 50, "x"), ("news", "3", "a leap", 0, "quantum"), ("word", "w1", "quantum", 1, None), ("news", "4", "none", 9, None)]
    c = spark.createDataFrame(rows, "kind string, id string, title string, hot long, source string")
    q = spark.createDataFrame([(1, "Quantum  LEAP"), (2, " "), (3, "zzz")], "qid long, q string")
    out = search.search(c, q).orderBy("section", "rank").collect()
    assert [(r.qid, r.section, r.rank, r.id) for r in out] == [(1, "main", 1, "1"), (1, "main", 2, "3"), (1, "word", 1, "w1")]
    assert search.marked(search.search(c, q), "title").filter("id = '1'").first().highlight_title == "<mark>Quantum</mark> <mark>leap</mark>"
    pool = search.pool(*(c.filter(f"id = '{i}'") for i in ("1", "2", "1", "w1")))
    assert pool.count() == 3


def test_surfaces_without_anchor(spark):
    texts = spark.createDataFrame([(1, "a § b"), (2, "x + y"), (3, "好 word"), (4, None), (5, "C++ and c")], "k long, text string")
    forms = spark.createDataFrame([("para", "§"), ("plus", "+"), ("good", "好"), ("cpp", "C++")], "canon string, surface string")
    assert sorted((r.k, r.canon) for r in match.matches(texts, forms, "k").collect()) == [(1, "para"), (2, "plus"), (3, "good"), (5, "cpp"), (5, "plus")]


def test_search_equals_every_pair(spark):
    made = random.Random(5)
    words = ["spark", "sp", "Ark", "é", "data", "lake", "da", "x1", "好"]
    pool = [("news", f"u{i}", " ".join(made.choices(words, k=made.randint(0, 4))), made.choice(["src", None, "lake"]), made.randint(0, 9)) for i in range(80)]
    asked = [(i, " ".join(made.choices([*words, "park", "ke", "zz", "a"], k=made.randint(0, 3)))) for i in range(25)]
    cs = spark.createDataFrame(pool, "kind string, id string, title string, source string, hot long")
    out = search.search(cs, spark.createDataFrame(asked, "qid long, q string"), n=100)
    got = {(r.qid, r.id) for r in out.collect()}
    titles = {}
    for qid, q in asked:
        ws = q.lower().split()
        for _, i, title, source, hot in pool:
            if any(w in title.lower() or w in (source or "").lower() for w in ws):
                titles.setdefault(qid, set()).add(title.replace(" ", "").lower() or i)
    assert {q for q, _ in got} == set(titles)
    for qid in titles:
        assert len([1 for q, _ in got if q == qid]) == min(100, len(titles[qid]))


def test_outlets_and_absent_terms(spark):
    pool = spark.createDataFrame([("a", 1.0), ("news-desk", 2.0), ("b", 3.0)], "canon string, hot double")
    outlets = spark.createDataFrame([("news-desk",)], "canon string")
    left = terms.without_outlets(pool, outlets)
    assert {r.canon for r in left.collect()} == {"a", "b"}
    assert {(r.canon, r.hot) for r in terms.absent_at_zero(left, spark.createDataFrame([("b",), ("b",)], "canon string")).collect()} == {("a", 0.0), ("b", 3.0)}


def test_equal_copies_of_a_page_go_by_url_not_by_refresh(spark):
    """of copies with keywords and equal scores the last by url stays, though another was refreshed later."""
    at = lambda day: datetime.datetime(2024, 1, day)
    rows = [("https://a.b/1?utm_x=1", ["k"], 2, 10, at(1), at(6)), ("https://a.b/1?utm_x=2", ["m"], 2, 11, at(2), at(3))]
    frame = spark.createDataFrame(rows, "url string, keywords array<string>, score long, page_id long, first_seen_at timestamp, last_refresh_at timestamp")
    (one,) = C.merge_duplicates(frame).collect()
    assert (one.url, one.page_id, one.keywords, one.first_seen_at, one.last_refresh_at) == ("https://a.b/1", 11, ["m", "k"], at(1), at(6))


def test_search_ranks_where_cards_lie(spark):
    """no card moves for a join, and copies of titles in other shares still count once."""
    rows = [("news", f"u{i:03}", f"Robot {i % 40}", i // 40) for i in range(400)]
    pool = spark.createDataFrame(rows, "kind string, id string, title string, hot long")
    asked = spark.createDataFrame([(1, "robot nothing"), (2, "xyz")], "qid int, q string")
    found = search.search(pool, asked, n=30)
    out = [(r["rank"], r["id"]) for r in found.orderBy("rank").collect()]
    assert out == list(enumerate([f"u{360 + i:03}" for i in range(30)], 1))
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
