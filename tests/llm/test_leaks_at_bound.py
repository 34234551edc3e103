"""Benchmark items at exactly the bound of edits: all are found, for any length."""

import random

import pytest

from heatline.llm import leaks


@pytest.mark.parametrize("size", [1, 4, 5, 16, 25, 50, 59, 100])
@pytest.mark.parametrize("rate", [0.1, 0.2])
def test_every_item_at_the_bound(size, rate):
    made = random.Random(size)
    rows = [(i, " ".join(f"w{made.randrange(3000)}" for _ in range(size))) for i in range(100)]
    items, missed = leaks.Items(rows), []
    for i, t in rows:
        part = t.split()
        for at in sorted(made.sample(range(size), int(rate * size)), reverse=True):
            part[at : at + 1] = made.choice([[], ["zz"], [part[at], "yy"]])
        text = [f"x{made.randrange(99)}" for _ in range(made.randrange(60))] + part + ["end"] * made.randrange(60)
        found = {items.items[n][0]: d for n, _, _, d in items.find(" ".join(text))}
        if found.get(i, size + 1) > int(rate * size):
            missed.append(i)
    assert not missed


def test_band_equals_whole():
    made = random.Random(2)
    for _ in range(3000):
        a, b = ([made.choice("abc") for _ in range(made.randint(1, 12))] for _ in range(2))
        s, most = made.randrange(len(b)), made.randint(0, 5)
        d, end = leaks.best_end(a, b, s, most)
        assert leaks.within(a, b, s, most) == ((d, end) if d <= most else None), (a, b, s, most)


def test_item_with_null_id_is_cleaned(spark):
    docs = spark.createDataFrame([(1, "here a b c d e f there"), (2, "other text")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c d e f")], "item_id long, text string")
    assert [r.doc_id for r in leaks.clean(docs, bench).collect()] == [2]
    assert [(r.doc_id, r.item_id, r.distance) for r in leaks.find(docs, bench).collect()] == [(1, None, 0)]


def test_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long = "filler words go on " * 60_000 + item
    rows = [(1, item, 5), (1, item, 5), (2, long, None), (None, item, 1), (3, None, 2), (4, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, distance long")
    bench = spark.createDataFrame([(7, item, "x"), (7, item, "y"), (8, item.upper(), None)], "item_id long, text string, word_start string")
    out = sorted((r.doc_id or 0, r.item_id, r.distance) for r in leaks.find(docs, bench).collect())
    each = [(7, 0), (7, 0), (8, 0)]
    assert out == sorted((d, *e) for d in (0, 1, 1, 2) for e in each)
    assert sorted(r.doc_id for r in leaks.clean(docs, bench).collect()) == [3, 4]
    assert leaks.clean(docs, bench).columns == docs.columns


def test_large_vocabulary():
    """Numbers of words far apart don't overflow the hashes."""
    numbers = leaks.np.array([2**40, 2**40 - 1, 1, 2**40, 2**40 - 1, 1], leaks.np.int64)
    codes = leaks.Items.codes_of(numbers, 3)
    assert codes[0] == codes[3] and len(set(codes.tolist())) == 3


def test_tables_find_what_a_lossless_search_finds(spark):
    """Each window that the q-gram bound opens is compared with every item of its length: the tables lose none of those."""
    from heatline.llm.common import table

    sf = "/root/testdata/sf0.01"
    items = leaks.Items([(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()])
    want, got = {}, {}
    for r in table(spark, sf, "documents").select("doc_id", "text").collect():
        ids = [items.number.get(w, 0) for w in leaks.words(r.text)]
        got |= {(r.doc_id, n): d for n, _, _, d in items.find(r.text)}
        for size, starts in items.windows(leaks.np.array(ids, leaks.np.int64)).items():
            for n, own in enumerate(items.ids):
                if len(own) == size:
                    near = [x[0] for s in starts if (x := leaks.within(own, ids, s, items.most[n]))]
                    if near:
                        want[r.doc_id, n] = min(near)
    assert got == want and len(want) > 10
