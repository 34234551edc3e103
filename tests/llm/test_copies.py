"""SimHash links, line dedup and benchmark leaks against brute force."""

import random

import pytest
from xxhash import xxh64_intdigest

from heatline.llm import leaks, lines, simhash
from heatline.llm.common import Scratch


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(nodes, near):
    """Union-find over all pairs."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_fingerprint():
    for t in [None, "", " \t\n", "One", "one  two", "A bÉ c d e f", "x " * 9000, " a b c"]:
        assert simhash.fingerprint(t) % (1 << 64) == plain_print(t), t


def test_masks_cover_every_pair():
    for radius in (1, 2):
        ms = simhash.masks(radius)
        assert len(ms) == 2 ** (radius + 1) - 1
        for i in range(64):
            for j in range(i, 64):
                if radius == 2 or i == j:
                    assert any(not (1 << i | 1 << j) & (m % (1 << 64)) for m in ms)


@pytest.mark.parametrize("small", [1, 32])
@pytest.mark.parametrize("radius", [1, 2])
def test_components_equal_brute_force(spark, monkeypatch, small, radius):
    monkeypatch.setattr(simhash, "SMALL", small)
    made = random.Random(small + radius)
    prints = set()
    while len(prints) < 300:
        x = made.getrandbits(64)
        for _ in range(made.randint(1, 12)):
            prints.add(x - (1 << 64) if x >> 63 else x)
            for _ in range(made.randint(1, 3)):
                x ^= 1 << made.randrange(64)
    nodes = dict(enumerate(sorted(prints, key=lambda p: made.random())))
    want = classes(list(nodes), lambda a, b: bin((nodes[a] ^ nodes[b]) % (1 << 64)).count("1") <= radius)
    scratch = Scratch(spark, "test")
    found = simhash.components(simhash.links(spark.createDataFrame(list(nodes.items()), "node long, fp long"), scratch, radius), scratch)
    got = {n: n for n in nodes} | {r.node: r.component for r in found.collect()}
    assert got == want


def test_near_duplicates_rows(spark):
    a, b = "the quick brown fox jumps over the lazy dog " * 30, "other words are in this text and they are many more " * 20
    rows = [(5, a, "fp"), (3, a, "fp"), (9, b, "q"), (7, None, None), (8, "", None), (None, a, "z"), (11, "only two", "r"), (5, b, "x")]
    out = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()]
    assert len(out) == 8
    assert (None, f"{plain_print(a):016x}", None) in out and (7, "0" * 16, 7) in out and (8, "0" * 16, 7) in out
    # an id with two texts ties their groups
    assert {(d, c) for d, _, c in out if d in (3, 5, 9, 11)} == {(3, 3), (5, 3), (9, 3), (11, 11)}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        then = [i]
        for j, y in enumerate(b, 1):
            then.append(min(row[j] + 1, then[j - 1] + 1, row[j - 1] + (x != y)))
        row = then
    return row[-1]


def brute_lines(docs, near):
    seen, out = [], {}
    for key, text in sorted(docs.items()):
        if text is None:
            out[key] = None
            continue
        kept = []
        for line in text.split("\n"):
            w = line.split()
            gone = bool(w) and any(w == o or len(w) >= near and len(o) >= near and word_distance(w, o) <= 1 for o in seen)
            if w:
                seen.append(w)
            if not gone:
                kept.append(line)
        out[key] = "\n".join(kept)
    return out


def test_lines_equal_brute_force(spark):
    made = random.Random(8)
    pool = [[made.choice("abcdefg") * made.randint(1, 2) for _ in range(made.choice([1, 2, 4, 5, 6, 7, 9, 30]))] for _ in range(25)]

    def line():
        w = list(made.choice(pool))
        for _ in range(made.choice([0, 0, 1, 1, 2])):
            k, i = made.randrange(3), made.randrange(len(w) + 1)
            if k == 0:
                w.insert(i, made.choice("abcz"))
            elif w and i < len(w):
                w[i : i + 1] = [made.choice("xyz")] if k == 1 else []
        return made.choice(["", " "]) + "  ".join(w)

    docs = {i: "\n".join(line() for _ in range(made.randint(0, 12))) for i in range(90)} | {90: None, 91: "", 92: "\n\n", 93: "w " * 20000}
    df = spark.createDataFrame([(k, v, "r", k) for k, v in docs.items()], "doc_id long, text string, row string, pos long").repartition(5)
    out = lines.dedup(df)
    assert out.columns == ["doc_id", "text", "row", "pos", "n_dropped"]
    assert {r.doc_id: r.text for r in out.collect()} == brute_lines(docs, lines.NEAR_WORDS)


def test_lines_edges(spark):
    rows = [(1, "same line here\nother"), (1, "same line here\nother"), (None, "same line here")]
    out = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, "same line here"), (1, ""), (1, "other")]
    assert lines.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_clashing_names_and_files(spark, tmp_path):
    rows = [(1, "a b\na  b\n\tc", 7, 1, "x"), (2, "a b", 8, 2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_dropped long, f long, _metadata string")
    with pytest.raises(ValueError):
        lines.dedup(df)
    df.write.parquet(f"{tmp_path}/d")
    for out in (lines.dedup(df, count_col=None), lines.dedup(spark.read.parquet(f"{tmp_path}/d"), from_files=True, count_col=None)):
        assert out.columns == df.columns
        assert sorted(map(tuple, out.collect())) == [(1, "a b\n\tc", 7, 1, "x"), (2, "", 8, 2, "y")]
    assert "k1" in lines.dedup(df, count_col="k1").columns


def test_leaks_equal_brute_force(spark):
    made = random.Random(4)
    vocabulary = ["w%d" % i for i in range(60)]
    items = {i: [made.choice(vocabulary) for _ in range(made.choice([3, 7, 12, 25, 40, 60]))] for i in range(25)}
    docs = {}
    for d in range(160):
        w = [made.choice(vocabulary) for _ in range(made.randint(0, 150))]
        if d % 2:
            part = list(items[made.randrange(25)])
            for _ in range(made.randint(0, int(len(part) * 0.25) + 1)):
                k, i = made.randrange(3), made.randrange(len(part))
                part[i : i + 1] = [[], ["zz"], [part[i], "yy"]][k]
                if not part:
                    break
            i = made.randint(0, len(w))
            w[i:i] = part
        docs[d] = w

    def nearest(item, text):
        most = int(0.2 * len(item))
        return min((leaks.best_end(item, text, s, most)[0] for s in range(len(text))), default=len(item)), most

    want = {(d, i) for d, t in docs.items() for i, x in items.items() if (m := nearest(x, t))[0] <= m[1]}
    bench = spark.createDataFrame([(i, " ".join(x).upper()) for i, x in items.items()] + [(90, None), (91, ""), (92, "...")], "item_id long, text string")
    df = spark.createDataFrame([(d, ", ".join(t)) for d, t in docs.items()] + [(900, None), (901, "")], "doc_id long, text string")
    out = leaks.find(df, bench)
    got = {(r.doc_id, r.item_id) for r in out.collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 50
    assert {(r.doc_id, r.item_id) for r in leaks.find(df, bench, block=10).collect()} == got
    left = {r.doc_id for r in leaks.clean(df, bench).collect()}
    assert left == {*docs, 900, 901} - {d for d, _ in got}
    assert leaks.find(df, bench.limit(0)).count() == 0 and leaks.find(df.limit(0), bench).count() == 0


def test_banded_distance():
    made = random.Random(1)
    for _ in range(300):
        a, b = ([made.choice("ab") for _ in range(made.randint(0, 9))] for _ in range(2))
        for most in (0, 1, 3):
            assert leaks.distance(a, b, most) == min(word_distance(a, b), most + 1)
