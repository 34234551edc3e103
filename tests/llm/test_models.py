"""Models: held-out accuracy, exact counts, exact top-k, token ids and packing."""

import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from heatline.llm import brown, licences, packing, quality, queries, topk

SF = "/root/testdata/sf0.001"


def test_packing_equals_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made = random.Random(2)
    texts = [None, "", " ", "a", "  two  spaces ", "line\n next", "tab\t x", "x  y", "end ", "<|endoftext|> in", "a  <|endoftext|>\n<|endoftext|><|endoftext |>", "it's 12 o'clock!!  \n\n ok", "é" * 5000]
    texts += ["".join(made.choices(["the", " ", "  ", "\n", "'s", "12", "!", "ß", " a", " ", "\t"], k=30)) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(df).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and r.length == 1 << r.bucket
        assert r.start == len(by.setdefault(r.doc_id, []))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by[r.doc_id] += r.ids
    for i, (t, e) in enumerate(zip(texts, own.encode_batch([t or "" for t in texts], add_special_tokens=False))):
        assert by[i] == [*e.ids, 1], t
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert packing.pack(df.limit(0)).count() == 0


def test_buckets_and_repeated_rows(spark, tmp_path, monkeypatch):
    rows = [(7, "a b c d e", "x"), (7, "a b c d e", "x"), (None, "w " * 9000, "y")]
    made = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, bucket string"), most=64)
    by = {}
    for r in made.collect():
        by.setdefault(r.doc_id, []).append((r.start, r.length))
    assert sorted(by[7]) == sorted(2 * [(0, 4), (4, 2)]) and sum(n for _, n in by[None]) == 9002
    packing.to_buckets(made, f"{tmp_path}/b")
    assert {(r.bucket, r.length) for r in spark.read.parquet(f"{tmp_path}/b").collect()} <= {(k, 1 << k) for k in range(7)}


def test_pieces():
    assert packing.pieces(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    for n in range(1, 300):
        assert sum(packing.pieces(n, 64)) == n


def rows_of(spark, n=300):
    made = random.Random(6)
    words = ["the", "of", "cat", "dog", "runs", "Sleeps", "é", *("r%d" % i for i in range(400))]
    texts = [" ".join(made.choices(words, weights=[60, 40, 20, 20, 10, 10, 5, *[1] * 400], k=made.randint(0, 60))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, ""), (None, "the unseen"), (5, texts[5])]


@pytest.mark.parametrize("head", [4, 50, 10_000])
def test_lm_base_scores_are_exact(spark, head):
    rows = rows_of(spark)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = {}
    for d, t in rows:
        if d is not None and not held(d):
            for w in [*(t or "").lower().split(), "\n"]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    out = brown.score(spark.createDataFrame(rows, "doc_id long, text string"), head=head, core=20, classes=5).collect()
    assert len(out) == len(rows)
    want = sorted((-1 if d is None else d, held(d), len((t or "").split()) + 1, sum(w in counts for w in [*(t or "").lower().split(), "\n"]), round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in [*(t or "").lower().split(), "\n"]), 6)) for d, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert all(r.train_tokens == n and r.score < 0 for r in out)


def plain_likelihood(pairs, of):
    """Log likelihood of class bigrams, up to what doesn't depend on the classes."""
    table = {}
    for a, row in enumerate(pairs):
        for b, n in enumerate(row):
            table[of[a], of[b]] = table.get((of[a], of[b]), 0) + n
    out, into = {}, {}
    for (a, b), n in table.items():
        out[a], into[b] = out.get(a, 0) + n, into.get(b, 0) + n
    log = lambda xs: sum(x * math.log(x) for x in xs if x)
    return log(table.values()) - log(out.values()) - log(into.values())


def test_exchange_ends_where_no_single_move_is_better():
    made = np.random.default_rng(5)
    pairs = made.poisson(3, (13, 13)) * made.integers(0, 2, (13, 13))
    of = [*brown.exchange(pairs, 4, 50).tolist(), 4]
    best = plain_likelihood(pairs, of)
    assert best > plain_likelihood(pairs, [*(i % 4 for i in range(12)), 4])
    for w in range(12):
        for k in range(4):
            assert plain_likelihood(pairs, [*of[:w], k, *of[w + 1 :]]) <= best + 1e-6


def test_further_words_get_the_best_class_and_scores_are_the_models(spark):
    """Classes and scores of all texts against a plain model: every head word outside the core is tried in each class."""
    rows = [(i, t) for i, t in rows_of(spark, 120) if i is not None]
    rows = list(dict(rows).items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    texts = [[w.encode() for w in (t or "").lower().split()] for d, t in rows if not held(d)]
    count = {}
    for t in texts:
        for w in [*t, brown.END]:
            count[w] = count.get(w, 0) + 1
    once, twice = (sum(n == k and w != brown.END for w, n in count.items()) for k in (1, 2))
    words = sorted(count, key=lambda w: (-count[w], w))
    core = [w for w in words if w != brown.END][:15]
    number = {w: i for i, w in enumerate(words)}
    number = {w: i for i, w in enumerate(words)}
    pairs = np.zeros((len(words), len(words)))
    for t in texts:
        for a, b in zip([brown.END, *t], [*t, brown.END]):
            pairs[number[a], number[b]] += 1
    small = np.zeros((16, 16))
    at = [core.index(w) if w in core else 15 for w in words]
    np.add.at(small, np.ix_(at, at), pairs)
    cluster = dict(zip(core, brown.exchange(small, 4, 8).tolist()))
    of = {w: cluster.get(w, 4) for w in words}
    for w in words:
        if w not in cluster and w != brown.END and count[w] > 1:
            tried = [plain_likelihood(pairs, [k if v == w else of[v] for v in words]) for k in range(4)]
            cluster[w] = tried
    scored = {r.doc_id: r for r in brown.score(docs, core=15, classes=4).collect()}
    one = np.eye(5)[[*(of[w] for w in core), 4]]
    got = brown.assign(docs.filter(~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))).select("text"), {w: of[w] for w in core}, number, one.T @ small @ one)
    for w, tried in cluster.items():
        if isinstance(tried, list):
            assert tried[got[w]] >= max(tried) - 1e-6
    # the end token's own class; 5: words seen once and unseen ones
    of = {w: 4 if w == brown.END else 5 if count[w] == 1 else got.get(w, of[w]) for w in words}
    moves, mass = np.zeros((6, 6)), np.zeros(6)
    for t in texts:
        for a, b in zip([brown.END, *t], [*t, brown.END]):
            moves[of[a], of[b]] += 1
    for w in words:
        mass[of[w]] += count[w]
    single = min(1, (2 * twice + 1) / (once + 1))
    whole = once + 1 + once * single
    share = (mass + 1) / (mass + 1).sum()
    for d, t in rows:
        want, before = 0.0, 4
        for w in [*(x.encode() for x in (t or "").lower().split()), brown.END]:
            k = of.get(w, 5)
            want += math.log10((moves[before, k] + share[k]) / (moves[before].sum() + 1)) + math.log10(count[w] / mass[k] if k < 5 else (single if w in count else once + 1) / whole)
            before = k
        assert abs(scored[d].score - want) < 1e-6, d


def test_lm_long_words_and_names(spark):
    rows = [(1, "x" * 50_000 + " a b", 1.0), (1, "a b", 2.0), (2, "a " * 30_000, 3.0)]
    out = brown.score(spark.createDataFrame(rows, "doc_id long, text string, score double")).collect()
    assert sorted(r.n_tokens for r in out) == [3, 4, 30_001] and all(r.score < 0 for r in out)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_lm_beats_the_base_on_held_out_documents(spark, sf):
    out = [r for r in queries.op3_brown(spark, f"/root/testdata/{sf}").collect() if r.held_out]
    n = sum(r.n_tokens for r in out)
    assert sum(r.score for r in out) / n > sum(r.base_score for r in out) / n + 0.2
    assert sum(r.score < r.base_score for r in out) <= len(out) // 20
    assert brown.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("head", [0, 7, 60, 10_000])
def test_lm_model_is_a_distribution(spark, head):
    """All one-word texts of known words and an unseen one, and the empty text: their probabilities are parts of one whole,
    for any size of the head."""
    rows = rows_of(spark, 80)
    words = sorted({w for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for w in (t or "").lower().split()})
    texts = [*words, "never-seen", ""]
    df = spark.createDataFrame(rows + [(None, w) for w in texts], "doc_id long, text string")
    out = [r for r in brown.score(df, head=head, core=20, classes=5).collect() if r.doc_id is None and r.n_tokens <= 2]
    assert len(out) >= len(texts) and 0 < sum(10**r.score for r in out) <= 1 + 1e-9


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score(docs, labels)
    assert out.count() == docs.count()
    got = out.filter("held_out").join(labels, "doc_id").collect()
    right = sum((r.predicted == 1) == (r.quality == 1) for r in got) / len(got)
    assert right > 0.93 and all(0 <= r.score <= 1 for r in got)


def test_quality_equals_plain_sums(spark):
    """Scores against the same model fitted in one place from the labelled rows."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: float(r.quality) for r in labels.filter("quality is not null").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    use = sorted(d for d in known if d in texts and zlib.crc32(str(d).encode()) % 4 != 2)
    x, y = np.array([quality.statistics(texts[d]) for d in use]), np.array([known[d] for d in use])
    far = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, x array<double>").select("i", (F.pmod(F.xxhash64("x"), F.lit(5)) == 0).alias("o"))
    other = np.array([r.o for r in far.orderBy("i").collect()])
    model = quality.Model(x.mean(0), np.maximum(x.std(0), 1e-6), None, None, None)
    f = model.features(x[~other])
    model.weights = np.linalg.solve(f.T @ f + quality.RIDGE * len(f) * np.eye(f.shape[1]) / quality.FEATURES, f.T @ y[~other])
    at = np.clip(((model.raw(x[other]) + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = sorted(set(at))
    model.edges = (np.array(bins) + 0.5) / quality.BINS * 2 - 0.5
    model.levels = np.clip(quality.isotonic(np.array([y[other][at == b].mean() for b in bins]), np.array([(at == b).sum() for b in bins])), 0, 1)
    got = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    want = dict(zip(texts, model.score(np.array([quality.statistics(t) for t in texts.values()]))))
    assert got.keys() == want.keys() and sum(abs(got[d] - want[d]) < 1e-3 for d in got) >= 0.99 * len(got)


def test_quality_long_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000, "s"), (2, "é" * 300_000, "t"), (3, "fine text here", "u")], "doc_id long, text string, score string")
    assert quality.score(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")).count() == 3


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", 1), (1, "a b c", 1), (None, None, 2), (2, "", 3)], "doc_id long, text string, x long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, none).collect()] == [0.5] * 4
    odd = spark.createDataFrame([(1, 1), (1, None), (1, 0), (None, 1), (2, 1)], "doc_id long, quality int")
    assert quality.score(docs, odd).count() == 4
    assert quality.good(docs, none).count() == 0
    assert quality.score(docs.limit(0), odd).count() == 0


def test_isotonic():
    out = quality.isotonic(np.array([0.1, 0.5, 0.3, 0.9, 0.8]), np.ones(5))
    assert np.allclose(out, [0.1, 0.4, 0.4, 0.85, 0.85])


@pytest.mark.parametrize("n,width,copies", [(700, 8, 0), (900, 4, 500)])
def test_topk_equals_sql(spark, tmp_path, n, width, copies):
    made = np.random.default_rng(n)
    x = made.normal(size=(n, width)).round(3)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(n + i, [0.5] * width) for i in range(copies)]
    rows += [(None, [1.0] * width), (10_000, None), (10_020, [float("nan")] * width), (10_040, [None] * width), (10_060, []), (10_080, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.coalesce(3).write.parquet(f"{tmp_path}/e")
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    want = sorted(db.sql(queries.OP7).fetchall())
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(spark.read.parquet(f"{tmp_path}/e"), block=30).collect() if r.query_id != 10_080)
    assert got == [w for w in want if w[0] != 10_080]
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["noise", "clusters", "copies"])
def test_cover_tree_invariants_and_search(kind, monkeypatch):
    monkeypatch.setattr(topk, "TREE", 30)  # several trees for the queries
    made = np.random.default_rng(3)
    x = np.floor(made.normal(size=(700, 6)) * 64)
    if kind == "clusters":
        x = np.floor((made.normal(size=(20, 6))[made.integers(0, 20, 700)] * 40 + made.normal(size=(700, 6))) * 64)
    if kind == "copies":
        x[200:] = x[made.integers(0, 40, 500)]
    tree = topk.CoverTree(x)
    far = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    levels = len(tree.scales)
    assert all(a >= 2 * b for a, b in zip(tree.scales, tree.scales[1:]))
    for level in range(levels):
        net = (tree.first <= level).nonzero()[0]  # nested: a net holds those above it
        assert (far[:, net].min(1) <= tree.scales[level] * (1 + 1e-9)).all()  # covering
        if level:
            apart = far[np.ix_(net, net)] + np.eye(len(net)) * 1e9
            assert (apart > tree.scales[level]).all()  # separation
            new = tree.entering(level)
            assert (tree.first[tree.parent[new]] < level).all()
            assert (far[new, tree.parent[new]] <= tree.scales[level - 1] * (1 + 1e-9)).all()
        assert (far[np.arange(700), tree.below[level]] <= tree.radius[level][tree.below[level]]).all()
        assert set(tree.below[level]) <= set(net)
    rest = tree.entering(levels)
    assert (far[rest, tree.parent[rest]] == 0).all() and (tree.first >= 0).all()
    ids, asked = np.arange(700), np.arange(0, 700, 7)
    searcher = topk.Searcher(ids[asked], x[asked], 9)
    for at in range(0, 700, 250):
        searcher.add(ids[at : at + 250], x[at : at + 250])
    scores = (x[asked] @ x.T).astype(int)
    want = [(n, s, i) for n, q in enumerate(asked) for s, i in [(-a, b) for a, b in sorted((-scores[n, i], i) for i in ids if i != q)[:9]]]
    b = searcher.best
    assert list(zip(b.query, b.score, b.of)) == want
    again = topk.Searcher(ids[asked], x[asked], 9, b.least, group=8)  # with true bounds from the start most pairs are never compared
    again.add(ids, x)
    assert list(zip(again.best.query, again.best.score, again.best.of)) == want
    if kind == "clusters":
        assert again.best.compared < 0.5 * scores.size


def test_topk_huge_parts_and_repeats(spark):
    rows = [(0, [1e30, 1.0], "x"), (20, [1.0, -1.0], "y"), (1, [1e30, 0.0], "z"), (2, [-1e30, 0.0], "z"), (3, [3e18, 0.5], ""), (4, [0.0, 2.0], ""), (4, [0.0, 2.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    exact = lambda a, b: max(-(2**63), min(2**63 - 1, sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b))))
    want = []
    for q, v, _ in rows:
        if q % 20 == 0:
            best = sorted((-exact(v, w), i) for i, w, _ in rows if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)


def test_licences(spark):
    rows = [(1, "junk line of words\nReleased under the MIT License.\nmore"), (2, "the software of the license in words"), (3, None), (4, ""), (5, "Licensed under CC BY-NC 4.0."), (6, "SPDX-License-Identifier: Apache-2.0"), (7, "this program ran under the terms we had"), (None, "This work is licensed under the GNU General Public License, version 3.")]
    rows += [(8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without any restriction.")]
    out = {(r.doc_id, r.paragraph, r.family) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(1, 1, "MIT"), (5, 0, "CC-BY-NC"), (6, 0, "Apache-2.0"), (None, 0, "GPL-3.0"), (8, 0, "MIT")}
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


WRAPPED = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""


def test_licences_wrapped_long_repeated(spark):
    long = "plain words of a text\n" * 30_000
    rows = [(1, "intro line\n" + WRAPPED + "\n\nend"), (1, "intro line\n" + WRAPPED + "\n\nend"), (2, long + "Licensed under the ISC License."), (3, WRAPPED.split("\n")[0])]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, family string")
    assert sorted((r.doc_id, r.paragraph, r.family) for r in licences.scan(df).collect()) == [(1, 1, "MIT"), (1, 1, "MIT"), (2, 30_000, "ISC")]


def test_similarity_equals_counting():
    made = random.Random(4)
    for _ in range(500):
        a, b = ([made.choice([b"a", b"b", b"c"]) for _ in range(made.randint(1, 14))] for _ in range(2))
        n = min(5, len(a), len(b))
        if n < min(5, len(a)):
            want = 0.0
        else:
            x, y = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a, b))
            want = max(len([t for t in x if t in y]) / len(x), len([t for t in y if t in x]) / len(y) if 2 * len(b) >= len(a) else 0)
        assert abs(licences.similarity(a, b) - want) < 1e-12


def test_licences_find_all_stated_in_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stated = {r.doc_id for r in docs.filter(F.col("text").rlike("(?m)^(Licensed|Released|This work is licensed) under .*(License|CC BY)[^\n]*$")).collect()}
    found = {r.doc_id for r in licences.scan(docs).collect()}
    assert found == stated and stated


@pytest.fixture(scope="module")
def licence_model():
    return licences.Classifier(["The harbour was quiet that morning.", "Prices rose by 3 percent in version after version."] * 20)


def test_licence_versions_and_identifiers(licence_model):
    one = lambda text: [r[1] for r in licence_model.scan(text)]
    by_version = {
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"], "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"], "This work is licensed under the GNU General Public License, version 7.": [],
        "Licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0"], "Licensed under the GNU Affero General Public License, version 2.": [], "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.": ["MPL-1.1"],
        "This library is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0"], "This library is licensed under the GNU Lesser General Public License.": ["LGPL"], "Licensed under CC BY 3.0.": ["CC-BY-3.0"], "Licensed under CC BY 4.0.": ["CC-BY"], "Licensed under CC BY-ND 4.0.": ["CC-BY-ND"],
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA"], "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": ["CC-BY-ND"], "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"], "Licensed under the Apache License, Version 3.0.": [],
        "SPDX-License-Identifier: BSD-2-Clause": ["BSD"], "SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0"], "SPDX-License-Identifier: LGPL-2.1-only": ["LGPL"], "SPDX-License-Identifier: EUPL-1.2": ["EUPL-1.2"], "SPDX-License-Identifier: Nobodys-1.0": [], "Licensed under the European Union Public Licence, version 1.1.": ["EUPL-1.1"], "Licensed under the BSD 2-Clause License.": ["BSD"],
    }
    assert {t: one(t) for t in by_version} == by_version
    assert [one(t) for t in ("Many lawyers wonder how the GNU General Public License would fare in court.", "She renewed her driving licence, version 3 of it.", "Version 2.0 of the paper", "")] == [[]] * 4


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 12, 30])
def test_licences_at_any_wrap_width(licence_model, width):
    """Each notice, wrapped, between prose lines without blank ones, by the line that it begins on; a line that is a whole
    statement of its own may be told apart from the rest."""
    for family, notices in licences.TEMPLATES.items():
        for text in notices:
            own = text.split()
            if len(own) < 14:
                continue
            wrapped = [" ".join(own[i : i + width]) for i in range(0, len(own), width)]
            rows = licence_model.scan("\n".join(["The boats came home late.", *wrapped, "Nobody had seen the lantern.", "", "The end."]))
            want = licences.settled(family, text)
            assert {r[1] for r in rows} == {want} and abs(rows[0][0] - 1) <= max(1, 4 // width), (width, text)


@pytest.mark.parametrize("family, k", [("MIT", 1), ("GPL-3.0", 1), ("BSD", 4), ("MPL-2.0", 1), ("LGPL", 1)])
def test_licence_statements_that_a_model_has_not_seen(family, k):
    """Left out of the templates: the right licence or none, never another family's."""
    notices = licences.TEMPLATES[family]
    model = licences.Classifier(["Plain prose."], licences.TEMPLATES | {family: notices[:k] + notices[k + 1 :]})
    assert {r[1] for r in model.scan(notices[k])} <= {family, licences.settled(family, notices[k])}


def test_licence_scan_of_many_short_lines(licence_model):
    import time

    began = time.time()
    assert licence_model.scan("\n".join(["and this", "permission notice", "shall be"] * 1500)) == []
    assert time.time() - began < 60
