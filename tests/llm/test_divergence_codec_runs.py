"""Divergence against SQL, the codec against the tokenizers library, runs against brute force; odd rows for each."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from heatline.llm import bpe, divergence, queries, runs

SF = "/root/testdata/sf0.001"


def in_sql(name, docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    return sorted(con.sql(queries.oracle_sql()[name]).fetchall())


def test_divergence_equals_dense_sums(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(tuple, divergence.audit(docs).collect())) == in_sql("op11_divergence", docs)


def test_divergence_of_odd_rows(spark):
    made = random.Random(3)
    words = ["Ab", "aB", "Σ", "σ", "x1y", "𝔘n", "é", "\x00z", "w-w", "K"]
    rows = [(i, " ".join(made.choices(words, k=made.randrange(9))), made.choice(["en", "de", None, ""]), made.choice(["s1", "s2", None, "ﬀ", "𝔘", "s9"]), "clash") for i in range(120)]
    rows += [(7, "Ab ab", "en", "s1", "x")] * 30 + [(i, None, "it", f"t{i}", None) for i in range(3)] + [(None, "one two", "fr", "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, digest string")
    found = sorted(map(tuple, divergence.audit(docs).collect()))
    assert found == in_sql("op11_divergence", docs)
    assert {r[4] for r in found if r[0] == "it"} == {0}  # no kept term: every pair of sources is there, with nothing
    assert divergence.audit(docs.limit(0)).count() == 0
    kept = divergence.GATHERED, divergence.FITS
    try:
        divergence.GATHERED, divergence.FITS = 5, 0  # counts passed on early; merge joins of the groups
        assert sorted(map(tuple, divergence.audit(docs).collect())) == found
    finally:
        divergence.GATHERED, divergence.FITS = kept


def ids(coded):
    return np.frombuffer(coded, "<u4").tolist()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bpe.FILE))


def odd_texts(made, n):
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    pieces = [" ", "  ", "\n", "\t", "the", "'s", "12", "!", "ß", " a", "\x1c", "\x85", "　", "<|endoftext|>", "<|endo", "漢字"]
    for _ in range(n):
        yield "".join(made.choices("ab", k=made.randrange(80)))
        yield "".join(made.choices(pieces, k=made.randrange(20)))
        yield made.choice(["a", "ab", "the", "=", " ", "\n", "0", "é", "漢字", "aab"]) * made.randrange(300)
        yield "".join(chr(made.choice(points)) for _ in range(made.randrange(30)))


def test_trees_give_the_ids_of_the_library(library):
    import public_tokenizers

    texts = list(odd_texts(random.Random(4), 1500))
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for leaf in (3, 16, bpe.LEAF):
        own = bpe.Codec(public_tokenizers.path(bpe.FILE), leaf)
        for text, want in zip(texts, wanted):
            assert ids(own.encode(text)) == want, text
            assert own.decode(own.encode(text)) == library.decode(want, skip_special_tokens=False) == text
    assert own.decode(np.array([128, 64], "<u4").tobytes()) == library.decode([128, 64], skip_special_tokens=False)


def test_every_token_is_its_own_encoding():
    own = bpe.codec()
    assert all(own.piece(w) == [i] for i, w in enumerate(own.words) if w not in {m.encode() for m in own.marks})


@pytest.mark.parametrize("spread", [40, bpe.SPREAD])
def test_encoding_over_the_cluster(spark, library, spread):
    made = random.Random(6)
    texts = [None, "", " ", "a" * 700, "x " + "ab" * 500 + " y <|endoftext|>" + "é" * 90 + "\n" * 200 + " end", "a.b" * 100, "<|endoftext|>" * 5, "12" * 400 + "'s"]
    texts += [t for t in odd_texts(made, 60)] + ["a" * 700] * 3
    docs = spark.createDataFrame([(i % 200, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, ids string, digest string")
    found = bpe.decode(bpe.encode(docs, leaf=8, spread=spread)).collect()
    assert len(found) == len(texts)
    assert sorted((r.doc_id, r.decoded) for r in found) == sorted((i % 200, t or "") for i, t in enumerate(texts))
    wanted = sorted((i % 200, len(e.ids)) for i, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)))
    assert sorted((r.doc_id, r.n_tokens) for r in found) == wanted
    both = bpe.encode(docs, leaf=8, spread=spread, decoded_col="back")
    assert sorted((r.doc_id, r.n_tokens, r.back) for r in both.collect()) == sorted((r.doc_id, r.n_tokens, r.decoded) for r in found)
    assert bpe.encode(docs.limit(0)).count() == 0


def test_digests_of_the_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    for r in queries.op12_bpe(spark, SF).collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert tuple(r)[1:] == (len(want), sha(np.array(want, "<u4").tobytes()), sha(library.decode(want, skip_special_tokens=False).encode()))


def brute(words, least, times):
    found = set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.add((i, j + q - i, q))
            i = j + 1
    smallest = {r for r in found if not any(s <= r[0] and s + n >= r[0] + r[1] and q < r[2] and r[2] % q == 0 for s, n, q in found)}
    return sorted((r for r in smallest if r[1] >= max(least, times * r[2])), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    made = random.Random(5)
    for _ in range(1200):
        words = [made.randrange(made.choice([1, 2, 2, 3, 5])) for _ in range(made.randrange(90))]
        if len(words) > 5 and made.random() < 0.6:
            a, p = made.randrange(len(words)), made.randrange(1, max(2, len(words) // 3))
            words = words[:a] + [words[a + (i - a) % p] if a + (i - a) % p < i else words[i] for i in range(a, len(words))]
        for least, times in ((24, 3), (6, 2), (4, 3), (1, 2), (10, 4)):
            assert runs.find(words, least, times) == brute(words, least, times)
    assert runs.find([i % 4000 for i in range(13000)]) == [(0, 13000, 4000)]
    assert runs.find(list(range(13000))) == []


def test_run_report(spark):
    made = random.Random(8)
    texts = [None, "", " \x0b\n ", "w " * 23, "w " * 24, "a b c " * 30, " ".join(made.choices("abcd", k=3000)), "x " * 50 + "y z " * 40]
    rows = [(i * 37, t, "clash") for i, t in enumerate(texts * 20)] + [(None, "w " * 30, "clash"), (0, "w " * 30, "clash"), (0, "w " * 30, "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for key, text, _ in rows:
        words = (text or "").translate({i: 32 for i in range(9, 14)}).split(" ")
        words = [w for w in words if w]
        n, h = len(words), zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        found = brute(words, 24, 3)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else None
        numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((key, len(found), *numbers, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, runs.report(docs).collect()), key=order) == sorted(want, key=order)
    assert sum(r[1] > 0 for r in want) > 40
    assert runs.report(docs.limit(0)).count() == 0
