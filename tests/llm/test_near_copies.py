"""The pipeline's near-duplicate stage against brute-force pairs."""

import importlib
import random

import pytest
from test_copies import classes

from heatline.llm import copies
from heatline.llm.common import table


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


@pytest.mark.parametrize("small", [1, 32])
def test_stage_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(copies, "SMALL", small)
    made, texts = random.Random(3), {}
    for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect():
        texts[r.doc_id] = r.text
        for k in range(made.choice([0, 0, 1, 3])):  # changed words, on both sides of the bound; a passage in common
            w = (r.text or "").split()[:400]
            for _ in range(int(len(w) * made.choice([0.01, 0.02, 0.025, 0.03, 0.06]))):
                w[made.randrange(len(w))] = f"w{made.randrange(10**6)}"
            texts[10_000 + 10 * r.doc_id + k] = " ".join(w)
    base = [f"v{i}" for i in range(204)]
    for k in range(60):  # one large group: single changes, and a chain
        texts[90_000 + k] = " ".join(base[:k] + ["new"] + base[k + 1 :])
        texts[91_000 + k] = " ".join(f"c{i}" for i in range(10 * k, 10 * k + 100))
        texts[92_000 + k] = " ".join([*(f"p{k}_{i}" for i in range(k)), *base[:30], str(k)])
    texts |= {95_000: None, 95_001: "", 95_002: " \n", 95_003: "Two words", 95_004: "two  words"}
    sets = {k: plain_set(t) for k, t in texts.items()}
    want = {n for n, c in classes(list(sets), lambda a, b: alike(sets[a], sets[b])).items() if n == c}
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    got = importlib.import_module("corpus_pipeline").drop_copies(spark, docs, "")
    assert {r.doc_id for r in got.collect()} == want
    exact = len({frozenset(s) for s in sets.values()})
    assert len(want) < exact - 100  # most of what goes is no exact copy


def test_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    docs = spark.createDataFrame([(5, a), (3, a), (9, b + " end"), (None, a), (5, b), (11, "x")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in copies.near_duplicates(docs).collect()} == {(3, 3), (5, 3), (9, 3), (11, 11)}
    assert copies.near_duplicates(docs.limit(0)).count() == 0
