"""The quality classifier: its vectors against loops, its scores on rows it wasn't fitted on."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import wordvectors

from .conftest import prose


def test_pieces():
    x, n = wordvectors.pieces(["Abc12 !?é".encode(), b"", b" \n", b"abc"])
    assert n.tolist() == [4, 0, 0, 1] and x.tolist() == [zlib.crc32(w) % wordvectors.SLOTS for w in (b"Abc", b"12", b"!?", "é".encode(), b"abc")]


def test_word_vectors_are_sums_over_the_surroundings(spark):
    rng = random.Random(2)
    docs = [" ".join(rng.choice("abcdefg,;") for _ in range(n)) for n in (0, 1, 2, 3, 7, 40)] + [None]
    at, sign = wordvectors.index_vectors()
    want = {}
    for t in docs:
        s = [zlib.crc32(w.encode()) % wordvectors.SLOTS for w in (t or "").split()]
        for i, own in enumerate(s):
            v = want.setdefault(own, [0] * wordvectors.DIM)
            for j in range(max(0, i - 2), min(len(s), i + 3)):
                for p, q in zip(at[s[j]], sign[s[j]], strict=True):
                    v[p] += int(q)
    got = wordvectors.word_vectors(spark.createDataFrame([(t,) for t in docs], "text string").repartition(3)).collect()
    assert {r["slot"]: list(r)[1:] for r in got} == want


@pytest.fixture(scope="module")
def corpus():
    """Prose, shouting, and one word over and over; labelled but for a few, each third text in three rows."""
    rng, docs, labels = random.Random(4), [], []
    for d in range(600):
        t, y = prose(rng, rng.randint(3, 80)), int(rng.random() < 0.7)
        if not y:
            t = t.upper().replace(" ", "!! ") if d % 2 else (t.split()[0] + " ") * 30
        docs += [(d, t)] * (3 if d % 3 == 0 else 1)
        if d % 10:
            labels.append((d, y, None))
    return docs, [*labels, (5, 7, None), (None, 1, 1), (6, None, 0), (10**9, 0, 0)]


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_labels(spark, corpus, monkeypatch):
    docs, labels = corpus
    tables = {"documents": spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")), "labels": spark.createDataFrame(labels, LABELS)}
    monkeypatch.setattr(wordvectors, "table", lambda s, d, name: tables[name])
    got = {r["doc_id"]: r for r in wordvectors.op11_quality_classifier(spark, "").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for d, r in got.items())
    held = [(got[d]["predicted"], y) for d, y, _ in labels if d in got and y in (0, 1) and got[d]["held_out"]]
    assert len(held) > 90 and sum(a == b for a, b in held) >= 0.97 * len(held)
    # what a held-out label says plays no part
    turned = [(d, 1 - y if d is not None and y in (0, 1) and zlib.crc32(str(d).encode()) % 4 == 2 else y, t) for d, y, t in labels]
    tables["labels"] = spark.createDataFrame(turned, LABELS)
    assert {r["doc_id"]: r["score"] for r in wordvectors.op11_quality_classifier(spark, "").collect()} == {d: r["score"] for d, r in got.items()}


def test_the_sample_is_bounded_and_does_not_depend_on_partitions(spark, corpus):
    docs, labels = corpus
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    vectors = wordvectors.unit_vectors(wordvectors.word_vectors(d))
    f = wordvectors.pooled([t.encode() for _, t in docs[:20]], vectors)
    a, b = (wordvectors.train(x, y, vectors, 80).scores(f).tolist() for x, y in ((d.repartition(1), lab), (d.repartition(5), lab.repartition(4))))
    assert a == b


def test_odd_rows(spark, odd, none, monkeypatch):
    labels = spark.createDataFrame([(1, 1, 0), (8, 1, 0), (9, 1, 0), (10, 0, 0), (13, 0, 0), (14, 0, 0), (11, 1, 0), (12, 0, 0), (15, 0, 0), (7, 1, 0)], LABELS)
    tables = {"documents": odd, "labels": labels}
    monkeypatch.setattr(wordvectors, "table", lambda s, d, name: tables[name])
    got = wordvectors.op11_quality_classifier(spark, "").collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (4, 5, 6)}) == 1
    tables["labels"] = labels.limit(0)
    assert {r["score"] for r in wordvectors.op11_quality_classifier(spark, "").collect()} == {0.5}
    tables["documents"] = none
    assert wordvectors.op11_quality_classifier(spark, "").count() == 0
    tables["labels"] = labels
    assert wordvectors.op11_quality_classifier(spark, "").count() == 0


def test_a_network_needs_both_classes():
    f = np.ones((8, 3))
    assert wordvectors.fit(f, np.ones(8, int)).scores(f).tolist() == [0.9] * 8
    assert wordvectors.fit(f * 0, np.array([0, 1] * 4)).scores(f).tolist() == [0.5] * 8
