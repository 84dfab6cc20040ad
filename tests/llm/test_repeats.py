"""Substring and suffix-array dedup against loops over all windows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from llm import substring, suffix

from .conftest import prose


def words_removed(rows, window=substring.WINDOW):
    """(doc_id, n_words, n_removed, kept) by a table of every window's smallest document."""
    low = lambda d: -(2**63) if d is None else d
    least = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, low(d)), low(d))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < low(d):
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def bytes_removed(rows, window=suffix.WINDOW):
    n, raw = {}, [(d, (t or "").encode()) for d, t in rows]
    for _, t in raw:
        for i in range(len(t) - window + 1):
            n[hash(t[i : i + window])] = n.get(hash(t[i : i + window]), 0) + 1
    out = []
    for d, t in raw:
        spans = []
        for i in range(len(t) - window + 1):
            if n[hash(t[i : i + window])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + window
                else:
                    spans.append([i, i + window])
        kept = suffix.rest_of(t, [tuple(s) for s in spans])
        out.append((d, len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def near_copies(seed, n, base_words=(60, 200)):
    rng = random.Random(seed)
    bases = [prose(rng, rng.randint(*base_words)).split() for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "edit"
        if rng.random() < 0.4:
            w = w[rng.randrange(20) :] + list(rng.choice(bases))[: rng.randint(20, 120)]
        rows.append((i, " ".join(w)))
    return rows


@pytest.fixture(params=["odd", "near", "shifted"])
def rows(request, odd_rows):
    if request.param == "odd":
        return [r[:2] for r in odd_rows]
    if request.param == "near":
        return near_copies(1, 120)
    rng = random.Random(2)  # one passage of exactly the window's length at every shift
    passage = prose(rng, substring.WINDOW)
    return [(i, prose(rng, i) + " " + passage + " " + prose(rng, 40)) for i in range(70)]


def got_words(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted((tuple(r) for r in substring.remove_repeats(df, digests=True).collect()), key=repr)


def test_substring_dedup(spark, rows):
    assert got_words(spark, rows) == words_removed(rows)


def test_a_common_line_is_spread(spark, monkeypatch):
    """A line of 30 words in ever different surroundings, and of 60 words in some: results as ever, and few rows meet under one anchor."""
    rng = random.Random(12)
    line, long = prose(rng, 30), prose(rng, 60)
    rows = [(i, f"{prose(rng, 30)} {line} {prose(rng, 30)}" + (f" {long}" if i % 40 == 0 else "")) for i in range(400)]
    assert got_words(spark, rows) == words_removed(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).withColumn("th", F.xxhash64("text"))
    held = substring.anchor_rows(docs)
    assert held.where("known").count() > 600
    assert held.groupBy("key").count().agg(F.max("count")).first()[0] <= 2 * substring.FEW
    monkeypatch.setattr(substring, "HELD", 200)
    assert got_words(spark, rows) == words_removed(rows)


def test_cover_meets_every_shift():
    c = set(substring.COVER)
    assert {(a - b) % substring.PERIOD for a in c for b in c} == set(range(substring.PERIOD))
    assert substring.GRAM == substring.WINDOW - substring.PERIOD + 1


def test_substring_texts_and_empty_table(spark, none, odd):
    assert substring.remove_repeats(none).count() == 0
    texts = {(r["doc_id"], r["n_words"]): r["text"] for r in substring.remove_repeats(odd.withColumnRenamed("source", "runs")).collect()}
    assert texts[(1, 150)] == "" and texts[(None, 0)] == "" and texts[(7, 1)] == "one"


def got_bytes(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffix, "table", lambda *a: df)
    return sorted((tuple(r) for r in suffix.op4_suffix_array_dedup(spark, "").collect()), key=repr)


def test_suffix_dedup(spark, rows, monkeypatch):
    assert got_bytes(spark, rows, monkeypatch) == bytes_removed(rows)


def test_split_collections_lose_nothing(spark, monkeypatch):
    rows = near_copies(3, 150)
    monkeypatch.setattr(suffix, "COLLECTION", 5)
    assert got_bytes(spark, rows, monkeypatch) == bytes_removed(rows)


def test_long_texts_go_in_pieces(spark, monkeypatch):
    rng = random.Random(4)
    a = prose(rng, 3000)
    rows = [(1, a), (2, prose(rng, 100) + a[5000:9000] + prose(rng, 100)), (3, prose(rng, 3000))]
    monkeypatch.setattr(suffix, "PIECE_BYTES", 3000)
    found = [x for raw in [[t.encode() for _, t in rows]] for x in suffix.anchors(raw)]
    windows = sum(int(c.sum()) for *_, c, _ in found)
    assert windows == sum(len(t.encode()) - suffix.WINDOW + 1 for _, t in rows)


def test_suffix_keeps_columns(spark, odd, none):
    extra = odd.withColumnsRenamed({"source": "runs", "lang": "th", "n_chars": "rest"})
    out = suffix.remove_repeats(extra)
    assert out.columns == extra.columns and out.count() == extra.count()
    assert {(r["doc_id"], r["text"]) for r in out.collect()} >= {(4, None), (5, ""), (1, ""), (12, "ONE")}
    assert suffix.remove_repeats(none).count() == 0
