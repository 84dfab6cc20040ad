"""Importance resampling against loops."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm import importance


def grams(text, lo=1, hi=1):
    low = (text or "").translate(str.maketrans(importance.UPPER, importance.LOWER))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + n]) for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=10, min_words=20, lo=1, hi=1, buckets=10_000, seed="2024"):
    at = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(at(g) for _, x in docs for g in grams(x, lo, hi)[1]), Counter(at(g) for x in target for g in grams(x, lo, hi)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for d, x in docs:
        w, own = grams(x, lo, hi)
        total = sum(math.floor(1000 * math.log((t[at(g)] + 1) * (big_s + buckets) / ((s[at(g)] + 1) * (big_t + buckets)))) for g in own)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = total // len(own) if own else 0
        out.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize(("lo", "hi", "percent", "buckets"), [(1, 1, 10, 10_000), (1, 3, 50, 97), (2, 2, 100, 10)])
def test_ranks_are_those_of_loops(spark, odd, odd_rows, lo, hi, percent, buckets):
    more = [(i, " ".join(f"W{i * k % 23} é{k % 5}" for k in range(i)), "en", "s", 1) for i in range(20, 60)]
    docs = odd.union(spark.createDataFrame(more, odd.schema)).withColumn("rank", F.lit("x")).withColumn("buckets", F.lit(1)).withColumn("SCORE", F.lit(1))
    target = ["w3 w4 é2 w5", None, "", "w6 é1 w7\x00w8"]
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    options = {"percent": percent, "shortest": lo, "longest": hi, "buckets": buckets}
    got = [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in importance.ranked(docs, goal, **options).collect()]
    want = brute([(r[0], r[1]) for r in odd_rows + more], target, percent, 20, lo, hi, buckets)
    assert sorted(r[:4] for r in got if r[0] is not None) == sorted(r[:4] for r in want if r[0] is not None)
    assert Counter(map(str, got)) == Counter(map(str, want))
    drawn = importance.resample(docs, goal, **options)
    assert drawn.columns == docs.columns and {r["doc_id"] for r in drawn.collect()} == {r[0] for r in want if r[4] and r[0] is not None}


def test_empty_tables(spark, odd, none):
    empty = spark.createDataFrame([], "text string")
    assert importance.ranked(none, empty).count() == 0
    got = importance.ranked(odd, empty).collect()
    assert len(got) == odd.count() and all(r["weight"] <= 0 or r["n_features"] for r in got)
    assert importance.ranked(odd, empty, percent=0).where("rank is not null").count() == 0


def test_query(spark, odd, odd_rows, monkeypatch):
    monkeypatch.setattr(importance, "table", lambda s, d, name: odd)
    got = importance.op12_importance_resampling(spark, "")
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(str(tuple(r)) for r in got.collect()) == Counter(map(str, brute([r[:2] for r in odd_rows], [r[1] for r in odd_rows])))
