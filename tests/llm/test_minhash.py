import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import graph, minhash

from .conftest import prose


def components(rows):
    """By comparing all pairs of full sets."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.setdefault(d, []).append(s)
    ids = [d for d in sets if d is not None]
    up = {d: d for d in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    flat = [(d, s) for d in ids for s in sets[d] if s]
    for i, (a, s) in enumerate(flat):
        for b, t in flat[:i]:
            if 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sorted(((d, len(s), find(d) if d is not None else None, d is None or find(d) == d) for d in sets for s in sets[d]), key=repr)


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=repr)


def chains(seed, n):
    """Copies of copies: neighbours are linked, ends are far apart; and documents that share a passage only."""
    rng = random.Random(seed)
    rows, shared = [], prose(rng, 40)
    for c in range(4):
        w = prose(rng, 80).split()
        for _ in range(n):
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
            w[rng.randrange(len(w))] = f"edit{len(rows)}"
    rows += [(5000 + i, shared + " " + prose(rng, 60)) for i in range(30)]
    return rows


def test_odd_documents(spark, odd_rows):
    rows = [r[:2] for r in odd_rows]
    assert got(spark, rows) == components(rows)


def test_chains(spark):
    rows = chains(5, 25)
    assert got(spark, rows) == components(rows)


@pytest.mark.parametrize("block", [150, 1000])
def test_split_families_lose_no_link(spark, monkeypatch, block):
    rows = chains(6, 20)
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", block)
    monkeypatch.setattr(minhash, "HUBS", 2)
    assert got(spark, rows) == components(rows)


def test_a_large_group_has_few_edges(spark):
    """Near copies of one text share most bands with one another; the edges must grow with the group, not with its pairs or bands."""
    rng = random.Random(4)
    base, rows = prose(rng, 120).split(), []
    for i in range(500):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    sig = minhash.sketch(spark.createDataFrame(rows, "doc_id long, text string")).select(F.col("doc_id").alias("cid"), "bytes", "bands")
    edges = minhash.near_edges(sig)
    assert edges.count() < 6 * len(rows)
    assert {r["label"] for r in graph.components(edges).collect()} == {0}


def test_split_buckets(spark, monkeypatch):
    rows = chains(7, 20)
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 10)
    want = components(rows)
    assert got(spark, rows) == want


def test_split_buckets_with_an_unlike_hub(spark, monkeypatch):
    """A passage that many unlike documents share, and two that are little more than it: all their common bands are hot."""
    rng = random.Random(3)
    shared = prose(rng, 60)
    rows = [(i, f"{shared} {prose(rng, 55)}") for i in range(400)] + [(1000 + i, f"{shared} {prose(rng, 8)}") for i in range(2)]
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 1)
    want = components(rows)
    assert (1001, 64, 1000, False) in want
    assert got(spark, rows) == want


def test_empty_and_columns(spark, none, odd):
    assert minhash.near_duplicates(none).count() == 0
    extra = odd.withColumnsRenamed({"source": "kept", "lang": "label", "n_chars": "component_id"})
    out = minhash.keep_one(extra)
    assert out.columns == extra.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert -5 in ids and 1 not in ids and 2 not in ids and ids.count(None) == 2 and ids.count(7) == 2


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    b = np.concatenate([a[:3000], np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64))])
    x, y = minhash.signatures([a, b])
    assert abs((x == y).mean() - 0.6) < 0.12


def test_components_of_odd_graphs(spark):
    edges = [(5, 5), (None, 3), (4, None), (9, 2), (2, 9), (9, 7), (100, 1), (100, 50), (50, 60), (60, 3)] + [(1000, 1001 + i) for i in range(40)] + [(2000 + i, 2500) for i in range(40)]
    want = {2: 2, 7: 2, 9: 2, 1: 1, 3: 1, 50: 1, 60: 1, 100: 1} | {n: 1000 for n in range(1000, 1041)} | {n: 2000 for n in [*range(2000, 2040), 2500]}
    assert {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    for n, m in ((60, 40), (60, 90)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        up = list(range(n))

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
        nodes = {x for a, b in edges if a != b for x in (a, b)}
        assert {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()} == {x: find(x) for x in nodes}


def test_components_of_a_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["label"] for r in graph.components(edges).collect()} == {0}
    assert graph.components(edges.limit(0)).count() == 0
