"""Periodic runs against the definition, word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import periodic


def brute(w):
    """Runs of w by trying every period at every place."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[: len(w) - q])


def contract(doc_id, text):
    """op13's row by loops."""
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n_},{q}\n" for s, n_, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.integers(1, 9)), max_size=6), max_size=5))
def test_runs_are_those_of_the_definition(docs):
    plain = [[x.encode() for part, k in d for x in part * k] for d in docs]
    counts, runs, collapsed = periodic._slice([b" ".join(d) for d in plain]) if plain else ([], [], [])
    for d, n, r, c in zip(plain, counts, runs, collapsed, strict=True):
        assert n == len(d) and r == brute(d)
        assert all(smallest_period(d[s : s + k]) == q for s, k, q in r)
        gone = {i for s, k, q in r for i in range(s + q, s + k)}
        assert c == b" ".join(x for i, x in enumerate(d) if i not in gone)


def test_runs_in_texts_of_every_length():
    rng = random.Random(5)
    for n in [*range(1, 40), 500, 3001]:
        for k in (1, 2, 5, 40):
            own = [f"w{rng.randrange(k)}" for _ in range(rng.randint(1, max(1, n // 5)))]
            d = [rng.choice("xyz") for _ in range(rng.randint(0, 9))] + (own * (n // len(own) + 1))[:n] + [rng.choice("xyz") for _ in range(rng.randint(0, 9))]
            assert periodic._slice([" ".join(d).encode(), b"", b" ".join([b"q"] * n)])[1] == [brute(d), [], brute("q" * n)]


@pytest.mark.parametrize("s", ["", "a", "aaaa", "abab", "abcabcab", "aabaab"])
def test_z_function(s):
    want = [0] * len(s)
    for i in range(1, len(s)):
        while i + want[i] < len(s) and s[want[i]] == s[i + want[i]]:
            want[i] += 1
    assert periodic.z_function(list(s)).tolist() == want


def test_long_periods_and_one_word(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 10**6, 9000).astype(str).tolist()
    text = " ".join(["u"] * 5 + base * 4 + base[:17] + ["v"] + ["z"] * 60_000)
    assert periodic._slice([text.encode()])[1] == [[(5, 36017, 9000), (36023, 60000, 1)]]


def test_query_over_odd_rows(spark, odd, none, odd_rows, monkeypatch):
    more = [(i, " ".join(random.Random(i).choice(["a", "b", "cc é"]) for _ in range(i)), "en", "s", 1) for i in range(60, 130)]
    docs = odd.union(spark.createDataFrame(more, odd.schema)).withColumn("runs", odd.text.substr(1, 1)).withColumn("n_words", odd.n_chars)
    monkeypatch.setattr(periodic, "table", lambda *a: docs)
    got = periodic.op13_periodic_runs(spark, "").collect()
    rows = [(r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) for r in got]
    assert sorted(rows, key=str) == sorted((contract(r[0], r[1]) for r in odd_rows + more), key=str)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in more) > 3
    monkeypatch.setattr(periodic, "table", lambda *a: none)
    assert periodic.op13_periodic_runs(spark, "").count() == 0
    out = periodic.with_runs(docs)
    assert [f.name for f in out.schema][-3:] == ["n_words", "runs", "collapsed"] and out.count() == docs.count()
