"""Search: stems as published, the index after changes against one made anew, hits against a loop."""

import re

import pytest
from pyspark.sql import functions as F

from postforge.functions import rules as R
from postforge.operators import searching
from postforge.sources.store import Store

#: Words and their published stems.
KNOWN = """consign consign consigned consign consigning consign consignment consign consistency consist consolation consol conspiracy conspiraci knackeries knackeri kneeling kneel knightly knight knots knot
generously generous generate generat communication communic engineers engin engineering engin developer develop nurses nurs sales sale management manag analytics analyt happy happi cry cri by by say say boy boy
enjoyed enjoy hopping hop hoping hope falling fall agreed agre feed feed skies sky dying die relational relat rational ration ties tie cries cri gas gas gaps gap kiwis kiwi luxuriated luxuri sized size aging age
bed bed replacement replac cement cement adoption adopt yes yes youth youth flying fli controlling control probate probat rate rate cease ceas sensibility sensibl technologies technolog business busi
proceed proceed outings outing nationally nation vietnamization vietnam operator oper hopefulness hope formality formal sensitivity sensit formative format goodness good dependent depend news news only onli"""

SCHEMA = "id long, title string, company string, role_family string, location string, extra int"
JOBS = [
    (1, "Senior Engineers of Sales", "Acme", "SWE", "Bonn", 1),
    (2, "Nurse", "Engineering Partners", None, "Graz", 1),
    (3, None, None, None, None, 1),
    (4, "", "", "", "", 1),
    (5, "the of and", "Été Énergie", "Sales", "Sales", 1),
    (6, "sales " * 5000 + "engine", "R2D2s", "x", "y", 1),
    (7, "Nurse", "Engineering Partners", None, "Graz", 1),
]


def stems(words):
    return words.select("word", searching.stem(F.col("word")).alias("stem"))


def test_stems(spark):
    pairs = list(zip(KNOWN.split()[::2], KNOWN.split()[1::2], strict=True))
    got = dict(stems(spark.createDataFrame([(a,) for a, _ in pairs], "word string")).collect())
    assert got == dict(pairs)
    odd = dict(stems(spark.createDataFrame([("",), ("a",), ("r2d2s",), ("énergies",), ("y" * 3000,)], "word string")).collect())
    assert odd[""] == "" and odd["a"] == "a" and odd["r2d2s"] == "r2d2s" and odd["énergies"] == "énergi" and len(odd["y" * 3000]) == 3000


def loop(spark, rows, query):
    """id to rank of rows that every word of the query hits."""
    stem = lambda ws: dict(stems(spark.createDataFrame([(w,) for w in sorted(ws)], "word string")).collect())
    cut = {r[0]: [(w, n) for text, n in zip(r[1:5], R.SEARCH_WEIGHTS.values(), strict=True) for w in re.findall(r"[^\W_]+", (text or "").lower()) if w not in R.SEARCH_STOP_WORDS] for r in rows}
    asked = [w for w in re.findall("[a-z0-9]+", query.lower()) if w not in R.SEARCH_STOP_WORDS]
    known = stem({w for ws in cut.values() for w, _ in ws} | set(asked))
    best = {i: [max((n for w, n in ws if known[w].startswith(known[a])), default=None) for a in asked] for i, ws in cut.items()}
    return {i: sum(b) for i, b in best.items() if None not in b}


@pytest.mark.parametrize("query", ["engineers", "the engineer sale", "nurses", "eng acme", "r2d2s", "sal"])
def test_hits(spark, query):
    jobs = spark.createDataFrame(JOBS, SCHEMA)
    hits = searching.search(searching.terms(jobs), jobs, query)
    assert hits.columns == [*jobs.columns, "rank"]
    assert {r["id"]: r["rank"] for r in hits.collect()} == loop(spark, JOBS, query) != {}


def test_no_hits_and_no_words(spark):
    jobs, none = spark.createDataFrame(JOBS, SCHEMA), spark.createDataFrame([], SCHEMA)
    found = lambda on, q: sorted((r["id"], r["rank"]) for r in searching.search(searching.terms(on), on, q).collect())
    assert found(jobs, "ngineering") == [(2, 0), (7, 0)]
    assert found(jobs, "of") == [(1, 0), (5, 0)]  # a stop word alone: no terms, so what holds it
    assert found(jobs, "") == found(jobs, " !? ") == found(none, "sales") == []


def test_refresh_equals_a_new_index(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"terms": searching.table(4)})
    of = lambda df: sorted(tuple(r) for r in df.where("term IS NOT NULL").select("id", "term", "weight").collect())
    now = {r[0]: r for r in JOBS}
    searching.refresh(store, spark.createDataFrame(JOBS, SCHEMA), stream="s", number=0)
    for n, change in enumerate([[(1, "Cook", "Acme", None, None, 1), (8, "Cook", "Bistro", None, None, 1)], [(2, None, "", None, None, 1)], [(5, "x", "y", "z", "w", 1)]], start=1):
        for _ in range(2):  # a repeated batch changes nothing
            searching.refresh(store, spark.createDataFrame(change, SCHEMA), stream="s", number=n)
        now.update({r[0]: r for r in change})
        assert of(store.read("terms")) == of(searching.terms(spark.createDataFrame(list(now.values()), SCHEMA)))
    plan = store.read("terms").where("term LIKE 'coo%'")._jdf.queryExecution().toString()
    assert "StringStartsWith(term,coo)" in plan
