"""Polls stored as one change: what is in force after each, after a loss between any two writes, and after time has passed."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postforge.operators import lifecycle, normalize
from postforge.sources.store import Store
from postforge.streaming import intake

NOW = dt.datetime(2024, 5, 1)
LANDED = "source_name string, source_id string, arrival long, title string, company string, location string, description string, apply_url string"
TEXT = "Responsibilities: build and run the data platform with the team. Requirements: five years of experience with pipelines and storage."


class Lost(Exception):
    pass


def landed(spark, rows, source="Lever:acme"):
    """rows: (source_id, title, place, url), in order of arrival."""
    data = [(source, i, k, t, "Acme", place, TEXT if "closed" not in t else "This job is no longer available. " + TEXT, url) for k, (i, t, place, url) in enumerate(rows)]
    df = spark.createDataFrame(data, LANDED).withColumns({"source_url": F.col("apply_url"), "fetched_at": F.lit(NOW), "posted_at": F.lit(NOW - dt.timedelta(days=3)), "deadline": F.lit(None).cast("timestamp"), **{c: F.lit(None).cast("string") for c in ("employment_type", "work_mode", "salary_currency")}, **{c: F.lit(None).cast("double") for c in ("salary_min", "salary_max")}})
    out = normalize.normalize(df)
    more = {"id": intake.raw_id(F.col("source_name"), F.col("source_id")), "rank": F.lit(80), "source_type": F.lit("ATS"), "source_reliability": F.lit(0.9), "source_url_key": F.lit(None).cast("string"), "posting_id_key": F.lit(None).cast("string"), "salary_min": F.col("salary_min").cast("long"), "salary_max": F.col("salary_max").cast("long")}
    return out.withColumns(more)


FIRST = [("a", "Data Engineer", "Bonn, DE", "https://x.example/1"), ("b", "Data Engineer", "Bonn, DE", "https://x.example/2"), ("c", "Night Nurse", "Graz, AT", "https://x.example/3"), ("d", "Head Cook", "Oslo, NO", "https://x.example/3"), ("e", "", "Oslo, NO", "https://x.example/5"), ("f", "Gardener", "Rome, IT", "https://x.example/6")]
SECOND = [("a", "Senior Data Engineer", "Bonn, DE", "https://x.example/1"), ("c", "Night Nurse closed", "Graz, AT", "https://x.example/3"), ("g", "Gardener", "Rome, IT", "https://x.example/6"), ("g", "Gardener", "Rome, IT", "https://x.example/66")]


def state(store):
    m = {r["source_id"]: (r["canonical_id"], r["removed_at"] is None, r["is_primary"], r["matched_by"]) for r in store.read("mapping").collect()}
    c = {r["id"]: (r["title"], r["status"], r["dead_signal_at"] is not None) for r in store.read("canonical").collect()}
    runs = {r["id"]: tuple(r[k] for k in intake.COUNTS) for r in store.read("run").collect()}
    return m, c, runs


def two_polls(spark, root, lost=None, monkeypatch=None):
    store = Store(spark, str(root), intake.tables(2), keep=20)
    calls = []

    def counted(f):
        def g(*args):
            calls.append(f)
            if len(calls) == lost:
                raise Lost
            return f(*args)

        return g

    def go():
        intake.poll(store, landed(spark, FIRST), "Lever:acme", 0, NOW, True, True)
        intake.poll(store, landed(spark, SECOND), "Lever:acme", 1, NOW + dt.timedelta(days=1), True, True)

    if lost:
        with monkeypatch.context() as m:
            m.setattr(store, "_write", counted(store._write))
            m.setattr(store, "_publish", counted(store._publish))
            with pytest.raises(Lost):
                go()
    go()
    return store


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    return two_polls(spark, tmp_path_factory.mktemp("whole"))


def test_what_is_in_force(whole):
    m, c, runs = state(whole)
    assert set(m) == set("abcdfg") and len(c) == 3
    assert m["a"][0] == m["b"][0] and m["b"][3] == "duplicateCluster" and m["c"][0] == m["d"][0] and m["d"][3] == "applyUrlKey" and m["f"][0] == m["g"][0]
    assert [m[k][1] for k in "abcdfg"] == [True, False, False, False, False, True]
    assert m["a"][2] and m["g"][2] and not any(m[k][2] for k in "bcdf")
    titles = {k: c[m[k][0]] for k in "acg"}
    assert titles["a"][0] == "Senior Data Engineer" and titles["c"][1:] == ("EXPIRED", True) and titles["g"][1:] == ("LIVE", False)
    # fetched accepted rejected | raw created updated | canonical created updated | deduped | mapping created updated removed | live stale expired removed
    assert runs == {"Lever:acme:0": (6, 5, 1, 6, 0, 3, 2, 2, 5, 0, 0, 3, 0, 0, 0), "Lever:acme:1": (4, 2, 1, 1, 2, 0, 2, 1, 1, 1, 3, 2, 0, 1, 0)}
    assert whole.read("eligibility").count() == 3 and whole.read("raw").count() == 7


def test_losing_any_write_changes_nothing(spark, tmp_path, monkeypatch, whole):
    want = state(whole)
    for lost in (9,):  # in the second poll: there are six writes in each, of five tables and the list
        assert state(two_polls(spark, tmp_path / str(lost), lost, monkeypatch)) == want


def test_a_poll_counts_once_and_another_source_finds_its_rows(spark, whole):
    before = state(whole)
    assert intake.poll(whole, landed(spark, FIRST), "Lever:acme", 1, NOW, True, True) is None
    assert state(whole) == before
    intake.poll(whole, landed(spark, [("z", "Gardener", "Rome, IT", "https://x.example/6")], "Board:x"), "Board:x", 0, NOW + dt.timedelta(days=1), False, True)
    m, c, runs = state(whole)
    assert m["z"][0] == m["g"][0] and len(c) == 3 and m["a"] == before[0]["a"] and runs["Board:x:0"][:11] == (1, 1, 0, 1, 0, 0, 1, 1, 1, 0, 0)


def test_refreshing_what_is_due_equals_scoring_everything(spark, whole):
    for days in (2, 31.01, 400):
        now = NOW + dt.timedelta(days=days)
        intake.refresh(whole, now)
        full = lifecycle.score(whole.read("canonical"), whole.read("mapping"), F.lit(now).cast("timestamp"))
        want = {r["id"]: (r["status"], r["availability_score"]) for r in full.collect()}
        assert {r["id"]: (r["status"], r["availability_score"]) for r in whole.read("canonical").collect()} == want
    assert intake.refresh(whole, NOW + dt.timedelta(days=400.5)) is None
