import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postforge.operators import feed, ingestion, lifecycle, matching, network, reports, tracker
from postforge.sources import boards, tables
from postforge.streaming import ingest

NOW = dt.datetime(2024, 5, 1)


def ago(**k):
    return NOW - dt.timedelta(**k)


MAPPING = "id long, canonical_id long, source_name string, source_type string, source_reliability double, is_full_snapshot boolean, last_seen_at timestamp, removed_at timestamp, source_quality_rank int, created_at timestamp"
JOB = "id long, first_seen_at timestamp, last_seen_at timestamp, last_source_seen_at timestamp, last_confirmed_alive_at timestamp, deadline timestamp, dead_signal_at timestamp"


def python_score(job, maps):
    """An independent loop of the lifecycle rules."""
    hours = lambda t: (NOW - t).total_seconds() / 3600
    pick = lambda x, steps, other: next((v for a, v in steps if x <= a), other)
    active, gone = [m for m in maps if m[7] is None], [m for m in maps if m[7] is not None]
    seen = max([m[6] for m in active] + ([job[3]] if job[3] else []), default=None)
    alive = job[4]
    late = max([t for t in (seen, alive) if t], default=None)
    if (job[5] and job[5] <= NOW and (late is None or late <= job[5])) or (job[6] and (alive is None or job[6] >= alive)):
        return "EXPIRED", 0

    def ev(m):
        r = pick(hours(m[6]), [(12, 1), (48, 0.92), (168, 0.78), (336, 0.6), (720, 0.42), (1440, 0.24)], 0.12)
        s = m[4] * 55 * r + (6 * r if m[5] else 0)
        return max(0, s + {"ATS": 8 * r, "BOARD": 4 * r, "AGGREGATOR": -3 * (1 - r)}.get(m[3], 0))

    best = min(78, sum(sorted(map(ev, active), reverse=True)[:2]))
    latest = {}
    for m in sorted(gone, key=lambda m: m[0]):
        if m[2] not in latest or m[7] > latest[m[2]][7]:
            latest[m[2]] = m
    pen = sum(max(0, (m[4] * 22 + (12 if m[5] else 0) + {"ATS": 8, "BOARD": 4, "AGGREGATOR": -10}.get(m[3], 0)) * pick(hours(m[7]) / 24, [(2, 1), (7, 0.85), (21, 0.65), (45, 0.35)], 0.15)) for m in latest.values())
    pen = min(28 if active else 70, pen)
    n, days = len(active), (hours(alive) / 24 if alive else None)
    confirm = 0 if days is None else pick(days, [(1, 15), (3, 12), (7, 8), (14, 4), (30, 1)], 0)
    floor = 0 if days is None else pick(days, [(1, 72 if n else 56), (3, 60 if n else 48), (7, 48 if n else 30)], 0)
    old = pick(hours(job[1]) / 24, [(120, 0), (240, 4 if n <= 1 else 2), (365, 10 if n == 0 else 6)], 16 if n == 0 else 10)
    points = max(floor, min(100, max(0, int((best + min(12, max(0, n - 1) * 4) + confirm - old - pen + 0.5) // 1))))
    strong = any(hours(m[7]) / 24 <= 21 and m[5] and m[4] >= 0.8 and m[3] != "AGGREGATOR" for m in gone)
    return ("LIVE" if points >= 72 else "AGING" if points >= 48 else "STALE" if points >= 22 else "REMOVED" if n == 0 and strong else "EXPIRED"), points


def test_lifecycle_against_a_loop(spark):
    rng = random.Random(3)
    maybe = lambda p, t: t if rng.random() < p else None
    jobs, maps = [], []
    for i in range(150):
        jobs.append((i, ago(days=rng.randint(1, 500)), ago(days=1), maybe(0.3, ago(days=rng.randint(0, 40))), maybe(0.4, ago(hours=rng.choice([24, 72, 168, 5, 400]))), maybe(0.2, ago(days=rng.randint(-20, 20))), maybe(0.1, ago(hours=rng.randint(1, 300)))))
        for _ in range(rng.randint(0, 5)):
            maps.append((len(maps), i, rng.choice(["Lever:a", "Adzuna:b", "X:c"]), rng.choice(["ATS", "BOARD", "AGGREGATOR", "COMPANY_HTML"]), rng.choice([0.95, 0.82, 0.55]), rng.random() < 0.5, ago(hours=rng.choice([12, 13, 48, 49, 168, 720, 1440, 2000])), maybe(0.4, ago(days=rng.choice([2, 7, 21, 45, 46]))), 1, NOW))
    got = {r["id"]: (r["status"], r["availability_score"]) for r in lifecycle.score(spark.createDataFrame(jobs, JOB), spark.createDataFrame(maps, MAPPING), F.lit(NOW)).collect()}
    want = {j[0]: python_score(j, [m for m in maps if m[1] == j[0]]) for j in jobs}
    assert got == want
    assert all(0 <= s <= 100 for _, s in got.values())


def test_empty_snapshot_removes_all(spark):
    m = spark.createDataFrame([(1, "a", "S", None), (2, "b", "T", None)], "id long, source_id string, source_name string, removed_at timestamp")
    got = {r["id"]: r["removed_at"] for r in lifecycle.tombstones(m, spark.createDataFrame([], "source_id string"), "S", F.lit(NOW)).collect()}
    assert got[1] == NOW and got[2] is None


def test_round_robin_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abc"), float(rng.randint(0, 5))) for i in range(60)]
    buckets = {b: sorted((r for r in rows if r[1] == b), key=lambda r: (-r[2], r[0])) for b in "abc"}
    want = []
    while len(want) < 25:
        for r in sorted((b.pop(0) for b in buckets.values() if b), key=lambda r: (-r[2], r[0])):
            want.append(r[0])
    got = [r["id"] for r in network.balanced(spark.createDataFrame(rows, "id long, b string, p double"), "b", "p", "id", 25).collect()]
    assert got == want[:25]


def test_diversify_spreads_companies(spark):
    rows = [(1, i, f"Dev {i % 2}", "Acme" if i < 6 else f"C{i}", NOW, 50, ["Lever"]) for i in range(10)]
    got = [r["id"] for r in feed.diversify(spark.createDataFrame(rows, "viewer long, id long, title string, company string, posted_at timestamp, total int, families array<string>")).orderBy("position").collect()]
    assert sorted(got) == list(range(10)) and set(got[:5]) >= {6, 7, 8, 9}


def test_shared_counts_repeats_on_the_right(spark):
    assert spark.range(1).select(matching.shared(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("a"), F.lit("b")))).first()[0] == 2


def test_survivorship_keeps_known_values(spark):
    p = lambda *a: spark.range(1).select(matching.pick_text(*map(F.lit, a[:2]), F.lit(a[2]), ("Unknown",))).first()[0]
    assert [p("Acme", "Unknown", True), p("Unknown", "Acme", False), p("A", "B", True), p("A", "B", False), p("", " ", True)] == ["Acme", "Acme", "B", "A", ""]
    d = lambda a, b, c: spark.range(1).select(matching.pick_description(F.lit(a), F.lit(b), F.lit(c))).first()[0]
    assert d("x" * 100, "y" * 59, True) == "x" * 100 and d("x" * 100, "y" * 60, True) == "y" * 60


def test_best_match_prefers_keys(spark):
    cols = "id long, company_key string, title_key string, title_core_key string, description_fingerprint string, location_key string, role_family string, work_mode string, short_summary string, description string, posted_at timestamp, region string, apply_url_key string, duplicate_cluster_id string"
    known = spark.createDataFrame([(1, "acme", "dev", "dev", "a-b", "toronto", "SWE", "REMOTE", "", "", NOW, "CA", "u1", "c1"), (2, "acme", "dev-two", "dev-two", "", "x", "SWE", "REMOTE", "", "", NOW, "CA", "u2", "c2")], cols)
    new = spark.createDataFrame([(7, "acme", "dev", "dev", "a-b", "toronto", "SWE", "REMOTE", "", "", NOW, "CA", "u2", "c9"), (8, "acme", "dev", "dev", "a-b", "toronto", "SWE", "REMOTE", "", "", NOW, None, "u9", "c9"), (9, "unknown", "dev", "dev", "", "", "", "", "", "", NOW, None, None, "c1")], cols).withColumns({"source_url_key": F.lit(None).cast("string"), "posting_id_key": F.lit(None).cast("string")})
    maps = spark.createDataFrame([], MAPPING + ", apply_url_key string, source_url_key string, posting_id_key string, is_primary boolean")
    got = {r["new_id"]: (r["known_id"], r["how"]) for r in matching.best_match(new, maps, known).collect()}
    assert got == {7: (2, "applyUrlKey"), 8: (1, "similarity")}


def test_upper_median(spark):
    for values in ([5, 1, 3], [4, 1, 3, 2], [2, 2, 9, 1, 2]):
        got = reports.upper_median(spark.createDataFrame([(v,) for v in values], "v long").withColumnRenamed("v", "s"), "s").first()
        assert tuple(got) == (max(values), min(values), sorted(values, reverse=True)[len(values) // 2])


def test_pages_have_one_row_more_in_view(spark):
    df = spark.range(45)
    assert [r["has_next"] for r in feed.page(df, 2, F.col("id").asc()).collect()][:1] == [True]
    last = feed.page(df, 3, F.col("id").asc()).collect()
    assert [r["id"] for r in last] == list(range(40, 45)) and not last[0]["has_next"]


def payloads(spark, text, token="acme-labs"):
    return spark.createDataFrame([(token, text, NOW)], "token string, payload string, fetched_at timestamp_ntz")


@pytest.mark.parametrize(
    ("board", "text", "want"),
    [
        ("greenhouse", '{"jobs":[{"id":5,"title":"Dev","absolute_url":"http://u","company_name":"Acme","location":{"name":"Toronto"},"content":"c","first_published":"2024-01-02T00:00:00Z"}]}', {"source_id": "5", "location": "Toronto", "source_name": "Greenhouse:acme-labs"}),
        ("lever", '[{"id":"a","text":"Dev","categories":{"commitment":"Full-time","allLocations":["X ","X","Y"]},"workplaceType":"hybrid","createdAt":1700000000000,"salaryRange":{"min":1,"max":2,"currency":"CAD"},"descriptionPlain":"d","additionalPlain":" e "}]', {"company": "Acme Labs", "location": "X, Y", "employment_type": "FULL_TIME", "work_mode": "HYBRID", "description": "d\n\ne", "salary_max": 2.0}),
        ("recruitee", '{"offers":[{"id":1,"title":"Dev","status":"published","slug":"dev","hybrid":true,"locations":[{"city":"A","country":"B"},{"city":"A","country":"B"}]},{"id":2,"title":"No","status":"draft"}]}', {"source_id": "1", "location": "A, B", "work_mode": "HYBRID", "apply_url": "https://acme-labs.recruitee.com/o/dev"}),
        ("rippling", '[{"uuid":"r1","name":"Dev","url":"u","workLocation":{"label":"Remote (United States)"},"department":{"label":"Eng"}}]', {"location": "United States", "work_mode": "REMOTE"}),
        ("smartrecruiters", '{"content":[{"id":"s","name":"Dev","location":{"city":"A","country":"us","remote":true},"typeOfEmployment":{"label":"Permanent"}}]}', {"location": "A, us", "work_mode": "REMOTE", "employment_type": "FULL_TIME"}),
        ("workable", '{"name":"W","jobs":[{"title":"Dev","shortcode":"AB","remote":true},{"title":" "}]}', {"company": "W", "location": "Remote", "source_url": "https://apply.workable.com/acme-labs/j/AB/"}),
        ("jobicy", '{"jobs":[{"id":3,"jobTitle":"Dev","jobGeo":"Canada","annualSalaryMin":"100"},{"id":3,"jobTitle":"Dev","jobGeo":"Canada","annualSalaryMin":"100"}]}', {"source_id": "jobicy:3", "location": "Remote (Canada)", "salary_min": 100.0, "salary_currency": "USD"}),
        ("remoteok", '[{"legal":"x"},{"id":"9","position":"Dev","company":"C","epoch":1700000000,"description":"contract work"}]', {"source_id": "remoteok:9", "location": "Remote", "employment_type": "CONTRACT"}),
        ("remotive", '{"jobs":[{"id":1,"title":"Dev","company_name":"C","url":"u","salary":"$40k - $60k"}]}', {"salary_min": 40000.0, "salary_max": 60000.0, "salary_currency": "USD"}),
        ("themuse", '{"results":[{"id":1,"name":"Dev","company":{"name":"C"},"locations":[{"name":"Flexible / Remote"},{"name":"Austin, TX"}]}]}', {"location": "Hybrid/Remote (Austin, TX)", "work_mode": "HYBRID"}),
        ("adzuna", '{"results":[{"id":"1","title":"Dev","company":{"display_name":"C"},"salary_min":5,"salary_is_predicted":"1","contract_time":"full_time"},{"id":"2","title":"Dev","company":{"display_name":"TEKsystems c/o Allegis Group"}}]}', {"source_id": "adzuna:acme-labs:1", "salary_min": None, "employment_type": "FULL_TIME"}),
        ("himalayas", '{"jobs":[{"guid":"g","title":"Dev","locationRestrictions":["Canada","US"],"minSalary":10},{"guid":"g","title":"Dev"}]}', {"source_id": "himalayas:g"}),
        ("ashby", '<script>window.__appData = {"jobBoard":{"jobPostings":[{"id":"x","title":"Dev","locationName":"A","secondaryLocations":[{"locationName":"B"}],"workplaceType":"Remote","teamName":"T"}]}};</script>', {"location": "A, B", "work_mode": "REMOTE", "description": "Team: T", "source_url": "https://jobs.ashbyhq.com/acme-labs/x"}),
        ("workday", '{"jobPostings":[{"title":"Dev","externalPath":"/job/A/Dev_R-1","postedOn":"Posted 3 Days Ago","bulletFields":["R-1"]}]}', {"source_id": "R-1", "posted_at": dt.datetime(2024, 4, 28)}),
        ("usajobs", '{"SearchResult":{"SearchResultItems":[{"MatchedObjectDescriptor":{"PositionID":"P","PositionTitle":"Dev","OrganizationName":"O","DepartmentName":"D","PositionLocation":[{"CityName":"A","CountrySubDivisionCode":"VA"},{"LocationName":"B"},{"LocationName":"C"},{"LocationName":"E"}]}}]}}', {"company": "O (D)", "location": "A, VA; B; C (+1 more)"}),
    ],
)
def test_boards(spark, board, text, want):
    rows = boards.parse(payloads(spark, text), board).collect()
    assert len(rows) == 1
    assert {k: rows[0][k] for k in want} == want


def test_broken_payloads_have_no_postings(spark):
    for board in boards.BOARDS:
        for text in ("", "<html>", "{}", "[]", "null"):
            assert boards.parse(payloads(spark, text), board).count() == 0


def test_job_bank(spark, tmp_path):
    head = "WIC Job Location Snapshot ID\tJob Title\tCity\tProvince/Territory\tSalary Minimum\tSalary Maximum\tSalary Per\tEmployment Type\tEmployment Term Telework"
    rows = ["11\tCook\tRegina\tSK\t20\t25\tHour\tFull time\tYes", "12\t\tX\tY\tNA\tNA\tNA\tNA\tNA"]
    (tmp_path / "jb.csv").write_bytes(("﻿" + "\r\n".join([head, *rows]) + "\r\n").encode("utf-16-le"))
    got = boards.read_job_bank(spark, str(tmp_path / "jb.csv"), "2024-05-01 00:00:00").collect()
    assert [(r["source_id"], r["location"], r["salary_min"], r["salary_max"], r["work_mode"], r["employment_type"]) for r in got] == [("jobbank:11", "Regina, SK, Canada", 41600.0, 52000.0, "REMOTE", "FULL_TIME")]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "id long, v string")
    out = tables.upsert(old, new, ["id"])
    assert {tuple(r) for r in out.collect()} == {(1, "a", "kept"), (2, "d", "updated"), (3, "e", "created")}
    assert {tuple(r) for r in tables.insert_ignore(old, new.union(new.where("id = 9")), ["id"]).collect()} == {(3, "e")}


def test_survivors_do_not_depend_on_partitions(spark):
    rows = [(k, f"v{i}", i % 3) for k in (1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, v string, n int")
    for p in (1, 3, 8):
        assert {tuple(r) for r in tables.least(df.repartition(p), ["id"]).collect()} == {(1, "v0", 0), (2, "v0", 0)}
        assert {tuple(r) for r in tables.least(df.repartition(p), ["id"], ["n"]).collect()} == {(1, "v0", 0), (2, "v0", 0)}
    assert tables.least(df.select("id"), ["id"]).count() == 2


def test_uncalled_parts(spark):
    decided = spark.createDataFrame([(1, "obvious_dead_at_intake", 7), (2, "obvious_dead_at_intake", None), (3, "obvious_junk", 8), (4, None, 9), (5, "obvious_dead_at_intake", 7)], "id long, reject_reason string, previous long")
    assert [tuple(r) for r in ingestion.dead_on_arrival(decided).collect()] == [(7,)]
    jobs = spark.createDataFrame([(i, ago(days=9), ago(days=8), "old") for i in range(1, 6)], "id long, last_confirmed_alive_at timestamp, dead_signal_at timestamp, dead_signal_reason string")
    checks = spark.createDataFrame([(1, "ALIVE", None), (1, "DEAD", "gone"), (2, "ALIVE", None), (3, "SUSPECT", None), (4, "DEAD", "404"), (9, "DEAD", "x")], "canonical_id long, result string, reason string")
    got = {r["id"]: tuple(r)[1:] for r in tracker.merge_health(jobs, checks, F.lit(NOW)).collect()}
    assert got == {1: (NOW, NOW, "gone"), 2: (NOW, None, None), 3: (ago(days=9), ago(days=8), None), 4: (ago(days=9), NOW, "404")}
    titles = ["Summer intern", "Junior clerk", "Senior engineer", "VP of sales", "Cook"]
    posts = spark.createDataFrame([(i, t, "", None, "") for i, t in enumerate(titles)], "id long, title string, description string, employment_type string, role_family string")
    said = {v: {r["id"] for r in posts.where(feed.stage_is(v)).collect()} for v in ("INTERNSHIP", "SENIOR")}
    assert 0 in said["INTERNSHIP"] and 2 in said["SENIOR"] and not said["INTERNSHIP"] & said["SENIOR"]


def test_reports_are_files(spark, tmp_path):
    for _ in range(2):
        tables.write_report(spark.createDataFrame([(1, "a")], "n long, v string"), f"{tmp_path}/r")
    assert [tuple(r) for r in spark.read.schema("n long, v string").json(f"{tmp_path}/r").collect()] == [(1, "a")]


def test_windowed_activity_streams(spark, tmp_path):
    rows = [(i, NOW + dt.timedelta(hours=i), "view", 1.0) for i in range(48)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/e")
    s = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(f"{tmp_path}/e")
    q = ingest.activity(s).writeStream.outputMode("append").format("memory").queryName("acts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("acts").agg(F.sum("n")).first()[0] in (24, 48)
    spark.createDataFrame([*rows, rows[0]], "event_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/f")
    d = ingest.distinct_signals(spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(f"{tmp_path}/f"))
    d.writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 48
