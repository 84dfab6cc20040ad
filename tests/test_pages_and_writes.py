"""Pages, descriptions, résumés and writes on odd inputs: nulls, empty texts and tables, broken markup."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postforge.operators import cards, describe, discovery, ingestion, pages, reports, resume
from postforge.sources import boards, markup, tables

LISTS, DETAILS = "token string, html string, fetched_at timestamp_ntz", "url string, html string"
NOW = dt.datetime(2024, 5, 1)


@pytest.mark.parametrize("read", [markup.successfactors, markup.icims])
def test_broken_pages_have_no_postings(spark, read):
    lists = spark.createDataFrame([("jobs.x.com", None, NOW), ("jobs.x.com", "", NOW), ("jobs.x.com", "<tr class=\"data-row\"><a href=\"/jobs/12", NOW), (None, "<p>", NOW)], LISTS)
    assert read(lists, spark.createDataFrame([("u", None), (None, "<h1>")], DETAILS)).count() == 0
    assert read(lists.limit(0), spark.createDataFrame([], DETAILS)).count() == 0


def test_nested_tags_are_closed(spark):
    df = spark.createDataFrame([('<b class="d">a<b>c</b>d</b>e',), ('<b class="d">a<b>c',), ("none",), (None,)], "h string")
    assert [r[0] for r in df.select(markup.inside(F.col("h"), '<b class="d">', "b")).collect()] == ["a<b>c</b>d", None, None, None]


def test_company_sites_on_odd_pages(spark):
    kind = "token string, company string, url string, html string, fetched_at timestamp_ntz"
    graph = '<script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "A", "description": "d"}, {"@type": "Thing"}]}</script><script type="application/ld+json">[{"@type": "JobPosting", "title": "B", "description": "d"}]</script>'
    rows = [("t", "Co", "https://x.example/1", h, NOW) for h in (None, "", "<script type='application/ld+json'>{broken</script>", graph)]
    out = boards.company_site(spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)).collect()
    assert {(r["title"], r["company"], r["location"]) for r in out} == {("A", "Co", "Unknown"), ("B", "Co", "Unknown")}


def test_routes(spark):
    df = spark.createDataFrame([(None,), ("",), ("<a href='/jobs/1'>Open job</a>",), ("<p>Join our team</p>",)], "h string")
    got = [r["r"] for r in df.select(pages.route(F.col("h"), F.lit("https://x.example/")).alias("r")).collect()]
    assert [(r["route"], round(r["confidence"], 2)) for r in got[1:]] == [("UNKNOWN", 0.15), ("HTML_FALLBACK", 0.37), ("HTML_FALLBACK", 0.22)]


def test_line_differences_side_by_side(spark):
    rows = [(1, "a\nb\nc", "a\nx\nc\nd"), (2, None, "n"), (3, "same", "same"), (4, "x\ny", "x\nx\ny")]
    df = pages.line_diff(spark.createDataFrame(rows, "k long, left string, right string"), ["k"], rows=True)
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["k"], r["n"])):
        got.setdefault(r["k"], []).append((r["left"], r["right"], r["change"]))
    assert got[1] == [("a", "a", "equal"), ("b", "x", "changed"), ("c", "c", "equal"), (None, "d", "changed")]
    assert got[2] == [("", "n", "changed")] and got[3] == [("same", "same", "equal")]
    assert got[4] == [(None, "x", "changed"), ("x", "x", "equal"), ("y", "y", "equal")]
    many = "\n".join(f"line {i}" for i in range(3000))
    counts = pages.line_diff(spark.createDataFrame([(1, many, many.replace("line 7\n", "", 1))], "k long, left string, right string"), ["k"]).first()
    assert tuple(counts) == (1, 0, 1, 2999)


def test_descriptions(spark):
    df = spark.createDataFrame([(None,), ("",), ("short",)], "d string")
    assert [r[0] for r in df.select(describe.best(F.array("d"))).collect()] == [None, None, None]
    raw = 'var x = 1;\nwindow["az_details"] = {"description":"' + "A fine job. " * 15 + '"};\nsimilar jobs'
    assert spark.createDataFrame([(raw,)], "d string").select(describe.cleanup(F.col("d"))).first()[0] == ("A fine job. " * 15).strip()


def test_resumes(spark):
    df = spark.createDataFrame([(None,), ("",), ("Summary\nonly words",)], "t string")
    assert [r[0] for r in df.select(resume.sections(F.col("t"))).collect()] == [None, {}, {"summary": "only words"}]
    assert [r[0] for r in df.select(resume.skills(F.col("t"))).collect()] == [[], [], ["Summary", "only words"]]
    held = spark.createDataFrame([(1, "Ann")], "user_id long, full_name string").withColumns({c: F.lit(None).cast("string") for c in resume.CONTACT[1:]})
    out = resume.merge_contact(held, held.limit(0)).first()
    assert out["full_name"] == "Ann" and out["added"] == [] and out["preserved"] == []


def test_reports_on_nothing(spark):
    none = spark.createDataFrame([], "v double")
    assert tuple(reports.upper_median(none, "v").first()) == (None, None, None)
    rows = spark.createDataFrame([(float(x),) for x in (5, 1, 4, 4, 2)], "v double")
    assert tuple(reports.upper_median(rows, "v").first()) == (5.0, 1.0, 4.0)
    names = spark.createDataFrame([("northwindtraders",), ("x",), ("acme",)], "key string")
    catalog = spark.createDataFrame([("Northwind", "northwind", 0, 1), ("Long", "thenorthwindtradersgroup", 1, 2), ("Acme", "acme", 2, 3)], "name string, alias_key string, ordinal int, bonus int")
    assert {r["key"]: r["catalog_name"] for r in reports.match_catalog(names, catalog).collect()} == {"northwindtraders": "Northwind", "x": None, "acme": "Acme"}
    assert reports.reason_counts(spark.createDataFrame([(None,), ("a",), ("a",)], "r string"), "r").first()["reasons"] == {"a": 2}


def test_promotion_without_a_preview(spark):
    rows = [("e", 1, 1, 5, 5), (None, None, None, None, None), (None, 3, 3, 1, 0), (None, 0, 0, 0, 0)]
    out = discovery.promotion(spark.createDataFrame(rows, "error string, accepted int, accepted_ca int, created int, created_ca int")).collect()
    assert [(r["promote"], r["reason"]) for r in out] == [(False, "e"), (False, "no_preview"), (True, "fully_canada_aligned"), (False, "insufficient_canada_weighted_yield")]


def test_json_merges(spark):
    rows = [(None, None), ('{"a": 1}', None), (None, '{"b": [1]}'), ('{"a": [1, {"x": 1}], "o": {"p": 1}}', '{"a": [{"x": 1}, 2], "o": {"q": 2}, "n": null}')]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(tables.merged_json("a", "b")).collect()]
    assert got == [None, '{"a": 1}', '{"b": [1]}', '{"a": [1, {"x": 1}, 2], "o": {"p": 1, "q": 2}}']


def test_labels(spark):
    df = spark.createDataFrame([(None, None, None), (0, 5000, "EUR"), (1234567, None, "JPY"), (10, 20, "CAD")], "a long, b long, c string")
    assert [r[0] for r in df.select(cards.salary_label(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["", "Up to €5,000", "JPY\u00a01,234,567+", "CA$10 - CA$20"]


def test_nothing_is_withdrawn_by_half_a_snapshot(spark):
    m = spark.createDataFrame([("a", "S", None), ("b", "S", None), ("c", "T", None)], "source_id string, source_name string, removed_at timestamp_ntz")
    seen = spark.createDataFrame([("a",)], "source_id string")
    ids = lambda *a: {r["source_id"] for r in ingestion.unseen(m, *a).collect()}
    assert ids(seen, "S", True, "FULL_SNAPSHOT") == {"b"} and ids(seen.limit(0), "S", True, "FULL_SNAPSHOT") == {"a", "b"}
    assert ids(seen, "S", False, "FULL_SNAPSHOT") == set() and ids(seen, "S", True, "INCREMENTAL") == set()


def test_lists_over_several_pages_are_followed(spark):
    job = lambda i: f'<script type="application/ld+json">{{"@type": "JobPosting", "title": "Job {i}", "description": "Do it all and more of it.", "url": "https://a.example/job/{i}"}}</script>'
    link = lambda to, text="Next page": f'<a href="{to}">{text}</a>'
    rows = [
        ("a", "https://a.example/jobs", job(1) + link("/jobs?p=2") + link("https://b.example/jobs", "next") + link("/about", "About us")),
        ("a", "https://a.example/jobs?p=2", job(2) + link("/jobs?p=3", "<b>Page 3</b>") + link("/jobs", "Older")),
        ("a", "https://a.example/jobs?p=3", job(3) + link("/jobs?p=2", "more") + link("/jobs?p=4")),
        ("a", "https://a.example/about", job(9)), ("a", "https://a.example/jobs?p=3", "zzz" + link("/lost")), ("a", "https://a.example/lost", job(8)),
        ("b", "https://b.example/jobs", job(7)), ("b", "https://a.example/jobs?p=2", None), (None, None, None),
    ]
    landed = spark.createDataFrame([(t, "Site", u, h, dt.datetime(2024, 5, 1)) for t, u, h in rows], "token string, company string, url string, html string, fetched_at timestamp")
    starts = spark.createDataFrame([("a", "https://a.example/jobs"), ("a", "https://a.example/jobs"), ("c", "https://c.example/")], "token string, url string")
    found = {r["url"].split("example")[1]: r["depth"] for r in pages.reached(starts, landed.repartition(3)).collect()}
    assert found == {"/jobs": 0, "/jobs?p=2": 1, "/jobs?p=3": 2}
    assert {r["url"] for r in pages.reached(starts, landed, 1).collect()} == {"https://a.example/jobs", "https://a.example/jobs?p=2"}
    lists = boards.site_listings(starts, landed)
    assert lists.count() == 3 and {r["title"] for r in boards.company_site(lists, landed.limit(0)).collect()} == {"Job 1", "Job 2", "Job 3"}
    assert pages.reached(starts.limit(0), landed).count() == 0 and pages.reached(starts, landed.limit(0)).count() == 0


def test_embedded_descriptions_and_labels_on_odd_texts(spark):
    say = lambda n, end="": '{"description": "' + "x" * n + end + '"}'
    mark = 'window["az_details"] = '
    cases = [
        ("a\n" + say(300) + mark + say(150), "x" * 150),  # the marked one, though shorter
        ("a\n" + say(300) + mark + say(100), "x" * 300),  # too short behind the marker
        ("a\n" + say(300) + mark + " " * 60000 + say(150), "x" * 300),  # too far behind it
        ("a\n" + say(130, "\nnext line"), "x" * 130 + "\nnext line"),  # a line break that JSON doesn't allow
        ("a\n" + say(10, '\\"q\\" ' * 30000), ("x" * 10 + '"q" ' * 30000).strip()),  # very long, with escapes
        ("", ""),
        (None, None),
    ]
    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, d string").select("i", describe.primary(F.col("d"))).collect()
    assert [r[1] for r in sorted(got)] == [c[1] for c in cases]
    lines = [
        ("• a\nWhat You’ll Do: build", "• a\nWhat You’ll Do:\nbuild"),  # an apostrophe doesn't count
        ("• a\nSkills, : x: y", "• a\nSkills, :\nx: y"),
        ("• a\nGrade: Salary: 5", "• a\nGrade: Salary: 5"),  # a value is no label
        ("• a\nBase salary: " + "y" * 220, "• a\nBase salary:\n" + "y" * 220),
        ("• a\nlower: x", "• a\nlower: x"),
    ]
    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(lines)], "i int, d string").select("i", describe._inline_headings(F.col("d"))).collect()
    assert [r[1] for r in sorted(got)] == [c[1] for c in lines]
