import pytest
from pyspark.sql import functions as F

from postforge.functions import salary, text, urls
from postforge.operators.pages import json_ld, links, posting


def one(spark, make, *values):
    """The expression's value over constants."""
    return spark.range(1).select(make(*[F.lit(v) for v in values]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("make", "value", "want"),
    [
        (text.entity_key, "  Maple & Sons, Ltd. ", "maple-and-sons-ltd"),
        (text.entity_key, "", ""),
        (text.title_core_key, "Senior Data Engineer II (Remote)", "data-engineer-remote"),
        (text.title_core_key, "Sr. Intern", ""),
        (text.location_key, "Toronto, ON; Remote / New  York", "new-york|on|toronto"),
        (text.description_fingerprint, "The <b>Data</b> data team builds data pipelines with care", "data-builds-pipelines-care"),
        (text.sanitize, "A &amp;lt; B &lt;b&gt;<br>x<p>y</p>\n\n\n\nz", "A &lt; B\nx\ny\n\nz"),
        (text.clean_company, "Company 12 - Globex (Canada) Holdings Ltd.", "Globex"),
        (text.clean_company, "Inc", ""),
        (text.company_key, "Acme & Co.", "acmeand"),
        (text.region, "Lausanne", "US"),
        (text.region, "North America", "CA"),
        (text.region, "Toronto, ON, CA", "CA"),
        (text.region, "Remote - EMEA", None),
        (text.region, "Anywhere", "CA"),
        (text.region, "Boise, ID", "US"),
        (text.region, None, None),
        (text.label, "AUTO_SUBMIT_READY", "Auto Submit Ready"),
        (urls.identity_key, "https://Boards.Greenhouse.io/Acme//Jobs/12/?utm=1&gh_jid=9&JobId=3", "boards.greenhouse.io/acme/jobs/12?JobId=3".lower() + "&gh_jid=9"),
        (urls.identity_key, "not a url", None),
        (urls.stable_id, " ab!C-1 ", "abc-1"),
        (urls.stable_id, "a1", None),
        (urls.metadata_id, '{"a":{"jobId":"x","n":[{"req_id":"REQ 77-1"}]},"id":"later-1"}', "later-1"),
        (urls.metadata_id, '{"id":5}', None),
        (urls.metadata_id, "not json", None),
        (urls.url_posting_id, "https://boards.greenhouse.io/acme/jobs/12345?gh_jid=777", "greenhouse:acme:777"),
        (urls.url_posting_id, "https://acme.wd5.myworkdayjobs.com/en-US/Site/job/X/Dev_R-1234", "workday:acme-wd5-myworkdayjobs-com:1234"),
        (urls.ats_match, "https://acme.wd5.myworkdayjobs.com/en-US/Site/job/X/Dev_R-1234", "workday/acme.wd5.myworkdayjobs.com/acme/site"),
        (urls.ats_match, "https://careers.example.com/search?q=x", "successfactors/careers.example.com"),
        (urls.ats_match, "https://example.com/jobs", None),
    ],
)
def test_text_functions(spark, make, value, want):
    assert one(spark, make, value) == want


def test_accents_are_no_word_letters(spark):
    assert one(spark, lambda c: text.matches(c, r"\blead\b"), "élead") is True
    assert one(spark, lambda c: text.matches(c, r"\b(préposé)\b"), "préposé") is False


def test_role_order_is_kept(spark):
    role = lambda t: one(spark, lambda c: text.role_profile(c)["role_family"], t)
    assert [role(t) for t in ("Solutions Architect Engineer", "Data Engineer", "Engineer", "Risk Manager", "Nurse")] == ["Solutions Architecture", "Data Engineering", "SWE", "Risk", None]


def test_intern_in_other_words_counts(spark):
    assert one(spark, lambda a, b, c: text.employment_type(a, b, c), "Analyst", "international team", None) == "INTERNSHIP"


@pytest.mark.parametrize(
    ("title", "description", "want"),
    [("VP of Sales", "", "EXECUTIVE"), ("Staff Engineer", "", "LEAD"), ("Senior Engineer", "", "SENIOR"), ("New Grad Engineer", "", "ENTRY"), ("Summer student", "", "ENTRY"), ("Intermediate Engineer", "", "MID"), ("Engineer", None, "UNKNOWN")],
)
def test_experience_level(spark, title, description, want):
    assert one(spark, text.experience_level, title, description, "FULL_TIME", "SWE") == want


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("Base salary: $90,000 - $120,000 per year", (90000, 120000, "USD")),
        ("Pay range 30 - 45 CAD per hour", (62400, 93600, "CAD")),
        ("We raised $50M in funding, salary unknown", None),
        ("compensation 100k to 150k", (100000, 150000, "USD")),
        ("Ten people work here", None),
        ("", None),
        (None, None),
    ],
)
def test_salary(spark, said, want):
    found = one(spark, lambda t: salary.from_text(t, F.lit(None).cast("string"), F.lit(None).cast("string")), said)
    assert (tuple(found) if found else None) == want


def test_short_summary(spark):
    got = one(spark, lambda d: text.short_summary(F.lit("Dev"), F.lit("Acme"), F.lit("REMOTE"), d), "ABOUT THE ROLE\n* You build things that last. And more.\nshort")
    assert got == "You build things that last. Remote-friendly."
    assert one(spark, lambda d: text.short_summary(F.lit("Dev"), F.lit("Acme"), F.lit("UNKNOWN"), d), "") == "Acme is hiring for Dev."


def test_junk_and_dead(spark):
    junk = lambda t, d: one(spark, lambda a, b, c: text.is_junk(a, b, c), t, d, "u")
    assert junk("Careers", "") and junk("Dev", "Access denied") and not junk("Dev", "Access denied. Requirements: two years")
    dead = one(spark, lambda a, b: text.dead_reason(a, b, F.lit(None).cast("timestamp"), F.current_timestamp()), "Dev", "Sorry, job not found")
    assert dead == "Explicit dead signal detected: job not found"


def test_stage_filter():
    assert text.stage_filter("mid, SENIOR,lead,none") == ["ASSOCIATE", "SENIOR_LEVEL"]
    assert text.stage_filter(None) == []


def test_page_readers(spark):
    html = '<a href="/jobs/1">x</a><a class=b href=\'/jobs/1\'>y</a><script type="application/ld+json">{"@type":"JobPosting","title":"Dev","hiringOrganization":{"name":"Acme"}}</script>'
    assert one(spark, links, html) == ["/jobs/1"]
    assert one(spark, lambda h: posting(json_ld(h)[0])["company"], html) == "Acme"


def test_rounding_and_tags(spark):
    assert one(spark, text.js_round, -2.5) == -2
    assert spark.range(1).select(text.tags(F.array(F.lit(" b"), F.lit("a"), F.lit("a "), F.lit(""))).alias("x")).first()["x"] == ["a", "b"]
