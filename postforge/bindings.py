"""Domain tables out of the driver's tables.

Each column is an expression that Spark SQL and other engines read alike, but for `ago(hours)`, a time so many hours
before AS_OF, which is filled in by dialect. The same text so serves the queries and the SQL that checks them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-11-05 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def _case(on: str, *values: str | None) -> str:
    return f"CASE {on} % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)) + " END"


TITLES = (
    "Senior Software Engineer", "Data Analyst II", "Executive Assistant", "Product Manager (Remote)", "Ingénieur logiciel", "Registered Nurse", "Sales Representative - Junior", "VP of Finance",
    "Machine Learning Engineer, Staff", "Summer Student Intern", "Risk & Compliance Officer", "Préposé aux commandes", "New Grad Developer", "Mid-level QA Tester", "Careers",
)
PLACES = (
    "Toronto, ON, CA", "Austin, TX, US", "Remote - EMEA", "North America", "Anywhere", "Unknown", "Lausanne", "Remote", "Montréal; Hybrid", "San Francisco / New York", "Paris", "Boise, ID", "Winnipeg, MB, CANADA",
)
COMPANIES = (
    "Acme Corp.", "Maple & Sons Ltd", "Company 12 - Northwind Inc", "Unknown", "Globex (Canada) Holdings Ltd.", "Blue Staffing Agency", "Initech", "Canada: Umbrella Incorporated Inc.", "Étoile Logiciels", "1234 Hooli LLC", "Initech LLC",
)
TEXTS = (
    "About the role. Base salary: $90,000 - $120,000 per year for the experienced developer.", "Pay range 30 - 45 USD per hour. Requirements include five years of data work.",
    "This job is no longer available. Thank you for your interest in our international team.", "Please sign in to continue.", "Flexible part-time contract with people management and great benefits for everyone in the office.",
    "Compensation 1.2M CAD market cap growth company valuation", "5+ years of leadership experience; write a cover letter; compensation 100k to 150k", "<p>Ship &amp; sell</p><ul><li>Travel arrangements</li></ul>",
)
URLS = (
    "https://boards.greenhouse.io/acme/jobs/12345?gh_jid=777&utm=x", "https://Jobs.Lever.co/Globex//abcd-1234/", "https://example.com/careers/apply?ref=1", "https://www.adzuna.com/land/ad/99?job_id=55", "https://jobs.smartrecruiters.com/Acme/7439990-dev", "", "https://www.jobbank.gc.ca/jobsearch/jobposting/31",
)
SOURCES = ("Greenhouse:acme", "Lever:globex", "Adzuna:ca", "BoardAggregator-X", "JobBank:31", "CompanySite:json", "PartnerAPI-Alpha", "Workday:initech", "SuccessFactors:umb")

#: name: (table, {column: expression}, condition)
BINDINGS: dict[str, tuple[str, dict[str, str], str]] = {
    "canonical": ("part", {
        "id": "p_partkey", "title": _case("p_partkey", *TITLES), "company": _case("(p_partkey * 7)", *COMPANIES), "location": _case("p_size", *PLACES), "description": _case("(p_partkey + p_size)", *TEXTS),
        "role_family": _case("p_size", "SWE", "Data Analyst", "Product Management", "Unknown", "Sales", "Administrative"), "region": _case("p_size", "US", "CA", None), "work_mode": _case("p_size", "REMOTE", "HYBRID", "ONSITE", "FLEXIBLE", "UNKNOWN"),
        "employment_type": _case("p_partkey", "FULL_TIME", "CONTRACT", "INTERNSHIP", None, "FULL_TIME"), "status": _case("(p_partkey * 3)", "LIVE", "AGING", "STALE", "EXPIRED", "LIVE", "LIVE", "REMOVED"),
        "availability_score": "CAST((p_partkey * 37) % 101 AS DOUBLE)", "salary_min": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(floor(p_retailprice * 40) AS BIGINT) END", "salary_max": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(floor(p_retailprice * 60) AS BIGINT) END",
        "posted_at": "ago((p_partkey * 7919) % 9600)", "first_seen_at": "ago((p_partkey * 7919) % 9600 + 24)", "last_source_seen_at": "CASE WHEN p_size % 4 = 0 THEN NULL ELSE ago((p_partkey * 131) % 3000) END",
        "last_confirmed_alive_at": "CASE WHEN p_size % 3 = 0 THEN ago((p_partkey * 17) % 900) END", "last_apply_check_at": "CASE WHEN p_size % 5 = 0 THEN ago((p_partkey * 29) % 500) END",
        "dead_signal_at": "CASE WHEN p_size % 11 = 0 THEN ago((p_partkey * 41) % 900) END", "deadline": "CASE WHEN p_size % 7 = 0 THEN ago((p_partkey * 53) % 2000 - 1000) END",
        "apply_url": _case("p_partkey", *URLS), "category": _case("p_size", "AUTO_SUBMIT_READY", "AUTO_FILL_REVIEW", "MANUAL_ONLY", None), "company_key": _case("(p_partkey * 7)", "acme", "maple", "northwind", "unknown", "globex", "blue", "initech", "umbrella", "", "hooli", "initech"),
    }, ""),
    "incoming": ("supplier", {
        "id": "s_suppkey", "title": _case("s_suppkey", *TITLES), "company": _case("(s_suppkey * 7)", *COMPANIES), "location": _case("s_nationkey", *PLACES), "description": _case("(s_suppkey + s_nationkey)", *TEXTS),
        "role_family": _case("s_nationkey", "SWE", "Data Analyst", "Product Management", "Unknown", "Sales", "Administrative"), "region": _case("s_nationkey", "US", "CA", None), "work_mode": _case("s_nationkey", "REMOTE", "HYBRID", "ONSITE", "FLEXIBLE", "UNKNOWN"),
        "employment_type": _case("s_suppkey", "FULL_TIME", "CONTRACT", "UNKNOWN", "UNKNOWN", "FULL_TIME"), "salary_min": "CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE CAST(s_suppkey * 1000 AS BIGINT) END", "salary_max": "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey * 1500 AS BIGINT) END",
        "posted_at": "ago((s_suppkey * 7919) % 9600)", "deadline": "CASE WHEN s_suppkey % 7 = 0 THEN ago((s_suppkey * 53) % 2000 - 1000) END", "apply_url": _case("s_suppkey", *URLS), "source_name": _case("s_suppkey", *SOURCES), "rank": "s_nationkey * 20",
        "company_key": _case("(s_suppkey * 7)", "acme", "maple", "northwind", "unknown", "globex", "blue", "initech", "umbrella", "", "hooli", "initech"),
    }, ""),
    "mapping": ("lineitem", {
        "id": "l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100", "canonical_id": "l_partkey", "source_name": _case("l_suppkey", *SOURCES), "source_id": "CAST(l_orderkey AS STRING)",
        "source_url": _case("l_orderkey", *URLS), "source_type": _case("l_suppkey", "ATS", "ATS", "AGGREGATOR", "COMPANY_HTML", "BOARD", "COMPANY_JSON"), "source_quality_rank": "CAST(l_quantity AS INT) * 10",
        "source_reliability": _case("l_orderkey", "0.95", "0.82", "0.55", "0.7", "0.85").replace("'", ""), "is_full_snapshot": "l_linenumber % 2 = 0", "is_primary": "l_linenumber = 1",
        "last_seen_at": "ago((l_orderkey * 13) % 1700)", "created_at": "l_shipdate", "removed_at": "CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN ago((l_orderkey * 7 + l_suppkey) % 1300) END",
    }, ""),
    "signal": ("events", {
        "user_id": "user_id", "canonical_id": "CAST(regexp_replace(props, '[^0-9]', '', 'g') AS BIGINT)", "created_at": "ts",
        "action": "CASE event_type WHEN 'click' THEN 'SAVE' WHEN 'purchase' THEN 'APPLY' WHEN 'error' THEN 'PASS' ELSE 'VIEW_DETAILS' END",
    }, ""),
    "run": ("orders", {"id": "o_orderkey", "source": "concat('source', CAST(o_custkey AS STRING))", "started_at": "o_orderdate", "status": "CASE o_orderstatus WHEN 'O' THEN 'SUCCESS' WHEN 'F' THEN 'FAILED' ELSE 'RUNNING' END", "fetched": "CAST(floor(o_totalprice) AS BIGINT)"}, ""),
    "task": ("orders", {
        "id": "o_orderkey", "kind": _case("o_orderkey", "POLL", "VALIDATE", "DISCOVER"), "target": "o_custkey", "status": "CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'PENDING' ELSE 'PENDING' END",
        "priority": "o_totalprice", "not_before": "ago((o_orderkey * 11) % 2000 - 500)", "created_at": "o_orderdate",
    }, ""),
    "source": ("customer", {
        "id": "c_custkey", "company_id": "c_nationkey", "connector": "lower(c_mktsegment)", "attempts": "c_custkey % 7", "successes": "CASE WHEN c_custkey % 7 > 2 THEN c_custkey % 7 - 2 ELSE 0 END", "fetched": "(c_custkey * 13) % 400", "accepted": "CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE (c_custkey * 13) % 300 END",
        "created": "CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE (c_custkey * 7) % 60 END", "retained": "CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE (c_custkey * 5) % 90 END", "deduped": "(c_custkey * 13) % 350", "quality": "CAST(c_custkey % 100 AS DOUBLE) / 100", "yield_": "CAST((c_custkey * 31) % 97 AS DOUBLE) / 97",
        "overlap": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 11 AS DOUBLE) / 11 END", "priority": "CAST(c_custkey % 50 AS DOUBLE) + 0.5", "confidence": "CAST(c_custkey % 10 AS DOUBLE) / 10", "history": "CAST(c_custkey % 40 AS DOUBLE)",
        "state": _case("c_custkey", "UNVALIDATED", "SUSPECT", "VALIDATED", "NEEDS_REDISCOVERY"), "status": _case("c_custkey", "ACTIVE", "DEGRADED", "ACTIVE"), "failures": "c_custkey % 6", "failure_streak": "c_custkey % 3", "http_status": _case("c_custkey", "404", "200", "500", None, "410").replace("'", ""),
        "last_accepted": "(c_custkey * 3) % 200", "last_created": "(c_custkey * 3) % 15", "validated": "c_custkey % 4 = 2", "ready": "c_custkey % 4 = 2 AND c_custkey % 3 <> 1", "ok": "c_custkey % 3 <> 0",
    }, ""),
    "preference": ("customer", {"user_id": "(c_custkey - c_custkey % 2)", "key": "CASE c_custkey % 2 WHEN 0 THEN 'softSignal:preferredRoleFamily' ELSE 'hardFilter:workMode' END", "value": _case("c_custkey", "SWE, Sales", "REMOTE,HYBRID", "", "ONSITE ,")}, ""),
    "tag": ("lineitem", {"id": "l_orderkey", "tag": _case("l_linenumber", "urgent", "remote", "referral", "dream")}, ""),
    "tracked": ("orders", {"id": "o_orderkey", "user_id": "o_custkey", "deadline": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE ago((o_orderkey * 5) % 480 - 240) END", "status": "o_orderstatus"}, ""),
    "sent": ("orders", {"user_id": "o_custkey", "tracked_id": "o_orderkey", "reminder": _case("o_orderkey", "DEADLINE_D3", "DEADLINE_TODAY")}, "o_orderkey % 4 = 0"),
    "document": ("documents", {"id": "doc_id", "description": "text", "source": "source", "lang": "lang"}, ""),
}


def _fill(expr: str, spark: bool) -> str:
    if spark:
        expr = expr.replace(", '', 'g')", ", '')")
    out = ""
    while (m := re.search(r"\bago\(", expr)) is not None:
        depth, at = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(expr[at], 0)
            at += 1
        inner = expr[m.end() : at - 1]
        made = f"timestampadd(HOUR, -CAST({inner} AS INT), TIMESTAMP_NTZ'{AS_OF}')" if spark else f"(TIMESTAMP '{AS_OF}' - to_hours(CAST({inner} AS BIGINT)))"
        out, expr = out + expr[: m.start()] + made, expr[at:]
    return out + expr


def spread(df: DataFrame) -> DataFrame:
    """The same rows over three tasks a core: for work that is dear per row on a file that is small, which Spark would read in one task or two."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def view(spark: SparkSession, sf_dir: str, name: str, *columns: str, dear: bool = False) -> DataFrame:
    """The domain table, or just some of its columns; only what they need is read. dear: the rows are spread first."""
    table, exprs, where = BINDINGS[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    df = df.where(where) if where else df
    df = spread(df) if dear else df
    return df.selectExpr(*[f"{_fill(exprs[c], True)} AS {c}" for c in (columns or exprs)])


def sql(name: str) -> str:
    """The same as a select for the checking engine."""
    table, exprs, where = BINDINGS[name]
    return f"SELECT {', '.join(f'{_fill(e, False)} AS {c}' for c, e in exprs.items())} FROM {table}" + (f" WHERE {where}" if where else "")
