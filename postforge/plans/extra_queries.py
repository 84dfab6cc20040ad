"""Queries over sources' administration, writes, cards, discovery and ingestion as a whole."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postforge.bindings import AS_OF, as_of, view
from postforge.functions import rules as R
from postforge.operators import cards, discovery, feed, ingestion, network, reports, resume
from postforge.plans import page_queries as P
from postforge.plans.board_queries import shown
from postforge.plans.queries import _TASTE, NOW, ORACLES, _score_sql, _sides, compatible_sql, inlist, query
from postforge.sources import boards, tables
from postforge.streaming import ingest

US = lambda c: F.unix_micros(F.col(c).cast("timestamp"))

# --- sources of other forms ------------------------------------------------------------------------------------------

_BANK = {
    "WIC Job Location Snapshot ID": "IF(id % 10 = 0, 'NA', CAST(id AS STRING))", "Job Title": "IF(id % 3 = 0, '*No data', title)", "Original Job Title": "IF(id % 6 = 0, ' ', concat(title, ' (orig)'))", "NAICS": "IF(id % 4 = 0, 'NA', company)", "City": "IF(id % 5 = 0, '', 'Regina')", "Province/Territory": "'SK'",
    "Salary Minimum": "CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '20.5' WHEN 2 THEN '900' ELSE '55000' END", "Salary Maximum": "CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '30' WHEN 2 THEN 'NA' ELSE '65000' END", "Salary Per": "CASE id % 4 WHEN 1 THEN 'Hour' WHEN 2 THEN 'Week' ELSE 'Year' END",
    "Employment Type": "IF(id % 2 = 0, 'Full Time', 'Part time')", "Employment Term Telework": "IF(id % 3 = 1, 'Yes', 'No')", "First Posting Date": "date_format(posted_at, 'yyyy-MM-dd')", "Experience Level": "'3 years'",
}
_JOB = "CASE WHEN id % 3 <> 0 THEN title ELSE title || ' (orig)' END"


@query(f"""SELECT 'JobBank:open-data' AS source_name, 'jobbank:' || CAST(id AS VARCHAR) AS source_id, 'https://www.jobbank.gc.ca/jobsearch/jobposting/' || CAST(id AS VARCHAR) AS source_url, {_JOB} AS title, CASE WHEN id % 4 = 0 THEN 'Job Bank Employer' ELSE company END AS company, CASE WHEN id % 5 = 0 THEN '' ELSE 'Regina, ' END || 'SK, Canada' AS location,
  'Position: ' || {_JOB} || chr(10) || 'Experience: 3 years' AS description, 'https://www.jobbank.gc.ca/jobsearch/jobposting/' || CAST(id AS VARCHAR) AS apply_url, epoch_us(date_trunc('day', posted_at)) AS posted, CAST(NULL AS BIGINT) AS due, CASE WHEN id % 2 = 0 THEN 'FULL_TIME' ELSE 'PART_TIME' END AS employment_type, CASE WHEN id % 3 = 1 THEN 'REMOTE' END AS work_mode,
  CASE id % 4 WHEN 1 THEN 42640 WHEN 2 THEN 46800 WHEN 3 THEN 55000 END::DOUBLE AS salary_min, CASE id % 4 WHEN 1 THEN 62400 WHEN 3 THEN 65000 END::DOUBLE AS salary_max, CASE WHEN id % 4 <> 0 THEN 'CAD' END AS salary_currency, 'INCREMENTAL' AS freshness_mode FROM canonical WHERE id % 10 <> 0 AND id % 6 <> 0""", "canonical")  # fmt: skip
def source_jobbank(spark, d):
    return shown(boards.job_bank(view(spark, d, "canonical").selectExpr(*[f"{e} AS `{c}`" for c, e in _BANK.items()]), AS_OF))


@query("SELECT DISTINCT unnest(CASE id % 3 WHEN 0 THEN ['https://a.example/' || CAST(id % 40 AS VARCHAR)] WHEN 1 THEN ['https://b.example/' || CAST(id % 25 AS VARCHAR)] ELSE ['http://c.example/' || CAST(id % 7 AS VARCHAR), 'https://d.example/x?y=1'] END) AS url FROM canonical", "canonical")
def source_seed_files(spark, d):
    line = "CASE id % 3 WHEN 0 THEN concat('{\"name\": \"n\", \"boardUrl\": \"https://a.example/', id % 40, '\"}') WHEN 1 THEN concat('\"https://b.example/', id % 25, '\",') ELSE concat('name,http://c.example/', id % 7, '\tsee https://d.example/x?y=1.') END"
    return boards.seed_urls(view(spark, d, "canonical", "id").select(F.expr(line).alias("value"))).select("url")


@query("SELECT g, CASE WHEN n > 5 THEN 5 ELSE n END AS n, last FROM (SELECT id // 10 AS g, count(*) AS n, max(id) FILTER (rn <= 5) AS k, max(CASE WHEN rn <= 5 THEN 'https://r.example/?a=' || CAST(id AS VARCHAR) || '&b=1' END) FILTER (rn = least(5, c)) AS last FROM (SELECT id, row_number() OVER (PARTITION BY id // 10 ORDER BY id) AS rn, count(*) OVER (PARTITION BY id // 10) AS c FROM canonical) GROUP BY 1)", "canonical")
def source_rss(spark, d):
    item = F.transform(F.array_sort(F.collect_list("id")), lambda i: F.concat(F.lit("<item><title>t</title><link> https://r.example/?a="), i.cast("string"), F.lit("&amp;b=1 </link></item>")))
    xml = view(spark, d, "canonical", "id").groupBy(F.expr("id div 10").alias("g")).agg(F.concat(F.lit("<rss><link>https://feed.example</link>"), F.array_join(item, ""), F.lit("</rss>")).alias("xml"))
    return xml.withColumn("l", discovery.rss_links(F.col("xml"), 5)).select("g", F.size("l").cast("long").alias("n"), F.try_element_at("l", F.lit(-1)).alias("last"))


@query("SELECT connector, array_to_string(list_sort(list_distinct(list(token))), ',') AS tokens FROM (SELECT connector, 't' || CAST(id % 13 AS VARCHAR) AS token FROM source WHERE id % 4 = 1 AND id % 13 > 0) GROUP BY 1", "source")
def source_registry_file(spark, d):
    entry = F.expr("named_struct('status', CASE id % 4 WHEN 1 THEN 'promoted' ELSE 'candidate' END, 'connectorName', connector, 'token', IF(id % 13 = 0, '', concat('t', id % 13)))")
    files = view(spark, d, "source", "id", "connector").groupBy(F.expr("id div 20").alias("g")).agg(F.to_json(F.struct(F.collect_list(entry).alias("entries"))).alias("value"))
    return discovery.promoted_tokens(files).select("connector", F.array_join("tokens", ",").alias("tokens"))


# --- writes ----------------------------------------------------------------------------------------------------------


@query(f"""+ n AS (SELECT id AS raw_id, id * 3 % 50 AS canonical_id, source_name FROM incoming), o AS (SELECT id AS raw_id, canonical_id FROM (SELECT l_orderkey AS id, min(l_partkey) AS canonical_id FROM lineitem GROUP BY 1))
SELECT coalesce(n.raw_id, o.raw_id) AS raw_id, coalesce(n.canonical_id, o.canonical_id) AS canonical_id, CASE WHEN n.raw_id IS NULL THEN 'kept' WHEN o.raw_id IS NULL THEN 'created' ELSE 'updated' END AS change, CASE WHEN n.canonical_id <> o.canonical_id THEN o.canonical_id END AS previous FROM n FULL JOIN o ON n.raw_id = o.raw_id""", "incoming")  # fmt: skip
def upsert_mapping(spark, d):
    new = view(spark, d, "incoming", "id", "source_name").select(F.col("id").alias("raw_id"), (F.col("id") * 3 % 50).alias("canonical_id"))
    old = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("raw_id")).agg(F.min("l_partkey").alias("canonical_id"))
    return tables.upsert_mappings(old, new).select("raw_id", "canonical_id", "change", "previous")


@query("SELECT coalesce(n.id, c.id) AS canonical_id, CASE WHEN n.id IS NULL THEN c.category ELSE 'R' || CAST(n.rank AS VARCHAR) END AS category, CASE WHEN n.id IS NULL THEN 'kept' WHEN c.id IS NULL THEN 'created' ELSE 'updated' END AS change FROM canonical c FULL JOIN incoming n ON c.id = n.id", "canonical", "incoming")
def upsert_eligibility(spark, d):
    old = view(spark, d, "canonical", "id", "category").select(F.col("id").alias("canonical_id"), "category")
    new = view(spark, d, "incoming", "id", "rank").select(F.col("id").alias("canonical_id"), F.concat(F.lit("R"), F.col("rank").cast("string")).alias("category"))
    return tables.upsert(old, new, ["canonical_id"])


@query("+ o AS (SELECT user_id, canonical_id, count(*) AS n FROM signal WHERE action = 'SAVE' GROUP BY 1, 2), w AS (SELECT user_id, canonical_id FROM signal WHERE action = 'APPLY' GROUP BY 1, 2) SELECT coalesce(w.user_id, o.user_id) AS user_id, coalesce(w.canonical_id, o.canonical_id) AS canonical_id, CASE WHEN w.user_id IS NULL THEN 'ACTIVE' ELSE 'APPLIED' END AS status FROM o FULL JOIN w ON o.user_id = w.user_id AND o.canonical_id = w.canonical_id", "signal")
def upsert_saved(spark, d):
    s = view(spark, d, "signal", "user_id", "canonical_id", "action")
    one = lambda a, st: s.where(F.col("action") == a).select("user_id", "canonical_id", F.lit(st).alias("status")).distinct()
    return tables.upsert(one("SAVE", "ACTIVE"), one("APPLY", "APPLIED"), ["user_id", "canonical_id"]).drop("change")


_FIRM = "CASE WHEN id % 4 = 0 THEN NULL ELSE 'd' || CAST(id AS VARCHAR) || '.example' END"


@query(f"""+ c AS (SELECT id, company_key, trim(company) AS name, {_FIRM} AS domain, CASE WHEN id % 5 = 0 THEN 'https://c/' || CAST(id AS VARCHAR) END AS careers_url, (id % 10)::DOUBLE / 10 AS confidence, 'a' || CAST(id % 3 AS VARCHAR) AS alias, CASE WHEN id % 2 = 0 THEN 'lever' END AS ats FROM canonical)
SELECT company_key, arg_max(name, (length(name), name)) AS name, arg_min(domain, id) AS domain, arg_min(careers_url, id) AS careers_url, arg_min(ats, id) AS detected_ats, max(confidence) AS confidence, array_to_string(list_sort(list_distinct(list(alias))), ',') AS aliases FROM c GROUP BY 1""", "canonical")  # fmt: skip
def merge_companies(spark, d):
    c = view(spark, d, "canonical", "id", "company_key", "company").selectExpr("id", "company_key", "trim(company) AS name", "IF(id % 4 = 0, NULL, concat('d', id, '.example')) AS domain", "IF(id % 5 = 0, concat('https://c/', id), NULL) AS careers_url", "IF(id % 2 = 0, 'lever', NULL) AS detected_ats", "CAST(id % 10 AS DOUBLE) / 10 AS confidence", "array(concat('a', id % 3)) AS aliases")
    return tables.merge_companies(c).select("company_key", "name", "domain", "careers_url", "detected_ats", "confidence", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT id, 'b' || CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE '' END AS text, CASE WHEN id % 3 = 0 THEN 'x,y,z' || CAST(id % 4 AS VARCHAR) ELSE 'x,y' END AS tags, CAST(id AS VARCHAR) AS inner_a, CASE WHEN id % 5 = 0 THEN '9' ELSE '1' END AS inner_b FROM canonical", "canonical")
def merge_company_metadata(spark, d):
    """Nested JSON of a record and its update: lists are united, objects joined, other values replaced unless null."""
    c = view(spark, d, "canonical", "id").selectExpr("id", "'{\"t\": \"b\", \"tags\": [\"x\", \"y\"], \"o\": {\"b\": 1}}' AS old", "concat('{\"t\": ', IF(id % 2 = 0, concat('\"b', id, '\"'), 'null'), IF(id % 3 = 0, concat(', \"tags\": [\"y\", \"z', id % 4, '\"]'), ''), ', \"o\": {\"a\": ', id, IF(id % 5 = 0, ', \"b\": 9', ''), '}}') AS new")
    m = c.select("id", tables.merged_json(F.col("old"), F.col("new")).alias("m"))
    get = lambda p: F.get_json_object("m", p)
    return m.select("id", get("$.t").alias("text"), F.array_join(F.from_json(get("$.tags"), "array<string>"), ",").alias("tags"), get("$.o.a").alias("inner_a"), get("$.o.b").alias("inner_b"))


@query("+ k AS (SELECT company_key, min(id) AS company_id FROM canonical WHERE company_key <> '' GROUP BY 1) SELECT c.id, CASE WHEN k.company_id IS NULL THEN c.id % 4 ELSE k.company_id END AS company_id, k.company_id IS NOT NULL AND k.company_id <> c.id % 4 AS changed FROM canonical c LEFT JOIN k ON c.company_key = k.company_key", "canonical")
def assign_companies(spark, d):
    c = view(spark, d, "canonical", "id", "company_key")
    firms = c.where("company_key <> ''").groupBy("company_key").agg(F.min("id").alias("company_id"))
    return tables.assign_companies(c.withColumn("company_id", F.col("id") % 4), firms).select("id", "company_id", "changed")


@query("SELECT DISTINCT o_orderkey AS id, 'tag' || CAST(o_orderkey AS VARCHAR) AS name FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)")
def drop_orphan_tags(spark, d):
    tags = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("tag"), F.col("o_orderkey").cast("string")).alias("name"))
    return tables.drop_orphans(tags, spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber = 3").select(F.col("l_orderkey").alias("tag_id")))


# --- filters, cards and pages ----------------------------------------------------------------------------------------


@query("SELECT id FROM canonical WHERE status IN ('LIVE', 'AGING', 'STALE') AND (dead_signal_at IS NULL OR status IN ('AGING', 'STALE'))", "canonical")
def health_candidates(spark, d):
    return view(spark, d, "canonical", "id", "status", "dead_signal_at").where(network.health_candidate()).select("id")


@query("SELECT id, source_name FROM mapping WHERE source_name LIKE 'Lever:%' OR source_name LIKE 'Work_ay:%'", "mapping")
def source_name_like(spark, d):
    return view(spark, d, "mapping", "id", "source_name").where(network.named_like(["Lever:%", "Work_ay:%"]))


@query("SELECT id, EXISTS (SELECT 1 FROM signal s WHERE s.canonical_id = canonical.id AND s.user_id = 7 AND s.action = 'SAVE') AS is_saved FROM canonical", "canonical", "signal")
def saved_flags(spark, d):
    return cards.with_saved(view(spark, d, "canonical", "id"), view(spark, d, "signal").where("action = 'SAVE'"), 7)


_MONEY = lambda v, c: f"CASE coalesce({c}, 'USD') " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in R.CURRENCY_SIGNS.items()) + f" ELSE {c} || ' ' END || format('{{:,}}', CAST({v} AS BIGINT))"
_LABEL = lambda a, b, c: f"CASE WHEN coalesce({a}, 0) <> 0 AND coalesce({b}, 0) <> 0 THEN {_MONEY(a, c)} || ' - ' || {_MONEY(b, c)} WHEN coalesce({a}, 0) <> 0 THEN {_MONEY(a, c)} || '+' WHEN coalesce({b}, 0) <> 0 THEN 'Up to ' || {_MONEY(b, c)} ELSE '' END"
_LEFT = f"ceil((epoch_us(deadline) - epoch_us({NOW})) / 86400000000.0)"


@query(f"""+ {P.salary_sql('canonical')}, s AS (SELECT c.id, CASE WHEN salary_min IS NOT NULL OR salary_max IS NOT NULL THEN salary_min ELSE low END AS a, CASE WHEN salary_min IS NOT NULL OR salary_max IS NOT NULL THEN salary_max ELSE high END AS b, CASE WHEN salary_min IS NOT NULL OR salary_max IS NOT NULL OR currency IS NULL THEN CASE WHEN region = 'CA' THEN 'CAD' ELSE 'USD' END ELSE currency END AS cur FROM canonical c LEFT JOIN pay ON c.id = pay.id),
r AS ({ORACLES['resolved_links'].replace('WITH canonical AS', 'WITH canonical_ AS', 1)}), m AS (SELECT canonical_id, count(*) AS n FROM mapping GROUP BY 1)
SELECT c.id, title, company, CASE work_mode WHEN 'UNKNOWN' THEN 'Unknown' WHEN 'REMOTE' THEN 'Remote' WHEN 'HYBRID' THEN 'Hybrid' WHEN 'ONSITE' THEN 'Onsite' WHEN 'FLEXIBLE' THEN 'Flexible' END AS work_mode, {_LABEL('a', 'b', 'cur')} AS salary,
  CASE WHEN {_LEFT} < 0 THEN 'Deadline passed' WHEN {_LEFT} = 0 THEN 'Closes today' WHEN {_LEFT} = 1 THEN 'Closes tomorrow' WHEN {_LEFT} <= 7 THEN 'Closes in ' || CAST(CAST({_LEFT} AS BIGINT) AS VARCHAR) || ' days' END AS urgency, href, kind, coalesce(level, 'UNAVAILABLE') AS level, coalesce(m.n, 0) AS n_sources,
  EXISTS (SELECT 1 FROM signal g WHERE g.canonical_id = c.id AND g.user_id = 7 AND g.action = 'SAVE') AS is_saved FROM canonical c JOIN s ON c.id = s.id LEFT JOIN r ON c.id = r.id LEFT JOIN m ON c.id = m.canonical_id""", "canonical", "mapping", "signal")  # fmt: skip
def job_cards(spark, d):
    c = view(spark, d, "canonical").withColumn("salary_currency", F.lit(None).cast("string"))
    m = view(spark, d, "mapping", "canonical_id", "id", "source_name", "source_url", "is_primary")
    return cards.cards(c, m, view(spark, d, "signal").where("action = 'SAVE'"), 7, as_of())


_PROFILE = "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'https://l/' {0} END"


@query(f"""SELECT id AS user_id, concat_ws('|', CASE WHEN id % 3 = 2 THEN 'LinkedIn=https://l/' || CAST(id AS VARCHAR) END, CASE WHEN id % 2 = 0 THEN 'GitHub=g' END) AS links,
  concat_ws('|', CASE WHEN id % 5 = 0 THEN 'Work authorization=PR' END, 'Salary target=' || ({_LABEL("CASE WHEN id % 4 = 0 THEN NULL ELSE id * 1000 END", "CASE WHEN id % 7 = 0 THEN NULL ELSE id * 2000 END", "CASE WHEN id % 2 = 0 THEN 'CAD' END")}), CASE WHEN id % 3 = 0 THEN 'Preferred work mode=Remote' END, 'Automation mode=Review Before Submit') AS answers FROM source""", "source")  # fmt: skip
def package_preview(spark, d):
    p = view(spark, d, "source", "id").selectExpr("id AS user_id", "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('https://l/', id) END AS linkedin_url", "IF(id % 2 = 0, 'g', NULL) AS github_url", "CAST(NULL AS STRING) AS portfolio_url", "IF(id % 5 = 0, 'PR', NULL) AS work_authorization", "IF(id % 4 = 0, NULL, id * 1000) AS salary_min", "IF(id % 7 = 0, NULL, id * 2000) AS salary_max", "IF(id % 2 = 0, 'CAD', NULL) AS salary_currency", "IF(id % 3 = 0, 'REMOTE', NULL) AS work_mode", "'REVIEW_BEFORE_SUBMIT' AS automation_mode")
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["label"], x["value"])), "|").alias(c)
    return cards.package_preview(p).select("user_id", said("links"), said("answers"))


@query("SELECT id AS user_id, CASE WHEN id % 3 = 0 AND id % 2 = 1 THEN NULL ELSE '{' || concat_ws(',', CASE WHEN id % 3 > 0 THEN '\"email\":\"u' || CAST(id AS VARCHAR) || '@x.example\"' END, CASE WHEN id % 2 = 0 THEN '\"phone\":\"1\"' END) || '}' END AS contact FROM source", "source")
def contact_json(spark, d):
    return cards.contact_json(view(spark, d, "source", "id").selectExpr("id AS user_id", "IF(id % 3 = 0, ' ', concat('u', id, '@x.example')) AS email", "IF(id % 2 = 0, '1', NULL) AS phone"))


@query("SELECT id, user_id, CAST(place AS BIGINT) AS place FROM (SELECT o_orderkey AS id, o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 5")
def latest_submissions(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), "o_orderdate")
    return reports.top_children(o, "user_id", "o_orderdate").select("id", "user_id", F.col("place").cast("long").alias("place"))


@query("SELECT c.id, coalesce(e.category, 'NONE') AS category, e.rank FROM canonical c LEFT JOIN (SELECT id AS eid, 'R' || CAST(rank AS VARCHAR) AS category, rank FROM incoming) e ON c.id = e.eid", "canonical", "incoming")
def eligibility_lookup(spark, d):
    e = view(spark, d, "incoming", "id", "rank").select("id", F.concat(F.lit("R"), F.col("rank").cast("string")).alias("category"), "rank")
    return feed.with_eligibility(view(spark, d, "canonical", "id"), e).select("id", F.coalesce("category", F.lit("NONE")).alias("category"), "rank")


@query("SELECT id, title, CAST(place AS BIGINT) AS place FROM (SELECT id, row_number() OVER (ORDER BY salary_max DESC NULLS LAST, id) AS place FROM canonical) JOIN (SELECT id, title FROM canonical) USING (id) WHERE place <= 30", "canonical")
def details_in_page_order(spark, d):
    c = view(spark, d, "canonical", "id", "title", "salary_max")
    page = c.orderBy(F.desc_nulls_last("salary_max"), "id").limit(30).withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("salary_max"), "id")))
    return reports.in_given_order(page, c.select("id", "title")).select("id", "title", F.col("place").cast("long").alias("place"))


@query("SELECT id, posted_at IS NULL AS missing FROM canonical ORDER BY posted_at DESC NULLS FIRST, id LIMIT 1200", "canonical")
def scoring_window(spark, d):
    return feed.scoring_window(view(spark, d, "canonical", "id", "posted_at")).select("id", F.col("posted_at").isNull().alias("missing"))


# --- the feed's greedy order -----------------------------------------------------------------------------------------

_KEYED = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'))"


@query(_score_sql().replace("f AS (SELECT c.id,", "f AS (SELECT c.id, c.status, c.availability_score, c.last_apply_check_at, c.last_confirmed_alive_at, c.dead_signal_at,", 1) + f""", fam AS (SELECT canonical_id, list_distinct(list(split_part(source_name, ':', 1))) AS fams FROM mapping GROUP BY 1),
v AS (SELECT t.id, total, epoch_us(posted_at) AS ts, {_KEYED('company')} AS ck, {_KEYED('company')} || '::' || trim(regexp_replace(lower(regexp_replace(title, '\\([^)]*\\)', ' ', 'g')), '\\s+', ' ', 'g')) AS tk, coalesce(fams, []) AS fams FROM (SELECT * FROM t WHERE status IN ('LIVE', 'AGING') AND (availability_score >= 35 OR (availability_score <= 0 AND last_apply_check_at IS NULL AND last_confirmed_alive_at IS NULL AND dead_signal_at IS NULL)) ORDER BY posted_at DESC NULLS FIRST, id LIMIT 1200) t LEFT JOIN fam ON t.id = canonical_id),
o AS (SELECT *, row_number() OVER (ORDER BY total DESC, ts DESC, id) AS place FROM v), n AS (SELECT count(*) AS n FROM o),
r AS (WITH RECURSIVE w AS (SELECT 0 AS step, id, total, ts, ck, tk, fams, place, 0 AS nc, 0 AS nt, [0 FOR f IN fams] AS nf, false AS taken FROM o
  UNION ALL SELECT step + 1, id, total, ts, ck, tk, fams, place, nc + CASE WHEN ck = b[2] THEN 1 ELSE 0 END, nt + CASE WHEN tk = b[3] THEN 1 ELSE 0 END, [nf[i] + CASE WHEN list_contains(b[4], fams[i]) THEN 1 ELSE 0 END FOR i IN range(1, len(fams) + 1)], id = b[1]
  FROM (SELECT *, first_value((id, ck, tk, fams)) OVER (ORDER BY total - least(6, 2 * nc) - CASE WHEN nt > 0 THEN 8 + 2 * (nt - 1) ELSE 0 END - CASE WHEN coalesce(list_max(nf), 0) < 6 THEN 0 WHEN list_max(nf) < 10 THEN 1 WHEN list_max(nf) < 14 THEN 2 ELSE 3 END DESC, ts DESC, place) AS b FROM w WHERE NOT taken))
  SELECT id, CAST(step AS BIGINT) AS position FROM w WHERE taken)
SELECT id, position FROM r""", "canonical", "mapping")  # fmt: skip
def diversified_feed(spark, d):
    from postforge.functions import urls

    m = view(spark, d, "mapping", "canonical_id", "source_name", "source_quality_rank", "source_reliability", "id")
    top = feed.scoring_window(view(spark, d, "canonical").where(feed.visible()))
    families = m.groupBy("canonical_id").agg(F.array_sort(F.collect_set(urls.source_prefix(F.col("source_name")))).alias("families"))
    s = feed.score(top, m, as_of(), **_TASTE).join(families, F.col("id") == families["canonical_id"], "left").withColumn("families", F.coalesce("families", F.array().cast("array<string>")))
    return feed.diversify(s.withColumn("viewer", F.lit(7).cast("long"))).select("id", "position")


# --- reports ---------------------------------------------------------------------------------------------------------


@query("SELECT connector, status, state, ready, count(*) AS n FROM source GROUP BY 1, 2, 3, 4", "source")
def sources_by_four(spark, d):
    return view(spark, d, "source").groupBy("connector", "status", "state", "ready").agg(F.count("*").alias("n"))


_TODAY = f"date_trunc('day', {NOW} - INTERVAL 30 DAY)"


@query(f"+ r AS (SELECT *, last_confirmed_alive_at AS expired_at, dead_signal_at AS removed_at FROM canonical c WHERE EXISTS (SELECT 1 FROM mapping m WHERE m.canonical_id = c.id AND source_name NOT IN {inlist(R.DEMO_SOURCES)})) SELECT count(*) FILTER (status IN ('LIVE', 'AGING')) AS live, count(*) FILTER (status IN ('LIVE', 'AGING') AND posted_at >= {_TODAY}) AS added, count(*) FILTER (status = 'EXPIRED' AND expired_at >= {_TODAY}) AS expired, count(*) FILTER (status = 'REMOVED' AND removed_at >= {_TODAY}) AS removed FROM r", "canonical", "mapping")
def feed_summary(spark, d):
    c = view(spark, d, "canonical").withColumns({"expired_at": F.col("last_confirmed_alive_at"), "removed_at": F.col("dead_signal_at")})
    return reports.feed_summary(c, view(spark, d, "mapping", "canonical_id", "source_name"), F.date_trunc("day", as_of() - F.expr("INTERVAL 30 DAY")))


@query("SELECT id, epoch_us(date_trunc('day', posted_at - INTERVAL 330 MINUTE) + INTERVAL 330 MINUTE) AS began FROM canonical", "canonical")
def local_day_start(spark, d):
    """The day of each posting where clocks are five and a half hours behind."""
    return view(spark, d, "canonical", "id", "posted_at").select("id", F.unix_micros(reports.day_start(F.col("posted_at"), "-05:30").cast("timestamp")).alias("began"))


@query("""+ r AS (SELECT source_name AS source, count(*) AS n FROM incoming GROUP BY 1), m AS (SELECT source_name AS source, count(*) AS a, count(DISTINCT canonical_id) FILTER (status IN ('LIVE', 'AGING')) AS l FROM mapping LEFT JOIN canonical ON canonical_id = canonical.id WHERE removed_at IS NULL GROUP BY 1)
SELECT coalesce(r.source, m.source) AS source, coalesce(n, 0) AS n_raw, coalesce(a, 0) AS n_active, coalesce(l, 0) AS n_live FROM r FULL JOIN m ON r.source = m.source""", "incoming", "mapping", "canonical")  # fmt: skip
def source_stats(spark, d):
    m = view(spark, d, "mapping", "source_name", "canonical_id", "removed_at").withColumnRenamed("source_name", "source")
    return reports.source_stats(view(spark, d, "incoming", "source_name").withColumnRenamed("source_name", "source"), m, view(spark, d, "canonical", "id", "status"))


@query(f"+ {P.normalize_sql()}, c AS (SELECT reject_reason AS r, count(*) AS n FROM done GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, string_agg(r || '=' || CAST(n AS VARCHAR), ',' ORDER BY r) AS reasons FROM c", "incoming")
def skipped_reasons(spark, d):
    r = reports.reason_counts(P._normalized(spark, d), "reject_reason")
    return r.select("n", F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("reasons"))


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN id % 10 = 0 THEN 0 ELSE fetched END) AS BIGINT) AS \"companiesProcessed\", CAST(sum(CASE WHEN id % 10 = 0 OR id % 3 = 0 THEN 0 ELSE id END) AS BIGINT) AS \"newCandidates\" FROM source", "source")
def batch_reports(spark, d):
    doc = "CASE WHEN id % 10 = 0 THEN 'broken' ELSE concat('{\"generatedAt\": \"x\", \"companiesProcessed\": ', fetched, IF(id % 3 = 0, '', concat(', \"newCandidates\": ', id)), '}') END AS value"
    return reports.batch_totals(view(spark, d, "source", "id", "fetched").selectExpr(doc), ["companiesProcessed", "newCandidates"])


@query("SELECT name, CAST(row_number() OVER (ORDER BY k, name) AS BIGINT) AS place FROM (SELECT unnest(['Zebra', 'apple', 'Étoile', 'etoile', 'Banana', 'ábaco', 'Apple']) AS name, unnest([7, 2, 6, 5, 4, 1, 3]) AS k)")
def locale_order(spark, d):
    names = spark.createDataFrame([(n,) for n in ("Zebra", "apple", "Étoile", "etoile", "Banana", "ábaco", "Apple")], "name string")
    return reports.in_locale_order(names, "name").withColumn("place", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("place")).cast("long"))


# --- discovery -------------------------------------------------------------------------------------------------------

_BOARD_URL = "concat('https://jobs.lever.co/firm', id % 40, '/x')"


@query("""+ p AS (SELECT 'lever/firm' || CAST(id % 40 AS VARCHAR) AS board, company, 'https://p/' || CAST(id % 11 AS VARCHAR) AS page, NULL AS link, 'career_page_scan' AS reason FROM canonical WHERE id % 3 > 0
  UNION ALL SELECT 'lever/firm' || CAST(id % 40 AS VARCHAR), company, NULL, 'https://jobs.lever.co/firm' || CAST(id % 40 AS VARCHAR) || '/x', 'career_page_direct_ats_link' FROM incoming),
s AS (SELECT board, list_sort(list_distinct(list(company))) AS c, list_sort(list_distinct(list(page) FILTER (page IS NOT NULL))) AS g, list_sort(list_distinct(list(link) FILTER (link IS NOT NULL))) AS l, list_sort(list_distinct(list(reason))) AS r FROM p WHERE board NOT IN ('lever/firm3', 'lever/firm4') GROUP BY 1)
SELECT board, array_to_string(c, ';') AS companies, coalesce(array_to_string(g, ';'), '') AS pages, coalesce(array_to_string(l, ';'), '') AS links, array_to_string(r, ';') AS reasons, CAST(len(c) + coalesce(len(g), 0) AS BIGINT) AS strength FROM s""", "canonical", "incoming")  # fmt: skip
def source_candidates(spark, d):
    pages = view(spark, d, "canonical", "id", "company").selectExpr("concat('https://p/', id % 11) AS page_url", "company", f"IF(id % 3 = 0, 'https://elsewhere.example/x', {_BOARD_URL}) AS target")
    links = view(spark, d, "incoming", "id", "company").selectExpr(f"{_BOARD_URL} AS url", "company")
    known = spark.createDataFrame([("lever/firm3",), ("lever/firm4",)], "board string")
    said = lambda c: F.array_join(c, ";").alias(c)
    return discovery.candidates(pages, links, known).select("board", said("companies"), said("pages"), said("links"), said("reasons"), F.col("strength").cast("long").alias("strength"))


@query("""+ p AS (SELECT id, CASE WHEN id % 19 = 0 THEN 'timeout' END AS error, CASE WHEN id % 17 = 0 THEN NULL ELSE accepted % 20 END AS a, CASE WHEN id % 17 = 0 THEN NULL ELSE least(accepted % 20, id % 7) END AS ac, CASE WHEN id % 17 = 0 THEN NULL ELSE created % 15 END AS c, CASE WHEN id % 17 = 0 THEN NULL ELSE least(created % 15, id % 4) END AS cc FROM source),
x AS (SELECT *, CASE WHEN a > 0 THEN ac::DOUBLE / a ELSE 0 END AS ra, CASE WHEN c > 0 THEN cc::DOUBLE / c ELSE 0 END AS rc FROM p),
y AS (SELECT *, CASE WHEN cc >= 3 THEN 'canada_heavy_created_volume' WHEN c >= 12 AND cc >= 4 AND ra >= 0.2 THEN 'broad_board_with_real_canada_slice' WHEN c >= 6 AND cc >= 2 AND ra >= 0.25 THEN 'strong_created_volume' WHEN c >= 1 AND cc >= 1 AND (rc >= 0.5 OR ra >= 0.6) THEN 'canada_dense_small_board' WHEN a > 0 AND a = ac AND c >= 1 THEN 'fully_canada_aligned' END AS yes FROM x)
SELECT id, error IS NULL AND c IS NOT NULL AND yes IS NOT NULL AS promote, CASE WHEN error IS NOT NULL THEN error WHEN c IS NULL THEN 'no_preview' ELSE coalesce(yes, 'insufficient_canada_weighted_yield') END AS reason FROM y""", "source")  # fmt: skip
def promotion_decision(spark, d):
    none = "IF(id % 17 = 0, NULL, {})"
    p = view(spark, d, "source", "id", "accepted", "created").selectExpr("id", "IF(id % 19 = 0, 'timeout', NULL) AS error", *[f"{none.format(e)} AS {n}" for n, e in {"accepted": "accepted % 20", "accepted_ca": "least(accepted % 20, id % 7)", "created": "created % 15", "created_ca": "least(created % 15, id % 4)"}.items()])
    return discovery.promotion(p).select("id", "promote", "reason")


@query("""+ c AS (SELECT id, 'Firm ' || CAST(id AS VARCHAR) AS name, CASE id % 4 WHEN 0 THEN 'workday' WHEN 1 THEN 'successfactors' WHEN 2 THEN 'both' ELSE 'unknown' END AS ats FROM source)
SELECT id, CASE WHEN id % 2 = 0 THEN 8 ELSE 0 END + CASE id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1.5 WHEN 2 THEN 3 ELSE 5 END + CASE WHEN id % 3 = 0 THEN 2.5 ELSE 0 END + CASE WHEN id % 7 = 0 THEN 3 ELSE 0 END + CASE WHEN id % 6 = 0 THEN 2.5 ELSE 0 END + CASE WHEN id % 9 = 0 THEN 1.25 ELSE 0 END + CASE ats WHEN 'unknown' THEN 0.75 WHEN 'both' THEN 2 WHEN 'successfactors' THEN 1.5 ELSE 0 END :: DOUBLE AS score FROM c WHERE ats IN ('workday', 'both', 'unknown')""", "source")  # fmt: skip
def catalog_selection(spark, d):
    c = view(spark, d, "source", "id").selectExpr("id", "concat('Firm ', id) AS name", "CASE id % 4 WHEN 0 THEN 'workday' WHEN 1 THEN 'successfactors' WHEN 2 THEN 'both' ELSE 'unknown' END AS ats", "id % 2 = 0 AS canada_hq", "slice(array('a', 'b', 'c', 'd'), 1, CAST(id % 5 AS INT)) AS canada_cities", "id % 3 = 0 AS remote_canada", "IF(id % 7 = 0, array('retail', 'FinTech banking'), array('retail')) AS sectors", "IF(id % 6 = 0, array('p'), array()) AS pages", "IF(id % 9 = 0, array('d'), NULL) AS domains", "array('t') AS tenants", "CAST(NULL AS ARRAY<STRING>) AS hosts")
    return discovery.catalog_order(c, families=("workday",)).select("id", "score")


# --- résumés ---------------------------------------------------------------------------------------------------------

_RESUME = "concat_ws(chr(10), IF(id % 4 = 0, concat('Summary', chr(10), 'https://me.example/x'), NULL), 'Ann Lee', 'Nurse and writer', concat('ann', id, '@mail.example.com | +1 (416) 555-', lpad(CAST(id % 10000 AS STRING), 4, '0')), IF(id % 3 = 0, 'https://www.linkedin.com/in/ann', 'https://site.example/a'), 'Toronto, ON', 'TECHNICAL SKILLS', 'Languages: Go, SQL | go', concat('• C++, R', id), 'Experience', 'Work at a place', 'Skills', 'Tea')"


@query("""SELECT id, 'Ann Lee' AS full_name, 'ann' || CAST(id AS VARCHAR) || '@mail.example.com' AS email, '+1 (416) 555-' || lpad(CAST(id % 10000 AS VARCHAR), 4, '0') AS phone, 'Toronto, ON' AS location, CASE WHEN id % 3 = 0 THEN 'https://www.linkedin.com/in/ann' ELSE '' END AS linkedin_url,
  CASE WHEN id % 4 = 0 THEN 'https://me.example/x' WHEN id % 3 = 0 THEN '' ELSE 'https://site.example/a' END AS portfolio_url, 'Go|SQL|C++|R' || CAST(id AS VARCHAR) || '|Tea' AS skills, 'Work at a place' AS experience FROM source""", "source")  # fmt: skip
def resume_facts(spark, d):
    r = view(spark, d, "source", "id", dear=True).select("id", F.expr(_RESUME).alias("t"))
    own, s = resume.contact(F.col("t")), resume.sections(F.col("t"))
    return r.select("id", *[own[c].alias(c) for c in ("full_name", "email", "phone", "location", "linkedin_url", "portfolio_url")], F.array_join(resume.skills(s["skills"]), "|").alias("skills"), s["experience"].alias("experience"))


@query("""SELECT id AS user_id, CASE WHEN id % 2 = 0 THEN 'A. Lee' ELSE 'Ann  LEE' END AS full_name, CASE WHEN id % 3 = 0 THEN 'old@x.example' ELSE 'ann@x.example' END AS email, CASE WHEN id % 3 = 0 THEN '' ELSE 'email' END || CASE WHEN id % 5 = 0 THEN '' ELSE CASE WHEN id % 3 = 0 THEN '' ELSE ',' END || 'location' END AS added,
  CASE WHEN id % 2 = 0 THEN 'full_name' ELSE '' END || CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN ',' ELSE '' END || 'email' ELSE '' END AS preserved FROM source""", "source")  # fmt: skip
def resume_merge(spark, d):
    rest = ["CAST(NULL AS STRING) AS phone", "'' AS linkedin_url", "'' AS github_url", "'' AS portfolio_url"]
    s = view(spark, d, "source", "id")
    held = s.selectExpr("id AS user_id", "IF(id % 2 = 0, 'A. Lee', 'Ann  LEE') AS full_name", "IF(id % 3 = 0, 'old@x.example', NULL) AS email", "IF(id % 5 = 0, 'Bonn', '') AS location", *rest)
    found = s.selectExpr("id AS user_id", "'Ann Lee' AS full_name", "'ann@x.example' AS email", "IF(id % 5 = 0, 'BONN!', 'Bern') AS location", *rest)
    return resume.merge_contact(held, found).select("user_id", "full_name", "email", F.array_join("added", ",").alias("added"), F.array_join("preserved", ",").alias("preserved"))


# --- streams ---------------------------------------------------------------------------------------------------------


@query("SELECT user_id, epoch_us(v[1]) AS at, v[2] AS event_id, v[3] AS event_type FROM (SELECT user_id, max((ts, event_id, event_type)) AS v FROM events GROUP BY 1)")
def stream_upsert(spark, d):
    """The latest event of each user, by a stream that folds its batches into a table; run to the end of what is there."""
    kind = "ts timestamp, event_id long, event_type string, user_id long"
    folder = tables.scratch(spark, "stream")
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").option("pathGlobFilter", "events.parquet").parquet(d)
    ingest.ingest(events.select("ts", "event_id", "event_type", "user_id"), f"{folder}/t", f"{folder}/ck", ["user_id"], 8).awaitTermination()
    return ingest.read(spark, f"{folder}/t", kind).select("user_id", F.unix_micros("ts").alias("at"), "event_id", "event_type")


@query(f"SELECT id FROM run WHERE status = 'RUNNING' AND (epoch_us({NOW}) - epoch_us(started_at)) / 60000000 > 90", "run")
def stale_runs(spark, d):
    return ingest.stale_runs(view(spark, d, "run"), as_of()).select("id")


@query("SELECT DISTINCT user_id, tracked_id, reminder FROM (SELECT user_id, id AS tracked_id, CASE WHEN id % 3 = 0 THEN 'DEADLINE_D3' ELSE 'DEADLINE_TODAY' END AS reminder FROM tracked) t WHERE NOT EXISTS (SELECT 1 FROM sent s WHERE s.user_id = t.user_id AND s.tracked_id = t.tracked_id AND s.reminder = t.reminder)", "tracked", "sent")
def reminder_log(spark, d):
    """What is to be sent, however often it was worked out: the log of what was sent decides."""
    due = view(spark, d, "tracked", "id", "user_id").selectExpr("user_id", "id AS tracked_id", "IF(id % 3 = 0, 'DEADLINE_D3', 'DEADLINE_TODAY') AS reminder")
    return tables.insert_ignore(view(spark, d, "sent"), due.union(due), ["user_id", "tracked_id", "reminder"])


@query("SELECT source_id FROM (SELECT source_id, source_name, removed_at FROM mapping) WHERE source_name = 'Lever:globex' AND removed_at IS NULL AND source_id NOT IN (SELECT CAST(id AS VARCHAR) FROM run WHERE status = 'SUCCESS')", "mapping", "run")
def unseen_in_snapshot(spark, d):
    seen = view(spark, d, "run", "id", "status").where("status = 'SUCCESS'").select(F.col("id").cast("string").alias("source_id"))
    return ingestion.unseen(view(spark, d, "mapping", "source_id", "source_name", "removed_at"), seen, "Lever:globex", True, "FULL_SNAPSHOT").select("source_id")


# --- ingestion as a whole --------------------------------------------------------------------------------------------

#: What was matched before: itself, a neighbour, or nothing.
_OLD = "SELECT id AS raw_id, CASE id % 3 WHEN 0 THEN id ELSE id + 10 END AS canonical_id FROM incoming WHERE id % 3 < 2"
_DECIDED = f"""+ old AS ({_OLD}), say AS (WITH {P.normalize_sql()} SELECT id, reject_reason FROM done), best AS ({ORACLES['best_match']}), ok AS (WITH {compatible_sql('(n.id, k.id) IN (SELECT raw_id, canonical_id FROM old)', 'i.id % 4 = 0')} SELECT * FROM fits),
x AS (SELECT say.id, reject_reason, old.canonical_id AS previous, best.known_id, best.how, coalesce(ok.fits, false) AS stays FROM say LEFT JOIN old ON old.raw_id = say.id LEFT JOIN best ON best.new_id = say.id LEFT JOIN ok ON ok.new_id = say.id AND ok.known_id = old.canonical_id),
y AS (SELECT id, reject_reason, CASE WHEN reject_reason IS NOT NULL THEN 'rejected' WHEN stays THEN 'kept' WHEN known_id IS NOT NULL THEN 'matched' ELSE 'created' END AS decision, CASE WHEN reject_reason IS NOT NULL THEN NULL WHEN stays THEN previous ELSE known_id END AS canonical_id,
  CASE WHEN reject_reason IS NULL AND NOT stays THEN how END AS how, CASE WHEN NOT stays OR reject_reason IS NOT NULL THEN CASE WHEN previous IS DISTINCT FROM CASE WHEN reject_reason IS NULL THEN known_id END THEN previous END END AS previous FROM x)"""


def _before(spark, d):
    return view(spark, d, "incoming", "id").where("id % 3 < 2").select(F.col("id").alias("raw_id"), F.expr("IF(id % 3 = 0, id, id + 10)").alias("canonical_id"))


def _decided(spark, d):
    new, m, known = _sides(spark, d)
    said = P._normalized(spark, d).select("id", "reject_reason")
    return ingestion.decide(new, said, _before(spark, d), m, known)


@query(_DECIDED + " SELECT * FROM y", "canonical", "incoming", "mapping")
def ingest_decisions(spark, d):
    return _decided(spark, d)


@query(_DECIDED + " SELECT count(*) AS fetched, count(*) FILTER (decision <> 'rejected') AS accepted, count(*) FILTER (decision = 'rejected') AS rejected, count(*) FILTER (decision = 'created') AS created, count(*) FILTER (decision IN ('matched', 'kept')) AS updated, count(*) FILTER (decision = 'matched') AS deduped, count(*) FILTER (previous IS NOT NULL) AS moved FROM y", "canonical", "incoming", "mapping")
def run_metrics(spark, d):
    return ingestion.metrics(_decided(spark, d))
