"""One query per operator over the driver's tables. `oracle` has the same in SQL, written on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postforge import bindings as B
from postforge.bindings import AS_OF, as_of, view
from postforge.functions import rules as R
from postforge.functions import text, urls
from postforge.operators import feed, lifecycle, links, matching, network, normalize, pages, reports, tracker

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = f"TIMESTAMP '{AS_OF}'"
DAYS = f"(epoch_us({NOW}) - epoch_us({{}})) / 86400000000.0"


def query(sql: str | None = None, *views: str, recursive: bool = False):
    """Registers a query by its function's name; sql may use the named domain tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            head = ", ".join(f"{v} AS ({B.sql(v)})" for v in views)
            ORACLES[f.__name__] = (("WITH RECURSIVE " if recursive else "WITH ") + head + ("," if sql.lstrip().startswith("+") else "") if head else "") + " " + sql.lstrip().removeprefix("+")
        return f

    return add


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inlist(xs) -> str:
    return "(" + ", ".join(map(q, xs)) + ")"


def anyof(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def re_(c: str, p: str) -> str:
    return f"regexp_matches({c}, {q('(?i)' + p)})"


# --- filters ---------------------------------------------------------------------------------------------------------

_UNSEEN = "(availability_score <= 0 AND last_apply_check_at IS NULL AND last_confirmed_alive_at IS NULL AND dead_signal_at IS NULL)"


@query(f"SELECT id, status, availability_score FROM canonical WHERE status IN ('LIVE', 'AGING') AND (availability_score >= 35 OR {_UNSEEN})", "canonical")
def feed_visible_filter(spark, d):
    return view(spark, d, "canonical").where(feed.visible()).select("id", "status", "availability_score")


@query(f"SELECT id, status, availability_score FROM canonical WHERE status IN ('LIVE', 'AGING', 'STALE') AND (availability_score >= 20 OR {_UNSEEN})", "canonical")
def feed_visible_search(spark, d):
    return view(spark, d, "canonical").where(feed.visible(searching=True)).select("id", "status", "availability_score")


@query(f"SELECT id, company FROM canonical c WHERE EXISTS (SELECT 1 FROM mapping m WHERE m.canonical_id = c.id AND source_name NOT IN {inlist(R.DEMO_SOURCES)})", "canonical", "mapping")
def feed_semi_source(spark, d):
    return feed.has_real_source(view(spark, d, "canonical", "id", "company"), view(spark, d, "mapping", "canonical_id", "source_name"))


@query("SELECT id, title FROM canonical c WHERE NOT EXISTS (SELECT 1 FROM signal s WHERE s.canonical_id = c.id AND user_id = 7 AND action = 'PASS')", "canonical", "signal")
def feed_anti_pass(spark, d):
    return feed.not_passed(view(spark, d, "canonical", "id", "title"), view(spark, d, "signal"), 7)


@query("SELECT id, 'contains' AS kind FROM canonical WHERE contains(lower(role_family), 'data') UNION ALL SELECT id, 'in' AS kind FROM canonical WHERE role_family IN ('SWE', 'Sales')", "canonical")
def role_contains_vs_in(spark, d):
    c = view(spark, d, "canonical", "id", "role_family")
    return c.where(feed.role_filter("data")).select("id", F.lit("contains").alias("kind")).union(c.where(feed.role_filter("SWE, Sales")).select("id", F.lit("in").alias("kind")))


@query("SELECT id, category FROM canonical WHERE category IN ('MANUAL_ONLY', 'AUTO_FILL_REVIEW')", "canonical")
def category_expansion(spark, d):
    return view(spark, d, "canonical", "id", "category").where(feed.category_filter("MANUAL_ONLY"))


@query("SELECT id, salary_max FROM canonical WHERE salary_max >= 57000", "canonical")
def salary_floor(spark, d):
    return view(spark, d, "canonical", "id", "salary_max").where(F.col("salary_max") >= 57000)


def _stage_sql() -> str:
    t, de, f = "lower(coalesce(title, ''))", "lower(coalesce(description, ''))", "lower(coalesce(role_family, ''))"
    i = f"(coalesce(employment_type, 'FULL_TIME') = 'INTERNSHIP' OR {anyof(t, R.INTERNSHIP_WORDS)} OR {anyof(de, R.INTERNSHIP_WORDS)})"
    a = f"({anyof(f, R.ADMIN_FAMILY)} OR {anyof(t, R.ADMIN_TITLE)} OR {anyof(de, R.ADMIN_TEXT)})"
    s, o, e = (f"({anyof(t, x)} OR {anyof(de, y)})" for x, y in ((R.SENIOR_TITLE, R.SENIOR_TEXT), (R.ASSOCIATE_TITLE, R.ASSOCIATE_TEXT), (R.ENTRY_TITLE, R.ENTRY_TEXT)))
    return f"SELECT id, {i} AS internship, {a} AS administrative, NOT {i} AND NOT {a} AND {s} AS senior, NOT {i} AND NOT {a} AND NOT {s} AND {o} AS associate, NOT {i} AND NOT {a} AND NOT {s} AND NOT {o} AND {e} AS entry FROM canonical"


@query(_stage_sql(), "canonical")
def career_stage_exclusive(spark, d):
    s = text.career_stages(F.col("title"), F.col("description"), F.col("employment_type"), F.col("role_family"), as_typed=True)
    names = {"internship": "INTERNSHIP", "administrative": "ADMINISTRATIVE_SUPPORT", "senior": "SENIOR_LEVEL", "associate": "ASSOCIATE", "entry": "ENTRY_LEVEL"}
    return view(spark, d, "canonical").select("id", *[s[v].alias(k) for k, v in names.items()])


@query("SELECT id FROM tag WHERE tag IN ('urgent', 'remote') GROUP BY id HAVING count(DISTINCT tag) = 2", "tag")
def tags_all_of(spark, d):
    return reports.with_all_tags(view(spark, d, "tag"), ["urgent", "remote"])


@query("""SELECT id FROM canonical c WHERE status IN ('LIVE', 'AGING') AND category = 'AUTO_SUBMIT_READY' AND EXISTS (SELECT 1 FROM signal s WHERE s.canonical_id = c.id AND action = 'SAVE')
  AND NOT EXISTS (SELECT 1 FROM signal s WHERE s.canonical_id = c.id AND action = 'APPLY' AND user_id = 3)""", "canonical", "signal")  # fmt: skip
def candidates_semi_anti(spark, d):
    c = view(spark, d, "canonical", "id", "status", "category").where("status IN ('LIVE', 'AGING') AND category = 'AUTO_SUBMIT_READY'")
    s = view(spark, d, "signal", "canonical_id", "action", "user_id")
    saved, applied = s.where("action = 'SAVE'"), s.where("action = 'APPLY' AND user_id = 3")
    return c.join(saved, c["id"] == saved["canonical_id"], "left_semi").join(applied, c["id"] == applied["canonical_id"], "left_anti").select("id")


# --- text keys and rules ---------------------------------------------------------------------------------------------


@query("SELECT id, trim(regexp_replace(replace(lower(company), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') AS k FROM canonical", "canonical")
def entity_key(spark, d):
    return view(spark, d, "canonical", "id", "company").select("id", text.entity_key(F.col("company")).alias("k"))


@query(f"SELECT id, array_to_string([w for w in string_split_regex(regexp_replace(lower(title), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+') if w <> '' AND w NOT IN {inlist(R.TITLE_STOP_WORDS)}], '-') AS k FROM canonical", "canonical")
def title_core_key(spark, d):
    return view(spark, d, "canonical", "id", "title").select("id", text.title_core_key(F.col("title")).alias("k"))


_PLACE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(location), '\b(remote|hybrid|on-site|onsite|flexible)\b', ' ', 'g'), '[;/]+', ',', 'g'), '\s+', ' ', 'g'), '[^a-z0-9, -]+', ' ', 'g')"


@query(f"SELECT id, array_to_string(list_sort([regexp_replace(trim(x), '\\s+', '-', 'g') for x in string_split({_PLACE}, ',') if trim(x) <> '']), '|') AS k FROM canonical", "canonical")
def location_key(spark, d):
    return view(spark, d, "canonical", "id", "location").select("id", text.location_key(F.col("location")).alias("k"))


_CONTENT = f"[w for w in string_split_regex(regexp_replace(regexp_replace(lower(description), '<[^>]+>', ' ', 'g'), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+') if length(w) >= 4 AND w NOT IN {inlist(R.TEXT_STOP_WORDS)}]"


@query(f"+ w AS (SELECT id, {_CONTENT} AS w FROM document), f AS (SELECT id, w[i] AS t, i FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM w)), g AS (SELECT id, t, min(i) AS i FROM f GROUP BY id, t), h AS (SELECT id, t, i, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM g), s AS (SELECT id, string_agg(t, '-' ORDER BY i) AS k FROM h WHERE n <= 24 GROUP BY id) SELECT document.id, coalesce(k, '') AS k FROM document LEFT JOIN s ON document.id = s.id", "document")
def description_fingerprint(spark, d):
    return view(spark, d, "document", "id", "description").select("id", text.description_fingerprint(F.col("description")).alias("k"))


@query("SELECT id, md5(concat_ws(':', company_key, lower(title), lower(location), lower(coalesce(region, 'unknown')))) AS k FROM canonical", "canonical")
def duplicate_cluster_md5(spark, d):
    return view(spark, d, "canonical").select("id", text.cluster_id(F.col("company_key"), F.lower("title"), F.lower("location"), F.col("region")).alias("k"))


@query(f"""+ u AS (SELECT id, apply_url AS u, lower(regexp_extract(apply_url, '^https?://([^/?#:]+)', 1)) AS h, regexp_replace(regexp_replace(lower(regexp_extract(apply_url, '^https?://[^/?#]+([^?#]*)', 1)), '/+$', ''), '/{{2,}}', '/', 'g') AS p, string_split(regexp_extract(apply_url, '\\?([^#]*)', 1), '&') AS q FROM canonical),
x AS (SELECT id, h, p, list_sort([lower(y) for y in q if split_part(lower(y), '=', 1) IN {inlist(R.STABLE_QUERY_PARAMS)} AND split_part(y, '=', 2) <> '']) AS q FROM u)
SELECT id, CASE WHEN h <> '' THEN h || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS k FROM x""", "canonical")  # fmt: skip
def url_identity_key(spark, d):
    return view(spark, d, "canonical", "id", "apply_url").select("id", urls.identity_key(F.col("apply_url")).alias("k"))


@query("SELECT id, CASE " + " ".join(f"WHEN {re_('title', chr(92) + 'b(' + p + ')' + chr(92) + 'b')} THEN {q(i + '/' + r)}" for i, r, p in R.ROLES) + " END AS role FROM canonical", "canonical")
def role_rules(spark, d):
    r = text.role_profile(F.col("title"))
    return view(spark, d, "canonical", "id", "title").select("id", F.concat_ws("/", r["industry"], r["role_family"]).alias("role")).select("id", F.nullif("role", F.lit("")).alias("role"))


def _region_sql() -> str:
    u, low = "upper(location)", "lower(location)"
    parts = "[upper(trim(x)) for x in string_split(location, ',') if trim(x) <> '']"
    last, before = f"coalesce(list_extract({parts}, -1), '')", f"coalesce(list_extract({parts}, -2), '')"
    remote = f"(({anyof(u, R.REMOTE_PHRASES)} OR {u} = 'GLOBAL') AND NOT {anyof(u, R.REMOTE_ELSEWHERE)})"
    return f"""SELECT id, CASE WHEN {anyof(u, R.CONTINENT_PHRASES)} THEN 'CA' WHEN {anyof(u, R.US_PHRASES)} THEN 'US' WHEN contains({u}, 'CANADA') THEN 'CA' WHEN {anyof(low, R.US_CITIES)} THEN 'US' WHEN {anyof(low, R.CA_CITIES)} THEN 'CA'
  WHEN {last} = 'CA' AND {before} IN {inlist(R.CA_PROVINCES)} THEN 'CA' WHEN {last} IN ('US', 'USA') AND {before} IN {inlist(R.US_STATES)} THEN 'US' WHEN {last} = 'CANADA' AND {before} IN {inlist(R.CA_PROVINCES)} THEN 'CA'
  WHEN {last} IN {inlist(R.US_STATES)} THEN 'US' WHEN {last} IN {inlist(R.CA_PROVINCES)} THEN 'CA' WHEN {remote} AND ({anyof(u, ['WORLDWIDE', 'ANYWHERE', 'CANADA', *R.CONTINENT_PHRASES])} OR {u} = 'GLOBAL') THEN 'CA' WHEN {remote} THEN 'US' END AS region FROM canonical"""


@query(_region_sql(), "canonical")
def region_rules(spark, d):
    return view(spark, d, "canonical", "id", "location").select("id", text.region(F.col("location")).alias("region"))


def _level_sql() -> str:
    p = lambda c: f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[–—]', '-', 'g'), '\\s+', ' ', 'g'))"
    t, de = p("title"), p("description")
    i = f"(coalesce(employment_type, 'FULL_TIME') = 'INTERNSHIP' OR {anyof(t, R.INTERNSHIP_WORDS)} OR {anyof(de, R.INTERNSHIP_WORDS)})"
    a = f"({anyof(p('role_family'), R.ADMIN_FAMILY)} OR {anyof(t, R.ADMIN_TITLE)} OR {anyof(de, R.ADMIN_TEXT)})"
    s = f"({anyof(t, R.SENIOR_TITLE)} OR {anyof(de, R.SENIOR_TEXT)})"
    early = f"({anyof(t, R.ASSOCIATE_TITLE)} OR {anyof(de, R.ASSOCIATE_TEXT)} OR {anyof(t, R.ENTRY_TITLE)} OR {anyof(de, R.ENTRY_TEXT)})"
    return f"""SELECT id, CASE WHEN {i} THEN 'ENTRY' WHEN {anyof(t, R.EXECUTIVE_WORDS)} OR {anyof(de, R.EXECUTIVE_TEXT)} THEN 'EXECUTIVE' WHEN {anyof(t, R.LEAD_WORDS)} OR {anyof(de, R.LEAD_TEXT)} THEN 'LEAD'
  WHEN {anyof(t, R.SENIOR_WORDS)} THEN 'SENIOR' WHEN NOT {a} AND NOT {s} AND {early} THEN 'ENTRY' WHEN {anyof(t, R.MID_WORDS)} OR {anyof(de, R.MID_TEXT)} THEN 'MID' ELSE 'UNKNOWN' END AS level FROM canonical"""


@query(_level_sql(), "canonical")
def experience_level(spark, d):
    return view(spark, d, "canonical").select("id", text.experience_level(F.col("title"), F.col("description"), F.col("employment_type"), F.col("role_family")).alias("level"))


_ALL = "lower(concat_ws(' ', title, location, description))"


@query(f"""SELECT id, CASE WHEN contains({_ALL}, 'hybrid') THEN 'HYBRID' WHEN {anyof(_ALL, ['remote', 'work from home'])} THEN 'REMOTE' WHEN contains({_ALL}, 'flexible') THEN 'FLEXIBLE' WHEN {anyof(_ALL, ['on-site', 'onsite'])} THEN 'ONSITE' ELSE 'UNKNOWN' END AS mode,
  coalesce(employment_type, CASE WHEN {anyof("lower(concat_ws(' ', title, description))", ['intern', 'co-op'])} THEN 'INTERNSHIP' WHEN {anyof("lower(concat_ws(' ', title, description))", ['contract', 'temporary', 'fixed-term'])} THEN 'CONTRACT'
  WHEN {anyof("lower(concat_ws(' ', title, description))", ['part time', 'part-time'])} THEN 'PART_TIME' ELSE 'UNKNOWN' END) AS type FROM canonical""", "canonical")  # fmt: skip
def work_mode_and_type(spark, d):
    c = F.col
    return view(spark, d, "canonical").select("id", text.work_mode(c("title"), c("location"), c("description"), F.lit(None).cast("string")).alias("mode"), text.employment_type(c("title"), c("description"), c("employment_type")).alias("type"))


_EVERY = "concat_ws(chr(10), title, description, apply_url)"
_TWO = "concat_ws(chr(10), title, description)"


@query(f"""SELECT id, ({' OR '.join(re_('title', p) for p in R.JUNK_TITLES)}) OR (({' OR '.join(re_(_EVERY, p) for p in R.JUNK_CONTENT)}) AND NOT ({re_(_EVERY, R.JOB_SIGNALS)} OR length(description) >= 240)) AS junk,
  CASE WHEN deadline <= {NOW} THEN 'Posting deadline has passed.' {' '.join(f"WHEN {re_(_TWO, p)} THEN 'Explicit dead signal detected: ' || trim(regexp_extract({_TWO}, {q('(?i)' + p)}))" for p in R.DEAD_CONTENT)} END AS dead FROM canonical""", "canonical")  # fmt: skip
def junk_and_dead(spark, d):
    c = F.col
    return view(spark, d, "canonical").select("id", text.is_junk(c("title"), c("description"), c("apply_url")).alias("junk"), text.dead_reason(c("title"), c("description"), c("deadline"), as_of()).alias("dead"))


@query(r"""+ s AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(description, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '<br\s*/?>', chr(10), 'gi'), '</?(p|div|section|article|h[1-6]|li|ul|ol|blockquote)[^>]*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g') AS t FROM canonical)
SELECT id, trim(regexp_replace(array_to_string([trim(regexp_replace(x, '[ \t]+', ' ', 'g')) for x in string_split(t, chr(10))], chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS t FROM s""", "canonical")
def sanitized_text(spark, d):
    return view(spark, d, "canonical", "id", "description").select("id", text.sanitize(F.col("description")).alias("t"))


def _host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^https?://([^/?#:]+)', 1))"


def _hosts(u: str, hosts) -> str:
    return "(" + " OR ".join(f"{_host(u)} = {q(h)} OR ends_with({_host(u)}, {q('.' + h)})" for h in hosts) + ")"


def _is(prefixes, hosts) -> str:
    return f"(split_part(source_name, ':', 1) IN {inlist(prefixes)} OR {_hosts('source_url', hosts)})"


_D, _S, _A = _is(R.DIRECT_PREFIXES, R.DIRECT_HOSTS), _is(R.BOARD_PREFIXES, R.BOARD_HOSTS), _is(R.AGGREGATOR_PREFIXES, R.AGGREGATOR_HOSTS)


@query(f"""SELECT id, source_name, source_url, CASE WHEN {_D} THEN 'DIRECT_COMPANY' WHEN {_S} THEN 'STRUCTURED_BOARD' WHEN {_A} THEN 'AGGREGATOR_REDIRECT' ELSE 'WEAK_SCRAPED_COPY' END AS kind,
  CAST(CASE WHEN {_D} THEN 400 WHEN {_S} THEN 300 WHEN {_A} THEN 200 ELSE 100 END + CASE WHEN {_host('source_url')} = '' THEN 0 WHEN {_hosts('source_url', R.DIRECT_HOSTS)} THEN 40 WHEN {_hosts('source_url', R.BOARD_HOSTS)} THEN 20 WHEN {_hosts('source_url', R.AGGREGATOR_HOSTS)} THEN 0 ELSE 10 END
  + CASE WHEN {_host('source_url')} = '' THEN 0 ELSE 5 END AS BIGINT) AS rank FROM mapping""", "mapping")  # fmt: skip
def source_quality_rank(spark, d):
    k = urls.quality(F.col("source_name"), F.col("source_url"), F.col("source_url"))
    return view(spark, d, "mapping", "id", "source_name", "source_url").select("id", "source_name", "source_url", k["kind"].alias("kind"), k["rank"].cast("long").alias("rank"))


@query(f"""SELECT id, CASE WHEN {_D} THEN 'ATS' WHEN {_S} THEN 'BOARD' WHEN {_A} THEN 'AGGREGATOR' WHEN contains(lower(split_part(source_name, ':', 1)), 'json') THEN 'COMPANY_JSON' ELSE 'COMPANY_HTML' END AS kind,
  round(least(0.99, CASE WHEN {_D} THEN 0.95 WHEN {_S} THEN 0.82 WHEN {_A} THEN 0.55 WHEN contains(lower(split_part(source_name, ':', 1)), 'json') THEN 0.85 ELSE 0.7 END + CASE WHEN is_full_snapshot THEN 0.05 ELSE 0 END)::DOUBLE, 4) AS reliability FROM mapping""", "mapping")  # fmt: skip
def source_lifecycle_type(spark, d):
    k = urls.lifecycle(F.col("source_name"), F.col("source_url"), F.col("source_url"), F.when(F.col("is_full_snapshot"), "FULL_SNAPSHOT").otherwise("INCREMENTAL"))
    return view(spark, d, "mapping", "id", "source_name", "source_url", "is_full_snapshot").select("id", k["source_type"].alias("kind"), F.round(k["reliability"], 4).alias("reliability"))


def _eligibility_sql() -> str:
    n, u = "lower(source_name)", "lower(apply_url)"
    portal = f"CASE WHEN {anyof(n, R.STRUCTURED_PORTALS[0])} OR {anyof(u, R.STRUCTURED_PORTALS[1])} THEN 'structured' WHEN {anyof(n, R.SEMI_PORTALS[0])} OR {anyof(u, R.SEMI_PORTALS[1])} THEN 'semi' WHEN {anyof(n, R.AGGREGATOR_PORTALS)} THEN 'aggregator' ELSE 'unknown' END"
    return f"""+ p AS (SELECT *, {portal} AS portal, regexp_matches(lower(description), {q(R.CUSTOM_WRITING)}) AS writing, {re_('title', R.HIGH_TOUCH_TITLE)} AS high, {re_('title', R.INTERN_TITLE)} AS intern, NOT {anyof('apply_url', R.KNOWN_REDIRECTS)} AS away FROM incoming)
SELECT id, CASE WHEN portal = 'unknown' THEN 'unknown_source_portal' WHEN portal = 'aggregator' AND away THEN 'aggregator_external_redirect' WHEN portal IN ('semi', 'aggregator') AND writing THEN 'custom_writing_semi_structured'
  WHEN portal IN ('semi', 'aggregator') AND high THEN 'senior_role_semi_structured' WHEN portal IN ('semi', 'aggregator') THEN 'semi_structured_portal' WHEN writing THEN 'custom_written_response_required' WHEN high THEN 'higher_touch_role_review'
  WHEN intern THEN 'internship_review' WHEN employment_type <> 'FULL_TIME' THEN 'non_standard_employment_review' ELSE 'structured_ats_flow' END AS reason FROM p"""


@query(_eligibility_sql(), "incoming")
def eligibility_rules(spark, d):
    df = view(spark, d, "incoming").withColumn("experience_level", F.lit("UNKNOWN"))
    return normalize.eligibility(df).select("id", F.col("eligibility.reason").alias("reason"))


_TRUST = f"CASE WHEN source_name IN {inlist(R.DEMO_SOURCES)} THEN 'UNAVAILABLE' WHEN NOT coalesce(regexp_matches(source_url, '(?i)^https?://[^/]'), false) THEN 'CAUTION' WHEN {_hosts('source_url', R.BLOCKED_HOSTS)} THEN 'UNAVAILABLE' WHEN (contains(source_name, ':') AND split_part(source_name, ':', 1) IN {inlist(R.TRUSTED_PREFIXES)}) OR {_hosts('source_url', R.TRUSTED_HOSTS)} THEN 'TRUSTED' ELSE 'CAUTION' END"


@query(f"SELECT id, source_name, source_url, {_TRUST} AS trust FROM mapping", "mapping")
def link_trust(spark, d):
    return view(spark, d, "mapping", "id", "source_name", "source_url").select("id", "source_name", "source_url", urls.trust(F.col("source_url"), F.col("source_name")).alias("trust"))


@query(f"""+ m AS (SELECT *, {_TRUST} AS t, coalesce(regexp_matches(source_url, '(?i)^https?://[^/]'), false) AS ok FROM mapping),
g AS (SELECT canonical_id, bool_and(source_name IN {inlist(R.DEMO_SOURCES)}) AS demo, min((NOT is_primary, id, source_name, source_url)) FILTER (ok AND t = 'TRUSTED') AS sure, min((NOT is_primary, id, source_name, source_url)) FILTER (ok AND t <> 'UNAVAILABLE') AS live FROM m GROUP BY 1),
x AS (SELECT c.id, apply_url, demo, coalesce(sure, live) AS best, sure, regexp_matches(apply_url, '(?i)^https?://[^/]') AND NOT demo AND NOT {_hosts('apply_url', R.BLOCKED_HOSTS)} AND live IS NOT NULL AS own FROM canonical c JOIN g ON c.id = g.canonical_id)
SELECT id, CASE WHEN own THEN apply_url WHEN NOT demo AND best IS NOT NULL THEN best[4] END AS href, CASE WHEN own THEN 'APPLY' WHEN NOT demo AND best IS NOT NULL THEN 'SOURCE' END AS kind, CASE WHEN own OR (NOT demo AND best IS NOT NULL) THEN CASE WHEN sure IS NOT NULL THEN 'TRUSTED' ELSE 'CAUTION' END ELSE 'UNAVAILABLE' END AS level FROM x""", "canonical", "mapping")  # fmt: skip
def resolved_links(spark, d):
    m = view(spark, d, "mapping", "canonical_id", "id", "source_name", "source_url", "is_primary")
    return links.resolved(view(spark, d, "canonical", "id", "apply_url"), m).select("id", "href", "kind", "level")


_SUFFIX = R.COMPANY_SUFFIX.removeprefix(r"\b").removesuffix("$")
_CLEAN = f"trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(company), {q('(?i)^(?:' + R.COMPANY_PREFIX.removeprefix('^') + ')+')}, '')), '(?i)\\((?:canada|ca)\\)', '', 'g')), {q('(?i)(?:' + chr(92) + 'b' + _SUFFIX + chr(92) + 's*)+$')}, ''))"


@query(f"+ c AS (SELECT id, regexp_replace(regexp_replace({_CLEAN}, '\\s+-\\s+', ' ', 'g'), '\\s{{2,}}', ' ', 'g') AS name FROM canonical) SELECT id, name, regexp_replace(replace(lower(name), '&', ' and '), '[^a-z0-9]+', '', 'g') AS k FROM c", "canonical")
def company_key_clean(spark, d):
    return view(spark, d, "canonical", "id", "company").select("id", text.clean_company(F.col("company")).alias("name"), text.company_key(F.col("company")).alias("k"))


# --- pages -----------------------------------------------------------------------------------------------------------


@query("SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '(?is)<a\\b[^>]*?href\\s*=\\s*[\"'']([^\"''#]+)', 1))) AS BIGINT) AS n_links, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages")
def html_links(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", F.size(pages.links(F.col("html"))).cast("long").alias("n_links"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"))


# --- matching and merging --------------------------------------------------------------------------------------------


def _keyed(df: DataFrame) -> DataFrame:
    k = normalize.keys(F.col("company"), F.col("title"), F.col("description"), F.col("location"), F.col("apply_url"))
    k.pop("company_key")
    return df.withColumns({**k, "short_summary": F.lit(""), "description": F.coalesce("description", F.lit(""))}).withColumn("duplicate_cluster_id", text.cluster_id(F.col("company_key"), F.col("title_core_key"), F.col("location_key"), F.col("region")))


@query("+ k AS (SELECT source_id AS k, canonical_id, removed_at, is_primary, source_quality_rank, last_seen_at, id FROM mapping), r AS (SELECT incoming.id AS new_id, canonical_id AS known_id, row_number() OVER (PARTITION BY incoming.id ORDER BY removed_at ASC NULLS LAST, is_primary DESC, source_quality_rank DESC, last_seen_at DESC, k.id) AS rn FROM incoming JOIN k ON CAST(incoming.id AS VARCHAR) = k.k) SELECT new_id, known_id FROM r WHERE rn = 1", "incoming", "mapping")
def exact_key_match(spark, d):
    new = view(spark, d, "incoming", "id", "company_key").withColumns({"posting_id_key": F.col("id").cast("string"), "apply_url_key": F.lit(None).cast("string"), "source_url_key": F.lit(None).cast("string"), "duplicate_cluster_id": F.lit(None).cast("string")})
    m = view(spark, d, "mapping").withColumns({"posting_id_key": F.col("source_id"), "apply_url_key": F.lit(None).cast("string"), "source_url_key": F.lit(None).cast("string")})
    known = view(spark, d, "canonical", "id").withColumns({"apply_url_key": F.lit(None).cast("string"), "duplicate_cluster_id": F.lit(None).cast("string")})
    return matching.exact_matches(new, m, known).where("how = 'postingIdKey'").select("new_id", "known_id")


_BLOCKS = "k.company_key = n.company_key AND n.company_key <> 'unknown' AND ((k.core = n.core AND n.core <> '') OR (k.fp = n.fp AND n.fp <> '') OR (k.loc = n.loc AND n.loc <> '')) AND (n.region IS NULL OR k.region IS NULL OR k.region = n.region)"


def _similar_sql(where: str = " WHERE c OR t OR (st >= 2 AND (sd >= 4 OR ss >= 4))", on: str = _BLOCKS) -> str:
    core = f"array_to_string([w for w in string_split_regex(regexp_replace(lower(title), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+') if w <> '' AND w NOT IN {inlist(R.TITLE_STOP_WORDS)}], '-')"
    key = "trim(regexp_replace(replace(lower(title), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-')"
    loc = f"array_to_string(list_sort([regexp_replace(trim(x), '\\s+', '-', 'g') for x in string_split({_PLACE}, ',') if trim(x) <> '']), '|')"
    uniq = f"list_filter({_CONTENT}, lambda x, i: list_position({_CONTENT}, x) = i)"
    cols = f"id, company_key, region, role_family, work_mode, posted_at, {core} AS core, {key} AS tk, {loc} AS loc, array_to_string(list_slice({uniq}, 1, 24), '-') AS fp, list_slice({_CONTENT}, 1, 24) AS sn"
    tok = lambda a, b, c: f"len([x for x in string_split({b}.{c}, '-') if length(x) >= 3 AND list_contains([y for y in string_split({a}.{c}, '-') if length(y) >= 3], x)])"
    return f"""+ k AS (SELECT {cols} FROM canonical), n AS (SELECT {cols} FROM incoming),
p AS (SELECT k.id AS known_id, n.id AS new_id, k.core = n.core AS c, k.tk = n.tk AS t, k.fp = n.fp AND k.fp <> '' AS f, k.loc = n.loc AS l, k.role_family = n.role_family AS r, k.work_mode = n.work_mode AS w,
  {tok('k', 'n', 'core')} AS st, {tok('k', 'n', 'fp')} AS sd, len([x for x in n.sn if list_contains(k.sn, x)]) AS ss, abs(epoch_us(k.posted_at) - epoch_us(n.posted_at)) / 86400000000.0 AS ap
  FROM k JOIN n ON {on})
SELECT known_id, new_id, CAST(CASE WHEN c OR t OR (st >= 2 AND (sd >= 4 OR ss >= 4)) THEN CASE WHEN c THEN 30 ELSE 0 END + CASE WHEN t THEN 16 ELSE 0 END + CASE WHEN f THEN 20 ELSE least(sd * 2, 14) END + least(st * 7, 21) + least(ss * 2, 10)
  + CASE WHEN l THEN 12 ELSE 0 END + CASE WHEN r THEN 10 ELSE 0 END + CASE WHEN w THEN 3 ELSE 0 END + CASE WHEN ap <= 7 THEN 10 WHEN ap <= 21 THEN 6 WHEN ap <= 45 THEN 3 ELSE 0 END ELSE 0 END AS BIGINT) AS score FROM p{where}"""


@query(_similar_sql(), "canonical", "incoming")
def similarity_match(spark, d):
    known, new = _keyed(view(spark, d, "canonical", dear=True)), _keyed(view(spark, d, "incoming", dear=True))
    return matching.score_pairs(known, new).withColumn("score", F.col("score").cast("long"))


def identity_sql(u: str) -> str:
    params = f"list_sort([lower(y) for y in string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&') if split_part(lower(y), '=', 1) IN {inlist(R.STABLE_QUERY_PARAMS)} AND split_part(y, '=', 2) <> ''])"
    path = f"regexp_replace(regexp_replace(lower(regexp_extract({u}, '^https?://[^/?#]+([^?#]*)', 1)), '/+$', ''), '/{{2,}}', '/', 'g')"
    return f"CASE WHEN {_host(u)} <> '' THEN {_host(u)} || {path} || CASE WHEN len({params}) > 0 THEN '?' || array_to_string({params}, '&') ELSE '' END END"


_CLUSTER = "md5(concat_ws(':', {0}.company_key, {0}.core, {0}.loc, lower(coalesce({0}.region, 'unknown'))))"
#: Postings of the query go by one kind of key each, so that every rung is met. Ends in u: all matches, rn = 1 where one counts.
MATCHES_SQL = f"""{_similar_sql().replace('SELECT known_id, new_id, CAST(', ', sim AS (SELECT known_id, new_id, CAST(', 1)}),
m AS (SELECT id AS mid, canonical_id, source_id, {identity_sql('source_url')} AS ak, removed_at, is_primary, source_quality_rank, last_seen_at FROM mapping),
ki AS (SELECT min(id) AS id, {identity_sql('apply_url')} AS ak FROM canonical GROUP BY 2), ni AS (SELECT id, CASE WHEN id % 4 = 0 THEN {identity_sql('apply_url')} END AS ak, CASE WHEN id % 4 = 1 THEN CAST(id AS VARCHAR) END AS pk, CASE WHEN id % 4 = 2 AND id % 3 = 0 THEN {identity_sql('apply_url')} END AS sk FROM incoming),
kc AS (SELECT min(id) AS id, {_CLUSTER.format('k')} AS ck FROM k GROUP BY 2), nc AS (SELECT id, {_CLUSTER.format('n')} AS ck FROM n WHERE id % 4 <> 3 AND company_key <> 'unknown'),
u AS (SELECT ni.id AS new_id, canonical_id AS known_id, 'applyUrlKey' AS how, 0 AS rung, 100 AS score, row_number() OVER (PARTITION BY ni.id ORDER BY removed_at ASC NULLS LAST, is_primary DESC, source_quality_rank DESC, last_seen_at DESC, mid) AS rn FROM ni JOIN m ON ni.ak = m.ak
  UNION ALL SELECT ni.id, canonical_id, 'sourceUrlKey', 2, 100, row_number() OVER (PARTITION BY ni.id ORDER BY removed_at ASC NULLS LAST, is_primary DESC, source_quality_rank DESC, last_seen_at DESC, mid) FROM ni JOIN m ON ni.sk = m.ak
  UNION ALL SELECT ni.id, canonical_id, 'postingIdKey', 4, 100, row_number() OVER (PARTITION BY ni.id ORDER BY removed_at ASC NULLS LAST, is_primary DESC, source_quality_rank DESC, last_seen_at DESC, mid) FROM ni JOIN m ON ni.pk = m.source_id
  UNION ALL SELECT ni.id, ki.id, 'applyUrlKey', 1, 100, 1 FROM ni JOIN ki ON ni.ak = ki.ak UNION ALL SELECT nc.id, kc.id, 'duplicateCluster', 6, 95, 1 FROM nc JOIN kc ON nc.ck = kc.ck UNION ALL SELECT new_id, known_id, 'similarity', 9, score, 1 FROM sim WHERE score >= 45)"""
_BEST_SQL = f"""{MATCHES_SQL}
SELECT new_id, known_id, how, CAST(score AS BIGINT) AS score FROM u WHERE rn = 1 QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY rung, score DESC, known_id) = 1"""


def _sides(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """new, mappings, known for the matching queries."""
    i, url = F.col("id") % 4, F.col("apply_url_key")
    known, new = _keyed(view(spark, d, "canonical", dear=True)), _keyed(view(spark, d, "incoming", dear=True))
    new = new.withColumns({"source_url_key": F.when((i == 2) & (F.col("id") % 3 == 0), url), "apply_url_key": F.when(i == 0, url), "posting_id_key": F.when(i == 1, F.col("id").cast("string")), "duplicate_cluster_id": F.when(i != 3, F.col("duplicate_cluster_id"))})
    m = view(spark, d, "mapping").withColumns({"posting_id_key": F.col("source_id"), "apply_url_key": urls.identity_key(F.col("source_url"))}).withColumn("source_url_key", F.col("apply_url_key"))
    return new, m, known


@query(_BEST_SQL, "canonical", "incoming", "mapping")
def best_match(spark, d):
    return matching.best_match(*_sides(spark, d)).withColumn("score", F.col("score").cast("long"))


def compatible_sql(on: str, own: str = "true") -> str:
    """CTEs that end in fits(known_id, new_id, fits) of the pairs of k and n that `on` joins; `own` says which incoming rows have a URL key."""
    url = f"CASE WHEN {own} THEN {identity_sql('i.apply_url')} END"
    return f"""{_similar_sql("", on).removeprefix("+ ").replace("SELECT known_id, new_id, CAST(", ", z AS (SELECT known_id, new_id, CAST(", 1)}),
fits AS (SELECT c.id AS known_id, i.id AS new_id, coalesce({identity_sql('c.apply_url')} = {url}, false) OR (i.company_key <> 'unknown' AND c.company_key = i.company_key AND k.core = n.core AND k.loc = n.loc) OR z.score > 0 AS fits FROM z JOIN canonical c ON c.id = z.known_id JOIN incoming i ON i.id = z.new_id JOIN k ON k.id = c.id JOIN n ON n.id = i.id)"""


@query("+ " + compatible_sql("k.company_key = n.company_key AND k.id % 10 = n.id % 10") + " SELECT * FROM fits", "canonical", "incoming")
def compatible_pairs(spark, d):
    """Whether a posting may stay where it was matched before, for each pair of a company that a stored match joins."""
    known, new = (_keyed(view(spark, d, v, dear=True)).withColumn("stored", F.col("id") % 10) for v in ("canonical", "incoming"))
    return matching.compatible_pairs(known, new, ["company_key", "stored"])


def merged_columns(p: str) -> str:
    """The columns of a row c after posting n, where p says whether n is preferred."""
    ok = lambda s, c, u="": f"(trim({s}.{c}) <> '' AND lower(trim({s}.{c})) <> '{u}')"
    txt = lambda c, u="": f"CASE WHEN {p} AND {ok('n', c, u)} THEN n.{c} WHEN {ok('c', c, u)} THEN c.{c} WHEN {ok('n', c, u)} THEN n.{c} WHEN {p} AND trim(n.{c}) <> '' THEN n.{c} ELSE c.{c} END AS {c}"
    en = lambda c: f"CASE WHEN {p} AND coalesce(n.{c} <> 'UNKNOWN', false) THEN n.{c} WHEN coalesce(c.{c} <> 'UNKNOWN', false) THEN c.{c} WHEN coalesce(n.{c} <> 'UNKNOWN', false) THEN n.{c} WHEN {p} AND n.{c} IS NOT NULL THEN n.{c} ELSE coalesce(c.{c}, n.{c}) END AS {c}"
    pay = f"(n.salary_min IS NOT NULL OR n.salary_max IS NOT NULL) AND ({p} OR (c.salary_min IS NULL AND c.salary_max IS NULL))"
    return f"""{txt('title')}, {txt('company', 'unknown')}, {txt('location', 'unknown')}, {txt('role_family', 'unknown')}, CASE WHEN {p} THEN coalesce(n.region, c.region) ELSE coalesce(c.region, n.region) END AS region, {en('work_mode')}, {en('employment_type')},
  CASE WHEN {p} THEN CASE WHEN length(trim(n.description)) > 0 AND length(trim(n.description)) >= floor(length(trim(c.description)) * 0.6) OR length(trim(c.description)) = 0 THEN n.description ELSE c.description END WHEN length(trim(c.description)) > 0 THEN c.description ELSE n.description END AS description,
  CASE WHEN trim(c.apply_url) = '' THEN trim(n.apply_url) WHEN trim(n.apply_url) = '' THEN trim(c.apply_url) WHEN {p} THEN trim(n.apply_url) ELSE trim(c.apply_url) END AS apply_url,
  CASE WHEN {pay} THEN n.salary_min ELSE c.salary_min END AS salary_min, CASE WHEN {pay} THEN n.salary_max ELSE c.salary_max END AS salary_max, least(c.posted_at, n.posted_at) AS posted_at, least(c.deadline, n.deadline) AS deadline"""


def _merge_sql() -> str:
    return f"SELECT * EXCLUDE (posted_at, deadline), epoch_us(posted_at) AS posted, epoch_us(deadline) AS due FROM (SELECT c.id, {merged_columns('n.rank >= c.availability_score * 5')} FROM canonical c JOIN incoming n ON c.id = n.id)"


@query(_merge_sql(), "canonical", "incoming")
def survivorship_merge(spark, d):
    a, b = view(spark, d, "canonical"), view(spark, d, "incoming")
    pairs = a.select("id", F.struct(*a.columns).alias("now")).join(b.select("id", F.struct(*b.columns).alias("next")), "id").select("now", "next", (F.col("now.availability_score") * 5).alias("now_rank"), F.col("next.rank").alias("next_rank"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return matching.merge(pairs).select("id", "title", "company", "location", "role_family", "region", "work_mode", "employment_type", "description", "apply_url", "salary_min", "salary_max", us("posted_at").alias("posted"), us("deadline").alias("due"))


@query("SELECT canonical_id, id AS mapping_id FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY source_quality_rank DESC, last_seen_at DESC, created_at, id) AS rn FROM mapping WHERE removed_at IS NULL) WHERE rn = 1", "mapping")
def primary_mapping(spark, d):
    return lifecycle.primary(view(spark, d, "mapping"))


@query(f"SELECT id, source_id, canonical_id, epoch_us(CASE WHEN removed_at IS NULL AND source_name = 'Lever:globex' AND source_id NOT IN (SELECT CAST(id AS VARCHAR) FROM run WHERE status = 'SUCCESS') THEN {NOW} ELSE removed_at END) AS removed FROM mapping", "mapping", "run")
def snapshot_tombstones(spark, d):
    seen = view(spark, d, "run", "id", "status").where("status = 'SUCCESS'").select(F.col("id").cast("string").alias("source_id"))
    m = view(spark, d, "mapping", "id", "source_id", "canonical_id", "source_name", "removed_at")
    return lifecycle.tombstones(m, seen, "Lever:globex", as_of()).select("id", "source_id", "canonical_id", F.unix_micros(F.col("removed_at").cast("timestamp")).alias("removed"))


# --- lifecycle -------------------------------------------------------------------------------------------------------


def _lifecycle_sql() -> str:
    hours, gone = f"(epoch_us({NOW}) - epoch_us(last_seen_at)) / 3600000000.0", DAYS.format("removed_at")
    step = lambda x, pairs, other: "CASE " + " ".join(f"WHEN {x} <= {a} THEN {b}::DOUBLE" for a, b in pairs) + f" ELSE {other}::DOUBLE END"
    r = step(hours, [(12, 1), (48, 0.92), (168, 0.78), (336, 0.6), (720, 0.42), (1440, 0.24)], 0.12)
    f = step(gone, [(2, 1), (7, 0.85), (21, 0.65), (45, 0.35)], 0.15)
    age, since = DAYS.format("first_seen_at"), DAYS.format("alive")
    return f"""+ m AS (SELECT *, source_reliability::DOUBLE AS rel, {r} AS r, {f} AS f FROM mapping),
a AS (SELECT canonical_id, last_seen_at, greatest(0.0, rel * 55 * r + CASE WHEN is_full_snapshot THEN 6 * r ELSE 0 END + CASE source_type WHEN 'ATS' THEN 8 * r WHEN 'BOARD' THEN 4 * r WHEN 'AGGREGATOR' THEN -3 * (1 - r) ELSE 0 END) AS s FROM m WHERE removed_at IS NULL),
b AS (SELECT canonical_id, count(*) AS n, max(last_seen_at) AS seen, list_sum(list_slice(list_reverse_sort(list(s)), 1, 2)) AS best FROM a GROUP BY 1),
g AS (SELECT *, greatest(0.0, (rel * 22 + CASE WHEN is_full_snapshot THEN 12 ELSE 0 END + CASE source_type WHEN 'ATS' THEN 8 WHEN 'BOARD' THEN 4 WHEN 'AGGREGATOR' THEN -10 ELSE 0 END) * f) AS s, row_number() OVER (PARTITION BY canonical_id, source_name ORDER BY removed_at DESC, id) AS rn,
  {gone} <= 21 AND is_full_snapshot AND rel >= 0.8 AND source_type <> 'AGGREGATOR' AS strong FROM m WHERE removed_at IS NOT NULL),
h AS (SELECT canonical_id, sum(CASE WHEN rn = 1 THEN s ELSE 0 END) AS gone, bool_or(strong) AS strong FROM g GROUP BY 1),
c AS (SELECT canonical.*, coalesce(n, 0) AS n, coalesce(best, 0.0) AS best, coalesce(gone, 0.0) AS gone, coalesce(strong, false) AS strong, CASE WHEN seen IS NULL THEN last_source_seen_at WHEN last_source_seen_at IS NULL THEN seen ELSE greatest(seen, last_source_seen_at) END AS seen, last_confirmed_alive_at AS alive
  FROM canonical LEFT JOIN b ON canonical.id = b.canonical_id LEFT JOIN h ON canonical.id = h.canonical_id),
e AS (SELECT id, n, strong, deadline <= {NOW} AND (seen IS NULL OR seen <= deadline) AND (alive IS NULL OR alive <= deadline) OR (dead_signal_at IS NOT NULL AND (alive IS NULL OR dead_signal_at >= alive)) AS ended,
  greatest(CASE WHEN alive IS NULL THEN 0 WHEN {since} <= 1 THEN CASE WHEN n > 0 THEN 72 ELSE 56 END WHEN {since} <= 3 THEN CASE WHEN n > 0 THEN 60 ELSE 48 END WHEN {since} <= 7 THEN CASE WHEN n > 0 THEN 48 ELSE 30 END ELSE 0 END,
    least(100, greatest(0, floor(least(78.0, best) + least(12, greatest(0, (n - 1) * 4)) + CASE WHEN alive IS NULL THEN 0 ELSE {step(since, [(1, 15), (3, 12), (7, 8), (14, 4), (30, 1)], 0)} END
    - CASE WHEN {age} <= 120 THEN 0 WHEN {age} <= 240 THEN CASE WHEN n <= 1 THEN 4 ELSE 2 END WHEN {age} <= 365 THEN CASE WHEN n = 0 THEN 10 ELSE 6 END ELSE CASE WHEN n = 0 THEN 16 ELSE 10 END END
    - least(CASE WHEN n > 0 THEN 28.0 ELSE 70.0 END, gone) + 0.5)))) AS s FROM c),
z AS (SELECT id, CASE WHEN coalesce(ended, false) THEN 'EXPIRED' WHEN s >= 72 THEN 'LIVE' WHEN s >= 48 THEN 'AGING' WHEN s >= 22 THEN 'STALE' WHEN n = 0 AND strong THEN 'REMOVED' ELSE 'EXPIRED' END AS status, CAST(CASE WHEN coalesce(ended, false) THEN 0 ELSE s END AS BIGINT) AS availability_score, CAST(n AS BIGINT) AS n_active FROM e)"""


def _scored(spark, d) -> DataFrame:
    return lifecycle.score(view(spark, d, "canonical"), view(spark, d, "mapping"), as_of()).withColumn("availability_score", F.col("availability_score").cast("long"))


@query(_lifecycle_sql() + " SELECT * FROM z", "canonical", "mapping")
def lifecycle_score(spark, d):
    return _scored(spark, d)


@query(_lifecycle_sql() + " SELECT count(*) AS updated, count(*) FILTER (status IN ('LIVE', 'AGING')) AS live, count(*) FILTER (status = 'AGING') AS aging, count(*) FILTER (status = 'STALE') AS stale, count(*) FILTER (status = 'EXPIRED') AS expired, count(*) FILTER (status = 'REMOVED') AS removed FROM z", "canonical", "mapping")
def lifecycle_tally(spark, d):
    return lifecycle.tally(_scored(spark, d))


@query(_lifecycle_sql() + " SELECT canonical.status || ' -> ' || z.status AS transition, count(*) AS n FROM canonical JOIN z ON canonical.id = z.id WHERE canonical.status <> z.status GROUP BY 1", "canonical", "mapping")
def transition_counts(spark, d):
    now = _scored(spark, d).select("id", F.col("status").alias("after"))
    return reports.transitions(view(spark, d, "canonical", "id", "status").join(now, "id"), "status", "after")


@query("SELECT canonical_id, round(list_sum(list_slice(list_reverse_sort(list(source_reliability::DOUBLE)), 1, 2)), 6) AS best_two FROM mapping WHERE removed_at IS NULL GROUP BY 1", "mapping")
def top2_evidence(spark, d):
    w = Window.partitionBy("canonical_id").orderBy(F.desc("rel"))
    m = view(spark, d, "mapping", "canonical_id", "source_reliability", "removed_at").where("removed_at IS NULL").withColumn("rel", F.col("source_reliability").cast("double"))
    return m.withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy("canonical_id").agg(F.round(F.sum("rel"), 6).alias("best_two"))


# --- source network --------------------------------------------------------------------------------------------------

_R = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END"
_YIELD = f"""least(0.99, greatest(0.01, quality * 0.22 + ({_R('successes', 'attempts')}) * 0.16 + ({_R('accepted', 'fetched')}) * 0.08 + ({_R('created', 'fetched')}) * 0.12 + least(1.0, ({_R('accepted', 'successes')}) / 175) * 0.08 + least(1.0, ({_R('created', 'successes')}) / 20) * 0.2
  + least(1.0, ({_R('retained', 'successes')}) / 125) * 0.16 + CASE WHEN accepted > 0 THEN retained::DOUBLE / accepted WHEN created > 0 THEN retained::DOUBLE / created ELSE 0 END * 0.1 - coalesce(overlap, 0) * 0.08))"""


@query(f"SELECT id, round({_YIELD}, 6) AS score FROM source", "source")
def yield_score(spark, d):
    c = F.col
    return view(spark, d, "source").select("id", F.round(network.yield_score(c("quality"), c("attempts"), c("successes"), c("fetched"), c("accepted"), c("created"), c("retained"), c("overlap")), 6).alias("score"))


_VALID = f"floor(priority * 100 + 0.5) / 100 + floor(quality * 45 + 0.5) + floor(yield_ * 35 + 0.5) + least(35.0, history * 1.25) + CASE state WHEN 'UNVALIDATED' THEN 40 WHEN 'SUSPECT' THEN 20 WHEN 'NEEDS_REDISCOVERY' THEN 10 ELSE 0 END + floor(({_R('successes', 'attempts')}) * 20 + 0.5) - failures * 5 + floor(confidence * 10 + 0.5)"


@query(f"SELECT id, round({_VALID}, 6) AS score FROM source", "source")
def validation_priority(spark, d):
    return view(spark, d, "source").select("id", F.round(network.validation_priority(F.col), 6).alias("score"))


_POLL = f"""floor(priority * 100 + 0.5) / 100 + floor(quality * 28 + 0.5) + floor(yield_ * 72 + 0.5) + floor(({_R('successes', 'attempts')}) * 18 + 0.5) + least(36.0, history * 1.2) + least(44.0, ({_R('accepted', 'successes')}) * 0.3) + least(120.0, ({_R('created', 'successes')}) * 4) + least(42.0, retained * 0.25)
  + least(40.0, last_accepted * 0.25) + least(90.0, last_created * 8.0) + CASE WHEN attempts = 0 THEN 42 WHEN successes = 0 THEN 18 ELSE 0 END + CASE WHEN status = 'DEGRADED' THEN 10 ELSE 0 END + greatest(0, 15 - failures * 3) + floor(confidence * 10 + 0.5) - CASE WHEN successes >= 3 AND created = 0 THEN 35 ELSE 0 END - CASE WHEN successes >= 2 AND accepted = 0 THEN 20 ELSE 0 END"""


@query(f"SELECT id, round({_POLL}, 6) AS score FROM source", "source")
def poll_priority(spark, d):
    return view(spark, d, "source").select("id", F.round(network.poll_priority(F.col), 6).alias("score"))


@query("SELECT id, connector, CAST(turn AS BIGINT) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY connector ORDER BY priority DESC, id) AS turn FROM source) ORDER BY turn, priority DESC, id LIMIT 60", "source")
def balanced_round_robin(spark, d):
    return network.balanced(view(spark, d, "source", "id", "connector", "priority"), "connector", "priority", "id", 60).select("id", "connector", F.col("turn").cast("long").alias("turn"))


@query("""SELECT id, CASE WHEN retained = 0 AND successes = 0 AND (coalesce(http_status IN (404, 410), false) OR failure_streak >= 2 OR failures >= 2) THEN 'hard_disable' WHEN successes >= 2 AND accepted = 0 THEN 'soft_backoff'
  WHEN successes >= 3 AND retained = 0 AND created = 0 AND accepted <= 5 THEN 'soft_backoff' WHEN successes >= 3 AND accepted > 0 AND deduped >= accepted AND retained = 0 AND created = 0 THEN 'soft_backoff' END AS action FROM source""", "source")  # fmt: skip
def prune_decision(spark, d):
    return network.prune(view(spark, d, "source")).select("id", "action")


_ERR = "CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN '404 Not Found' WHEN 2 THEN 'HTTP 403' WHEN 3 THEN 'Error: 503' WHEN 4 THEN 'socket hang up' ELSE '410 Gone' END"
_BOARD = "CASE id % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'workday' WHEN 2 THEN 'lever' ELSE 'icims' END"


@query(f"""+ e AS (SELECT *, {_ERR} AS error, {_BOARD} AS board FROM source), k AS (SELECT *, CASE WHEN error SIMILAR TO '.*(404|410).*' THEN CASE WHEN board IN ('greenhouse', 'lever', 'ashby') OR state = 'SUSPECT' OR failures >= 1 THEN 'INVALID' ELSE 'SUSPECT' END WHEN error SIMILAR TO '.*(401|403|429).*' THEN 'BLOCKED' WHEN error IS NULL OR accepted > 0 THEN 'VALIDATED' ELSE 'SUSPECT' END AS kind FROM e),
l AS (SELECT *, kind = 'INVALID' OR (kind = 'SUSPECT' AND failures + 1 >= 2) AS lost FROM k)
SELECT id, kind, CASE WHEN lost THEN 'QUARANTINED' WHEN kind = 'VALIDATED' THEN 'READY' ELSE 'BACKOFF' END AS poll_state, CAST(CASE WHEN kind = 'INVALID' THEN 720 WHEN kind = 'BLOCKED' THEN 360 WHEN kind = 'VALIDATED' THEN 0 WHEN error SIMILAR TO '.*(404|410).*' THEN 240 WHEN error LIKE '%503%' THEN 180 ELSE 240 END AS BIGINT) AS cooldown,
  CASE WHEN lost THEN 'REDISCOVER_REQUIRED' WHEN kind = 'VALIDATED' THEN CASE WHEN successes > 0 THEN 'ACTIVE' ELSE 'PROVISIONED' END ELSE 'DEGRADED' END AS next_status FROM l""", "source")  # fmt: skip
def validation_outcome(spark, d):
    s = view(spark, d, "source").withColumns({"error": F.expr(_ERR), "connector": F.expr(_BOARD), "jobs_found": F.col("accepted"), "polled": F.col("successes") > 0})
    return network.validation_outcome(s).select("id", "kind", "poll_state", F.col("cooldown_minutes").cast("long").alias("cooldown"), "next_status")


@query(f"""+ e AS (SELECT *, coalesce({_ERR}, 'x') AS error, {_BOARD} AS board FROM source), g AS (SELECT *, error SIMILAR TO '.*(404|410).*' AS gone FROM e), l AS (SELECT *, gone AND board IN ('greenhouse', 'lever', 'ashby') AS final FROM g), z AS (SELECT *, final OR CASE WHEN gone THEN failures + 1 >= 2 ELSE failure_streak + 1 >= 3 END AS lost FROM l)
SELECT id, CASE WHEN lost THEN 'REDISCOVER_REQUIRED' ELSE 'DEGRADED' END AS next_status, CASE WHEN final OR (gone AND lost) THEN 'INVALID' WHEN gone THEN 'SUSPECT' WHEN error LIKE '%403%' THEN 'BLOCKED' ELSE 'SUSPECT' END AS next_state, CASE WHEN lost THEN 'QUARANTINED' ELSE 'BACKOFF' END AS next_poll, CAST(CASE WHEN final THEN 12 WHEN gone THEN (failures + 1) * 4 ELSE failure_streak + 1 END AS BIGINT) AS hours FROM z""", "source")  # fmt: skip
def poll_failure(spark, d):
    s = view(spark, d, "source").withColumns({"error": F.coalesce(F.expr(_ERR), F.lit("x")), "connector": F.expr(_BOARD)})
    return network.poll_failure(s).select("id", "next_status", "next_state", "next_poll", F.col("cooldown_hours").cast("long").alias("hours"))


@query(f"""SELECT id, round(CASE WHEN last_accepted > 0 THEN ({_R('last_created', 'last_accepted')}) ELSE overlap END, 6) AS overlap, fetched + last_accepted AS fetched, created + last_created AS created, round(greatest(0.1, least(1.5, (last_created + 1)::DOUBLE / greatest(1, last_accepted) + CASE WHEN id % 2 = 0 THEN 0.15 ELSE 0.3 END)), 6) AS priority FROM source""", "source")
def poll_success(spark, d):
    s = view(spark, d, "source").withColumns({"n_fetched": F.col("last_accepted"), "n_accepted": F.col("last_accepted"), "n_deduped": F.col("last_created"), "n_created": F.col("last_created"), "fallback": F.col("id") % 2 == 0})
    return network.poll_success(s).select("id", F.round("overlap", 6).alias("overlap"), "fetched", "created", F.round("priority", 6).alias("priority"))


@query("SELECT id, CAST(CASE WHEN ready THEN 0 ELSE 50 END + CASE WHEN validated THEN 40 ELSE 0 END + floor(confidence * 20 + 0.5) + least(30, least(retained, 25) * 3) - CASE WHEN failures > 3 THEN 20 ELSE 0 END + CASE WHEN attempts > 0 THEN 0 ELSE 15 END AS BIGINT) AS place, CAST(least(40, least(retained, 25) * 3) + CASE WHEN ready THEN 0 ELSE 30 END + CASE WHEN failures > 3 THEN -10 ELSE 15 END + greatest(0, 20 - floor(confidence * 20 + 0.5)) AS BIGINT) AS priority FROM source", "source")
def discovery_priority(spark, d):
    cols = {"n_sources": F.col("ready").cast("int"), "detected": F.col("validated"), "confidence": F.col("confidence"), "n_jobs": F.col("retained"), "failed": F.col("failures") > 3, "searched": F.col("attempts") > 0}
    return view(spark, d, "source").select("id", network.discovery_order(cols.get).cast("long").alias("place"), network.discovery_priority(cols.get).cast("long").alias("priority"))


@query(f"SELECT id, CAST(floor(priority * 100) AS BIGINT) AS p FROM task WHERE kind = 'POLL' AND status = 'PENDING' AND not_before <= {NOW} ORDER BY priority DESC, created_at, id LIMIT 75", "task")
def queue_dequeue(spark, d):
    return network.claim(view(spark, d, "task"), "POLL", as_of(), 75).select("id", F.floor(F.col("priority") * 100).alias("p"))


@query("SELECT kind, target, max(priority) AS priority, epoch_us(min(not_before)) AS not_before, min(id) AS id, count(*) AS merged FROM task WHERE status = 'PENDING' GROUP BY 1, 2", "task")
def task_unique_merge(spark, d):
    return network.merge_tasks(view(spark, d, "task")).withColumn("not_before", F.unix_micros(F.col("not_before").cast("timestamp")))


@query(f"""SELECT id, round(CASE status WHEN 'AGING' THEN 45 WHEN 'STALE' THEN 35 WHEN 'LIVE' THEN 8 ELSE 0 END + greatest(0.0, 70 - availability_score) + least(24, floor(coalesce({DAYS.format('last_apply_check_at')} * 24, 999) / 8)) + least(18, floor(coalesce({DAYS.format('last_confirmed_alive_at')}, 999) * 3))
  + CASE WHEN coalesce((epoch_us(deadline) - epoch_us({NOW})) / 86400000000.0 <= 7, false) THEN 20 ELSE 0 END - CASE WHEN regexp_matches(apply_url, '(?i)^https?://') THEN 0 ELSE 25 END - CASE WHEN dead_signal_at IS NOT NULL THEN 40 ELSE 0 END, 6) AS p FROM canonical""", "canonical")  # fmt: skip
def health_priority(spark, d):
    names = {"status": "status", "availability": "availability_score", "checked_at": "last_apply_check_at", "alive_at": "last_confirmed_alive_at", "deadline": "deadline", "apply_url": "apply_url", "dead_at": "dead_signal_at"}
    c = lambda n: F.col(names[n]) if n in names else F.lit(0)
    return view(spark, d, "canonical").select("id", F.round(network.health_priority(c, as_of()), 6).alias("p"))


# --- feed ------------------------------------------------------------------------------------------------------------

_BEST = f"s AS (SELECT canonical_id, arg_max(source_name, r) AS name, arg_max(source_reliability, r)::DOUBLE AS rel, count(*) FILTER (regexp_matches(source_name, {q(R.TRUSTED_SOURCE)})) AS trusted FROM (SELECT *, (source_quality_rank, source_reliability::DOUBLE, -id, source_name) AS r FROM mapping) GROUP BY 1)"


def _score_sql() -> str:
    age = DAYS.format("posted_at")
    fresh = "CASE " + " ".join(f"WHEN {age} <= {a} THEN {b}" for a, b in [(1, 20), (3, 17), (7, 14), (14, 10), (21, 6), (45, 2), (90, -4), (180, -8), (365, -12)]) + " ELSE -16 END"
    return f"""+ {_BEST}, f AS (SELECT c.id, title, company, posted_at, CASE WHEN category = 'AUTO_SUBMIT_READY' THEN 20 ELSE 0 END AS eligibility, {fresh} AS freshness, CASE status WHEN 'LIVE' THEN 8 WHEN 'AGING' THEN 3 WHEN 'STALE' THEN -8 ELSE -14 END
  + CASE WHEN availability_score >= 90 THEN 10 WHEN availability_score >= 75 THEN 7 WHEN availability_score >= 60 THEN 4 WHEN availability_score >= 45 THEN 1 WHEN availability_score >= 30 THEN -3 ELSE -6 END AS availability,
  CASE WHEN contains(lower(role_family), 'data') THEN 15 ELSE 0 END + CASE WHEN work_mode IN ('REMOTE') THEN 10 ELSE 0 END + CASE WHEN lower(role_family) IN ('swe') THEN 8 ELSE 0 END + CASE WHEN lower(company) IN ('initech') THEN 6 ELSE 0 END - CASE WHEN lower(role_family) IN ('sales') THEN 6 ELSE 0 END AS personal,
  CASE WHEN regexp_matches(coalesce(name, ''), {q(R.TRUSTED_SOURCE)}) THEN 5 WHEN coalesce(rel, 0) >= 0.85 THEN 4 WHEN coalesce(rel, 0) >= 0.7 THEN 2 ELSE 0 END + CASE WHEN coalesce(trusted, 0) >= 2 THEN 3 ELSE 0 END AS trust FROM canonical c LEFT JOIN s ON c.id = s.canonical_id),
t AS (SELECT *, eligibility + freshness + availability + personal + trust AS total FROM f)"""


_TASTE = {"role_families": ["data"], "work_modes": ["REMOTE"], "liked_roles": ["swe"], "liked_companies": ["initech"], "passed_roles": ["sales"]}


def _feed(spark, d) -> DataFrame:
    return feed.score(view(spark, d, "canonical"), view(spark, d, "mapping", "canonical_id", "source_name", "source_quality_rank", "source_reliability", "id"), as_of(), **_TASTE)


@query(_score_sql() + " SELECT id, CAST(eligibility AS BIGINT) AS eligibility, CAST(freshness AS BIGINT) AS freshness, CAST(availability AS BIGINT) AS availability, CAST(personal AS BIGINT) AS personal, CAST(trust AS BIGINT) AS trust, CAST(total AS BIGINT) AS total FROM t", "canonical", "mapping")
def feed_score(spark, d):
    s, c = _feed(spark, d), F.col
    personal = c("pref_role") + c("pref_mode") + c("liked_role") + c("liked_company") + c("passed_role")
    return s.select("id", *[x.cast("long").alias(n) for n, x in {"eligibility": c("eligibility"), "freshness": c("freshness"), "availability": c("availability"), "personal": personal, "trust": c("source_trust") + c("multi_source"), "total": c("total")}.items()])


@query(_score_sql() + f" SELECT t.id, CAST(total AS BIGINT) AS total FROM t JOIN canonical c ON t.id = c.id WHERE c.status IN ('LIVE', 'AGING') AND (c.availability_score >= 35 OR (c.availability_score <= 0 AND last_apply_check_at IS NULL AND last_confirmed_alive_at IS NULL AND dead_signal_at IS NULL)) AND EXISTS (SELECT 1 FROM mapping m WHERE m.canonical_id = c.id AND source_name NOT IN {inlist(R.DEMO_SOURCES)}) AND NOT EXISTS (SELECT 1 FROM signal s WHERE s.canonical_id = c.id AND user_id = 7 AND action = 'PASS') ORDER BY total DESC, t.id LIMIT 20", "canonical", "mapping", "signal")
def ranked_feed_page(spark, d):
    """The flagship: visible postings with a real source that the viewer hasn't turned down, scored, the first page."""
    c, m = view(spark, d, "canonical"), view(spark, d, "mapping", "canonical_id", "source_name", "source_quality_rank", "source_reliability", "id")
    seen = feed.not_passed(feed.has_real_source(c.where(feed.visible()), m), view(spark, d, "signal"), 7)
    return feed.score(seen, m, as_of(), **_TASTE).orderBy(F.desc("total"), "id").limit(feed.PAGE).select("id", F.col("total").cast("long").alias("total"))


_SIG = f"+ s AS (SELECT user_id, action, lower(role_family) AS role, lower(company) AS company FROM signal JOIN canonical ON canonical_id = canonical.id WHERE action IN ('SAVE', 'APPLY', 'PASS') AND (epoch_us({NOW}) - epoch_us(signal.created_at)) / 86400000000.0 <= 90)"


@query(_SIG + """, n AS (SELECT user_id, 'role' AS kind, role AS name, count(*) FILTER (action <> 'PASS') AS likes, count(*) FILTER (action = 'PASS') AS passes FROM s GROUP BY 1, 3 UNION ALL SELECT user_id, 'company', company, count(*) FILTER (action <> 'PASS'), count(*) FILTER (action = 'PASS') FROM s GROUP BY 1, 3)
SELECT user_id, CASE WHEN likes > 0 THEN kind ELSE 'passed' END AS kind, name FROM n WHERE name <> '' AND (likes > 0 OR (kind = 'role' AND passes >= 2))""", "signal", "canonical")  # fmt: skip
def behavior_profile(spark, d):
    return feed.taste(view(spark, d, "signal"), view(spark, d, "canonical", "id", "role_family", "company"), as_of())


_LIST = lambda k: f"array_to_string([trim(x) for x in string_split(coalesce(max(value) FILTER (key = '{k}'), ''), ',') if trim(x) <> ''], '|')"


@query(f"SELECT user_id, {_LIST('softSignal:preferredRoleFamily')} AS roles, {_LIST('hardFilter:workMode')} AS modes FROM preference GROUP BY 1", "preference")
def prefs_pivot(spark, d):
    return feed.preferences(view(spark, d, "preference")).select("user_id", F.array_join("role_families", "|").alias("roles"), F.array_join("work_modes", "|").alias("modes"))


_LEX = "string_split(regexp_replace(lower(concat_ws(' ', title, company, role_family, location)), '[^a-z0-9]+', ' ', 'g'), ' ')"


@query(f"SELECT id FROM canonical WHERE len([w for w in {_LEX} if starts_with(w, 'eng')]) > 0 AND len([w for w in {_LEX} if starts_with(w, 'sw')]) > 0", "canonical")
def fts_prefix_search(spark, d):
    return feed.search(view(spark, d, "canonical", "id", "title", "company", "role_family", "location"), "eng  SW!").select("id")


@query("SELECT id FROM canonical WHERE contains(lower(title), 'oftware engin') OR contains(lower(company), 'oftware engin') OR contains(lower(role_family), 'oftware engin')", "canonical")
def fts_fallback_search(spark, d):
    """A phrase that begins no word, so that the search falls back to what holds it."""
    return feed.search(view(spark, d, "canonical", "id", "title", "company", "role_family", "location"), "oftware engin").select("id")


@query("SELECT id, salary_max FROM canonical ORDER BY salary_max DESC NULLS FIRST, id LIMIT 40", "canonical")
def salary_sort_nulls_first(spark, d):
    return view(spark, d, "canonical", "id", "salary_max").orderBy(F.desc_nulls_first("salary_max"), "id").limit(40)


@query("SELECT id, true AS has_next FROM canonical ORDER BY posted_at DESC, id LIMIT 20 OFFSET 40", "canonical")
def page_offset_limit(spark, d):
    return feed.page(view(spark, d, "canonical", "id", "posted_at"), 3, F.desc("posted_at"), F.asc("id")).select("id", "has_next")


# --- reports ---------------------------------------------------------------------------------------------------------


@query("SELECT status, region, count(*) AS n FROM canonical GROUP BY 1, 2", "canonical")
def status_by_region(spark, d):
    return view(spark, d, "canonical", "status", "region").groupBy("status", "region").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT company_id) AS companies, count(*) AS provisioned, count(*) FILTER (NOT validated) AS unvalidated, count(*) FILTER (validated) AS validated, count(*) FILTER (ready) AS ready, count(*) FILTER (attempts > 0) AS tracked, count(*) FILTER (successes > 0) AS polled, count(*) FILTER (created > 0) AS yielded, count(*) FILTER (retained > 0) AS retaining FROM source", "source")
def ops_funnel(spark, d):
    return reports.funnel(view(spark, d, "source"))


@query(f"""SELECT connector, count(*) AS n_sources, count(*) FILTER (attempts > 0) AS n_tracked, count(*) FILTER (successes > 0) AS n_successful, round(avg(quality), 6) AS avg_quality, round(avg(yield_), 6) AS avg_yield, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(retained) AS BIGINT) AS retained,
  CAST(sum(CASE WHEN attempts > 0 THEN retained ELSE 0 END) AS BIGINT) AS tracked_retained, round({_R('sum(successes)', 'sum(attempts)')}, 6) AS success_rate, round({_R('sum(created)', 'sum(successes)')}, 6) AS created_per_success FROM source GROUP BY 1""", "source")  # fmt: skip
def vendor_performance(spark, d):
    v = reports.vendors(view(spark, d, "source"))
    return v.select("connector", "n_sources", "n_tracked", "n_successful", F.round("avg_quality", 6).alias("avg_quality"), F.round("avg_yield", 6).alias("avg_yield"), "fetched", "accepted", "retained", "tracked_retained", F.round("success_rate", 6).alias("success_rate"), F.round("created_per_success", 6).alias("created_per_success"))


@query("""+ m AS (SELECT 'source' || CAST(canonical_id AS VARCHAR) AS source, count(DISTINCT canonical_id) FILTER (source_type = 'ATS') AS n_live, count(DISTINCT canonical_id) FILTER (source_type = 'BOARD') AS n_stale FROM mapping GROUP BY 1),
w AS (SELECT 'source' || CAST(target AS VARCHAR) AS source, count(*) AS n_raw FROM task GROUP BY 1),
u AS (SELECT source, arg_max(status, (started_at, id)) AS last_status, max(started_at) AS last_run, max(started_at) FILTER (status = 'SUCCESS') AS last_success FROM run GROUP BY 1),
s AS (SELECT 'source' || CAST(id AS VARCHAR) AS source FROM source), e AS (SELECT source FROM s UNION SELECT source FROM m UNION SELECT source FROM w UNION SELECT source FROM u)
SELECT e.source, coalesce(n_raw, 0) AS n_raw, coalesce(n_live, 0) AS n_live, coalesce(n_stale, 0) AS n_stale, last_status, epoch_us(last_run) AS last_run, epoch_us(last_success) AS last_success FROM e LEFT JOIN m ON e.source = m.source LEFT JOIN w ON e.source = w.source LEFT JOIN u ON e.source = u.source""", "mapping", "task", "run", "source")  # fmt: skip
def source_coverage(spark, d):
    name = lambda c: F.concat(F.lit("source"), F.col(c).cast("string")).alias("source")
    m = view(spark, d, "mapping", "canonical_id", "source_type").select(name("canonical_id"), "canonical_id", F.when(F.col("source_type") == "ATS", "LIVE").when(F.col("source_type") == "BOARD", "STALE").alias("status"))
    out = reports.coverage(view(spark, d, "source", "id").select(name("id")), view(spark, d, "task", "target").select(name("target")), m, view(spark, d, "run"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return out.select("source", "n_raw", "n_live", "n_stale", "last_status", us("last_run"), us("last_success"))


@query("SELECT source, arg_max(id, (started_at, id)) AS last_id, arg_max(id, (started_at, id)) FILTER (status = 'SUCCESS') AS last_success_id FROM run GROUP BY 1", "run")
def last_success_run(spark, d):
    return reports.latest_runs(view(spark, d, "run"))


@query(_score_sql() + ", o AS (SELECT total, row_number() OVER (ORDER BY total DESC) - 1 AS p, count(*) OVER () AS n FROM t) SELECT CAST(max(total) AS BIGINT) AS hi, CAST(min(total) AS BIGINT) AS lo, CAST(max(total) FILTER (p = n // 2) AS BIGINT) AS median FROM o", "canonical", "mapping")
def score_median(spark, d):
    return reports.upper_median(_feed(spark, d).select(F.col("total").cast("long").alias("total")), "total")


@query("""+ g AS (SELECT company_key, company, count(*) AS total, count(*) FILTER (status IN ('LIVE', 'AGING', 'STALE')) AS live, max(nullif(apply_url, '')) AS sample_apply_url, max(nullif(source_url, '')) AS sample_source_url FROM canonical LEFT JOIN mapping ON canonical.id = mapping.canonical_id AND removed_at IS NULL WHERE company_key <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY total DESC, company) AS rank FROM g)
SELECT company_key, company, total, live, sample_apply_url, sample_source_url FROM r WHERE rank = 1 AND company_key NOT IN ('blue', 'umbrella') ORDER BY live DESC, total DESC, company_key LIMIT 100""", "canonical", "mapping")  # fmt: skip
def seed_top_name_window(spark, d):
    known = spark.createDataFrame([("blue",), ("umbrella",)], "company_key string")
    return reports.top_company_names(view(spark, d, "canonical"), view(spark, d, "mapping", "canonical_id", "source_url", "removed_at"), known, 100)


CATALOG = [("Acme Group", "acme", 0, 24), ("Northwind Traders", "northwindtraders", 1, 18), ("Globex", "globex", 2, 12), ("Maple", "mapleandsons", 3, 6)]
_CATALOG = " UNION ALL ".join(f"SELECT {q(n)} AS name, {q(k)} AS alias_key, {o} AS ordinal, {b} AS bonus" for n, k, o, b in CATALOG)
_CORPUS = f"""+ l AS (SELECT company, count(*) AS total, count(*) FILTER (region = 'CA') AS ca, count(*) FILTER (region = 'CA' AND work_mode = 'REMOTE') AS ca_remote FROM canonical WHERE status IN ('LIVE', 'AGING') GROUP BY 1),
c AS (SELECT *, regexp_replace(regexp_replace({_CLEAN}, '\\s+-\\s+', ' ', 'g'), '\\s{{2,}}', ' ', 'g') AS name FROM l WHERE ca >= 1),
k AS (SELECT *, regexp_replace(replace(lower(name), '&', ' and '), '[^a-z0-9]+', '', 'g') AS key FROM c WHERE name <> '' AND NOT {re_('name', R.COMPANY_SKIP)}),
g AS (SELECT key, sum(total) AS total, sum(ca) AS ca, sum(ca_remote) AS ca_remote, arg_min(name, (length(name), name)) AS shortest FROM k WHERE key <> '' GROUP BY 1), a AS ({_CATALOG}),
m AS (SELECT key, a.name, bonus, row_number() OVER (PARTITION BY key ORDER BY key <> alias_key, ordinal) AS rn FROM g JOIN a ON key = alias_key OR (length(key) >= 8 AND length(alias_key) >= 8 AND (contains(key, alias_key) OR contains(alias_key, key))))"""


@query(_CORPUS + " SELECT g.key, coalesce(m.name, shortest) AS name, CAST(total AS BIGINT) AS total, CAST(ca AS BIGINT) AS ca, CAST(ca_remote AS BIGINT) AS ca_remote, m.name AS catalog_name, CAST(ca * 8 + ca_remote * 3 + total * 1.5 + coalesce(bonus, CASE WHEN ca_remote > 0 THEN 5 ELSE 0 END) AS DOUBLE) AS score FROM g LEFT JOIN m ON g.key = m.key AND rn = 1", "canonical")
def company_corpus(spark, d):
    return reports.company_corpus(view(spark, d, "canonical", "company", "status", "region", "work_mode"), spark.createDataFrame(CATALOG, "name string, alias_key string, ordinal int, bonus int"))


@query(_CORPUS + " SELECT key, name AS catalog_name FROM m WHERE rn = 1", "canonical")
def catalog_theta_join(spark, d):
    return company_corpus(spark, d).where("catalog_name IS NOT NULL").select("key", "catalog_name")


@query(f"""+ t AS (SELECT DISTINCT user_id, id AS tracked_id, CASE CAST(date_trunc('day', deadline) AS DATE) - CAST({NOW} AS DATE) WHEN 7 THEN 'DEADLINE_D7' WHEN 3 THEN 'DEADLINE_D3' WHEN 1 THEN 'DEADLINE_D1' WHEN 0 THEN 'DEADLINE_TODAY' WHEN -1 THEN 'DEADLINE_OVERDUE_D1' END AS reminder FROM tracked)
SELECT * FROM t WHERE reminder IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sent s WHERE s.user_id = t.user_id AND s.tracked_id = t.tracked_id AND s.reminder = t.reminder)""", "tracked", "sent")  # fmt: skip
def deadline_reminders(spark, d):
    return reports.reminders(view(spark, d, "tracked"), as_of(), view(spark, d, "sent"))


@query("SELECT id, arg_min(company, part) AS company FROM (SELECT id, company, (0, company) AS part FROM incoming UNION ALL SELECT id, company, (1, company) AS part FROM canonical) GROUP BY 1", "incoming", "canonical")
def union_first_wins(spark, d):
    return reports.first_wins([view(spark, d, "incoming", "id", "company"), view(spark, d, "canonical", "id", "company")], "id")


@query("SELECT DISTINCT company, title FROM canonical c WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.company = c.company AND i.title = c.title)", "canonical", "incoming")
def except_known(spark, d):
    return reports.except_known(view(spark, d, "canonical", "company", "title"), view(spark, d, "incoming", "company", "title"), ["company", "title"])


@query("SELECT id, company FROM canonical WHERE company IN (SELECT company FROM incoming) AND status = 'LIVE'", "canonical", "incoming")
def intersect_ids(spark, d):
    return reports.also_in(view(spark, d, "canonical", "id", "company", "status").where("status = 'LIVE'"), view(spark, d, "incoming", "company"), ["company"]).select("id", "company")


# --- sources, sinks and streams --------------------------------------------------------------------------------------


@query("+ n AS (SELECT id, max((title, company, rank)) AS v FROM incoming GROUP BY 1) SELECT coalesce(c.id, n.id) AS id, CASE WHEN n.id IS NULL THEN c.title ELSE n.v[1] END AS title, CASE WHEN c.id IS NULL THEN 'created' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS change FROM canonical c FULL JOIN n ON c.id = n.id", "canonical", "incoming")
def upsert_raw(spark, d):
    old = view(spark, d, "canonical", "id", "title", "company").withColumn("rank", F.lit(0).cast("long"))
    new = view(spark, d, "incoming", "id", "title", "company", "rank").withColumn("rank", F.col("rank").cast("long"))
    from postforge.sources.tables import upsert

    return upsert(old, new, ["id"]).select("id", "title", "change")


@query("SELECT DISTINCT id, tag FROM tag t WHERE NOT EXISTS (SELECT 1 FROM tag u JOIN tracked k ON k.id = u.id AND k.status = 'O' WHERE u.id = t.id AND u.tag = t.tag)", "tag", "tracked")
def insert_ignore_tags(spark, d):
    from postforge.sources.tables import insert_ignore

    tags = view(spark, d, "tag", "id", "tag")
    held = tags.join(view(spark, d, "tracked", "id", "status").where("status = 'O'").select("id"), "id", "left_semi")
    return insert_ignore(held, tags, ["id", "tag"])


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def daily_activity(spark, d):
    from postforge.streaming.ingest import activity

    out = activity(spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(f"+ l AS (SELECT source, max(started_at) AS last FROM run GROUP BY 1) SELECT 'source' || CAST(s.id AS VARCHAR) AS source FROM source s LEFT JOIN l ON l.source = 'source' || CAST(s.id AS VARCHAR) WHERE last IS NULL OR (epoch_us({NOW}) - epoch_us(last)) / 60000000 >= 1440 * (200 + s.attempts * 100)", "run", "source")
def cadence_gate(spark, d):
    from postforge.streaming.ingest import due

    c = view(spark, d, "source", "id", "attempts").select(F.concat(F.lit("source"), F.col("id").cast("string")).alias("source"), (1440 * (200 + F.col("attempts") * 100)).alias("minutes"))
    return due(c, view(spark, d, "run", "source", "started_at"), as_of()).select("source")


# --- tracker ---------------------------------------------------------------------------------------------------------

_NOWST = "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'WISHLIST' WHEN 2 THEN 'PREPARING' WHEN 3 THEN 'APPLIED' ELSE 'OFFER' END"
_ASK = "CASE user_id % 4 WHEN 0 THEN 'WISHLIST' WHEN 1 THEN 'PREPARING' WHEN 2 THEN 'APPLIED' ELSE 'WITHDRAWN' END"


@query(f"""+ t AS (SELECT id, {_NOWST} AS a, {_ASK} AS b FROM tracked), n AS (SELECT *, CASE WHEN a IS NULL THEN b WHEN b = 'WISHLIST' THEN a WHEN b = 'PREPARING' THEN CASE WHEN a = 'WISHLIST' THEN b ELSE a END ELSE b END AS c FROM t)
SELECT id, c AS status, CASE WHEN c IN ('APPLIED', 'SCREEN', 'INTERVIEW', 'OFFER', 'REJECTED') THEN c ELSE 'NOTE' END AS event, CASE WHEN a IS NULL OR a IN ('WISHLIST', 'PREPARING') THEN 'APPLIED' ELSE a END AS sent FROM n""", "tracked")  # fmt: skip
def tracked_status_merge(spark, d):
    t = view(spark, d, "tracked", "id", "user_id").select("id", F.expr(_NOWST).alias("a"), F.expr(_ASK).alias("b"))
    n = tracker.next_status(F.col("a"), F.col("b"))
    return t.select("id", n.alias("status"), tracker.event_type(n).alias("event"), tracker.after_submission(F.col("a")).alias("sent"))


_UMODE = "CASE id % 3 WHEN 0 THEN 'STRICT_AUTO_APPLY' WHEN 1 THEN 'REVIEW_BEFORE_SUBMIT' ELSE 'ASSIST' END"


@query(f"SELECT id, CASE WHEN category = 'AUTO_SUBMIT_READY' AND {_UMODE} = 'STRICT_AUTO_APPLY' THEN 'fill_and_submit' WHEN (category = 'AUTO_SUBMIT_READY' AND {_UMODE} = 'REVIEW_BEFORE_SUBMIT') OR category = 'AUTO_FILL_REVIEW' THEN 'fill_only' ELSE 'dry_run' END AS mode, CASE WHEN status <> 'LIVE' OR category IS NULL THEN 'NOT_ELIGIBLE' WHEN category IN ('MANUAL_ONLY', 'AUTO_FILL_REVIEW') THEN 'MANUAL_ONLY' ELSE 'READY_FOR_REVIEW' END AS review FROM canonical", "canonical")
def automation_mode(spark, d):
    c = F.col
    return view(spark, d, "canonical", "id", "category", "status").select("id", tracker.run_mode(c("category"), F.expr(_UMODE)).alias("mode"), tracker.review_state(c("status"), c("category")).alias("review"))


@query("""+ r AS (SELECT id AS resume_id, user_id, lower(role_family) AS t, ok FROM (SELECT s.id, s.company_id AS user_id, CASE s.id % 4 WHEN 0 THEN 'swe' WHEN 1 THEN 'Data' WHEN 2 THEN '' END AS role_family, s.id % 5 = 0 AS ok FROM source s)),
p AS (SELECT c.id, c.id % 25 AS user_id, resume_id, CASE WHEN lower(role_family) = t THEN 0 WHEN t <> '' AND (contains(lower(role_family), t) OR contains(t, lower(role_family))) THEN 1 WHEN ok THEN 2 ELSE 3 END AS pl FROM canonical c LEFT JOIN r ON c.id % 25 = r.user_id)
SELECT id, user_id, arg_min(resume_id, (pl, resume_id)) AS resume_id FROM p GROUP BY 1, 2""", "canonical", "source")  # fmt: skip
def resume_recommendation(spark, d):
    r = view(spark, d, "source", "id", "company_id").select("id", F.col("company_id").alias("user_id"), F.expr("CASE id % 4 WHEN 0 THEN 'swe' WHEN 1 THEN 'Data' WHEN 2 THEN '' END").alias("target"), (F.col("id") % 5 == 0).alias("is_default"))
    return tracker.recommended_resume(view(spark, d, "canonical", "id", "role_family").withColumn("user_id", F.col("id") % 25), r)


@query("""+ p AS (SELECT user_id, canonical_id, max(created_at) AS at FROM signal WHERE action = 'SAVE' GROUP BY 1, 2), s AS (SELECT user_id, canonical_id, arg_max(action, created_at) AS st, max(created_at) AS at FROM signal WHERE action IN ('APPLY', 'PASS') GROUP BY 1, 2)
SELECT coalesce(p.user_id, s.user_id) AS user_id, coalesce(p.canonical_id, s.canonical_id) AS canonical_id, coalesce(st, 'PACKAGE_ONLY') AS status, epoch_us(CASE WHEN p.at IS NULL THEN s.at WHEN s.at IS NULL THEN p.at ELSE greatest(p.at, s.at) END) AS active FROM p FULL JOIN s ON p.user_id = s.user_id AND p.canonical_id = s.canonical_id WHERE coalesce(p.canonical_id, s.canonical_id) IN (SELECT id FROM canonical)""", "signal", "canonical")  # fmt: skip
def application_history(spark, d):
    s = view(spark, d, "signal").withColumnRenamed("created_at", "updated_at").withColumns({"id": F.lit(0), "status": F.col("action")})
    h = tracker.history(view(spark, d, "canonical", "id"), s.where("action = 'SAVE'"), s.where("action IN ('APPLY', 'PASS')"))
    return h.select("user_id", "canonical_id", "status", F.unix_micros(F.col("active_at").cast("timestamp")).alias("active"))


_CODE = "CASE id % 7 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN 503 WHEN 4 THEN 302 WHEN 5 THEN NULL ELSE 200 END"
_BODY = "CASE id % 3 WHEN 0 THEN repeat('We are hiring people. ', 9) WHEN 1 THEN 'short' ELSE repeat('position has been filled ', 5) END"


@query(f"""+ h AS (SELECT id, apply_url, {_CODE} AS code, {_BODY} AS body, concat_ws(chr(10), title, description, {_BODY}) AS t, deadline FROM canonical),
x AS (SELECT *, deadline <= {NOW} OR {' OR '.join(re_('t', p) for p in R.DEAD_CONTENT)} AS said FROM h)
SELECT id, CASE WHEN NOT regexp_matches(apply_url, '(?i)^https?://') OR code IS NULL THEN 'ERROR' WHEN code IN (404, 410, 451) OR coalesce(said, false) THEN 'DEAD' WHEN code IN (401, 403, 429) THEN 'BLOCKED' WHEN code >= 500 THEN 'ERROR' WHEN code NOT BETWEEN 200 AND 299 OR length(trim(body)) < 80 THEN 'SUSPECT' ELSE 'ALIVE' END AS result FROM x""", "canonical")  # fmt: skip
def url_health(spark, d):
    c = view(spark, d, "canonical").withColumns({"url": F.col("apply_url"), "status_code": F.expr(_CODE), "body": F.expr(_BODY)})
    return tracker.url_health(c, as_of()).select("id", "result")


@query("SELECT id, CASE " + " ".join(f"WHEN {re_('trim(title)', p)} THEN {q(c)}" for c, p in R.LABELS) + " END AS concept FROM (SELECT id, CASE id % 6 WHEN 0 THEN 'Your e-mail address' WHEN 1 THEN 'First  name *' WHEN 2 THEN 'Curriculum Vitae' WHEN 3 THEN 'Are you legally allowed?' WHEN 4 THEN 'Where did you find us?' ELSE title END AS title FROM canonical)", "canonical")
def form_labels(spark, d):
    said = F.expr("CASE id % 6 WHEN 0 THEN 'Your e-mail address' WHEN 1 THEN 'First  name *' WHEN 2 THEN 'Curriculum Vitae' WHEN 3 THEN 'Are you legally allowed?' WHEN 4 THEN 'Where did you find us?' ELSE title END")
    return view(spark, d, "canonical", "id", "title").select("id", tracker.label_concept(said).alias("concept"))


@query("SELECT source, arg_min(id, n) AS id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) AS n FROM run) WHERE n <= 10 AND (status = 'SUCCESS' OR fetched % 2 = 0) GROUP BY 1", "run")
def resume_checkpoint(spark, d):
    r = view(spark, d, "run").withColumns({"exhausted": F.col("status") == "SUCCESS", "checkpoint": F.when(F.col("fetched") % 2 == 0, F.lit("x"))})
    return tracker.latest_checkpoint(r)


# --- further reports and functions -----------------------------------------------------------------------------------


@query(f"SELECT source_name, CAST(split_part(source_name, ':', 1) AS VARCHAR) AS prefix, lower(trim(split_part(source_name, ':', 1))) AS family, count(*) AS n FROM mapping GROUP BY 1, 2, 3", "mapping")
def source_families(spark, d):
    c = F.col("source_name")
    return view(spark, d, "mapping", "source_name").groupBy("source_name", urls.source_prefix(c).alias("prefix"), urls.source_family(c).alias("family")).agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN regexp_matches(apply_url, '^https?://') AND NOT " + _hosts("apply_url", [*R.DIRECT_HOSTS, *R.BOARD_HOSTS, *R.AGGREGATOR_HOSTS]) + " THEN regexp_replace(" + _host("apply_url") + ", '^www\\.', '') END AS domain FROM canonical", "canonical")
def company_domain(spark, d):
    return view(spark, d, "canonical", "id", "apply_url").select("id", urls.company_domain(F.array("apply_url")).alias("domain"))


@query("SELECT id, status, availability_score FROM canonical WHERE status IN ('AGING', 'STALE', 'EXPIRED') ORDER BY availability_score, posted_at DESC, id LIMIT 40", "canonical")
def at_risk_jobs(spark, d):
    return view(spark, d, "canonical", "id", "status", "availability_score", "posted_at").where("status IN ('AGING', 'STALE', 'EXPIRED')").orderBy("availability_score", F.desc("posted_at"), "id").limit(40).select("id", "status", "availability_score")


@query(_score_sql() + " SELECT id, CAST(total AS BIGINT) AS total FROM t ORDER BY total DESC, id LIMIT 50", "canonical", "mapping")
def ranking_top_50(spark, d):
    return _feed(spark, d).orderBy(F.desc("total"), "id").limit(50).select("id", F.col("total").cast("long").alias("total"))


@query("SELECT c.id, CAST(least(25, count(m.canonical_id)) AS BIGINT) AS n FROM canonical c LEFT JOIN mapping m ON m.canonical_id = c.id AND m.removed_at IS NULL GROUP BY 1", "canonical", "mapping")
def bounded_child_count(spark, d):
    return reports.child_counts(view(spark, d, "canonical", "id"), view(spark, d, "mapping", "canonical_id", "removed_at").where("removed_at IS NULL"), "canonical_id", 25)


@query("SELECT id, arg_max(company, part) AS company FROM (SELECT id, company, (0, company) AS part FROM incoming UNION ALL SELECT id, company, (1, company) AS part FROM canonical) GROUP BY 1", "incoming", "canonical")
def union_last_wins(spark, d):
    return reports.last_wins([view(spark, d, v, "id", "company") for v in ("incoming", "canonical")], "id")


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def json_path_stats(spark, d):
    return reports.by_json_number(spark.read.parquet(f"{d}/events.parquet"), "props", "$.k", "value").select("k", "n", F.round("mean", 6).alias("mean"))


@query("+ g AS (SELECT source, count(*) AS n, sum(fetched) AS fetched FROM run WHERE status = 'SUCCESS' GROUP BY 1) SELECT s.id, CAST(coalesce(g.fetched, s.fetched) AS BIGINT) AS fetched, CAST(coalesce(g.n, 0) AS BIGINT) AS n FROM source s LEFT JOIN g ON g.source = 'source' || CAST(s.id AS VARCHAR)", "run", "source")
def backfill_from_aggregate(spark, d):
    g = view(spark, d, "run").where("status = 'SUCCESS'").groupBy("source").agg(F.count("*").alias("n"), F.sum("fetched").alias("_f"))
    s = view(spark, d, "source", "id", "fetched").withColumn("source", F.concat(F.lit("source"), F.col("id").cast("string")))
    return s.join(g, "source", "left").select("id", F.coalesce("_f", "fetched").cast("long").alias("fetched"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("SELECT m.source_name, c.company_key, max(c.company) AS company, count(*) AS n, count(*) FILTER (c.status IN ('LIVE', 'AGING')) AS live FROM mapping m JOIN canonical c ON c.id = m.canonical_id WHERE m.removed_at IS NULL AND c.company_key <> '' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY m.source_name ORDER BY count(*) DESC, c.company_key DESC) = 1", "mapping", "canonical")
def seed_sources_window(spark, d):
    return reports.main_companies(view(spark, d, "mapping", "canonical_id", "source_name", "removed_at"), view(spark, d, "canonical", "id", "company_key", "company", "status"))


@query("SELECT id, array_to_string(list_sort(list_distinct([left(trim(x), 40) for x in string_split(title || ', ' || company, ',') if trim(x) <> ''])), '|') AS tags FROM canonical", "canonical")
def normalized_tags(spark, d):
    t = text.tags(F.split(F.concat_ws(", ", "title", "company"), ","))
    return view(spark, d, "canonical", "id", "title", "company").select("id", F.array_join(t, "|").alias("tags"))


@query("SELECT date_trunc('day', started_at)::DATE::VARCHAR AS day, count(*) AS n, count(*) FILTER (status = 'SUCCESS') AS ok, CAST(sum(fetched) AS BIGINT) AS fetched FROM run GROUP BY 1", "run")
def runs_by_day(spark, d):
    return reports.runs_by_day(view(spark, d, "run"))


@query(f"SELECT id, CASE WHEN deadline IS NULL THEN 'NO_DEADLINE' WHEN deadline < date_trunc('day', {NOW}) THEN 'OVERDUE' ELSE 'UPCOMING' END AS bucket FROM tracked", "tracked")
def deadline_buckets(spark, d):
    return view(spark, d, "tracked", "id", "deadline").select("id", tracker.deadline_bucket(F.col("deadline"), as_of()).alias("bucket"))
