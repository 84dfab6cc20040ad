"""Queries over texts and pages: salaries, summaries, ids, routes, blocks, differences, company sites; and normalization as a whole."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postforge.bindings import AS_OF, as_of, view
from postforge.functions import rules as R
from postforge.functions import salary, text, urls
from postforge.operators import describe, normalize, pages
from postforge.plans.board_queries import shown
from postforge.plans.queries import _CONTENT, _PLACE, NOW, anyof, inlist, q, query, re_
from postforge.sources import boards

#: The driver's texts are short and plain; these add what they lack: lines, headings, lists, several salaries, boilerplate.
LONG = "CASE id % 7 WHEN 0 THEN concat('ABOUT US', chr(10), 'We are a team of builders.', chr(10), 'Visit https://x.example/a now, it is worth it! Really.', chr(10), '- Salary: CAD 45.50 to 60 per hour', chr(10), '- Bonus', chr(10), 'and more', chr(10), '12. Numbered item') WHEN 1 THEN concat('Equal opportunity employer of note', chr(10), 'Compensation', chr(10), 'USD 80,000', chr(10), 'to 95k yearly', chr(10), chr(10), 'Pay range: €3,000 - €4,200 per month in base pay') WHEN 2 THEN concat('Requirements:', chr(10), '• one', chr(10), '• two', chr(10), 'What we offer:', chr(10), 'Requirements:', chr(10), 'requirements:', chr(10), 'A long paragraph that says what there is to say. It goes on.') WHEN 3 THEN concat('[link](http://a.example) Short', chr(10), 'Annual salary 20 USD per day or $52,000', chr(10), 'Apply now and search') ELSE description END"
_TEXT = f"x AS (SELECT id, title, company, region, work_mode, {LONG} AS description FROM canonical)"


def _texts(spark, d):
    return view(spark, d, "canonical", dear=True).selectExpr("id", "title", "company", "region", "work_mode", f"{LONG} AS description")


# --- salaries and summaries ------------------------------------------------------------------------------------------

EDGED = lambda p: "(?i)" + p


def salary_sql(source: str) -> str:
    """CTEs that end in pay(id, low, high, currency): the best snippet of source(id, description, region)."""
    hint = lambda c: f"({re_(c, R.SALARY_WORDS)} OR {re_(c, R.RANGE_HINT)})"
    squeeze = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    times = "CASE " + " ".join(f"WHEN {re_('s', p)} THEN {n}" for n, p in R.PERIODS) + " ELSE 1 END"
    own = "CASE " + " ".join(f"WHEN {re_('s', p)} THEN '{c}'" for c, p in (("CAD", r"\bCAD\b|CA\$|C\$"), ("USD", r"\bUSD\b|US\$"), ("EUR", r"\bEUR\b|€"), ("GBP", r"\bGBP\b|£"), ("AUD", r"\bAUD\b"), ("NZD", r"\bNZD\b"))) + " END"
    return f"""pt AS (SELECT id, region, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(description, ''), '<br\\s*/?>', chr(10), 'gi'), '</?(p|div|section|article|li|ul|ol|h[1-6])[^>]*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), chr(13), ''), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM {source}),
pl AS (SELECT *, [y FOR y IN [{squeeze('x')} FOR x IN string_split(t, chr(10))] IF y <> ''] AS lines, [{squeeze('x')} FOR x IN string_split_regex(t, '\\n\\s*\\n')] AS paras FROM pt),
ps AS (SELECT id, region, 1 AS part, i AS nth, array_to_string(list_slice(lines, i, i + 2), ' ') AS s FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM pl) WHERE {hint('lines[i]')} UNION ALL SELECT id, region, 2, i, paras[i] FROM (SELECT *, unnest(range(1, len(paras) + 1)) AS i FROM pl) WHERE {hint('paras[i]')}),
pu AS (SELECT id, region, s, min((part, nth)) AS nth FROM ps WHERE length(s) >= 6 GROUP BY 1, 2, 3),
pa AS (SELECT *, {times} AS times, list_transform(range(1, len(regexp_extract_all(s, {q(R.AMOUNT)}, 1)) + 1), lambda i: TRY_CAST(replace(regexp_extract_all(s, {q(R.AMOUNT)}, 1)[i], ',', '') AS DOUBLE) * CASE lower(regexp_extract_all(s, {q(R.AMOUNT)}, 2)[i]) WHEN 'm' THEN 1000000 WHEN 'k' THEN 1000 ELSE 1 END) AS vs FROM pu),
pv AS (SELECT *, [v FOR v IN [floor(v * times + 0.5) FOR v IN vs IF v > 0] IF v >= {R.SALARY_LEAST} AND v <= {R.SALARY_MOST}] AS good, len([v FOR v IN vs IF v >= 1000]) > 0 AS big, {re_('s', R.SALARY_WORDS)} AS word, {re_('s', R.MONEY_HINT)} AS money, {re_('s', R.RANGE_HINT)} AS span, {re_('s', chr(92) + 'b(CAD|USD|EUR|GBP|AUD|NZD|US' + chr(92) + '$|CA' + chr(92) + '$|C' + chr(92) + '$)' + chr(92) + 'b')} AS named, {own} AS own FROM pa),
pw AS (SELECT *, good[1] AS low, coalesce(good[2], good[1]) AS high, CASE WHEN word THEN 4 ELSE 0 END + CASE WHEN span THEN 3 ELSE 0 END + CASE WHEN money THEN 2 ELSE 0 END + CASE WHEN times <> 1 THEN 1 ELSE 0 END + CASE WHEN named THEN 1 ELSE 0 END AS score FROM pv WHERE NOT {re_('s', R.NOT_SALARY)} AND (word OR span) AND (money OR big)),
pay AS (SELECT id, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high, coalesce(own, CASE WHEN region = 'CA' THEN 'CAD' ELSE 'USD' END) AS currency FROM pw WHERE high >= low QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, nth) = 1)"""


@query(f"+ {_TEXT}, {salary_sql('x')} SELECT x.id, low, high, currency FROM x LEFT JOIN pay ON x.id = pay.id", "canonical")
def salary_extract(spark, d):
    s = salary.from_text(F.col("description"), F.lit(None).cast("string"), F.col("region"))
    return _texts(spark, d).select("id", s.alias("s")).select("id", "s.low", "s.high", "s.currency")


def summary_sql(description: str, mode: str) -> str:
    """One expression over title, company and these."""
    line = lambda x: f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({x}, '^[\\s>*•\\-–—]+', '')), '\\[[^\\]]+\\]\\([^)]+\\)', ' ', 'g'), '(?i)https?://\\S+', ' ', 'g'), '(?i)www\\.\\S+', ' ', 'g'), '\\s+', ' ', 'g'))"
    first = f"[y FOR y IN [{line('x')} FOR x IN string_split({description}, chr(10))] IF length(y) >= 20 AND NOT regexp_matches(y, {q(R.SUMMARY_HEADING)}) AND NOT regexp_matches(y, {q(R.SUMMARY_BOILERPLATE)})][1]"
    sentence = f"CASE WHEN regexp_matches({first}, '^[^.!?]+[.!?]') THEN trim(regexp_extract({first}, '^([^.!?]+[.!?])', 1)) ELSE {first} END"
    said = f"CASE {mode} WHEN 'REMOTE' THEN 'Remote-friendly.' WHEN 'HYBRID' THEN 'Hybrid schedule.' WHEN 'FLEXIBLE' THEN 'Flexible work arrangement.' WHEN 'ONSITE' THEN 'On-site expectation.' ELSE '' END"
    return f"left(trim(regexp_replace(concat_ws(' ', coalesce({sentence}, company || ' is hiring for ' || title || '.'), {said}), '\\s+', ' ', 'g')), 280)"


@query(f"+ {_TEXT} SELECT id, {summary_sql('description', 'work_mode')} AS summary FROM x", "canonical")
def short_summary(spark, d):
    c = F.col
    return _texts(spark, d).select("id", text.short_summary(c("title"), c("company"), c("work_mode"), c("description")).alias("summary"))


# --- normalization ---------------------------------------------------------------------------------------------------


def normalize_sql() -> str:
    """CTEs that end in done: what normalize() says of incoming rows. The parts that have SQL of their own read them as canonical."""
    plain = r"trim(regexp_replace(array_to_string([trim(regexp_replace(x, '[ \t]+', ' ', 'g')) for x in string_split(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(description, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '<br\s*/?>', chr(10), 'gi'), '</?(p|div|section|article|h[1-6]|li|ul|ol|blockquote)[^>]*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), chr(10))], chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ')".replace('\\"', '"')
    role = "CASE " + " ".join(f"WHEN {re_('title', chr(92) + 'b(' + p + ')' + chr(92) + 'b')} THEN {q(r)}" for _, r, p in R.ROLES) + " ELSE 'Unknown' END"
    core = f"array_to_string([w for w in string_split_regex(regexp_replace(lower(title), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+') if w <> '' AND w NOT IN {inlist(R.TITLE_STOP_WORDS)}], '-')"
    loc = f"array_to_string(list_sort([regexp_replace(trim(x), '\\s+', '-', 'g') for x in string_split({_PLACE}, ',') if trim(x) <> '']), '|')"
    return f"""inc AS (SELECT id, title, coalesce(nullif(trim(company), ''), 'Unknown') AS company, coalesce(nullif(trim(location), ''), 'Unknown') AS location, {plain} AS description, employment_type AS given, trim(apply_url) AS apply_url, deadline, salary_min, salary_max FROM incoming),
canonical AS (SELECT *, given AS employment_type, {role} AS role_family, NULL AS given_mode FROM inc),
reg AS ({_only('region_rules')}), lev AS ({_only('experience_level')}), mt AS ({_only('work_mode_and_type')}), jd AS ({_only('junk_and_dead')}),
reged AS (SELECT canonical.*, reg.region FROM canonical JOIN reg ON canonical.id = reg.id), {salary_sql('reged')},
done AS (SELECT r.id, CASE WHEN r.title = '' THEN 'missing_minimum_identity' WHEN r.apply_url = '' THEN 'missing_apply_or_detail_path' WHEN junk THEN 'obvious_junk' WHEN dead IS NOT NULL THEN 'obvious_dead_at_intake' END AS reject_reason, r.company, r.location, r.region, r.role_family, mt.mode AS work_mode, mt.type AS employment_type, lev.level AS experience_level,
  {core} AS title_core_key, {loc} AS location_key, md5(concat_ws(':', trim(regexp_replace(replace(lower(r.company), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-'), {core}, {loc}, lower(coalesce(r.region, 'unknown')))) AS duplicate_cluster_id,
  CAST(CASE WHEN salary_min IS NOT NULL OR salary_max IS NOT NULL THEN salary_min ELSE low END AS BIGINT) AS salary_min, CAST(CASE WHEN salary_min IS NOT NULL OR salary_max IS NOT NULL THEN salary_max ELSE high END AS BIGINT) AS salary_max,
  CASE WHEN salary_min IS NOT NULL OR salary_max IS NOT NULL OR currency IS NULL THEN CASE WHEN r.region = 'CA' THEN 'CAD' ELSE 'USD' END ELSE currency END AS salary_currency, {summary_sql('description', 'mt.mode')} AS short_summary
  FROM reged r JOIN lev ON r.id = lev.id JOIN mt ON r.id = mt.id JOIN jd ON r.id = jd.id LEFT JOIN pay ON r.id = pay.id)"""


def _only(name: str) -> str:
    """A registered SQL without the definition of its one view."""
    from postforge import bindings
    from postforge.plans.queries import ORACLES

    return ORACLES[name].removeprefix(f"WITH canonical AS ({bindings.sql('canonical')})").strip()


@query(f"+ {normalize_sql()} SELECT * FROM done", "incoming")
def normalize_postings(spark, d):
    return _normalized(spark, d).select("id", "reject_reason", "company", "location", "region", "role_family", "work_mode", "employment_type", "experience_level", "title_core_key", "location_key", "duplicate_cluster_id", "salary_min", "salary_max", "salary_currency", "short_summary")


def _normalized(spark, d):
    raw = view(spark, d, "incoming").withColumns({"source_id": F.col("id").cast("string"), "source_url": F.lit(None).cast("string"), "salary_currency": F.lit(None).cast("string"), "fetched_at": as_of(), "work_mode": F.lit(None).cast("string")})
    return normalize.normalize(raw)


# --- ids and URLs ----------------------------------------------------------------------------------------------------

#: URL of a posting, its id and its board, by id modulo the number of these; {n} is the id plus 10000.
POSTINGS = [
    ("https://boards.greenhouse.io/Acme/jobs/{n}", "greenhouse:acme:{n}", "greenhouse/acme"), ("https://boards.greenhouse.io/embed/job_app?for=acme&gh_jid={n}", "greenhouse:embed:{n}", "greenhouse/acme"), ("https://jobs.lever.co/globex/ab-{n}", "lever:globex:ab-{n}", "lever/globex"),
    ("https://jobs.ashbyhq.com/initech/x{n}", "ashby:initech:x{n}", "ashby/initech"), ("https://acme.wd5.myworkdayjobs.com/en-US/Ext/job/Toronto/Engineer_R-{n}", "workday:acme-wd5-myworkdayjobs-com:{n}", "workday/acme.wd5.myworkdayjobs.com/acme/ext"),
    ("https://acme.taleo.net/careersection/2/jobdetail.ftl?job={n}", "taleo:acme-taleo-net:{n}", "taleo/acme/2"), ("https://jobs.smartrecruiters.com/Acme/{n}-dev", "smartrecruiters:jobs-smartrecruiters-com:{n}-dev", "smartrecruiters/acme"),
    ("https://careers-acme.icims.com/jobs/{n}/dev/job", "icims:careers-acme-icims-com:{n}", "icims/careers-acme"), ("https://apply.workable.com/acme/j/A{n}/", "workable:acme:a{n}", "workable/acme"), ("https://acme.recruitee.com/o/dev-{n}", "recruitee:dev-{n}:dev-{n}", "recruitee/acme"),
    ("https://careers.example.com/open?requisitionId={n}&x=1", None, None), ("https://www.example.com/?jobid={n}", "unknown:www-example-com:{n}", None), ("not a url", "adzuna:{n}", None), ("https://example.com/about", "adzuna:example-com:{n}", None),
]


def _by_number(i: int, duck: bool) -> str:
    make = lambda t: "NULL" if t is None else f"replace({q(t)}, '{{n}}', CAST(id + 10000 AS {'VARCHAR' if duck else 'STRING'}))"
    return f"CASE id % {len(POSTINGS)} " + " ".join(f"WHEN {k} THEN {make(p[i])}" for k, p in enumerate(POSTINGS)) + " END"


@query(f"SELECT id, coalesce({_by_number(1, True)}, 'adzuna:careers-example-com:' || CAST(id + 10000 AS VARCHAR)) AS posting_id, {_by_number(2, True)} AS board FROM canonical", "canonical")
def posting_ids(spark, d):
    c = view(spark, d, "canonical", "id").selectExpr("id", f"{_by_number(0, False)} AS url", "CAST(id + 10000 AS STRING) AS own")
    return c.select("id", urls.posting_id(F.col("url"), F.col("url"), F.lit("adzuna"), F.col("own")).alias("posting_id"), urls.ats_match(F.col("url")).alias("board"))


_JSON = "CASE id % 5 WHEN 0 THEN concat('{\"a\": {\"x\": \"no-1\", \"jobId\": \"J', id, 'abc\"}, \"n\": [\"Deep-', id, '\"]}') WHEN 1 THEN concat('{\"n\": [{\"req_id\": \"REQ 7 ', id + 10, '\"}], \"my_GUID\": \"g-', id, '-x\"}') WHEN 2 THEN concat('[\"plain\", \"https://a.example/1\", \"two words 2\", \"R-', id + 100, '\"]') WHEN 3 THEN '{\"id\": 5, \"title\": \"A-1\"}' ELSE 'no json' END"


@query("SELECT id, CASE id % 5 WHEN 0 THEN 'j' || CAST(id AS VARCHAR) || 'abc' WHEN 1 THEN 'g-' || CAST(id AS VARCHAR) || '-x' WHEN 2 THEN 'r-' || CAST(id + 100 AS VARCHAR) END AS own FROM canonical", "canonical")
def metadata_ids(spark, d):
    return view(spark, d, "canonical", "id").select("id", urls.metadata_id(F.expr(_JSON)).alias("own"))


@query("SELECT id, CASE WHEN length(regexp_replace(lower(trim(apply_url)), '[^a-z0-9_-]+', '', 'g')) >= 4 THEN regexp_replace(lower(trim(apply_url)), '[^a-z0-9_-]+', '', 'g') END AS stable, coalesce(length(title) >= 4 AND regexp_matches(title, '[0-9_-]') AND NOT regexp_matches(title, '\\s'), false) AS looks FROM canonical", "canonical")
def stable_ids(spark, d):
    return view(spark, d, "canonical", "id", "apply_url", "title").select("id", urls.stable_id(F.col("apply_url")).alias("stable"), urls.looks_stable(F.col("title")).alias("looks"))


_HARVEST = "concat('see <a href=\"', apply_url, '\">x</a> and (https://two.example/', id, '), https://two.example/', id, '. http://three.example/a?b=c;')"


@query(f"SELECT id, array_to_string(list_distinct_ordered, ' ') AS found FROM (SELECT id, list_filter(us, lambda u, i: list_position(us, u) = i) AS list_distinct_ordered FROM (SELECT id, [regexp_replace(u, '[.,;:)\\]]+$', '') FOR u IN regexp_extract_all({_HARVEST}, {q(chr(40) + 'https?://[^' + chr(92) + 's' + chr(34) + chr(39) + '<>]+' + chr(41))}, 1)] AS us FROM canonical))", "canonical")
def url_harvest(spark, d):
    return view(spark, d, "canonical", "id", "apply_url").select("id", F.array_join(urls.urls_in(F.expr(_HARVEST)), " ").alias("found"))


@query("SELECT id, nullif(left(trim(regexp_replace(repeat(description || chr(10) || '  ', 1 + id % 30), '\\s+', ' ', 'g')), 1200), '') AS snippet FROM canonical", "canonical")
def response_snippets(spark, d):
    return view(spark, d, "canonical", "id", "description").select("id", text.snippet(F.expr("repeat(concat(description, chr(10), '  '), CAST(1 + id % 30 AS INT))")).alias("snippet"))


@query("SELECT id, regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), 'x', 'x') AS t FROM (SELECT id, title || ' &amp;lt; &quot;' || company || '&quot;&nbsp;&#39;' AS t FROM canonical)", "canonical")
def decoded_entities(spark, d):
    return view(spark, d, "canonical", "id", "title", "company").select("id", text.decode_entities(F.concat("title", F.lit(' &amp;lt; &quot;'), "company", F.lit("&quot;&nbsp;&#39;"))).alias("t"))


# --- descriptions ----------------------------------------------------------------------------------------------------

_HEAD = r"^(?:#{1,3}\s+\S.*|\*\*[^*]+\*\*:?|[A-Z][A-Z\s&'/():-]{3,}|[A-Z][^.!?]{0,55}:)$"
_ITEMS = r"^(?:[-•*–·]|\d{1,2}\.)\s+(.+)$"
_NOISE = " + ".join(f"CASE WHEN contains(lower(description), {q(w)}) THEN {R.NOISE_POINTS} ELSE 0 END" for w in R.NOISE_WORDS)


@query(rf"""+ {_TEXT}, l AS (SELECT id, description, [y FOR y IN [trim(z) FOR z IN string_split(regexp_replace(regexp_replace(replace(description, '&amp;', '&'), '</?(p|div|section|article|h[1-6]|li|ul|ol|blockquote)[^>]*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), chr(10))] IF y NOT IN ('', ':')] AS lines FROM x),
b AS (WITH RECURSIVE r AS (SELECT id, lines, 0 AS i, [] :: VARCHAR[] AS kinds, '' AS last FROM l
  UNION ALL SELECT id, lines, i + 1, CASE WHEN head AND kinds[-1] = 'header' AND lower(last) = lower(said) THEN kinds WHEN kind = 'list' AND kinds[-1] = 'list' THEN kinds ELSE list_append(kinds, kind) END, said FROM (
    SELECT *, CASE WHEN head THEN 'header' WHEN item IS NOT NULL OR (kinds[-1] = 'list' AND length(line) <= 180) THEN 'list' ELSE 'paragraph' END AS kind, CASE WHEN head THEN trim(regexp_replace(line, '^#+\s+|\*\*|:$', '', 'g')) ELSE coalesce(item, line) END AS said FROM (
      SELECT *, lines[i + 1] AS line, nullif(regexp_extract(lines[i + 1], {q(_ITEMS)}, 1), '') AS item, NOT regexp_matches(lines[i + 1], {q(_ITEMS)}) AND regexp_matches(lines[i + 1], {q(_HEAD)}) AS head FROM r WHERE i < len(lines))))
  SELECT id, kinds FROM r WHERE i = len(lines))
SELECT l.id, CAST(len(kinds) AS BIGINT) AS n_blocks, array_to_string(kinds, ',') AS kinds, round(len([k FOR k IN kinds IF k = 'header']) * 45 + len([k FOR k IN kinds IF k = 'list']) * 30 + len([k FOR k IN kinds IF k = 'paragraph']) * 8 + least(length(description), 2400) / 12.0 - ({_NOISE}), 4)::DOUBLE AS worth FROM l JOIN b ON l.id = b.id""", "canonical")  # fmt: skip
def description_blocks(spark, d):
    b = _texts(spark, d).withColumn("b", describe.blocks(F.col("description")))
    return b.select("id", F.size("b").cast("long").alias("n_blocks"), F.array_join(F.col("b.kind"), ",").alias("kinds"), F.round(describe.worth(F.col("description"), F.col("b")), 4).alias("worth"))


_PAGE = "concat('United States', chr(10), 'Search', chr(10), 'var path = 1;', chr(10), 'Job description', chr(10), '<p>', description, '</p><ul><li>One', id, '</li><li>Two</li></ul>Responsibilities: Build and run', chr(10), repeat('Further words of the text. ', 6), chr(10), '{\"a\": [1]};', chr(10), 'Similar jobs', chr(10), 'Other role')"


@query("SELECT id, 'Job description' || chr(10) || CASE WHEN description LIKE '<p>Ship%' THEN 'Ship & sell' || chr(10) || '• Travel arrangements' || chr(10) ELSE replace(replace(description, ' salary: ', chr(10) || chr(10) || 'salary:' || chr(10) || ' '), ' - 45', chr(10) || '- 45') || chr(10) END || '• One' || CAST(id AS VARCHAR) || chr(10) || '• Two' || chr(10) || chr(10) || 'Responsibilities:' || chr(10) || chr(10) || 'Build and run' || chr(10) || trim(repeat('Further words of the text. ', 6)) AS said FROM canonical", "canonical")
def clean_descriptions(spark, d):
    return view(spark, d, "canonical", "id", "description", dear=True).select("id", describe.cleanup(F.expr(_PAGE)).alias("said"))


_GOOD = "repeat('A sentence of the longer text. ', 12)"


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'Duties:' || chr(10) || '- one' || chr(10) || '- two' || chr(10) || trim(repeat('A sentence of the longer text. ', 12)) WHEN 3 THEN 'Requirements:' || chr(10) || trim(repeat('A sentence of the longer text. ', 12)) END AS best FROM canonical", "canonical")
def best_description(spark, d):
    """A label with one long line behind it is no heading, unless it is that of a section."""
    long = f"trim({_GOOD})"
    one, two, three = f"concat('Duties:', chr(10), {long})", f"concat('Duties:', chr(10), '- one', chr(10), '- two', chr(10), {long})", f"concat('Requirements:', chr(10), {long})"
    c = view(spark, d, "canonical", "id", dear=True).selectExpr("id", f"CASE id % 4 WHEN 0 THEN array({one}, NULL, {two}, 'short') WHEN 1 THEN array(NULL, ' ', 'short', {long}, concat({one}, '...')) WHEN 2 THEN array('x', {one}, {one}) ELSE array('x', {one}, {three}, {three}) END AS said")
    return c.select("id", describe.best(F.col("said")).alias("best"))


_LABELLED = "concat(company, ' has a place.', chr(10), CASE id % 7 WHEN 0 THEN concat('Work Location: ', location) WHEN 1 THEN concat('Shift:', chr(10), chr(10), title) WHEN 2 THEN concat('Business unit:  ', title) WHEN 3 THEN concat('Business unit: ', repeat('x', 221)) WHEN 4 THEN concat('Industry: Base: ', title) WHEN 5 THEN concat('Reports To: ', title, chr(10), 'Grade: 7') ELSE concat('see Shift: ', title) END, chr(10), '• last')"


@query("""SELECT id, regexp_replace(company || ' has a place.' || CASE id % 7 WHEN 0 THEN E'\\n\\nWork Location:\\n' || coalesce(chr(10) || location, '') WHEN 1 THEN E'\\nShift: ' || title WHEN 2 THEN E'\\nBusiness unit:\\n' || title WHEN 3 THEN E'\\nBusiness unit: ' || repeat('x', 221) WHEN 4 THEN E'\\n\\nIndustry:\\n\\nBase: ' || title WHEN 5 THEN E'\\nReports To:\\n' || title || E'\\nGrade: 7' ELSE E'\\nsee Shift: ' || title END || E'\\n• last', '\\s+[-–—]\\s+([A-Z0-9])', E'\\n- \\\\1', 'g') AS said FROM canonical WHERE company <> '' AND title <> '' AND location <> ''""", "canonical")
def inline_headings(spark, d):
    """Labels with a value on their line: a heading with a line below, or one line as before."""
    c = view(spark, d, "canonical", "id", "company", "title", "location", dear=True).where("company <> '' AND title <> '' AND location <> ''")
    return c.select("id", describe.cleanup(F.expr(_LABELLED)).alias("said"))


_DATA_OF = "concat('Menu', chr(10), '{{\"description\": \"', repeat(concat(title, ' and more words. '), 12), '\", \"n\": 1}}', chr(10), {0}, chr(10), 'Footer of the page')"
_MARKED = _DATA_OF.format("""CASE id % 4 WHEN 0 THEN concat('window["az_details"] = {"description": "', repeat(concat(company, ' said \\\\"yes\\\\" to it. '), 8), '"};') WHEN 1 THEN concat('window["az_details"] = {"description": "', company, '"};') WHEN 2 THEN concat('{"description": "', repeat(concat(company, ' has it all. '), 30), '"}') ELSE '' END""")


@query("""SELECT id, CASE id % 4 WHEN 0 THEN trim(repeat(company || ' said "yes" to it. ', 8)) WHEN 2 THEN trim(repeat(company || ' has it all. ', 30)) ELSE trim(repeat(title || ' and more words. ', 12)) END AS said FROM canonical WHERE length(company) > 2 AND length(title) > 2""", "canonical")
def embedded_descriptions(spark, d):
    """A page's description in its data: the one behind the marker if it is long enough, else the longest."""
    c = view(spark, d, "canonical", "id", "company", "title", dear=True).where("length(company) > 2 AND length(title) > 2")
    return c.select("id", describe.primary(F.expr(_MARKED)).alias("said"))


# --- pages -----------------------------------------------------------------------------------------------------------

_LD = "'<script type=\"application/ld+json\">{\"@type\": \"JobPosting\", \"title\": \"Nurse\", \"description\": \"<b>Care</b>\"}</script>'"
_DATA = "'<script>{\"jobTitle\": \"Nurse\", \"description\": \"Care\"}</script>'"
_MORE = "repeat('<a href=\"/jobs/1\">Open job one</a><a href=\"/next\">next page of jobs</a><a href=\"https://other.example.org/jobs/2\">Elsewhere job</a>', CAST(page_id % 30 AS {0}))"


def _page(duck: bool) -> str:
    return f"CASE page_id % 5 WHEN 0 THEN {'html || ' + _LD if duck else 'concat(html, ' + _LD + ')'} WHEN 1 THEN {'html || ' + _DATA if duck else 'concat(html, ' + _DATA + ')'} WHEN 2 THEN {'html || ' + _MORE.format('BIGINT') if duck else 'concat(html, ' + _MORE.format('INT') + ')'} WHEN 3 THEN {'html || ' if duck else 'concat(html, '}'<p>See our open roles</p>'{'' if duck else ')'} ELSE html END"


_ALINK = r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
_PLAINTEXT = r"regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_HOSTP = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"


@query(f"""WITH p AS (SELECT page_id, url, {_page(True)} AS html FROM pages), l AS (SELECT page_id, url, html, regexp_extract_all(html, {q(_ALINK)}, 1) AS hs, [trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '\\s+', ' ', 'g')) FOR t IN regexp_extract_all(html, {q(_ALINK)}, 2)] AS ts FROM p),
k AS (SELECT page_id, url, html, least(40, len([i FOR i IN range(1, len(hs) + 1) IF length(ts[i]) BETWEEN 4 AND 140 AND NOT starts_with(hs[i], '#') AND NOT regexp_matches(hs[i], '^(javascript|mailto|tel):') AND (NOT regexp_matches(hs[i], '^https?://') OR lower(regexp_extract(hs[i], '^https?://([^/?#:]+)', 1)) = {_HOSTP}) AND regexp_matches(ts[i] || ' ' || CASE WHEN regexp_matches(hs[i], '^https?://') THEN hs[i] ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || CASE WHEN starts_with(hs[i], '/') THEN '' ELSE '/' END || hs[i] END, {q('(?i)' + R.JOB_LINK)}) AND NOT regexp_matches(ts[i], {q('(?i)' + R.PAGING_LINK)})])) AS n FROM l),
a AS (SELECT *, regexp_matches(lower(url) || chr(10) || lower(left(trim(regexp_replace({_PLAINTEXT}, '[ \\t]{{2,}}', ' ', 'g')), 4000)), {q('|'.join(R.CAREER_PAGE))}) AS about FROM k)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'STRUCTURED_JSON' WHEN 1 THEN 'STRUCTURED_API' ELSE CASE WHEN n > 0 OR about THEN 'HTML_FALLBACK' ELSE 'UNKNOWN' END END AS route, round(CASE page_id % 5 WHEN 0 THEN 0.96 WHEN 1 THEN 0.82 ELSE CASE WHEN n > 0 THEN least(0.7, 0.35 + n * 0.02) WHEN about THEN 0.22 ELSE 0.15 END END, 4)::DOUBLE AS confidence,
  trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '\\s+', ' ', 'g')) AS heading FROM a""")  # fmt: skip
def html_route(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").selectExpr("page_id", "url", f"{_page(False)} AS html")
    return p.select("page_id", pages.route(F.col("html"), F.col("url")).alias("r"), pages.heading(F.col("html")).alias("heading")).select("page_id", "r.route", F.round("r.confidence", 4).alias("confidence"), "heading")


_CAREER = "CASE page_id % 3 WHEN 0 THEN '<a href=\"/careers\">c</a><a href=\"jobs/open.html#x\">j</a><a href=\"/jobs/list.pdf\">p</a>' WHEN 1 THEN '<a href=\"https://jobs.other.example/x\">o</a><a href=\"https://elsewhere.example/careers\">e</a><a href=\"mailto:jobs@x.example\">m</a>' ELSE '' END"


@query(f"""WITH p AS (SELECT page_id, url, html || ({_CAREER}) AS html, regexp_replace({_HOSTP}, '^www\\.', '') AS own, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root FROM pages),
l AS (SELECT page_id, own, root, unnest(list_distinct(regexp_extract_all(html, '(?is)<a\\b[^>]*?href\\s*=\\s*["'']([^"''#]+)', 1))) AS u FROM p),
f AS (SELECT page_id, own, CASE WHEN regexp_matches(u, '(?i)^https?://') THEN u WHEN starts_with(u, '/') THEN root || u ELSE root || '/' || u END AS u FROM l WHERE NOT regexp_matches(u, '(?i)^(?:mailto:|tel:|javascript:)')),
h AS (SELECT *, regexp_replace(lower(regexp_extract(u, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS h FROM f),
w AS (SELECT DISTINCT page_id, u FROM h WHERE NOT regexp_matches(regexp_replace(u, '[?#].*$', ''), {q('(?i)' + R.NO_PAGE)}) AND (starts_with(h, 'careers.') OR starts_with(h, 'jobs.') OR (regexp_matches(u, {q('(?i)' + R.CAREER_WORDS)}) AND (h = own OR ends_with(h, '.' || own)))))
SELECT p.page_id, count(w.u) AS n, coalesce(string_agg(w.u, ' ' ORDER BY w.u), '') AS found FROM p LEFT JOIN w ON p.page_id = w.page_id GROUP BY 1""")  # fmt: skip
def career_links(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", F.concat("html", F.expr(_CAREER)).alias("html"))
    return p.withColumn("l", pages.career_links(F.col("html"), F.col("url"))).select("page_id", F.size("l").cast("long").alias("n"), F.array_join(F.array_sort("l"), " ").alias("found"))


_SITE = "concat('https://acme', id % 9, '.example/jobs')"


@query(f"""+ c AS (SELECT *, 'Do it all. ' || description AS said0, trim(regexp_replace(replace(regexp_replace(description, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')) AS flat FROM canonical WHERE id % 4 < 3),
x AS (SELECT id, id % 4 AS k, title, CASE id % 4 WHEN 0 THEN company WHEN 1 THEN company ELSE 'Site Inc' END AS company, CASE id % 4 WHEN 0 THEN 'Bonn' WHEN 1 THEN location ELSE 'Bern' END AS location, CASE id % 4 WHEN 2 THEN NULL ELSE flat END AS description,
  CASE id % 4 WHEN 0 THEN 'https://s.example/' || CAST(id AS VARCHAR) WHEN 1 THEN 'https://s' || CAST(id % 9 AS VARCHAR) || '.example/list/' || CAST(id AS VARCHAR) ELSE 'https://d.example/job/' || CAST(id AS VARCHAR) END AS source_url FROM c),
z AS (SELECT *, title || chr(10) || coalesce(description, 'x') AS t FROM x)
SELECT 'CompanySite:t' || CAST(id % 4 AS VARCHAR) AS source_name, title, company, location, source_url, CASE WHEN k = 2 THEN 'https://d.example/apply/' || CAST(id AS VARCHAR) ELSE source_url END AS apply_url, CASE WHEN k = 0 THEN 'company:Q' || CAST(id AS VARCHAR) END AS known_id,
  CASE k WHEN 0 THEN epoch_us(TIMESTAMP '2001-10-01') WHEN 2 THEN epoch_us(TIMESTAMP '2001-03-05') END AS posted, CASE WHEN regexp_matches(t, '(?i)\\bintern(ship)?\\b') THEN 'INTERNSHIP' WHEN regexp_matches(t, '(?i)\\bcontract\\b') THEN 'CONTRACT' WHEN regexp_matches(t, '(?i)\\bpart[- ]?time\\b') THEN 'PART_TIME' END AS employment_type,
  CASE WHEN regexp_matches(t, '(?i)\\bhybrid\\b') THEN 'HYBRID' WHEN regexp_matches(t, '(?i)\\bremote\\b') THEN 'REMOTE' END AS work_mode, CASE WHEN k <> 2 AND contains(description, '$90,000 - $120,000') THEN 90000.0 END::DOUBLE AS salary_min, CASE WHEN k <> 2 AND contains(description, '$90,000 - $120,000') THEN 'USD' END AS salary_currency FROM z""", "canonical")  # fmt: skip
def source_company_site(spark, d):
    """Sites with structured data, with data in scripts, and with links to pages without either."""
    c = view(spark, d, "canonical", dear=True)
    at = F.lit(AS_OF).cast("timestamp_ntz")
    ld = "concat('<html><script type=\"application/ld+json\">', to_json(named_struct('@type', 'JobPosting', 'title', title, 'description', description, 'url', concat('https://s.example/', id), 'identifier', concat('Q', id), 'datePosted', '2001-10-01', 'hiringOrganization', named_struct('name', company), 'jobLocation', array(named_struct('address', named_struct('addressLocality', 'Bonn'))))), '</script></html>')"
    data = "concat('<html><script>', to_json(named_struct('jobTitle', title, 'description', description, 'company', company, 'location', location)), '</script></html>')"
    lists = c.where("id % 4 = 0").selectExpr("'t0' AS token", "'Site Inc' AS company", f"{_SITE} AS url", f"{ld} AS html").union(c.where("id % 4 = 1").selectExpr("'t1'", "'Site Inc'", "concat('https://s', id % 9, '.example/list/', id)", f"{data}"))
    links = c.where("id % 4 = 2").selectExpr("id div 20 AS g", "concat('<a href=\"/job/', id, '\">Opening no ', id, '</a>') AS a").groupBy("g").agg(F.array_join(F.collect_list("a"), " ").alias("html")).selectExpr("'t2' AS token", "'Site Inc' AS company", "concat('https://d.example/all/', g) AS url", "html")
    body = "concat('<html><h1>', title, '</h1><p>Location: Bern</p><p>Posted: March 5, 2001</p><p>', repeat('All the words. ', 10), '</p><a href=\"/apply/', id, '\">Apply here</a></html>')"
    details = c.where("id % 4 = 2").selectExpr("'t2' AS token", "'Site Inc' AS company", "concat('https://d.example/job/', id) AS url", f"{body} AS html").withColumn("fetched_at", at)
    out = shown(boards.company_site(lists.union(links).withColumn("fetched_at", at), details))
    return out.select("source_name", "title", "company", "location", "source_url", "apply_url", F.when(F.col("source_id").startswith("company:Q"), F.col("source_id")).alias("known_id"), "posted", "employment_type", "work_mode", "salary_min", "salary_currency")


#: Lists of seven pages: each leads to the one after it and to that of twice its number, the last back to the first.
_NEXT = "concat('<a href=\"/p/', (page_id + 1) % 7, '\">Next</a><a href=\"https://s', page_id div 7, '.example/p/', page_id * 2 % 7, '\">Load <b>more</b></a><a href=\"https://other.example/p/3\">Next</a><a href=\"/p/5\">Our offices</a>')"


@query("""WITH RECURSIVE p AS (SELECT page_id // 7 AS g, page_id % 7 AS k, page_id FROM pages), e AS (SELECT g, k, (k + 1) % 7 AS t FROM p UNION SELECT g, k, page_id * 2 % 7 FROM p),
w(g, k, depth) AS (SELECT g, k, 0 FROM p WHERE k = 0 UNION SELECT w.g, e.t, depth + 1 FROM w JOIN e ON e.g = w.g AND e.k = w.k JOIN p ON p.g = e.g AND p.k = e.t WHERE depth < 4)
SELECT 't' || CAST(g AS VARCHAR) AS token, 'https://s' || CAST(g AS VARCHAR) || '.example/p/' || CAST(k AS VARCHAR) AS url, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY g, k""")
def listing_pages(spark, d):
    """Lists over several pages, with loops, followed four steps from their first."""
    p = spark.read.parquet(f"{d}/pages.parquet").selectExpr("page_id", "html")
    landed = p.select(F.expr("concat('t', page_id div 7)").alias("token"), F.expr("concat('https://s', page_id div 7, '.example/p/', page_id % 7)").alias("url"), F.concat(F.coalesce("html", F.lit("")), F.expr(_NEXT)).alias("html"))
    return pages.reached(p.selectExpr("concat('t', page_id div 7) AS token", "concat('https://s', page_id div 7, '.example/p/0') AS url"), landed, 4).withColumn("depth", F.col("depth").cast("long"))


# --- differences -----------------------------------------------------------------------------------------------------

_PAIRS = "p AS (SELECT conv_id, turn, string_split(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), chr(10)) AS a, string_split(coalesce(text, ''), chr(10)) AS b FROM conversations)"


@query(f"""WITH RECURSIVE {_PAIRS}, r AS (SELECT conv_id, turn, a, b, 0 AS i, [0 FOR x IN range(0, len(b) + 1)] AS row FROM p
  UNION ALL SELECT conv_id, turn, a, b, i + 1, [list_max(list_slice(t, 1, k)) FOR k IN range(1, len(t) + 1)] FROM (SELECT *, list_concat([0], [greatest(row[j + 1], CASE WHEN b[j] = a[i + 1] THEN row[j] + 1 ELSE 0 END) FOR j IN range(1, len(b) + 1)]) AS t FROM r WHERE i < len(a)))
SELECT conv_id, turn, CAST(len(b) - row[-1] AS BIGINT) AS added, CAST(len(a) - row[-1] AS BIGINT) AS removed, CAST(row[-1] AS BIGINT) AS kept FROM r WHERE i = len(a)""")  # fmt: skip
def line_diff_stats(spark, d):
    return pages.line_diff(_turns(spark, d), ["conv_id", "turn"])


def _turns(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.lag("text").over(w).alias("left"), F.col("text").alias("right"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, array_to_string(a, chr(10)) AS old, array_to_string(b, chr(10)) AS new FROM p")
def line_diff_sides(spark, d):
    """Both sides of the differences, put together again."""
    rows = pages.line_diff(_turns(spark, d), ["conv_id", "turn"], rows=True)
    side = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("n", c)))), lambda x: x[c]), "\n")
    return rows.groupBy("conv_id", "turn").agg(side("left").alias("old"), side("right").alias("new"))
