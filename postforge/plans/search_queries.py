"""Search over the driver's tables; the SQL stems each word of the vocabulary once, by expressions of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from postforge.bindings import view
from postforge.functions import rules as R
from postforge.operators import searching
from postforge.plans.queries import inlist, q, query
from postforge.sources.store import Store
from postforge.sources.tables import scratch

_OF = ("id", "title", "company", "role_family", "location")


def _cases(endings: dict[str, str]) -> str:
    """Each ending, the longest first, as a branch: what is left and what comes behind it."""
    return "CASE " + " ".join(f"WHEN ends_with(x, {q(e)}) THEN [left(x, length(x) - {len(e)}), {q(to)}, {q(e)}]" for e, to in sorted(endings.items(), key=lambda kv: (-len(kv[0]), kv[0]))) + " END"


def _stems_sql(words: str) -> str:
    """Relation stemmed(w, stem) of a relation of words."""
    short = "(regexp_matches({0}, '[^aeiouy][aeiouy][^aeiouywxY]$') OR regexp_matches({0}, '^[aeiouy][^aeiouy]$'))"
    region = lambda s, whole="": f"coalesce(nullif(length(regexp_extract({s}, '^({whole}.*?[aeiouy][^aeiouy])')), 0), length({s}))"
    whole = "".join(f"{b}|" for b in R.STEM_BEGINNINGS)
    return rf"""m0 AS (SELECT DISTINCT w, regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\1Y', 'g') AS x FROM ({words})),
m1 AS (SELECT *, {region("x", whole)} AS p FROM m0), m2 AS (SELECT *, p + {region("substr(x, p + 1)")} AS r FROM m1),
m3 AS (SELECT w, p, r, CASE WHEN ends_with(x, 'sses') THEN left(x, -2) WHEN ends_with(x, 'ied') OR ends_with(x, 'ies') THEN left(x, CASE WHEN length(x) > 4 THEN -2 ELSE -1 END) WHEN ends_with(x, 'us') OR ends_with(x, 'ss') THEN x WHEN regexp_matches(x, '[aeiouy].+s$') THEN left(x, -1) ELSE x END AS x FROM m2),
m4 AS (SELECT *, x IN {inlist(R.STEM_KEPT)} AS kept, {_cases({e: "" for e in ("eed", "eedly", "ed", "edly", "ing", "ingly")})} AS c FROM m3),
m5 AS (SELECT w, p, r, kept, CASE WHEN c IS NULL THEN x WHEN c[3] IN ('eed', 'eedly') THEN CASE WHEN length(c[1]) >= p THEN c[1] || 'ee' ELSE x END WHEN NOT regexp_matches(c[1], '[aeiouy]') THEN x WHEN regexp_matches(c[1], '(at|bl|iz)$') THEN c[1] || 'e' WHEN regexp_matches(c[1], '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(c[1], -1) WHEN length(c[1]) = p AND {short.format("c[1]")} THEN c[1] || 'e' ELSE c[1] END AS x, x AS before FROM m4),
m6 AS (SELECT * REPLACE (regexp_replace(x, '^(.+[^aeiouy])[yY]$', '\1i') AS x) FROM m5), m7 AS (SELECT *, {_cases(R.STEM_ENDINGS_2)} AS c FROM m6),
m8 AS (SELECT * EXCLUDE (c) REPLACE (CASE WHEN c IS NULL OR length(c[1]) < p OR (c[3] = 'ogi' AND NOT ends_with(c[1], 'l')) OR (c[3] = 'li' AND NOT regexp_matches(c[1], '[cdeghkmnrt]$')) THEN x ELSE c[1] || c[2] END AS x) FROM m7), m9 AS (SELECT *, {_cases(R.STEM_ENDINGS_3)} AS c FROM m8),
m10 AS (SELECT * EXCLUDE (c) REPLACE (CASE WHEN c IS NULL OR length(c[1]) < CASE c[3] WHEN 'ative' THEN r ELSE p END THEN x ELSE c[1] || c[2] END AS x) FROM m9), m11 AS (SELECT *, {_cases({e: "" for e in R.STEM_ENDINGS_4})} AS c FROM m10),
m12 AS (SELECT * EXCLUDE (c) REPLACE (CASE WHEN c IS NULL OR length(c[1]) < r OR (c[3] = 'ion' AND NOT regexp_matches(c[1], '[st]$')) THEN x ELSE c[1] END AS x) FROM m11),
m13 AS (SELECT *, CASE WHEN ends_with(x, 'e') AND (length(x) > r OR (length(x) > p AND NOT {short.format("left(x, -1)")})) THEN left(x, -1) WHEN ends_with(x, 'll') AND length(x) > r THEN left(x, -1) ELSE x END AS y FROM m12),
own(w, stem) AS (VALUES {", ".join(f"({q(a)}, {q(b)})" for a, b in R.STEM_EXCEPTIONS.items())}),
stemmed AS (SELECT w, CASE WHEN length(w) <= 2 OR regexp_matches(w, '[0-9]') THEN w ELSE coalesce(own.stem, CASE WHEN kept THEN before END, lower(y)) END AS stem FROM m13 LEFT JOIN own USING (w))"""


def _terms_sql(asked: str = "") -> str:
    split = lambda c: f"string_split(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
    placed = " UNION ALL ".join(f"SELECT id, unnest({split(c)}) AS w, {n} AS weight FROM canonical" for c, n in R.SEARCH_WEIGHTS.items())
    also = "".join(f" UNION ALL SELECT {q(a)}" for a in asked.split())
    return f"+ told AS (SELECT * FROM ({placed}) WHERE w <> '' AND w NOT IN {inlist(R.SEARCH_STOP_WORDS)}), {_stems_sql('SELECT w FROM told' + also)}, terms AS (SELECT id, stem AS term, max(weight)::BIGINT AS weight FROM told JOIN stemmed USING (w) GROUP BY 1, 2)"


@query(_terms_sql() + " SELECT * FROM terms", "canonical")
def search_terms(spark, d):
    return searching.terms(view(spark, d, "canonical", *_OF, dear=True)).where("term IS NOT NULL").select("id", "term", F.col("weight").cast("long").alias("weight"))


@query("+ texts AS (SELECT string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ') AS ws FROM documents), " + _stems_sql("SELECT unnest(ws) AS w FROM texts") + " SELECT w AS word, stem FROM stemmed WHERE w <> ''", "canonical")
def word_stems(spark, d):
    """The stem of every word of the documents."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")).alias("word"))
    return docs.where("word <> ''").distinct().select("word", searching.stem(F.col("word")).alias("stem"))


def _hits_sql(asked: str) -> str:
    each = [f"max(weight) FILTER (starts_with(term, (SELECT stem FROM stemmed WHERE w = {q(a)})))" for a in asked.split()]
    return _terms_sql(asked) + f" SELECT id, rank FROM (SELECT id, {' + '.join(each)} AS rank FROM terms GROUP BY id) WHERE rank IS NOT NULL"


@query(_hits_sql("engineers soft"), "canonical")
def ranked_search(spark, d):
    """A stored index: postings with other titles first, then those that changed, then a query with a stop word, plurals and a mark."""
    jobs = view(spark, d, "canonical", *_OF, dear=True)
    store = Store(spark, scratch(spark, "search"), {"terms": searching.table(8)})
    before = jobs.where("id % 4 <> 1").withColumn("title", F.expr("CASE WHEN id % 3 = 0 THEN concat('Software engineering of ', company) ELSE title END"))
    searching.refresh(store, before, stream="changes", number=0)
    searching.refresh(store, jobs.where("id % 3 = 0 OR id % 4 = 1"), stream="changes", number=1)
    return searching.search(store.read("terms"), jobs, "the ENGINEERS, soft").select("id", "rank")


@query("SELECT id, 0::BIGINT AS rank FROM canonical WHERE contains(lower(concat_ws(chr(10), title, company, role_family)), 'ple & so')", "canonical")
def search_without_terms(spark, d):
    """A query whose stop word doesn't count and whose other word begins no term: what holds it as it is."""
    jobs = view(spark, d, "canonical", *_OF, dear=True)
    return searching.search(searching.terms(jobs), jobs, "ple & so").select("id", "rank")
