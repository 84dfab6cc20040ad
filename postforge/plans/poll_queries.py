"""Polls over the driver's tables: what belongs together, what becomes of the known rows, and what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postforge.bindings import as_of, view
from postforge.operators import lifecycle, polls
from postforge.plans import extra_queries as X
from postforge.plans import page_queries as P
from postforge.plans.queries import MATCHES_SQL, _lifecycle_sql, _sides, _similar_sql, compatible_sql, merged_columns, query
from postforge.sources.store import Store
from postforge.sources.tables import scratch
from postforge.streaming import intake

#: Where a posting stands in its poll: neither by id nor by any key.
ARRIVAL = "(id * 7919) % 1000003"

_KEYS_OF = f"keyed AS (SELECT ni.id, {ARRIVAL.replace('id', 'ni.id')} AS arrival, ni.ak, ni.sk, ni.pk, nc.ck FROM ni LEFT JOIN nc ON nc.id = ni.id)"

_PAIRS = """links(a, b) AS (SELECT x.id, y.id FROM keyed x JOIN keyed y ON x.ak = y.ak UNION SELECT x.id, y.id FROM keyed x JOIN keyed y ON x.sk = y.sk UNION SELECT x.id, y.id FROM keyed x JOIN keyed y ON x.pk = y.pk UNION SELECT x.id, y.id FROM keyed x JOIN keyed y ON x.ck = y.ck),
reach(a, b) AS (SELECT id, id FROM keyed UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)"""


def _poll(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    new, mappings, known = _sides(spark, d)
    return new.withColumn("arrival", F.expr(ARRIVAL)), mappings, known


@query(f"{MATCHES_SQL}, {_KEYS_OF}, {_PAIRS} SELECT a AS id, min(b) AS component FROM reach GROUP BY a", "canonical", "incoming", "mapping", recursive=True)
def poll_components(spark, d):
    """Postings of a poll that share a key, through others as well."""
    return polls.components(_poll(spark, d)[0])


_WITHIN = f"""acc AS (SELECT keyed.* FROM keyed JOIN say ON say.id = keyed.id WHERE reject_reason IS NULL), stay AS (SELECT old.raw_id AS id, old.canonical_id FROM old JOIN ok ON ok.new_id = old.raw_id AND ok.known_id = old.canonical_id JOIN acc ON acc.id = old.raw_id WHERE ok.fits),
own AS ({_similar_sql(" WHERE c OR t OR (st >= 2 AND (sd >= 4 OR ss >= 4))").replace("+ k AS", "WITH k AS", 1).replace("FROM canonical)", "FROM incoming)", 1)}),
met AS (SELECT new_id, known_id, CAST(NULL AS BIGINT) AS earlier, how, rung, score, 0 AS own, known_id AS tie FROM u WHERE rn = 1
  UNION ALL SELECT y.id, NULL, x.id, 'applyUrlKey', 0, 100, 1, x.arrival FROM acc x JOIN acc y ON x.ak = y.ak AND x.arrival < y.arrival UNION ALL SELECT y.id, NULL, x.id, 'sourceUrlKey', 2, 100, 1, x.arrival FROM acc x JOIN acc y ON x.sk = y.sk AND x.arrival < y.arrival
  UNION ALL SELECT y.id, NULL, x.id, 'postingIdKey', 4, 100, 1, x.arrival FROM acc x JOIN acc y ON x.pk = y.pk AND x.arrival < y.arrival UNION ALL SELECT y.id, NULL, x.id, 'duplicateCluster', 6, 95, 1, x.arrival FROM acc x JOIN acc y ON x.ck = y.ck AND x.arrival < y.arrival
  UNION ALL SELECT y.id, NULL, x.id, 'similarity', 9, score, 1, x.arrival FROM own JOIN acc x ON x.id = own.known_id JOIN acc y ON y.id = own.new_id AND x.arrival < y.arrival WHERE score >= 45),
best AS (SELECT * FROM met WHERE new_id IN (SELECT id FROM acc) AND new_id NOT IN (SELECT id FROM stay) QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY rung, score DESC, own, tie) = 1),
node AS (SELECT acc.id, coalesce(stay.canonical_id, best.known_id) AS canonical_id, best.earlier, best.how FROM acc LEFT JOIN stay ON stay.id = acc.id LEFT JOIN best ON best.new_id = acc.id),
walk(id, spot) AS (SELECT id, id FROM node UNION ALL SELECT walk.id, node.earlier FROM walk JOIN node ON node.id = walk.spot WHERE node.earlier IS NOT NULL),
ends AS (SELECT walk.id, node.canonical_id, CASE WHEN node.canonical_id IS NULL THEN node.id END AS created_by FROM walk JOIN node ON node.id = walk.spot WHERE node.earlier IS NULL)"""


_IN_ORDER = f"{MATCHES_SQL}, {_KEYS_OF}, old AS ({X._OLD}), say AS (WITH {P.normalize_sql()} SELECT id, reject_reason FROM done), ok AS (WITH {compatible_sql('(n.id, k.id) IN (SELECT raw_id, canonical_id FROM old)', 'i.id % 4 = 0')} SELECT * FROM fits), {_WITHIN}"


@query(f"{_IN_ORDER} SELECT ends.*, node.how FROM ends JOIN node ON node.id = ends.id", "canonical", "incoming", "mapping", recursive=True)
def poll_in_order(spark, d):
    """Where each accepted posting of a poll goes: to a known row, to an earlier posting, or to a row of its own."""
    new, mappings, known = _poll(spark, d)
    said = P._normalized(spark, d).select("id", "reject_reason")
    return X.ingestion.decide_in_order(new, said, X._before(spark, d), mappings, known).where("decision <> 'rejected'").select("id", "canonical_id", "created_by", "how")


#: Which row a posting of the fold's poll belongs to: a handful of rows, so that many postings meet each.
_TARGET = "1 + id % 7"


def _fold_sql() -> str:
    return f"""+ j AS (SELECT *, {_TARGET} AS target, row_number() OVER (PARTITION BY {_TARGET} ORDER BY {ARRIVAL}) AS k FROM incoming),
f AS (SELECT id, 0::BIGINT AS step, title, company, location, role_family, region, work_mode, employment_type, description, apply_url, salary_min, salary_max, posted_at, deadline, (availability_score * 5)::BIGINT AS top FROM canonical WHERE id <= 9
  UNION ALL SELECT c.id, c.step + 1, {merged_columns("n.rank >= c.top")}, greatest(c.top, n.rank)::BIGINT FROM f c JOIN j n ON n.target = c.id AND n.k = c.step + 1)
SELECT * EXCLUDE (posted_at, deadline, step, top), epoch_us(posted_at) AS posted, epoch_us(deadline) AS due, top AS "rank", step AS n_merged FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY step DESC) = 1"""


@query(_fold_sql(), "canonical", "incoming", recursive=True)
def survivorship_fold(spark, d):
    """What the postings of a poll make, one after the other, of the few rows that all of them belong to."""
    known = view(spark, d, "canonical").where("id <= 9").withColumn("rank", (F.col("availability_score") * 5).cast("long"))
    postings = view(spark, d, "incoming").withColumns({"target": F.expr(_TARGET), "arrival": F.expr(ARRIVAL)})
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    out = polls.fold(postings, known)
    return out.withColumns({"posted": us("posted_at"), "due": us("deadline")}).drop("posted_at", "deadline")


# --- what is stored --------------------------------------------------------------------------------------------------

_STORED = """, going AS (SELECT ends.id, coalesce(ends.canonical_id, -ends.created_by) AS target, ends.created_by = ends.id AS made, node.how, old.raw_id IS NOT NULL AS had FROM ends JOIN node ON node.id = ends.id LEFT JOIN old ON old.raw_id = ends.id),
sums AS (SELECT count(*) AS accepted, count(*) FILTER (coalesce(made, false)) AS made, count(*) FILTER (how IS NOT NULL) AS deduped, count(*) FILTER (had) AS had, count(DISTINCT target) AS targets FROM going), whole AS (SELECT count(*) AS fetched, count(*) FILTER (id % 5 = 0) AS gone FROM incoming)
SELECT unnest(['raw', 'mapping', 'canonical', 'eligibility', 'run', 'fetched', 'accepted', 'rejected', 'raw_created', 'raw_updated', 'canonical_created', 'canonical_updated', 'deduped', 'mapping_created', 'mapping_updated', 'mappings_removed']) AS name,
  unnest([fetched, (SELECT count(*) FROM (SELECT DISTINCT id, canonical_id FROM mapping)) + (SELECT count(*) FROM old) + gone + accepted - had, (SELECT count(*) FROM canonical) + made, targets, 1, fetched, accepted, fetched - accepted, fetched, 0, made, accepted - made, deduped, accepted - had, had, gone]) AS n FROM sums, whole"""


@query(_IN_ORDER + _STORED, "canonical", "incoming", "mapping", recursive=True)
def ingest_commit(spark, d):
    """A poll put into force as one change: how many rows each table has then, and the counts of the run's row."""
    new, mappings, known = _poll(spark, d)
    store = Store(spark, scratch(spark, "store"), intake.tables(8))
    source, none = F.lit("Feed:poll"), F.lit(None).cast("string")
    feed = lambda rows, kind: rows.select("id", "canonical_id", source.alias("source_name"), kind.alias("source_id"))
    old = feed(X._before(spark, d).select((-F.col("raw_id")).alias("id"), "canonical_id"), F.col("id").cast("string"))
    gone = feed(view(spark, d, "incoming", "id").where("id % 5 = 0").select((-F.col("id") - 10**9).alias("id"), F.lit(1).cast("long").alias("canonical_id")), F.concat(F.lit("gone-"), F.col("id").cast("string")))
    own = mappings.withColumn("id", F.col("id") * 1_000_003 + F.col("canonical_id") % 1_000_003)  # ids of this table repeat
    maps = own.unionByName(old, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)
    store.commit(lambda at: {"canonical": intake._shaped(store, "canonical", known), "mapping": intake._shaped(store, "mapping", maps)})
    said = P._normalized(spark, d).select("id", "reject_reason")
    postings = new.join(said, "id").withColumns({"id": -F.col("id"), "source_id": (-F.col("id")).cast("string"), "source_url": F.col("apply_url"), "experience_level": F.lit("UNKNOWN"), "source_type": F.lit("BOARD"), "source_reliability": F.lit(0.7), "short_summary": F.coalesce("short_summary", none)})
    intake.poll(store, postings, "Feed:poll", 0, spark.range(1).select(as_of()).first()[0], full=True, exhausted=True)
    sizes = [store.read(t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("raw", "mapping", "canonical", "eligibility", "run")]
    run = store.read("run").select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in intake.COUNTS[:11]])))
    for s in sizes:
        run = run.union(s)
    return run


@query(_lifecycle_sql() + " SELECT * FROM z", "canonical", "mapping")
def lifecycle_refresh(spark, d):
    """Postings scored a month ago and again where that no longer holds: the same as scoring all of them."""
    jobs, mappings = view(spark, d, "canonical"), view(spark, d, "mapping")
    then = (as_of() - F.expr("INTERVAL 30 DAYS")).cast("timestamp_ntz")
    first = polls._kept(spark, lifecycle.rescored(jobs, mappings, then), "scored")
    stored = jobs.drop("status", "availability_score").join(first, "id").withColumn("scored_at", then)
    open_ = polls._kept(spark, lifecycle.due(stored, stored.select("id").limit(0), as_of()).select("id"), "due")
    again = lifecycle.score(jobs.join(open_, "id", "left_semi"), mappings.join(open_.select(F.col("id").alias("canonical_id")), "canonical_id", "left_semi"), as_of())
    rest = first.join(open_, "id", "left_anti").select(*again.columns)
    return again.union(rest).withColumn("availability_score", F.col("availability_score").cast("long"))
