"""One poll of a source as one change of several tables: raw postings, mappings, canonical rows, eligibility, and the run's row with its counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from postforge.functions import text
from postforge.operators import ingestion, lifecycle, normalize, polls
from postforge.sources.store import Snapshot, Store, Table
from postforge.sources.tables import scratch

_POSTING = "title string, company string, location string, description string, role_family string, region string, work_mode string, employment_type string, apply_url string, salary_min long, salary_max long, posted_at timestamp, deadline timestamp"
_KEYS = "company_key string, title_key string, title_core_key string, description_fingerprint string, location_key string, apply_url_key string, duplicate_cluster_id string"
RAW = f"id long, source_name string, source_id string, fetched_at timestamp, reject_reason string, {_POSTING}"
MAPPING = "id long, canonical_id long, source_name string, source_id string, source_url string, apply_url_key string, source_url_key string, posting_id_key string, source_type string, source_quality_rank int, source_reliability double, is_full_snapshot boolean, is_primary boolean, matched_by string, created_at timestamp, last_seen_at timestamp, removed_at timestamp"
CANONICAL = f"id long, {_POSTING}, {_KEYS}, short_summary string, status string, availability_score int, first_seen_at timestamp, last_seen_at timestamp, last_source_seen_at timestamp, last_confirmed_alive_at timestamp, last_apply_check_at timestamp, dead_signal_at timestamp, dead_signal_reason string, scored_at timestamp, next_change long"
ELIGIBILITY = "canonical_id long, category string, reason string, level int"
COUNTS = ["fetched", "accepted", "rejected", "raw_created", "raw_updated", "canonical_created", "canonical_updated", "deduped", "mapping_created", "mapping_updated", "mappings_removed", "live", "stale", "expired", "removed"]
RUN = "id string, source_name string, started_at timestamp, status string, " + ", ".join(f"{c} long" for c in COUNTS)


def tables(buckets: int = 64) -> dict[str, Table]:
    return {"raw": Table(RAW, ["id"], buckets), "mapping": Table(MAPPING, ["id"], buckets), "canonical": Table(CANONICAL, ["id"], buckets), "eligibility": Table(ELIGIBILITY, ["canonical_id"], buckets), "run": Table(RUN, ["id"], 1)}


def raw_id(source_name: Column, source_id: Column) -> Column:
    """A raw posting's id: the same in every poll."""
    return F.xxhash64(source_name, source_id)


def _shaped(store: Store, table: str, df: DataFrame) -> DataFrame:
    """df's columns as the table has them; what it lacks is null."""
    kinds = store.spark.createDataFrame([], store.tables[table].schema).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


def _kept(store: Store, df: DataFrame, name: str) -> DataFrame:
    path = scratch(store.spark, name)
    df.write.parquet(path)
    return store.spark.read.schema(df.schema).parquet(path)


def poll(store: Store, postings: DataFrame, source: str, number: int, now: datetime, full: bool, exhausted: bool) -> int | None:
    """Puts a poll of a source into force, or passes it over if the source's poll of that number is in force already. The version, or None.

    postings: what was fetched, normalized: id (see raw_id), source_id, arrival, reject_reason, rank, source_type, source_reliability, source_url, source_url_key, posting_id_key, duplicate_cluster_id, short_summary, experience_level,
    the keys and the posting's columns. Of rows with one id the last to arrive counts. full, exhausted: a whole snapshot, taken to its end; what it no longer has is removed.
    Every row that the poll touches is scored again; rows that it doesn't touch are for refresh().
    """
    return store.commit(lambda at: _changes(store, at, postings, source, number, now, full, exhausted), f"poll:{source}", number)


def _changes(store: Store, at: Snapshot, fetched: DataFrame, source: str, number: int, now: datetime, full: bool, exhausted: bool) -> dict[str, DataFrame]:
    c, t = F.col, F.lit(now).cast("timestamp")
    spark, read = store.spark, lambda name: store.read(name, at)
    last = fetched.groupBy("id").agg(F.max_by(F.struct(*fetched.columns), "arrival").alias("r"), F.count("*").alias("n_fetched")).select("r.*", "n_fetched")
    p = _kept(store, last, "poll")
    raw, mapping, canonical = read("raw"), read("mapping"), read("canonical")
    before = mapping.join(p.select("id"), "id", "left_semi").select(c("id").alias("raw_id"), "canonical_id")
    decided = ingestion.decide_in_order(p, p.select("id", "reject_reason"), before, mapping, canonical)
    known_raw = raw.join(p.select("id"), "id", "left_semi").select(c("id").alias("_raw"))
    decided = decided.join(known_raw, c("id") == c("_raw"), "left").join(before.select(c("raw_id").alias("_had")), c("id") == c("_had"), "left").join(p.select("id", "n_fetched", "arrival", "rank"), "id")
    decided = decided.withColumn("target", F.when(c("reject_reason").isNull(), F.coalesce("canonical_id", F.xxhash64("created_by", F.lit(source), F.lit(number)))))
    ok, n = c("reject_reason").isNull(), F.count_if
    seen = Observation("poll")
    decided = decided.observe(
        seen, F.sum("n_fetched").alias("fetched"), n(ok).alias("accepted"), n(~ok).alias("rejected"), n(c("_raw").isNull()).alias("raw_created"), n(c("_raw").isNotNull()).alias("raw_updated"), n(c("decision") == "created").alias("canonical_created"),
        n(ok & (c("decision") != "created")).alias("canonical_updated"), n(c("decision") == "matched").alias("deduped"), n(ok & c("_had").isNull()).alias("mapping_created"), n(ok & c("_had").isNotNull()).alias("mapping_updated"),
    )
    decided = _kept(store, decided, "decided")  # this write counts, too

    # canonical rows: what the postings make of those they belong to
    own = decided.where("target is not null").select(c("id").alias("_id"), "target", "created_by", "canonical_id", "how", "decision")
    mine = p.join(own, c("id") == c("_id"))
    ranks = mapping.where("removed_at is null").join(own.select("canonical_id").distinct(), "canonical_id", "left_semi").groupBy("canonical_id").agg(F.max("source_quality_rank").alias("rank"))
    old = canonical.join(own.where("canonical_id is not null").select(c("canonical_id").alias("id")).distinct(), "id", "left_semi").join(ranks.select(c("canonical_id").alias("id"), "rank"), "id", "left")
    cols = [f.split()[0] for f in _POSTING.split(", ")]
    held = old.select("id", F.coalesce("rank", F.lit(0)).cast("long").alias("rank"), *cols)
    made = mine.where("decision = 'created'").select(c("target").alias("id"), c("rank").cast("long").alias("rank"), *cols)
    merged = polls.fold(mine.select("target", "arrival", c("rank").cast("long").alias("rank"), *cols), held.unionByName(made)).drop("rank", "n_merged")
    stamps = old.select("id", "first_seen_at", "availability_score", "last_apply_check_at", "short_summary").withColumnRenamed("id", "_id")
    rows = merged.join(stamps, c("id") == c("_id"), "left").drop("_id")
    keys = normalize.keys(c("company"), c("title"), c("description"), c("location"), c("apply_url"))
    rows = rows.withColumns(keys).withColumn("duplicate_cluster_id", text.cluster_id(c("company_key"), c("title_core_key"), c("location_key"), c("region")))
    rows = rows.withColumns({"first_seen_at": F.coalesce("first_seen_at", t), "last_seen_at": t, "last_source_seen_at": t, "last_confirmed_alive_at": t, "availability_score": F.coalesce("availability_score", F.lit(100)), "status": F.lit("LIVE")})

    # postings that say that they are over
    dead = decided.where("reject_reason = 'obvious_dead_at_intake' and _had is not null").select(c("id").alias("_dead"), c("previous").alias("_where"))
    over = canonical.join(dead.select(c("_where").alias("id")).distinct(), "id", "left_semi").join(own.select(c("target").alias("id")).distinct(), "id", "left_anti")
    over = over.withColumns({"dead_signal_at": t, "dead_signal_reason": F.lit("Said to be over when it was fetched."), "last_apply_check_at": t})

    # mappings: the poll's own, then what it no longer has
    was = mapping.select(c("id").alias("_m"), c("created_at").alias("_made"))
    mapped = mine.join(was, c("id") == c("_m"), "left").withColumns({
        "canonical_id": c("target"), "source_name": F.lit(source), "source_quality_rank": c("rank"), "is_full_snapshot": F.lit(full), "matched_by": c("how"), "created_at": F.coalesce("_made", t), "last_seen_at": t, "removed_at": F.lit(None).cast("timestamp"), "is_primary": F.lit(False),
    })
    mapped = _shaped(store, "mapping", mapped)
    gone = ingestion.unseen(mapping, p.select("source_id"), source, full and exhausted, "FULL_SNAPSHOT").where("removed_at is null")
    gone = gone.join(mapped.select("id"), "id", "left_anti").withColumn("removed_at", t)
    lost = mapping.join(dead.select(c("_dead").alias("id")), "id", "left_semi").withColumn("removed_at", t)
    n_gone = Observation("gone")
    changed = mapped.unionByName(lost).unionByName(gone.join(lost.select("id"), "id", "left_anti").observe(n_gone, F.count("*").alias("mappings_removed")))
    changed = _kept(store, changed, "mapped")

    # of every row that is touched: its primary mapping, its status
    touched = own.select("target").union(dead.select("_where")).union(decided.where("previous is not null").select("previous")).union(changed.select("canonical_id")).distinct().toDF("id")
    touched = _kept(store, touched, "touched")
    near = mapping.join(changed.select("id"), "id", "left_anti").unionByName(changed).join(touched.select(c("id").alias("canonical_id")), "canonical_id", "left_semi").select(*[f.split()[0] for f in MAPPING.split(", ")])
    first = lifecycle.primary(near).select(c("mapping_id").alias("_first"))
    near = _kept(store, near.join(first, c("id") == c("_first"), "left").withColumn("is_primary", c("_first").isNotNull()).drop("_first"), "mappings")
    rest = canonical.join(touched, "id", "left_semi").join(rows.select("id"), "id", "left_anti").join(over.select("id"), "id", "left_anti")
    every = _kept(store, _shaped(store, "canonical", rows).unionByName(_shaped(store, "canonical", over)).unionByName(_shaped(store, "canonical", rest)), "canonical")
    tally = Observation("tally")
    every = _kept(store, _scored(every, near, now).observe(tally, *[n(c("status").isin(s)).alias(k) for k, s in (("live", ["LIVE", "AGING"]), ("stale", ["STALE"]), ("expired", ["EXPIRED"]), ("removed", ["REMOVED"]))]), "scored")

    fit = normalize.eligibility(mine.withColumn("source_name", F.lit(source))).groupBy(c("target").alias("canonical_id")).agg(F.max_by("eligibility", "arrival").alias("e")).select("canonical_id", "e.category", "e.reason", "e.level")
    counts = {**seen.get, **n_gone.get, **tally.get}
    run = spark.createDataFrame([(f"{source}:{number}", source, now, "SUCCESS", *[int(counts[k] or 0) for k in COUNTS])], RUN)
    return {"raw": _shaped(store, "raw", p.withColumns({"source_name": F.lit(source), "fetched_at": t})), "mapping": near, "canonical": every, "eligibility": fit, "run": run}


def _scored(jobs: DataFrame, mappings: DataFrame, now: datetime) -> DataFrame:
    """Rows with status, score and the time until which they hold."""
    new = lifecycle.rescored(jobs, mappings, F.lit(now).cast("timestamp")).select(F.col("id").alias("_id"), F.col("status").alias("_s"), F.col("availability_score").alias("_a"), F.col("next_change").alias("_n"))
    out = jobs.join(new, F.col("id") == F.col("_id"))
    return out.withColumns({"status": F.col("_s"), "availability_score": F.col("_a"), "next_change": F.col("_n"), "scored_at": F.lit(now).cast("timestamp")}).drop("_id", "_s", "_a", "_n")


def refresh(store: Store, now: datetime, stream: str | None = None, number: int | None = None) -> int | None:
    """Scores again what by age alone no longer has the score that is stored; other rows' mappings aren't read into any shuffle."""

    def change(at: Snapshot) -> dict[str, DataFrame]:
        jobs = store.read("canonical", at)
        old = _kept(store, lifecycle.due(jobs, jobs.select("id").limit(0), F.lit(now).cast("timestamp")), "due")
        return {"canonical": _scored(old, store.read("mapping", at), now)}

    return store.commit(change, stream, number)
