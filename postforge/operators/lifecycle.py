"""Which postings are alive: evidence of their sources, weighed by age and trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postforge.functions.text import days_between, hours_between, js_round


#: Limits of the steps below: hours since a sight, days since a removal, a confirmation and the first sight.
SEEN_HOURS, GONE_DAYS, ALIVE_DAYS, AGE_DAYS = (12, 48, 168, 336, 720, 1440), (2, 7, 21, 45), (1, 3, 7, 14, 30), (120, 240, 365)


def steps(x: Column, limits: list[tuple[float, float]], beyond: float) -> Column:
    """The value of the first limit that x doesn't pass."""
    out = F.lit(float(beyond))
    for limit, value in reversed(limits):
        out = F.when(x <= limit, float(value)).otherwise(out)
    return out


def primary(mappings: DataFrame) -> DataFrame:
    """canonical_id, mapping_id of each posting's primary mapping: active, of the highest rank, seen last, made first."""
    w = Window.partitionBy("canonical_id").orderBy(F.desc("source_quality_rank"), F.desc("last_seen_at"), F.asc("created_at"), F.asc("id"))
    return mappings.where("removed_at is null").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("canonical_id", F.col("id").alias("mapping_id"))


def tombstones(mappings: DataFrame, seen: DataFrame, source: str, as_of: Column) -> DataFrame:
    """mappings with removed_at set where a full snapshot of the source no longer has them; an empty snapshot removes all. Other sources' rows aren't shuffled."""
    own, rest = mappings.where(F.col("source_name") == source), mappings.where(~F.col("source_name").eqNullSafe(source))
    known = seen.select(F.col("source_id").alias("_seen")).distinct()
    own = own.join(known, F.col("source_id") == F.col("_seen"), "left").withColumn("removed_at", F.coalesce("removed_at", F.when(F.col("_seen").isNull(), as_of)))
    return own.select(*mappings.columns).union(rest)


def active_evidence(m: DataFrame, as_of: Column) -> Column:
    r = steps(hours_between(as_of, m["last_seen_at"]), [(12, 1), (48, 0.92), (168, 0.78), (336, 0.6), (720, 0.42), (1440, 0.24)], 0.12)
    kind = m["source_type"]
    full = m["source_reliability"].cast("double") * 55 * r + F.when(m["is_full_snapshot"], r * 6).otherwise(0.0)
    return F.greatest(F.lit(0.0), full + F.when(kind == "ATS", r * 8).when(kind == "BOARD", r * 4).when(kind == "AGGREGATOR", (r - 1) * 3).otherwise(0.0))


def removal_evidence(m: DataFrame, as_of: Column) -> Column:
    f = steps(days_between(as_of, m["removed_at"]), [(2, 1), (7, 0.85), (21, 0.65), (45, 0.35)], 0.15)
    kind = m["source_type"]
    score = m["source_reliability"].cast("double") * 22 + F.when(m["is_full_snapshot"], 12).otherwise(0) + F.when(kind == "ATS", 8).when(kind == "BOARD", 4).when(kind == "AGGREGATOR", -10).otherwise(0)
    return F.greatest(F.lit(0.0), score * f)


def evidence(mappings: DataFrame, as_of: Column) -> DataFrame:
    """One row per posting: n_active, the two best active scores' sum, the removals' sum (the last of each source), the last sight, and whether a removal is strong.

    The removals are first reduced to one per posting and source; sums and counts are partial aggregation, and of the
    active scores each task passes on a posting's two best (Spark limits the groups of a ranking before the shuffle).
    """
    m = mappings
    gone = m["removed_at"].isNotNull()
    strong = gone & (days_between(as_of, m["removed_at"]) <= 21) & m["is_full_snapshot"] & (m["source_reliability"] >= 0.8) & (m["source_type"] != "AGGREGATOR")
    scored = m.select("canonical_id", "source_name", "last_seen_at", "removed_at", "id", F.when(~gone, active_evidence(m, as_of)).alias("active"), F.when(gone, removal_evidence(m, as_of)).alias("removal"), strong.alias("strong"))
    last = F.struct("removed_at", (-F.col("id")).alias("first"), "removal")  # of removals at one time the first counts
    by_source = scored.groupBy("canonical_id", "source_name").agg(
        F.count("active").alias("n"), F.max(F.when(F.col("removal").isNotNull(), last)).alias("last"), F.max(F.when(F.col("active").isNotNull(), F.col("last_seen_at"))).alias("seen"), F.max("strong").alias("strong"),
    )
    out = by_source.groupBy("canonical_id").agg(F.sum("n").alias("n_active"), F.sum("last.removal").alias("removal"), F.max("seen").alias("seen"), F.max("strong").alias("strong"))
    top = Window.partitionBy("canonical_id").orderBy(F.desc("active"))
    two = scored.where("active is not null").select("canonical_id", "active").withColumn("rn", F.row_number().over(top)).where("rn <= 2").groupBy("canonical_id").agg(F.sum("active").alias("best_two"))
    return out.join(two, "canonical_id", "left")


def score(jobs: DataFrame, mappings: DataFrame, as_of: Column) -> DataFrame:
    """id, status and availability_score of every posting, by its mappings' evidence at as_of.

    jobs: id, first_seen_at, last_seen_at, last_source_seen_at, last_confirmed_alive_at, deadline, dead_signal_at. Postings without mappings have no active evidence.
    """
    e = jobs.join(evidence(mappings, as_of), jobs["id"] == F.col("canonical_id"), "left")
    n, alive = F.coalesce("n_active", F.lit(0)), F.col("last_confirmed_alive_at")
    seen = F.greatest("seen", "last_source_seen_at")
    late = F.greatest(seen, alive)
    since, age = days_between(as_of, alive), days_between(as_of, F.col("first_seen_at"))
    confirm = F.when(alive.isNull(), 0.0).otherwise(steps(since, [(1, 15), (3, 12), (7, 8), (14, 4), (30, 1)], 0))
    floor = F.when(alive.isNull(), 0).when(since <= 1, F.when(n > 0, 72).otherwise(56)).when(since <= 3, F.when(n > 0, 60).otherwise(48)).when(since <= 7, F.when(n > 0, 48).otherwise(30)).otherwise(0)
    old = F.when(age <= 120, 0).when(age <= 240, F.when(n <= 1, 4).otherwise(2)).when(age <= 365, F.when(n == 0, 10).otherwise(6)).otherwise(F.when(n == 0, 16).otherwise(10))
    gone = F.least(F.when(n > 0, 28.0).otherwise(70.0), F.coalesce("removal", F.lit(0.0)))
    total = F.least(F.lit(78.0), F.coalesce("best_two", F.lit(0.0))) + F.least(F.lit(12), F.greatest(F.lit(0), (n - 1) * 4)) + confirm - old - gone
    points = F.greatest(floor, F.least(F.lit(100), F.greatest(F.lit(0), js_round(total))))
    over = (F.col("deadline") <= as_of) & F.coalesce(F.coalesce(late, F.lit(None)) <= F.col("deadline"), F.lit(True))
    dead = F.col("dead_signal_at").isNotNull() & F.coalesce(F.col("dead_signal_at") >= alive, F.lit(True))
    ended = F.coalesce(over, F.lit(False)) | dead
    status = F.when(ended, "EXPIRED").when(points >= 72, "LIVE").when(points >= 48, "AGING").when(points >= 22, "STALE").when((n == 0) & F.coalesce("strong", F.lit(False)), "REMOVED").otherwise("EXPIRED")
    return e.select("id", status.alias("status"), F.when(ended, 0).otherwise(points).cast("int").alias("availability_score"), n.cast("long").alias("n_active"))


def _next(since: Column, hours: list[float], as_of: Column) -> Column:
    """Microseconds of the first instant, not before as_of, after which `since` is longer ago than one of the limits; null if there is none."""
    at = F.unix_micros(since.cast("timestamp"))
    return F.array_min(F.filter(F.transform(F.array(*[F.lit(int(h * 3_600_000_000)) for h in hours]), lambda h: at + h), lambda x: x >= F.unix_micros(as_of.cast("timestamp"))))


def next_change(jobs: DataFrame, mappings: DataFrame, as_of: Column) -> DataFrame:
    """id, next_change: microseconds of the last instant at which the score of as_of still holds if nothing new comes; null if it holds for good."""
    days = lambda d: [24.0 * x for x in d]
    own = F.when(F.col("removed_at").isNull(), _next(F.col("last_seen_at"), list(SEEN_HOURS), as_of)).otherwise(_next(F.col("removed_at"), days(GONE_DAYS), as_of))
    m = mappings.groupBy("canonical_id").agg(F.min(own).alias("_m"))
    ends = F.unix_micros(F.col("deadline").cast("timestamp")) - 1
    ends = F.when(ends >= F.unix_micros(as_of.cast("timestamp")), ends)
    at = F.least("_m", _next(F.col("last_confirmed_alive_at"), days(ALIVE_DAYS), as_of), _next(F.col("first_seen_at"), days(AGE_DAYS), as_of), ends)
    return jobs.join(m, F.col("id") == F.col("canonical_id"), "left").select("id", at.alias("next_change"))


def rescored(jobs: DataFrame, mappings: DataFrame, as_of: Column) -> DataFrame:
    """score() with next_change, for the given postings only: mappings of others are left out before anything is shuffled for them."""
    own = mappings.join(jobs.select(F.col("id").alias("_id")), F.col("canonical_id") == F.col("_id"), "left_semi")
    return score(jobs, own, as_of).join(next_change(jobs, own, as_of), "id")


def due(jobs: DataFrame, touched: DataFrame, as_of: Column) -> DataFrame:
    """Postings that have to be scored again: those that news came for (touched: id), and those whose score no longer holds by age alone. jobs: with the next_change of their last score; never scored is due."""
    news = jobs.join(touched.select(F.col("id").alias("_t")).distinct(), F.col("id") == F.col("_t"), "left")
    return news.where(F.col("_t").isNotNull() | (F.col("next_change") < F.unix_micros(as_of.cast("timestamp"))) | F.col("scored_at").isNull()).drop("_t")


def tally(scored: DataFrame) -> DataFrame:
    """Counters of a status pass; AGING counts as live and as aging."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return scored.agg(F.count("*").alias("updated"), n("LIVE", "AGING").alias("live"), n("AGING").alias("aging"), n("STALE").alias("stale"), n("EXPIRED").alias("expired"), n("REMOVED").alias("removed"))
