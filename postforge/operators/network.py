"""The network of sources: yields, priorities, fair picks, state changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postforge.functions import rules as R
from postforge.functions.text import js_round



def health_candidate() -> Column:
    """Postings whose links are worth a look: alive ones without a dead signal, and ageing ones with one too."""
    return F.col("status").isin("LIVE", "AGING", "STALE") & (F.col("dead_signal_at").isNull() | F.col("status").isin("AGING", "STALE"))


def named_like(patterns: list[str], column: str = "source_name") -> Column:
    """Names that any of the LIKE patterns fits."""
    return reduce(lambda a, b: a | b, [F.col(column).like(p) for p in patterns], F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b isn't positive."""
    return F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)


def yield_score(quality: Column, attempts: Column, successes: Column, fetched: Column, accepted: Column, created: Column, retained: Column, overlap: Column) -> Column:
    per = lambda a: ratio(a, successes)
    kept = F.when(accepted > 0, ratio(retained, accepted)).otherwise(ratio(retained, created))
    one = F.lit(1.0)
    total = (
        quality * 0.22 + ratio(successes, attempts) * 0.16 + ratio(accepted, fetched) * 0.08 + ratio(created, fetched) * 0.12 + F.least(one, per(accepted) / 175) * 0.08
        + F.least(one, per(created) / 20) * 0.20 + F.least(one, per(retained) / 125) * 0.16 + kept * 0.10 - F.coalesce(overlap, F.lit(0.0)) * 0.08
    )
    return F.least(F.greatest(total, F.lit(0.01)), F.lit(0.99))


def validation_priority(c) -> Column:
    """c names the columns: priority, quality, yield_, confidence, history, state, failures, attempts, successes."""
    state = lambda s, n: F.when(c("state") == s, n).otherwise(0)
    return (
        js_round(c("priority") * 100) / 100 + js_round(c("quality") * 45) + js_round(c("yield_") * 35) + F.least(F.lit(35.0), c("history") * 1.25)
        + state("UNVALIDATED", 40) + state("SUSPECT", 20) + state("NEEDS_REDISCOVERY", 10) + js_round(ratio(c("successes"), c("attempts")) * 20)
        - F.greatest(F.lit(0), c("failures") * 5) + js_round(c("confidence") * 10)
    )


def poll_priority(c) -> Column:
    """c names the columns: priority, quality, yield_, confidence, history, status, failures, attempts, successes, accepted, created, last_accepted, last_created, retained."""
    most = lambda n, x: F.least(F.lit(float(n)), x)
    per = lambda a: ratio(c(a), c("successes"))
    return (
        js_round(c("priority") * 100) / 100 + js_round(c("quality") * 28) + js_round(c("yield_") * 72) + js_round(ratio(c("successes"), c("attempts")) * 18)
        + most(36, c("history") * 1.2) + most(44, per("accepted") * 0.3) + most(120, per("created") * 4) + most(42, c("retained") * 0.25)
        + most(40, c("last_accepted") * 0.25) + most(90, c("last_created") * 8.0) + F.when(c("attempts") == 0, 42).when(c("successes") == 0, 18).otherwise(0)
        + F.when(c("status") == "DEGRADED", 10).otherwise(0) + F.greatest(F.lit(0), 15 - c("failures") * 3) + js_round(c("confidence") * 10)
        - F.when((c("successes") >= 3) & (c("created") == 0), 35).otherwise(0) - F.when((c("successes") >= 2) & (c("accepted") == 0), 20).otherwise(0)
    )


def balanced(df: DataFrame, bucket: str, priority: str, tie: str, limit: int) -> DataFrame:
    """The first `limit` rows when buckets take turns: each turn gives every bucket's best row left, the better first. Adds turn.

    Within a bucket no more than `limit` rows can count, so Spark keeps that many a task before the shuffle.
    """
    w = Window.partitionBy(bucket).orderBy(F.desc(priority), F.asc(tie))
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit).orderBy("turn", F.desc(priority), tie).limit(limit)


def prune(df: DataFrame) -> DataFrame:
    """Adds action and reason: sources to switch off, to slow down, or (null) to leave.

    df: http_status, attempts, successes, accepted, deduped, created, retained, failure_streak, failures.
    """
    none, hard = F.col("retained") == 0, F.coalesce(F.col("http_status").isin(R.GONE_STATUSES), F.lit(False))
    c = F.col
    rules = [
        (none & (c("successes") == 0) & (hard | (c("failure_streak") >= 2) | (c("failures") >= 2)), "hard_disable", "failing_without_value"),
        ((c("successes") >= 2) & (c("accepted") == 0), "soft_backoff", "nothing_accepted"),
        ((c("successes") >= 3) & none & (c("created") == 0) & (c("accepted") <= 5), "soft_backoff", "nothing_durable"),
        ((c("successes") >= 3) & (c("accepted") > 0) & (c("deduped") >= c("accepted")) & none & (c("created") == 0), "soft_backoff", "only_duplicates"),
    ]
    pick = lambda i: F.coalesce(*[F.when(r[0], r[i]) for r in rules])
    return df.withColumns({"action": pick(1), "reason": pick(2)})


def merge_tasks(tasks: DataFrame) -> DataFrame:
    """One pending task per kind and target: the highest priority, the earliest start, the oldest id."""
    return tasks.where("status = 'PENDING'").groupBy("kind", "target").agg(F.max("priority").alias("priority"), F.min("not_before").alias("not_before"), F.min("id").alias("id"), F.count("*").alias("merged"))


def claim(tasks: DataFrame, kind: str, as_of: Column, limit: int) -> DataFrame:
    """The pending tasks of a kind that are due, by priority, then age."""
    due = tasks.where((F.col("kind") == kind) & (F.col("status") == "PENDING") & (F.col("not_before") <= as_of))
    return due.orderBy(F.desc("priority"), F.asc("created_at"), F.asc("id")).limit(limit)


def _status(df: DataFrame) -> Column:
    """The HTTP status that an error message names."""
    return F.regexp_extract(F.coalesce("error", F.lit("")), r"(?<![0-9])(4[0-9]{2}|5[0-9]{2})(?![0-9])", 1).try_cast("int")


def validation_outcome(df: DataFrame) -> DataFrame:
    """Adds kind, poll_state, quality, cooldown_minutes and next_status to recorded validations.

    df: connector, error (null if the answer was fine), jobs_found, state (before), failures (in a row, before), polled (ever with success).
    """
    c, code = F.col, _status(df)
    gone, blocked = F.coalesce(code.isin(R.GONE_STATUSES), F.lit(False)), F.coalesce(code.isin(R.BLOCKING_STATUSES), F.lit(False))
    final = c("connector").isin(R.EXACT_BOARDS) | (c("state") == "SUSPECT") | (c("failures") >= 1)
    fine = c("error").isNull() | ((c("jobs_found") > 0) & ~gone & ~blocked)
    kind = F.when(gone, F.when(final, "INVALID").otherwise("SUSPECT")).when(blocked, "BLOCKED").when(fine, "VALIDATED").otherwise("SUSPECT")
    passing = F.coalesce(code.isin(R.PASSING_STATUSES), F.lit(False))
    fails = F.when(kind == "VALIDATED", 0).otherwise(c("failures") + 1)
    lost = (kind == "INVALID") | ((kind == "SUSPECT") & (fails >= 2))
    return df.withColumns({
        "kind": kind, "poll_state": F.when(lost, "QUARANTINED").when(kind == "VALIDATED", "READY").otherwise("BACKOFF"),
        "cooldown_minutes": F.when(kind == "INVALID", 720).when(kind == "BLOCKED", 360).when(kind == "VALIDATED", 0).when(gone, 240).when(passing, 180).otherwise(240),
        "quality": F.when(kind == "INVALID", 0.05).when(kind == "BLOCKED", 0.2).when(kind == "VALIDATED", None).when(gone, 0.15).when(passing, 0.28).otherwise(0.3),
        "next_status": F.when(lost, "REDISCOVER_REQUIRED").when(kind == "VALIDATED", F.when(c("polled"), "ACTIVE").otherwise("PROVISIONED")).otherwise("DEGRADED"), "next_failures": fails,
    })


def poll_failure(df: DataFrame) -> DataFrame:
    """Adds what a failed poll makes of a source. df: connector, error, failures and failure_streak (before)."""
    c, code = F.col, _status(df)
    gone, blocked = F.coalesce(code.isin(R.GONE_STATUSES), F.lit(False)), F.coalesce(code.isin(R.BLOCKING_STATUSES), F.lit(False))
    final, fails, streak = gone & c("connector").isin(R.EXACT_BOARDS), c("failures") + 1, c("failure_streak") + 1
    lost = final | F.when(gone, fails >= 2).otherwise(streak >= 3)
    return df.withColumns({
        "next_status": F.when(lost, "REDISCOVER_REQUIRED").otherwise("DEGRADED"), "next_state": F.when(final | (gone & lost), "INVALID").when(gone, "SUSPECT").when(blocked, "BLOCKED").otherwise("SUSPECT"),
        "next_poll": F.when(lost, "QUARANTINED").otherwise("BACKOFF"), "cooldown_hours": F.when(final, 12).when(gone, fails * 4).otherwise(streak).cast("int"), "quality": F.when(c("failure_streak") > 0, 0.12).otherwise(0.2), "status_code": code,
    })


def poll_success(df: DataFrame) -> DataFrame:
    """Adds a source's counters, priority and overlap after a poll. df: the counters so far, and n_fetched, n_accepted, n_deduped, n_created of the poll, fallback (read as plain HTML)."""
    c = F.col
    prio = F.greatest(F.lit(0.1), F.least(F.lit(1.5), (c("n_created") + 1) / F.greatest(F.lit(1), c("n_fetched")) + F.when(c("fallback"), 0.15).otherwise(0.3)))
    sums = {k: c(k) + c(f"n_{k}") for k in ("fetched", "accepted", "deduped", "created")}
    return df.withColumns({"overlap": F.when(c("n_fetched") > 0, ratio(c("n_deduped"), c("n_fetched"))).otherwise(c("overlap")), **sums, "attempts": c("attempts") + 1, "successes": c("successes") + 1, "priority": prio, "quality": F.greatest("quality", F.least(F.lit(0.99), prio / 1.5)), "failures": F.lit(0), "status": F.lit("ACTIVE")})


def discovery_order(c) -> Column:
    """Which companies to search for sources first. c names: n_sources, detected, confidence, n_jobs, failed, searched."""
    return F.when(c("n_sources") == 0, 50).otherwise(0) + F.when(c("detected"), 40).otherwise(0) + js_round(c("confidence") * 20) + F.least(F.lit(30), F.least(c("n_jobs"), F.lit(25)) * 3) - F.when(c("failed"), 20).otherwise(0) + F.when(c("searched"), 0).otherwise(15)


def discovery_priority(c) -> Column:
    """The priority of such a search's task; not the order above."""
    return F.least(F.lit(40), F.least(c("n_jobs"), F.lit(25)) * 3) + F.when(c("n_sources") == 0, 30).otherwise(0) + F.when(c("failed"), -10).otherwise(15) + F.greatest(F.lit(0), 20 - js_round(c("confidence") * 20))


def health_priority(c, as_of: Column) -> Column:
    """Which postings to look at next. c names: status, availability, checked_at, alive_at, deadline, saved, applied, apply_url, dead_at."""
    from postforge.functions.text import days_between, hours_between

    hours = F.coalesce(hours_between(as_of, c("checked_at")), F.lit(999.0))
    days = F.coalesce(days_between(as_of, c("alive_at")), F.lit(999.0))
    soon = F.coalesce(days_between(c("deadline"), as_of) <= 7, F.lit(False))
    return (
        F.when(c("status") == "AGING", 45).when(c("status") == "STALE", 35).when(c("status") == "LIVE", 8).otherwise(0) + F.greatest(F.lit(0.0), 70 - c("availability"))
        + F.least(F.lit(24), F.floor(hours / 8)) + F.least(F.lit(18), F.floor(days * 3)) + c("saved") * 6 + c("applied") * 8 + F.when(soon, 20).otherwise(0)
        - F.when(c("apply_url").rlike("(?i)^https?://"), 0).otherwise(25) - F.when(c("dead_at").isNotNull(), 40).otherwise(0)
    )
