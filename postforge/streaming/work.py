"""The queue of tasks as a stored table: claimed by one worker at a time, given back when a lease ends, and worked through in cycles that may be broken off anywhere."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postforge.functions import rules as R
from postforge.sources.store import Snapshot, Store, Table

TASKS = "task"
TASK = "id string, kind string, target long, status string, priority double, not_before timestamp, created_at timestamp, started_at timestamp, finished_at timestamp, attempts int, claimed_by string, last_error string, payload string"


def task_table(buckets: int = 16) -> dict[str, Table]:
    return {TASKS: Table(TASK, ["id"], buckets)}


def _at(t: datetime) -> Column:
    return F.lit(t).cast("timestamp")


def expired(tasks: DataFrame, now: Column) -> DataFrame:
    """Running tasks whose lease is over, as they go back to the queue: the lease is that of the kind."""
    lease = F.coalesce(*[F.when(F.col("kind") == k, F.lit(m)) for k, m in R.LEASE_MINUTES.items()], F.lit(R.LEASE_OTHERS))
    over = tasks.where((F.col("status") == "RUNNING") & (F.unix_micros("started_at") < F.unix_micros(now) - lease.cast("long") * 60_000_000))
    nothing = F.lit(None)
    return over.withColumns({
        "status": F.lit("PENDING"), "started_at": nothing.cast("timestamp"), "finished_at": nothing.cast("timestamp"), "claimed_by": nothing.cast("string"), "not_before": now,
        "last_error": F.concat(F.lit("Lease of "), lease.cast("string"), F.lit(" minutes ended.")),
    })


def merged(tasks: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """What asking for tasks (kind, target, priority, not_before, payload) makes of the queue: a pending task of the kind and target gets the higher priority, the earlier start and the newer payload; else there is a new one.

    Several askings for one target are one. A new task's id is its kind, target and time, so that asking again at that time is the same task.
    """
    one = asked.groupBy("kind", "target").agg(F.max("priority").alias("p"), F.min("not_before").alias("n"), F.max("payload").alias("l"))
    best = tasks.where("status = 'PENDING'").groupBy("kind", "target").agg(F.min_by(F.struct(*tasks.columns), F.struct(-F.col("priority"), "created_at", "id")).alias("t"))
    both = one.join(best, (one["kind"] == best["kind"]) & one["target"].eqNullSafe(best["target"]), "left").select(one["kind"], one["target"], "p", "n", "l", "t")
    new = F.col("t").isNull()
    made = {
        "id": F.concat_ws(":", "kind", F.col("target").cast("string"), F.unix_micros(now).cast("string")), "kind": F.col("kind"), "target": F.col("target"), "status": F.lit("PENDING"), "priority": F.coalesce("p", F.lit(0.0)), "not_before": F.coalesce("n", now), "created_at": now,
        "started_at": F.lit(None), "finished_at": F.lit(None), "attempts": F.lit(0), "claimed_by": F.lit(None), "last_error": F.lit(None), "payload": F.col("l"),
    }
    old = {"priority": F.greatest("t.priority", "p"), "not_before": F.least("t.not_before", "n"), "payload": F.coalesce("l", "t.payload")}
    return both.select(*[F.when(new, made[f.name]).otherwise(old.get(f.name, F.col(f"t.{f.name}"))).cast(f.dataType).alias(f.name) for f in tasks.schema])


def enqueue(store: Store, asked: DataFrame, now: datetime, stream: str | None = None, number: int | None = None) -> int | None:
    return store.commit(lambda at: {TASKS: merged(store.read(TASKS, at), asked, _at(now))}, stream, number)


def claim(store: Store, kind: str, limit: int, now: datetime, worker: str | None = None, stream: str | None = None, number: int | None = None) -> DataFrame:
    """The tasks of a kind that the worker holds now: those that are due, by priority, then age, `limit` at most; expired ones are due again.

    What two workers claim at once doesn't overlap: the second chooses among what the first has left.
    """
    worker = worker or uuid.uuid4().hex

    def change(at: Snapshot) -> dict[str, DataFrame]:
        tasks = store.read(TASKS, at).where(F.col("kind") == kind)
        back = expired(tasks, _at(now))
        open_ = tasks.where("status = 'PENDING'").union(back).where(F.col("not_before") <= _at(now))
        own = open_.orderBy(F.desc("priority"), F.asc("created_at"), F.asc("id")).limit(limit)
        own = own.withColumns({"status": F.lit("RUNNING"), "started_at": _at(now), "attempts": F.col("attempts") + 1, "claimed_by": F.lit(worker)})
        rest = back.join(own.select("id"), "id", "left_anti").select(*own.columns)
        return {TASKS: own.union(rest)}

    store.commit(change, stream, number)
    return store.read(TASKS).where((F.col("claimed_by") == worker) & (F.col("kind") == kind) & (F.col("status") == "RUNNING"))


def finish(store: Store, outcomes: DataFrame, now: datetime, worker: str, stream: str | None = None, number: int | None = None) -> int | None:
    """Ends tasks that the worker holds. outcomes: id, status (SUCCESS, FAILED or SKIPPED), error, retry_at; a failed one with a time to retry goes back to the queue. Those that it no longer holds are passed over."""
    said = outcomes.select(F.col("id").alias("_id"), F.col("status").alias("_s"), F.col("error").alias("_e"), F.col("retry_at").alias("_r"))

    def change(at: Snapshot) -> dict[str, DataFrame]:
        held = store.read(TASKS, at).where((F.col("claimed_by") == worker) & (F.col("status") == "RUNNING"))
        again, none = (F.col("_s") == "FAILED") & F.col("_r").isNotNull(), F.lit(None)
        rows = held.join(said, F.col("id") == F.col("_id")).withColumns({
            "status": F.when(again, "PENDING").otherwise(F.col("_s")), "not_before": F.when(again, F.col("_r")).otherwise(F.col("not_before")), "started_at": F.when(~again, F.col("started_at")), "finished_at": F.when(~again, _at(now)),
            "claimed_by": none.cast("string"), "last_error": F.col("_e"),
        })
        return {TASKS: rows.select(*held.columns)}

    return store.commit(change, stream, number)


# --- cycles ----------------------------------------------------------------------------------------------------------


def interval(minutes: float | None) -> int:
    """Minutes between two cycles: within limits, a default if nothing is said."""
    return int(min(max(minutes or R.CYCLE_MINUTES[1], R.CYCLE_MINUTES[0]), R.CYCLE_MINUTES[2]))


Handler = Callable[[DataFrame, datetime], DataFrame]


def cycle(store: Store, number: int, now: datetime, scheduled: Callable[[int, datetime], None], asked: Callable[[Store, datetime], DataFrame], queues: list[tuple[str, int, Handler]], name: str = "cycle") -> None:
    """One cycle: what is scheduled, then what is asked for goes into the queue, then each queue (kind, limit, handler) is claimed, handled and ended, in this order.

    scheduled(number, now) commits under its own stream and number. A cycle that broke off is run again under its number and time: what it had done is passed over, tasks that it had claimed
    are handled anew, so a handler's effects have to be stored under the number as well.
    """
    scheduled(number, now)
    enqueue(store, asked(store, now), now, f"{name}:enqueue", number)
    for kind, limit, handle in queues:
        worker = f"{name}:{kind}:{number}"
        held = claim(store, kind, limit, now, worker, f"{name}:claim:{kind}", number)
        finish(store, handle(held, now), now, worker, f"{name}:finish:{kind}", number)
    store.commit(lambda at: {}, f"{name}:done", number)


def daemon(store: Store, run: Callable[[int, datetime], None], minutes: float | None, cycles: int, clock: Callable[[], datetime] = datetime.now, sleep: Callable[[float], None] = time.sleep, name: str = "cycle") -> None:
    """Runs cycles one after the other until `cycles` are done in all, each at its time or at once if that has passed; goes on with the first that isn't done."""
    gap = timedelta(minutes=interval(minutes))
    while (number := store.snapshot().streams.get(f"{name}:done", -1) + 1) < cycles:
        began = clock()
        run(number, began)
        rest = (began + gap - clock()).total_seconds()
        if rest > 0 and number + 1 < cycles:
            sleep(rest)
