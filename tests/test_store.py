"""Tables that change together: crashes between any two writes, writers that meet, streams, leases and cycles."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from postforge.sources.store import Store, Table
from postforge.streaming import ingest, work

KIND = "id long, v string"
NOW = dt.datetime(2024, 5, 1)


def rows(df):
    return {tuple(r) for r in df.collect()}


def pair(spark, root):
    return Store(spark, str(root), {"a": Table(KIND, ["id"], 4), "b": Table("k string, n long", ["k"], 2)})


class Lost(Exception):
    pass


def breaking(store, monkeypatch, at):
    """Makes the store fail at its at-th write (a table's files, or the list)."""
    calls = []

    def wrap(f):
        def g(*args):
            calls.append(f)
            if len(calls) == at:
                raise Lost
            return f(*args)

        return g

    monkeypatch.setattr(store, "_write", wrap(store._write))
    monkeypatch.setattr(store, "_publish", wrap(store._publish))


def test_a_change_of_two_tables_is_whole_or_nothing(spark, tmp_path, monkeypatch):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], KIND), spark.createDataFrame([("p", 1)], "k string, n long")
    for at in (1, 2, 3):
        store = pair(spark, tmp_path / str(at))
        store.commit(lambda s: {"a": a, "b": b}, "polls", 0)
        with monkeypatch.context() as m:
            breaking(store, m, at)
            with pytest.raises(Lost):
                store.commit(lambda s: {"a": a.where("id = 2").withColumn("v", F.lit("z")), "b": b.withColumn("n", F.lit(2).cast("long"))}, "polls", 1)
        fresh = pair(spark, tmp_path / str(at))
        assert rows(fresh.read("a")) == {(1, "x"), (2, "y")} and rows(fresh.read("b")) == {("p", 1)}
        for _ in range(2):  # repeated, and repeated once more
            fresh.commit(lambda s: {"a": a.where("id = 2").withColumn("v", F.lit("z")), "b": fresh.read("b", s).withColumn("n", F.col("n") + 1)}, "polls", 1)
        assert rows(fresh.read("a")) == {(1, "x"), (2, "z")} and rows(fresh.read("b")) == {("p", 2)}
        assert fresh.sweep(-1) == (at > 1) + (at > 2) and rows(fresh.read("a")) == {(1, "x"), (2, "z")}


def test_streams_into_one_table_lose_nothing(spark, tmp_path):
    def run(source, ck, data):
        data.write.parquet(f"{tmp_path}/{source}/{ck}")
        s = spark.readStream.schema(KIND).parquet(f"{tmp_path}/{source}/*")
        ingest.ingest(s, f"{tmp_path}/out", f"{tmp_path}/ck-{source}", ["id"], 4).awaitTermination()

    for source, i in (("s", 1), ("t", 2), ("s", 3), ("t", 4)):
        run(source, f"n{i}", spark.createDataFrame([(i, source)], KIND))
    ingest.ingest(spark.readStream.schema(KIND).parquet(f"{tmp_path}/s/*"), f"{tmp_path}/out", f"{tmp_path}/ck-s", ["id"], 4).awaitTermination()
    assert rows(ingest.read(spark, f"{tmp_path}/out", KIND)) == {(1, "s"), (2, "t"), (3, "s"), (4, "t")}
    # the same source again from the start: a stream of its own
    spark.createDataFrame([(3, "again")], KIND).write.parquet(f"{tmp_path}/s/n9")
    ingest.ingest(spark.readStream.schema(KIND).parquet(f"{tmp_path}/s/n9"), f"{tmp_path}/out", f"{tmp_path}/ck-new", ["id"], 4).awaitTermination()
    assert (3, "again") in rows(ingest.read(spark, f"{tmp_path}/out", KIND))


def test_a_stream_goes_on_after_a_failure_between_the_writes(spark, tmp_path, monkeypatch):
    run = lambda: ingest.ingest(spark.readStream.schema(KIND).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/ck", ["id"], 4).awaitTermination()
    assert ingest.read(spark, f"{tmp_path}/out", KIND).count() == 0
    spark.createDataFrame([(1, "a"), (2, "b")], KIND).write.parquet(f"{tmp_path}/in/1")
    run()
    spark.createDataFrame([(2, "c"), (3, "d")], KIND).write.parquet(f"{tmp_path}/in/2")

    def broken(*args):
        raise OSError("lost between the files and their list")

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", broken)
        with pytest.raises(Exception, match="lost between"):
            run()
    assert rows(ingest.read(spark, f"{tmp_path}/out", KIND)) == {(1, "a"), (2, "b")}
    run()
    run()
    assert rows(ingest.read(spark, f"{tmp_path}/out", KIND)) == {(1, "a"), (2, "c"), (3, "d")}


def test_untouched_buckets_and_old_lists(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"a": Table(KIND, ["id"], 16)}, keep=2)
    store.upsert("a", spark.createDataFrame([(i, "a") for i in range(200)], KIND))
    before = store.snapshot()
    store.upsert("a", spark.createDataFrame([(7, "b")], KIND))
    after = store.snapshot()
    assert sum(before.places["a"][b] != after.places["a"][b] for b in range(16)) == 1
    assert store.read("a").count() == 200 and store.read("a", before).where("v = 'b'").count() == 0
    assert store.upsert("a", spark.createDataFrame([], KIND)) is None
    for v in "cde":
        store.upsert("a", spark.createDataFrame([(7, v)], KIND))
    assert store._versions() == [4, 5] and store.read("a").where("v = 'e'").count() == 1
    assert len([p for p in tmp_path.rglob("bucket=*") if any(p.glob("*.parquet"))]) <= 17


def test_writers_that_meet(spark, tmp_path):
    """Each of six adds one to a counter; what one works out on an old list it works out again."""
    Store(spark, str(tmp_path), {"a": Table("id long, n long", ["id"], 2)}).upsert("a", spark.createDataFrame([(1, 0)], "id long, n long"))
    tried = []

    def add(k):
        store = Store(spark, str(tmp_path), {"a": Table("id long, n long", ["id"], 2)}, keep=20)
        store.commit(lambda s: tried.append(k) or {"a": store.read("a", s).withColumn("n", F.col("n") + 1)})

    ts = [threading.Thread(target=add, args=(k,)) for k in range(6)]
    [t.start() for t in ts]
    [t.join() for t in ts]
    got = Store(spark, str(tmp_path), {"a": Table("id long, n long", ["id"], 2)}).read("a")
    assert rows(got) == {(1, 6)} and len(tried) >= 6


# --- tasks -----------------------------------------------------------------------------------------------------------


def queue(spark, root, n=8):
    store = Store(spark, str(root), work.task_table(4), keep=20)
    asked = spark.createDataFrame([("CONNECTOR_POLL", i, float(i % 5), NOW, None) for i in range(n)] + [("CONNECTOR_POLL", 0, 9.0, NOW - dt.timedelta(hours=1), "p")], "kind string, target long, priority double, not_before timestamp, payload string")
    work.enqueue(store, asked, NOW - dt.timedelta(hours=2))
    return store, asked


def test_asking_twice_is_one_task(spark, tmp_path):
    store, asked = queue(spark, tmp_path)
    t = {r["target"]: r for r in store.read("task").collect()}
    assert len(t) == 8 and t[0]["priority"] == 9.0 and t[0]["not_before"] == NOW - dt.timedelta(hours=1) and t[0]["payload"] == "p"
    later = asked.where("target < 2 and priority < 9").withColumns({"priority": F.lit(5.0), "payload": F.lit("q"), "not_before": F.lit(NOW + dt.timedelta(days=1))})
    work.enqueue(store, later, NOW)
    t = {r["target"]: r for r in store.read("task").collect()}
    assert len(t) == 8 and (t[0]["priority"], t[1]["priority"]) == (9.0, 5.0) and t[1]["not_before"] == NOW and t[1]["payload"] == "q"


def test_two_workers_never_hold_one_task(spark, tmp_path):
    store, _ = queue(spark, tmp_path)
    held = {}

    def take(k):
        held[k] = {r["target"] for r in work.claim(Store(spark, str(tmp_path), work.task_table(4), keep=20), "CONNECTOR_POLL", 3, NOW, f"w{k}").collect()}

    ts = [threading.Thread(target=take, args=(k,)) for k in range(3)]
    [t.start() for t in ts]
    [t.join() for t in ts]
    assert sorted(len(h) for h in held.values()) == [2, 3, 3] and len(set().union(*held.values())) == 8
    assert work.claim(store, "CONNECTOR_POLL", 3, NOW + dt.timedelta(minutes=120), "late").count() == 0
    again = work.claim(store, "CONNECTOR_POLL", 99, NOW + dt.timedelta(minutes=121), "late")
    assert again.count() == 8 and {r["attempts"] for r in again.collect()} == {2}
    first = min(held[0])
    work.finish(store, spark.createDataFrame([(r["id"], "SUCCESS", None, None) for r in again.collect() if r["target"] == first], "id string, status string, error string, retry_at timestamp"), NOW, "w0")
    assert store.read("task").where("status = 'SUCCESS'").count() == 0  # it isn't that worker's any more


def test_failed_tasks_wait_until_they_are_tried_again(spark, tmp_path):
    store, _ = queue(spark, tmp_path, 3)
    held = work.claim(store, "CONNECTOR_POLL", 9, NOW, "w").orderBy("target").collect()
    said = [(held[0]["id"], "FAILED", "503", NOW + dt.timedelta(hours=1)), (held[1]["id"], "FAILED", "404", None), (held[2]["id"], "SUCCESS", None, None)]
    work.finish(store, spark.createDataFrame(said, "id string, status string, error string, retry_at timestamp"), NOW, "w")
    t = {r["target"]: r for r in store.read("task").collect()}
    assert [t[i]["status"] for i in range(3)] == ["PENDING", "FAILED", "SUCCESS"] and t[0]["last_error"] == "503" and t[0]["claimed_by"] is None
    assert work.claim(store, "CONNECTOR_POLL", 9, NOW, "x").count() == 0
    assert [r["target"] for r in work.claim(store, "CONNECTOR_POLL", 9, NOW + dt.timedelta(hours=1), "x").collect()] == [0]


@pytest.mark.parametrize(("said", "minutes"), [(None, 10), (1, 5), (30, 30), (9999, 360)])
def test_interval(said, minutes):
    assert work.interval(said) == minutes


def cycles(spark, root, fail_at=None, monkeypatch=None):
    """Three cycles over a queue and a table of results; the fail_at-th write is lost, and the daemon starts again."""
    tables = {**work.task_table(2), "result": Table("target long, n long", ["target"], 2)}
    store = Store(spark, str(root), tables, keep=50)
    start, passed = NOW, []
    clock = lambda: start + dt.timedelta(minutes=10 * len(passed))
    ask = lambda s, now: spark.createDataFrame([("URL_HEALTH", i, float(i), now, None) for i in range(3)], "kind string, target long, priority double, not_before timestamp, payload string")

    def handle(number):
        def run(held, now):
            add = held.groupBy("target").agg(F.count("*").alias("m"))
            store.commit(lambda at: {"result": add.join(store.read("result", at), "target", "left").select("target", (F.coalesce("n", F.lit(0)) + F.col("m")).alias("n"))}, "handled", number)
            return held.select("id", F.lit("SUCCESS").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("timestamp").alias("retry_at"))

        return run

    def one(number, now):
        work.cycle(store, number, now, lambda k, t: None, ask, [("URL_HEALTH", 2, handle(number))])

    go = lambda: work.daemon(store, one, 10, 3, clock, lambda s: passed.append(s))
    if fail_at:
        with monkeypatch.context() as m:
            breaking(store, m, fail_at)
            with pytest.raises(Lost):
                go()
    go()
    return rows(store.read("result")), rows(store.read("task").select("target", "status", "attempts"))


def test_a_daemon_that_breaks_off_ends_where_an_unbroken_one_does(spark, tmp_path, monkeypatch):
    want = cycles(spark, tmp_path / "whole")
    assert want[0] == {(2, 3), (1, 3)} or sum(n for _, n in want[0]) == 6
    for at in (3, 8, 15):
        assert cycles(spark, tmp_path / str(at), at, monkeypatch) == want
