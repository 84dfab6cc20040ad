"""Polls as micro-batches: landed postings come as a stream and keep the current table up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postforge.sources.store import BUCKETS, Store, Table

TABLE = "rows"


def table_of(spark: SparkSession, folder: str, schema: str, keys: list[str], buckets: int = BUCKETS) -> Store:
    """The store whose one table streams keep up to date."""
    return Store(spark, folder, {TABLE: Table(schema, keys, buckets)})


def ingest(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], buckets: int = BUCKETS, name: str | None = None) -> StreamingQuery:
    """Folds each batch of `stream` into the table below `folder`, then stops (all that is there now is taken).

    A batch is known by the stream's name (its checkpoint folder unless given) and its number, so one that is repeated after a failure counts once, and several
    streams, or one begun anew with another checkpoint, may write into the same table.
    """
    spark, kind = stream.sparkSession, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    store = table_of(spark, folder, kind, keys, buckets)
    fold = lambda batch, number: store.upsert(TABLE, batch, name or checkpoint, number)
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The table as of now; empty if nothing was written yet."""
    return table_of(spark, folder, schema, []).read(TABLE)


def distinct_signals(stream: DataFrame, within: str = "1 hour") -> DataFrame:
    """Signals without repeats that come within the delay; late ones beyond it are dropped."""
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(["event_id"])


def activity(stream: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and event type."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def due(connectors: DataFrame, runs: DataFrame, as_of) -> DataFrame:
    """Connectors whose last run is at least their cadence ago, or that never ran. connectors: source, minutes; runs: source, started_at."""
    last = runs.groupBy("source").agg(F.max("started_at").alias("last"))
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 60_000_000
    return connectors.join(last, "source", "left").where(F.col("last").isNull() | (age >= F.col("minutes")))


def stale_runs(runs: DataFrame, as_of, minutes: int = 90) -> DataFrame:
    """Runs that have been going for longer than a run may."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 60_000_000
    return runs.where((F.col("status") == "RUNNING") & (age > minutes))
