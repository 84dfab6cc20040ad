"""Tables that change together, without a table format.

Rows are dealt into buckets by their keys. A change writes the buckets that it touches, of however many tables, into files of
its own, and then one list: which files each bucket of each table is in, and which batch of each stream was the last. A list has
the next number and is put there only if no list with that number is; so a change is in force as a whole or not at all, and of
two writers that meet one is first and the other one works its change out anew on what the first left.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table; fixed for its life. A change costs the buckets that it touches, so a large table has thousands.
BUCKETS = 64


@dataclass(frozen=True)
class Table:
    """many: a key has many rows, which are replaced together; one with nothing but the key says that it has none now. order: how a bucket's file is sorted."""

    schema: str
    keys: list[str]
    buckets: int = BUCKETS
    many: bool = False
    order: tuple[str, ...] = ()


@dataclass
class Snapshot:
    """A list: places[table][bucket] is the folder of its rows, streams[stream] the number of its last batch."""

    version: int = 0
    places: dict[str, dict[int, str]] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table], keep: int = 3):
        """root: a folder that the driver and all executors share. keep: lists that stay, for readers that began with an older one."""
        self.spark, self.root, self.tables, self.keep = spark, root.rstrip("/"), tables, keep
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    # files

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def _versions(self) -> list[int]:
        fs, folder = self._fs(), self._path(f"{self.root}/lists")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, version: int) -> Snapshot:
        stream = self._fs().open(self._path(f"{self.root}/lists/{version:012d}.json"))
        try:
            said = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(said["version"], {t: {int(b): p for b, p in w.items()} for t, w in said["places"].items()}, said["streams"])

    def _publish(self, s: Snapshot) -> bool:
        """Puts a list there unless one with its number is; the file appears with all it holds. A link on a local disk, a rename that doesn't replace elsewhere: both are one step of the file system."""
        lists = f"{self.root}/lists"
        made, goal = f"{lists}/{uuid.uuid4().hex}.tmp", f"{lists}/{s.version:012d}.json"
        fs = self._fs()
        fs.mkdirs(self._path(lists))
        out = fs.create(self._path(made), False)
        out.write(bytearray(json.dumps({"version": s.version, "places": s.places, "streams": s.streams}).encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                local = lambda p: self._path(p).toUri().getPath()
                os.link(local(made), local(goal))
            else:
                none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(self._path(made), self._path(goal), options)
        except Exception:
            if s.version in self._versions():
                return False
            raise
        finally:
            if fs.exists(self._path(made)):
                fs.delete(self._path(made), False)
        return True

    # reading

    def snapshot(self) -> Snapshot:
        """The list in force; an empty one if nothing was written yet."""
        found = self._versions()
        return self._load(found[-1]) if found else Snapshot()

    def read(self, table: str, at: Snapshot | None = None, only: set[int] | None = None) -> DataFrame:
        """A table as of a list (the one in force), or some of its buckets."""
        where = (at or self.snapshot()).places.get(table, {})
        paths = [f"{self.root}/{p}" for b, p in sorted(where.items()) if only is None or b in only]
        t = self.tables[table]
        return self.spark.read.schema(t.schema).parquet(*paths) if paths else self.spark.createDataFrame([], t.schema)

    # writing

    def _dealt(self, table: str, old: DataFrame, rows: DataFrame) -> DataFrame:
        """What becomes of old buckets, with the column bucket, a bucket in one task: rows in place of old ones with their keys, in one shuffle."""
        t, at = self.tables[table], bucket(self.tables[table].keys, self.tables[table].buckets)
        if t.many:
            said = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in rows.columns if c not in t.keys])
            return old.join(rows.select(*t.keys), t.keys, "left_anti").unionByName(rows.where(said)).withColumn("bucket", at).repartition("bucket")
        # of new rows with equal keys the last by all columns, before the old one
        rest = [c for c in rows.columns if c not in t.keys]
        both = old.withColumn("_new", F.lit(False)).unionByName(rows.withColumn("_new", F.lit(True))).withColumn("bucket", at).repartition("bucket")
        last = both.groupBy("bucket", *t.keys).agg(F.max(F.struct("_new", *rest)).alias("_last"))
        return last.select(*t.keys, *[F.col(f"_last.{c}").alias(c) for c in rest], "bucket")

    def _write(self, table: str, rows: DataFrame, at: Snapshot, folder: str) -> dict[int, str | None]:
        """Writes the touched buckets with rows in place of those with their keys; where they are now, None if nothing is left of one."""
        t = self.tables[table]
        rows = rows.select(*self.spark.createDataFrame([], t.schema).columns)
        touched = {r["b"] for r in rows.select(bucket(t.keys, t.buckets).alias("b")).distinct().collect()}
        if not touched:
            return {}
        old = self.read(table, at, touched)
        dealt = self._dealt(table, old, rows)
        (dealt.sortWithinPartitions("bucket", *t.order) if t.order else dealt).write.partitionBy("bucket").parquet(f"{self.root}/{table}/{folder}")
        there = {x.getPath().getName() for x in self._fs().listStatus(self._path(f"{self.root}/{table}/{folder}"))}
        return {b: f"{table}/{folder}/bucket={b}" if f"bucket={b}" in there else None for b in touched}

    def commit(self, change: Callable[[Snapshot], dict[str, DataFrame]], stream: str | None = None, number: int | None = None) -> int | None:
        """Puts into force what change makes of the list in force: rows per table that replace those with their keys. The version, or None if there was nothing to do.

        A batch is known by its stream and number, not by the number alone: one that is in force already is passed over, whoever repeats it, and streams don't hinder each other.
        Where another writer was first, change is called again with what it left. What fails before its list leaves nothing in force; its files are swept later.
        """
        while True:
            at = self.snapshot()
            if stream is not None and at.streams.get(stream, -1) >= number:
                return None
            made, folder = change(at), uuid.uuid4().hex
            places = {t: dict(w) for t, w in at.places.items()}
            touched = False
            for table, rows in made.items():
                moved = self._write(table, rows, at, folder)
                touched |= bool(moved)
                places[table] = {b: p for b, p in {**places.get(table, {}), **moved}.items() if p}
            if not touched and stream is None:
                return None
            streams = at.streams if stream is None else {**at.streams, stream: number}
            if self._publish(Snapshot(at.version + 1, places, streams)):
                self._prune()
                return at.version + 1

    def upsert(self, table: str, rows: DataFrame, stream: str | None = None, number: int | None = None) -> int | None:
        return self.commit(lambda at: {table: rows}, stream, number)

    def _prune(self) -> None:
        """Removes lists but the last ones, and the files that only those named. Files that no list ever named may be another writer's, and stay."""
        versions = self._versions()
        gone, left = versions[: -self.keep], versions[-self.keep :]
        used = lambda vs: {p for v in vs for w in self._load(v).places.values() for p in w.values()}
        fs = self._fs()
        for p in used(gone) - used(left) if gone else ():
            fs.delete(self._path(f"{self.root}/{p}"), True)
        for v in gone:
            fs.delete(self._path(f"{self.root}/lists/{v:012d}.json"), False)

    def sweep(self, hours: float = 24.0) -> int:
        """Removes what no list names and was written longer ago than any writer takes; how many folders."""
        fs, n = self._fs(), 0
        used = {"/".join(p.split("/")[:2]) for v in self._versions() for w in self._load(v).places.values() for p in w.values()}
        for table in self.tables:
            folder = self._path(f"{self.root}/{table}")
            for s in fs.listStatus(folder) if fs.exists(folder) else ():
                if f"{table}/{s.getPath().getName()}" not in used and s.getModificationTime() < (time.time() - hours * 3600) * 1000:
                    fs.delete(s.getPath(), True)
                    n += 1
        return n
