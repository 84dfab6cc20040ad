"""Helpers that the text operators share: Arrow slices of bounded size, the shared folder, document keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python workers hold about ten times this in temporary arrays.
SLICE_BYTES = 1 << 20

#: What [^\x20\x09-\x0D]+ leaves out; bytes.split() without arguments cuts at the same six.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each slice holds about `budget` bytes of `column`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = end[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(end, base + budget, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary() if batch.column(column).type != pa.large_string() else pa.large_binary()).to_pylist()]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one where that is unset (local mode)."""
    base = checkpoint_root(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: with its size known, Spark may send it to all tasks of a join where it is small, and doesn't where it isn't."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A session in local mode without one gets a temporary folder; on a cluster it must be set, since executors don't see the driver's folders."""
    sc = spark.sparkContext
    set_ = sc.getConf().get("spark.checkpoint.dir", None)
    if set_:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(set_)
        return set_
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: str = "text") -> Column:
    """With doc_id, the key that leads a document's findings back to it; rows equal in both have equal results."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
