"""Sharding by fixed virtual slots: a record's key names its slot, a small versioned map names the slot's shard.

Only DataFrame functions. Bytes are added up per slot, and the map is a stored table with a version for each edit: a
rebalancing edits the map, so that records of the slots that move, move, and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import shared_dir, table

#: Virtual slots; fixed for the life of a data set, far more than there are shards.
SLOTS = 4096
#: A slot's rows are numbered in this many parts, so that a full slot isn't one task's work.
PARTS = 8


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """0 to slots - 1, from the key alone; null keys share a slot."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt evenly in runs. Columns vslot, version, shard; as many rows as slots."""
    return spark.range(slots).select(F.col("id").cast("int").alias("vslot"), F.lit(1).alias("version"), F.floor(F.col("id") * shards / F.lit(slots)).cast("int").alias("shard"))


def add_shard(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version, with shard number `shards` added: each old shard gives an equal part of its slots to it, nothing else moves.

    Depends on the map and the number of shards alone, not on the data.
    """
    n = F.row_number().over(Window.partitionBy("shard").orderBy("vslot"))
    gives = F.pmod(n + F.col("shard"), F.lit(shards + 1)) == 0
    return slot_map.select("vslot", (F.col("version") + 1).alias("version"), F.when(gives, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def slot_sizes(records: DataFrame, key: str, size: Column, slots: int = SLOTS) -> DataFrame:
    """Rows and bytes per virtual slot; slots without records are absent."""
    return records.groupBy(virtual_slot(F.col(key), slots).alias("vslot")).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))


def move_slots(slot_map: DataFrame, sizes: DataFrame, moves: DataFrame) -> DataFrame:
    """The next version, with the slots in moves (vslot, to_shard) taken elsewhere; sizes tell what each move carries (column bytes)."""
    out = slot_map.join(F.broadcast(moves.select("vslot", "to_shard")), "vslot", "left").join(F.broadcast(sizes.select("vslot", "bytes")), "vslot", "left")
    return out.select("vslot", (F.col("version") + 1).alias("version"), F.coalesce("to_shard", "shard").cast("int").alias("shard"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def heaviest_moves(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """Moves (vslot, to_shard) that lower the fullest shard: its slots beyond the mean go to the emptiest shard, largest first, while both stay on their side of the mean."""
    full = slot_map.join(F.broadcast(sizes), "vslot", "left").select("vslot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    by = full.groupBy("shard").agg(F.sum("bytes").alias("b"))
    ends = by.agg(F.max_by("shard", F.struct("b", "shard")).alias("most"), F.min_by("shard", F.struct("b", "shard")).alias("least"), F.max("b").alias("hi"), F.min("b").alias("lo"), (F.sum("b") / shards).alias("mean"))
    part = full.join(F.broadcast(ends), F.col("shard") == F.col("most"))
    running = F.sum("bytes").over(Window.partitionBy("shard").orderBy("bytes", "vslot"))
    return part.withColumn("run", running).where((F.col("run") <= F.col("hi") - F.col("mean")) & (F.col("run") <= F.col("mean") - F.col("lo"))).select("vslot", F.col("least").alias("to_shard"))


def store_map(slot_map: DataFrame, sizes: DataFrame, folder: str, version: int) -> None:
    """Adds a version of the map to the table below folder: vslot, shard, and rows and bytes of each slot. A version that is written again replaces itself."""
    held = slot_map.select("vslot", "shard").join(F.broadcast(sizes.select("vslot", "rows", "bytes")), "vslot", "left")
    held.select("vslot", "shard", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("bytes", F.lit(0)).alias("bytes")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """vslot, version, shard, rows, bytes of one version."""
    return spark.read.schema("vslot int, shard int, rows long, bytes long, version int").parquet(folder).where(F.col("version") == version)


def assign(records: DataFrame, slot_map: DataFrame, key: str, tie: list[str], slots: int = SLOTS) -> DataFrame:
    """Adds shard and slot (0-based place within the shard, without gaps) to records.

    Places follow slot, part, key, then `tie`; rows equal in all of them take neighbouring places in any
    order. Null keys are a key. The map has as many rows as there are slots, and the offsets PARTS times
    that, whatever the data: both are broadcast. No other row leaves its slot's part. Columns of records with the
    names that are added (vslot, map_version, shard, slot) are replaced.
    """
    records = records.drop(*[c for c in records.columns if c.lower() in ("vslot", "map_version", "shard", "slot", "_part", "_at")])
    placed = records.withColumn("vslot", virtual_slot(F.col(key), slots)).withColumn("_part", F.pmod(F.xxhash64(key, *tie), F.lit(PARTS)).cast("int"))
    small = F.broadcast(slot_map.select(F.col("vslot").alias("_v"), "shard", F.col("version").alias("map_version")))
    counts = placed.groupBy("vslot", "_part").agg(F.count("*").alias("_n")).join(small, F.col("vslot") == F.col("_v"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("vslot", "_part")) - F.col("_n")
    offsets = counts.select(F.col("vslot").alias("_v"), F.col("_part").alias("_p"), "shard", "map_version", before.alias("_before"))
    at = F.row_number().over(Window.partitionBy("vslot", "_part").orderBy(key, *tie)) - 1
    numbered = placed.withColumn("_at", at)
    out = numbered.join(F.broadcast(offsets), (numbered["vslot"] == offsets["_v"]) & (numbered["_part"] == offsets["_p"]))
    return out.select(*[numbered[c] for c in records.columns], numbered["vslot"], offsets["map_version"], offsets["shard"], (offsets["_before"] + numbered["_at"]).cast("long").alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents, by the law `key`: doc_id and the shard count decide. Null texts have no bytes; a null doc_id is a key; repeated rows take neighbouring places.

    Bytes per slot go into the stored map (version 1, and version 2 with one shard more), where a rebalancing finds them. They
    don't decide shards here: under this law only doc_id and the shard count may.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    folder, sizes = shared_dir(spark, "slots"), slot_sizes(docs, "doc_id", F.col("size"))
    store_map(first_map(spark, shards), sizes, folder, 1)
    one = read_map(spark, folder, 1)
    store_map(add_shard(one, shards), one, folder, 2)
    out = assign(docs, one, "doc_id", ["text_crc32", "size"])
    grown = read_map(spark, folder, 2).select(F.col("vslot").alias("_g"), F.col("shard").alias("grown_shard"))
    out = out.join(F.broadcast(grown), F.col("vslot") == F.col("_g"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "vslot", "map_version")
