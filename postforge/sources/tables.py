"""What becomes of a table's rows when new ones come: by key, by company, by JSON object. How tables are stored is in store.py."""

from __future__ import annotations

import json
import re
import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those with the same keys; new rows are added. Adds change: created, updated, kept.

    Of rows of `new` with equal keys the last by all columns counts. Keys match null-safe.
    """
    last = new.groupBy(*keys).agg(F.max(F.struct(*[c for c in new.columns if c not in keys])).alias("_new"))
    o = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.struct(*[c for c in old.columns if c not in keys]).alias("_old"))
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_o_{k}"))
        on = c if on is None else on & c
    both = last.join(o, on, "full_outer")
    change = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "kept").otherwise("updated")
    rest = [c for c in old.columns if c not in keys]
    key = [F.when(F.col("_new").isNull(), F.col(f"_o_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return both.select(*key, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in rest], change.alias("change"))


def upsert_mappings(old: DataFrame, new: DataFrame, key: str = "raw_id", target: str = "canonical_id") -> DataFrame:
    """upsert() by the raw row, and previous: where a mapping pointed before, if it points elsewhere now."""
    before = old.select(F.col(key).alias("_k"), F.col(target).alias("_was"))
    out = upsert(old, new, [key]).join(before, F.col(key) == F.col("_k"), "left")
    return out.withColumn("previous", F.when(F.col("_was") != F.col(target), F.col("_was"))).drop("_k", "_was")


def least(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per combination of keys: the first by `order` (all other columns as given, nulls first); what counts doesn't depend on partitions."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    by = F.struct(*(order or []), *rest)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new's rows whose keys old doesn't have, one per key (of several the least by all columns): what is to be appended."""
    return least(new, keys).join(old.select(*keys), keys, "left_anti")


def merge_companies(rows: DataFrame) -> DataFrame:
    """One record per company_key: the longest name, the first known domain, site and board kind by id, the highest confidence, all aliases."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    one = rows.groupBy("company_key").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("name"), first("domain"), first("careers_url"), first("detected_ats"), F.max("confidence").alias("confidence"))
    names = rows.select(F.col("company_key").alias("_k"), F.explode("aliases").alias("a")).groupBy("_k").agg(F.array_sort(F.collect_set("a")).alias("aliases"))
    return one.join(names, F.col("company_key").eqNullSafe(F.col("_k")), "left").drop("_k")


def _merged(old: str | None, new: str | None) -> str | None:
    a, b = (json.loads(x) if x else None for x in (old, new))
    if not a or not b:
        return json.dumps(a or b, ensure_ascii=False) if a or b else None
    for k, v in b.items():
        if isinstance(a.get(k), list) and isinstance(v, list):
            a[k] = list({json.dumps(x): x for x in [*a[k], *v]}.values())
        elif isinstance(a.get(k), dict) and isinstance(v, dict):
            a[k] = {**a[k], **v}
        elif v is not None:
            a[k] = v
    return json.dumps(a, ensure_ascii=False)


@F.pandas_udf(StringType())
def merged_json(old: pd.Series, new: pd.Series) -> pd.Series:
    """A JSON object brought up to date by another: lists are united, objects joined, other values replaced unless null. Objects have no common schema, hence in Arrow batches."""
    return pd.Series([_merged(a, b) for a, b in zip(old, new, strict=True)], dtype=object)


def assign_companies(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """jobs with company_id of their company_key, and changed: whether it was another. companies: company_key, company_id; jobs without one there keep theirs."""
    c = companies.select(F.col("company_key").alias("_k"), F.col("company_id").alias("_id"))
    out = jobs.join(c, F.col("company_key") == F.col("_k"), "left")
    changed = F.col("_id").isNotNull() & ~F.col("_id").eqNullSafe(F.col("company_id"))
    return out.withColumn("changed", changed).withColumn("company_id", F.coalesce("_id", "company_id")).drop("_k", "_id")


def drop_orphans(tags: DataFrame, links: DataFrame) -> DataFrame:
    """Tags that a link still uses."""
    return tags.join(links.select(F.col("tag_id").alias("id")), "id", "left_semi")


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines; one that is there already is replaced."""
    df.write.mode("overwrite").json(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; on a cluster spark.checkpoint.dir must name where."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix=f"spark-{name}-")
    return f"{base.rstrip('/')}/{name}-{spark.sparkContext.applicationId}-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
