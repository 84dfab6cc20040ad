"""Links of postings out of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postforge.functions import rules as R
from postforge.functions import urls


def resolved(jobs: DataFrame, mappings: DataFrame) -> DataFrame:
    """id, href, kind, source, level of every posting that has a source: the link that its page leads to, and how far it is trusted.

    Of a posting's sources only the best trusted and the best live one are kept on the way, so very many sources cost no more
    than two. Primary ones go first, then the smallest id. jobs: id, apply_url; mappings: canonical_id, id, source_name, source_url, is_primary.
    """
    c = F.col
    # host, then level, each in a projection of its own: named more than once, they are still worked out once a row
    m = mappings.select("canonical_id", "id", "source_name", "source_url", "is_primary", urls.host(c("source_url")).alias("_host"), urls.absolute(c("source_url")).alias("_ok"))
    m = m.select("*", urls.trust(c("source_url"), c("source_name"), c("_host"), c("_ok")).alias("_level"))
    level, ok = c("_level"), c("_ok")
    place = F.struct((~c("is_primary")).alias("late"), "id", c("source_name").alias("name"), c("source_url").alias("url"))
    m = m.groupBy("canonical_id").agg(
        F.every(c("source_name").isin(R.DEMO_SOURCES)).alias("demo"), F.min(F.when(ok & (level == "TRUSTED"), place)).alias("sure"), F.min(F.when(ok & (level != "UNAVAILABLE"), place)).alias("live"),
    )
    own = urls.absolute(c("apply_url")) & ~c("demo") & ~urls.host_in(urls.host(c("apply_url")), R.BLOCKED_HOSTS) & c("live").isNotNull()
    df = jobs.select("id", "apply_url").join(m, c("id") == c("canonical_id")).withColumns({"own": own, "best": F.coalesce("sure", "live")})
    some = ~c("demo") & c("best").isNotNull()
    return df.select(
        "id", F.when(c("own"), c("apply_url")).when(some, c("best.url")).alias("href"), F.when(c("own"), "APPLY").when(some, "SOURCE").alias("kind"), F.when(c("own") | some, c("best.name")).alias("source"),
        F.when(c("own") | some, F.when(c("sure").isNotNull(), "TRUSTED").otherwise("CAUTION")).otherwise("UNAVAILABLE").alias("level"),
    )
