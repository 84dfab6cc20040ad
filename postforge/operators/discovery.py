"""Finding sources: candidates out of pages and links, the catalog's order, and which of them are taken on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postforge.functions import rules as R
from postforge.functions import text, urls


def rss_links(xml: Column, most: int) -> Column:
    """Up to `most` targets of a search feed; the first link is the feed's own."""
    found = F.filter(F.transform(F.regexp_extract_all(xml, F.lit("<link>([^<]+)</link>"), 1), lambda u: text.decode_entities(F.trim(u))), lambda u: u != "")
    return F.slice(found, 2, most)


def promoted_tokens(registry: DataFrame) -> DataFrame:
    """connector, tokens (distinct, in order) of the promoted entries of registry files (column value, a JSON document each). Entries without connector or token are passed over."""
    kind = "entries array<struct<status:string,connectorName:string,token:string>>"
    e = registry.select(F.explode(F.from_json("value", kind)["entries"]).alias("e")).where("e.status = 'promoted' AND e.connectorName <> '' AND e.token <> ''")
    return e.groupBy(F.col("e.connectorName").alias("connector")).agg(F.array_sort(F.collect_set("e.token")).alias("tokens"))


def candidates(pages: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
    """One row per board that pages or direct links lead to and that isn't known: board, companies, pages, links, reasons (sorted sets), strength.

    pages: page_url, company, target; links: url, company; known: board. Boards are named by urls.ats_match(); targets that are no board's are passed over.
    """
    none = F.lit(None).cast("string")
    seen = pages.select(urls.ats_match(F.col("target")).alias("board"), "company", F.col("page_url").alias("page"), none.alias("link"), F.lit("career_page_scan").alias("reason"))
    direct = links.select(urls.ats_match(F.col("url")).alias("board"), "company", none.alias("page"), F.col("url").alias("link"), F.lit("career_page_direct_ats_link").alias("reason"))
    every = seen.union(direct).where("board IS NOT NULL").join(known.select("board"), "board", "left_anti")
    sets = lambda c: F.array_sort(F.collect_set(c))
    out = every.groupBy("board").agg(sets("company").alias("companies"), sets("page").alias("pages"), sets("link").alias("links"), sets("reason").alias("reasons"))
    return out.withColumn("strength", F.size("companies") + F.size("pages"))


def promotion(previews: DataFrame) -> DataFrame:
    """Adds promote and reason: whether a board's preview has enough postings of the region that counts. previews: error, accepted, accepted_ca, created, created_ca (null counters: no preview)."""
    c = F.col
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(0.0)
    accepted, created = share("accepted_ca", "accepted"), share("created_ca", "created")
    yes = (
        F.when(c("created_ca") >= 3, "canada_heavy_created_volume")
        .when((c("created") >= 12) & (c("created_ca") >= 4) & (accepted >= 0.2), "broad_board_with_real_canada_slice")
        .when((c("created") >= 6) & (c("created_ca") >= 2) & (accepted >= 0.25), "strong_created_volume")
        .when((c("created") >= 1) & (c("created_ca") >= 1) & ((created >= 0.5) | (accepted >= 0.6)), "canada_dense_small_board")
        .when((c("accepted") > 0) & (c("accepted") == c("accepted_ca")) & (c("created") >= 1), "fully_canada_aligned")
    )
    no = F.when(c("error").isNotNull(), c("error")).when(c("created").isNull(), "no_preview")
    return previews.withColumns({"promote": no.isNull() & yes.isNotNull(), "reason": F.coalesce(no, yes, F.lit("insufficient_canada_weighted_yield"))})


def catalog_order(catalog: DataFrame, names: list[str] | None = None, families: tuple[str, ...] = ("workday", "successfactors"), weighted: bool = True) -> DataFrame:
    """Companies of the catalog that may have a board of these families, with score, best first, then by name.

    catalog: name, tenants, hosts, domains, pages, sectors (arrays), ats, canada_hq, canada_cities (array), remote_canada. names, if
    given: only companies with such a name, tenant or host.
    """
    c = F.col
    n = lambda a: F.coalesce(F.size(a), F.lit(0))
    pts = lambda cond, p: F.when(F.coalesce(cond, F.lit(False)), p).otherwise(0.0)
    cities = n("canada_cities")
    home = pts(c("canada_hq"), 8.0) + F.when(cities >= 3, 5.0).when(cities == 2, 3.0).when(cities == 1, 1.5).otherwise(0.0) + pts(c("remote_canada"), 2.5)
    score = [pts(F.exists("sectors", lambda x: x.rlike("(?i)" + R.CATALOG_SECTORS)), 3.0), pts(n("pages") > 0, 2.5), pts(n("domains") > 0, 1.25), F.when(c("ats") == "unknown", 0.75).when(c("ats") == "both", 2.0).when(c("ats") == "successfactors", 1.5).otherwise(0.0)]
    fits = F.lit(False)
    if "workday" in families:
        fits = fits | c("ats").isin("workday", "both", "unknown")
    if "successfactors" in families:
        fits = fits | c("ats").isin("successfactors", "both")
    low = sorted({x.strip().lower() for x in names or []} - {""})
    if low:
        fits = fits & (F.lower(F.trim("name")).isin(low) | F.exists("tenants", lambda x: F.lower(x).isin(low)) | F.coalesce(F.exists("hosts", lambda x: F.lower(x).isin(low)), F.lit(False)))
    return catalog.where(fits).withColumn("score", reduce(lambda x, y: x + y, score, home if weighted else F.lit(0.0))).orderBy(F.desc("score"), F.collate(c("name"), "UNICODE"))
