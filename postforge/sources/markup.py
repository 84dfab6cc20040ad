"""Postings out of landed HTML: listing pages of two applicant systems with their detail pages, and company sites.

All by expressions on the page's text; a listing's rows meet their detail pages by URL. Where a detail page wasn't landed,
the first system's posting is made of its listing, and the second's is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postforge.functions import text
from postforge.sources.boards import COLUMNS
from postforge.sources.tables import least

LD = "`@type` string, url string, title string, description string, datePosted string, validThrough string, jobLocationType string, employmentType string, hiringOrganization struct<name:string>, jobLocation array<struct<address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>>, baseSalary struct<currency:string,value:struct<minValue:double,maxValue:double,unitText:string>>"


def find(c: Column, pattern: str) -> Column:
    """The first match's group; null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def last(c: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), 1), F.lit(-1))


def one_line(html: Column) -> Column:
    """Without tags, entities decoded, on one line; null if nothing is left."""
    c = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<[^>]+>", " ")
    return F.nullif(text.compact(text.decode_entities(c)), F.lit(""))


def lines(html: Column) -> Column:
    """Without tags, entities decoded, with the line ends of breaks, paragraphs and items."""
    c = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)<br\s*/?>|</li>", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)</p>|</h[1-6]>", "\n\n"), "<[^>]+>", " ")
    c = F.regexp_replace(F.regexp_replace(text.decode_entities(c), r"\s+\n", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"^\s+|\s+$", "")


def inside(html: Column, start: str, tag: str) -> Column:
    """What stands between the tag that `start` matches and its own end, with nested tags of that name; null if it isn't closed."""
    rest = F.try_element_at(F.split(html, "(?is)" + start, 2), F.lit(2))
    pieces = F.split(rest, rf"(?i)(?=<{tag}[\s>])|(?<=</{tag}>)")
    zero = F.struct(F.lit(1).alias("depth"), F.lit("").alias("said"))

    def step(a: Column, p: Column) -> Column:
        opens, closes = F.when(p.rlike(rf"(?i)^<{tag}[\s>]"), 1).otherwise(0), F.when(p.rlike(rf"(?i)</{tag}>$"), 1).otherwise(0)
        return F.when(a["depth"] == 0, a).otherwise(F.struct((a["depth"] + opens - closes).alias("depth"), F.concat(a["said"], p).alias("said")))

    end = F.aggregate(pieces, zero, step)
    return F.when(end["depth"] == 0, F.regexp_replace(end["said"], rf"(?i)</{tag}>$", ""))


def absolute(href: Column, base: Column) -> Column:
    """href seen from base, an address with scheme and host."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    return F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(root, F.lit("/"), href))


def when_posted(c: Column) -> Column:
    """A date in any of the usual forms; null if it is none."""
    c = F.trim(c)
    return F.coalesce(F.try_to_timestamp(c), *[F.try_to_timestamp(c, F.lit(p)) for p in ("MMM d, yyyy", "MMMM d, yyyy", "M/d/yyyy", "d-MMM-yyyy")]).cast("timestamp_ntz")


def _named(words: dict[str, list[str]], said: Column) -> Column:
    """The first name, one of whose words is in the text; null if none."""
    return F.coalesce(*[F.when(text.contains_any(said, w), name) for name, w in words.items()])


def _postings(df: DataFrame, name: Column, freshness: str, values: dict[str, Column]) -> DataFrame:
    cols = [(values[c] if c in values else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()]
    return df.select(name.alias("source_name"), *cols, F.lit(freshness).alias("freshness_mode"), "fetched_at")


def _met(rows: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """Listing rows with their detail pages. Both sides are shuffled: pages are made of little, so their size is underrated, and a broadcast would send all of them through the driver."""
    return rows.join(known.hint("merge"), F.col("_url") == F.col("_key"), how)


def successfactors(lists: DataFrame, details: DataFrame) -> DataFrame:
    """lists: token (host, or host/path), html, fetched_at; details: url, html. Rows without a link, title or place are passed over."""
    c = F.col
    rows = lists.select("token", "fetched_at", F.explode(F.regexp_extract_all("html", F.lit(r'(?is)<tr class="data-row">(.*?)</tr>'), 1)).alias("row"))
    link = r'(?i)<a href="([^"]*/job/[^"]+)" class="jobTitle-link">([^<]+)</a>'
    rows = rows.select(
        "token", "fetched_at", absolute(find(c("row"), link), F.concat(F.lit("https://"), "token")).alias("_url"), one_line(F.regexp_extract("row", link, 2)).alias("_title"),
        one_line(last(c("row"), r'(?is)<span class="jobLocation">\s*(.*?)\s*</span>')).alias("_place"), when_posted(one_line(last(c("row"), r'(?is)<span class="jobDate">\s*(.*?)\s*</span>'))).alias("_at"),
    ).where("_url IS NOT NULL AND _title IS NOT NULL AND _place IS NOT NULL")
    h = c("html")
    meta = lambda name: one_line(find(h, f'(?i)itemprop="{name}" content="([^"]+)"'))
    said = F.coalesce(inside(h, '<span class="jobdescription">', "span"), inside(h, 'itemprop="description"[^>]*>', "span"))
    known = least(details.select("url", "html"), ["url"]).select(
        c("url").alias("_key"), F.coalesce(one_line(find(h, '(?i)itemprop="title"[^>]*>([^<]+)<')), one_line(find(h, "(?is)<title>(.*?)</title>"))).alias("title"), meta("hiringOrganization").alias("company"),
        F.nullif(F.concat_ws(", ", meta("addressLocality"), meta("addressRegion"), meta("addressCountry")), F.lit("")).alias("location"), one_line(said).alias("description"), when_posted(meta("datePosted")).alias("at"),
        find(h, r'(?i)<a[^>]*class="[^"]*\bapply\b[^"]*"[^>]*href="([^"]+)"').alias("apply"),
    )
    df = _met(rows, known, "left")
    host = F.regexp_replace(F.lower("token"), r"^jobs\.|^careers?\.", "")
    company = F.coalesce("company", F.initcap(F.replace(F.substring_index(host, ".", 1), F.lit("-"), F.lit(" "))))
    title, place = F.coalesce("title", "_title"), F.coalesce("location", "_place")
    description = F.coalesce("description", F.concat(c("_title"), F.lit(" at "), company, F.lit(". "), c("_place")))
    own, all_ = F.lower(F.concat_ws(" ", "title", "description")), F.lower(F.concat_ws(" ", place, description))
    kind = _named({"INTERNSHIP": ["intern", "co-op"], "CONTRACT": ["contract", "temporary", "fixed-term"], "PART_TIME": ["part time", "part-time"]}, own)
    mode = _named({"HYBRID": ["hybrid"], "REMOTE": ["remote", "virtual", "work from home"], "FLEXIBLE": ["flexible"], "ONSITE": ["on-site", "onsite"]}, all_)
    return _postings(df, F.concat(F.lit("SuccessFactors:"), "token"), "FULL_SNAPSHOT", {
        "source_id": c("_url"), "source_url": c("_url"), "title": title, "company": company, "location": place, "description": description, "apply_url": F.coalesce(absolute(c("apply"), c("_url")), "_url"),
        "posted_at": F.coalesce("at", "_at", "fetched_at"), "employment_type": F.when(c("_key").isNotNull(), kind), "work_mode": mode,
    })


def icims(lists: DataFrame, details: DataFrame) -> DataFrame:
    """lists: token (the portal's subdomain), html, fetched_at; details: url, html. A posting without a detail page is left out, a page names a posting once; its fields are looked for from 500 characters before its link to 800 after."""
    c = F.col
    link = r'href="((?:https?://[^"]*)?/jobs/(\d+)/([^"]*?)/job[^"]*)"'
    pieces = F.split("html", f"(?i)(?={link})")
    rows = lists.select("token", "fetched_at", "html", F.posexplode(pieces).alias("n", "piece"), pieces.alias("pieces")).where(F.col("piece").rlike(f"(?i)^{link}"))
    at = F.length(F.array_join(F.slice("pieces", 1, c("n")), ""))
    start = F.greatest(at - 500, F.lit(0))
    rows = rows.select(
        "token", "fetched_at", "n", F.regexp_extract("piece", f"(?i)^{link}", 2).alias("id"), F.regexp_extract("piece", f"(?i)^{link}", 3).alias("slug"), F.regexp_extract(F.regexp_extract("piece", f"(?i)^{link}", 1), r"(/jobs/\d+/[^?#]*)", 1).alias("path"),
        F.substring("html", start + 1, at + 800 - start).alias("near"), F.substring("piece", 1, 800).alias("own"), F.xxhash64("html").alias("page"),
    )
    first = F.min_by(F.struct("token", "fetched_at", "slug", "path", "near", "own"), F.col("n"))
    rows = rows.groupBy("token", "page", "id").agg(first.alias("f")).select("id", "f.*")
    field = lambda names: F.trim(find(c("near"), f"(?i)(?:{names})[^>]*</span>\\s*<span[^>]*>\\s*([^<]+)"))
    base = F.concat(F.lit("https://"), "token", F.lit(".icims.com"))
    named = F.initcap(F.replace(c("slug"), F.lit("-"), F.lit(" ")))
    rows = rows.select(
        "token", "fetched_at", "id", F.concat(base, "path").alias("_url"), F.coalesce(one_line(find(c("own"), r"(?is)^[^>]*>.*?<(?:h[1-6]|span)[^>]*>\s*(.*?)\s*</(?:h[1-6]|span)>")), F.nullif(named, F.lit(""))).alias("_title"),
        field("Job Locations?|Location").alias("_place"), field("Position Type|Employment Type").alias("_kind"), find(c("near"), r"(?i)Remote[^>]*</span>\s*<span[^>]*>\s*(Yes|No)").alias("_away"),
    ).where("_title IS NOT NULL")
    blocks = F.transform(F.regexp_extract_all("html", F.lit(r"""(?is)<script\s+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1), lambda b: F.from_json(b, LD))
    page = F.coalesce(find(c("html"), '(?is)class="[^"]*iCIMS_JobContent[^"]*"[^>]*>(.*?)</div>'), find(c("html"), '(?is)class="[^"]*iCIMS_InfoMsg_Job[^"]*"[^>]*>(.*?)</div>'))
    known = least(details.select("url", "html"), ["url"]).select(c("url").alias("_key"), F.try_element_at(F.filter(blocks, lambda j: j["@type"] == "JobPosting"), F.lit(1)).alias("j"), page.alias("page"))
    df = _met(rows, known, "inner")
    ld, remote = c("j").isNotNull(), F.coalesce(c("j.jobLocationType") == "TELECOMMUTE", F.lit(False))
    places = F.array_join(F.filter(F.transform("j.jobLocation", lambda x: F.concat_ws(", ", F.nullif(x["address"]["addressLocality"], F.lit("")), F.nullif(x["address"]["addressRegion"], F.lit("")), F.nullif(x["address"]["addressCountry"], F.lit("")))), lambda x: x != ""), "; ")
    there = F.nullif(places, F.lit(""))
    place = F.when(ld, F.when(remote, F.coalesce(F.concat(F.lit("Remote – "), there), F.lit("Remote"))).otherwise(F.coalesce(there, F.lit("Unknown")))).otherwise(F.coalesce(F.nullif("_place", F.lit("")), F.lit("Unknown")))
    kind = F.lower(F.when(ld, c("j.employmentType")).otherwise(c("_kind")))
    hourly = F.lower("j.baseSalary.value.unitText").isin("hour", "hourly")
    pay = lambda n: F.when(hourly, text.js_round(c(f"j.baseSalary.value.{n}") * 2080)).otherwise(c(f"j.baseSalary.value.{n}"))
    company = F.initcap(F.regexp_replace(F.regexp_replace("token", "(?i)^(jobs|careers|uscareers|us|ca|uk|eu|apac)-", ""), "[-_]+", " "))
    low = F.lower(place)
    return _postings(df, F.concat(F.lit("iCIMS:"), "token"), "FULL_SNAPSHOT", {
        "source_id": c("id"), "source_url": F.coalesce("j.url", "_url"), "title": F.coalesce("j.title", "_title"), "company": F.coalesce("j.hiringOrganization.name", company), "location": place, "description": lines(F.when(ld, c("j.description")).otherwise(c("page"))),
        "apply_url": F.concat("_url", F.lit("?mode=apply&apply=yes")), "posted_at": when_posted(c("j.datePosted")), "deadline": when_posted(c("j.validThrough")),
        "employment_type": _named({"INTERNSHIP": ["intern"], "CONTRACT": ["contract", "temporary"], "PART_TIME": ["part"], "FULL_TIME": ["full", "permanent", "other"]}, kind),
        "work_mode": F.when(remote | F.coalesce(F.lower("_away") == "yes", F.lit(False)), "REMOTE").when(low.contains("remote"), "REMOTE").when(low.contains("hybrid"), "HYBRID"),
        "salary_min": pay("minValue"), "salary_max": pay("maxValue"), "salary_currency": c("j.baseSalary.currency"),
    })
