"""What an HTML page says about postings, and line differences of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postforge.functions.text import compact, decode_entities

_HREF = r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"'#]+)"""


def links(html: Column) -> Column:
    """Targets of links, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(_HREF), 1))


def json_ld(html: Column) -> Column:
    """The contents of JSON-LD scripts that name a posting."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1)
    return F.filter(blocks, lambda b: F.contains(b, F.lit("JobPosting")))


def posting(block: Column) -> Column:
    """Struct of a JSON-LD posting's fields."""
    get = lambda p: F.get_json_object(block, p)
    return F.struct(get("$.title").alias("title"), get("$.hiringOrganization.name").alias("company"), get("$.jobLocation.address.addressLocality").alias("location"), get("$.datePosted").alias("posted"), get("$.baseSalary.value.minValue").alias("salary_min"), get("$.baseSalary.value.maxValue").alias("salary_max"))


def heading(html: Column) -> Column:
    return compact(decode_entities(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " ")))


LINK = "array<struct<href:string,text:string>>"
#: A posting in JSON, by any of the names that sites use.
RECORD = (
    "`@type` string, type string, title string, jobTitle string, name string, description string, url string, applicationUrl string, applyUrl string, company string, location string, identifier string, reqId string, datePosted string, postedDate string, validThrough string, closeDate string, "
    "hiringOrganization struct<name:string>, jobLocation string"
)


def said(html: Column) -> Column:
    """Text on one line."""
    return compact(decode_entities(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " ")))


def readable(html: Column, longest: int = 18_000) -> Column:
    """A page's text with the line ends of its blocks."""
    c = F.regexp_replace(html, "(?is)<script.*?</script>|<style.*?</style>", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<(br|/p|/div|/li|/ul|/ol|/section|/article|/h[1-6])[^>]*>", "\n"), "<[^>]+>", " ")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\r", ""), "\n{3,}", "\n\n"), "[ \t]{2,}", " ")
    return F.substring(decode_entities(F.regexp_replace(c, r"^\s+|\s+$", "")), 1, longest)


def opening(html: Column, longest: int = 4_000) -> Column:
    """The first characters of a page's text, its blocks run together with spaces."""
    c = F.regexp_replace(F.regexp_replace(html, "(?is)<script.*?</script>|<style.*?</style>", " "), "<[^>]+>", " ")
    return decode_entities(F.substring(F.trim(F.regexp_replace(c, "[ \t]{2,}", " ")), 1, longest))


def site_links(html: Column, url: Column) -> Column:
    """Links with a text that stay on the page's host, in order: structs href (absolute) and text."""
    from postforge.functions.urls import host

    root = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    found = F.zip_with(F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""), 1), F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""), 2), lambda h, t: F.struct(F.trim(decode_entities(h)).alias("h"), said(t).alias("t")))
    kept = F.filter(found, lambda x: (x["h"] != "") & (x["t"] != "") & ~x["h"].startswith("#") & ~x["h"].rlike("^(javascript|mailto|tel):"))
    full = F.transform(kept, lambda x: F.struct(F.when(x["h"].rlike("(?i)^https?://"), x["h"]).when(x["h"].startswith("/"), F.concat(root, x["h"])).otherwise(F.concat(root, F.lit("/"), x["h"])).alias("href"), x["t"].alias("text")))
    return F.filter(full, lambda x: F.coalesce(host(x["href"]) == host(url), F.lit(False))).cast(LINK)


def job_links(html: Column, url: Column, most: int = 40) -> Column:
    """Of the links that stay on the host, the first ones that look like postings: by their words, with a text of 4 to 140 characters, and not leading to a further page."""
    from postforge.functions import rules as R

    looks = lambda x: F.length(x["text"]).between(4, 140) & F.concat_ws(" ", x["text"], x["href"]).rlike("(?i)" + R.JOB_LINK) & ~x["text"].rlike("(?i)" + R.PAGING_LINK)
    return F.slice(F.filter(site_links(html, url), looks), 1, most)


def further(html: Column, url: Column) -> Column:
    """Of the links that stay on the host, where those lead that say that a list goes on."""
    from postforge.functions import rules as R

    return F.array_distinct(F.transform(F.filter(site_links(html, url), lambda x: x["text"].rlike("(?i)" + R.PAGING_LINK)), lambda x: x["href"]))


def reached(starts: DataFrame, landed: DataFrame, depth: int = 7) -> DataFrame:
    """token, url, depth of the landed pages that are reached from the starts (token, url) by following a list's further pages, each once, by its shortest way; `depth` steps at most.

    landed: token, url, html; of pages with one URL the first by their text counts. Links are read once, out of every page; a round is a join of the pages found last with them, so loops and
    pages that weren't landed end by themselves, and the rounds are as many as steps, however many sites and pages there are.
    """
    from postforge.sources.tables import scratch

    spark, keys = landed.sparkSession, ["token", "url"]

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    pages_ = landed.groupBy(*keys).agg(F.min("html").alias("html"))
    links_ = kept(pages_.select(*keys, F.explode(further(F.col("html"), F.col("url"))).alias("to")), "links")
    links_ = links_.join(pages_.select("token", F.col("url").alias("to")), ["token", "to"], "left_semi")
    links_ = kept(links_, "links")
    last = kept(starts.select(*keys).distinct().join(pages_.select(*keys), keys, "left_semi").withColumn("depth", F.lit(0)), "reached")
    found = last
    for step in range(1, depth + 1):
        new = last.select(*keys).join(links_, keys).select("token", F.col("to").alias("url")).distinct().join(found, keys, "left_anti")
        last = kept(new.withColumn("depth", F.lit(step)), "reached")
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found


def _records(json: Column) -> Column:
    """The objects of a JSON text: of a list its members, of a graph its nodes, else itself."""
    graph = F.get_json_object(json, "$.@graph")
    text = F.trim(F.coalesce(graph, json))
    return F.when(text.startswith("["), F.from_json(text, f"array<struct<{_fields()}>>")).otherwise(F.array(F.from_json(text, RECORD)))


def _fields() -> str:
    return ",".join(f.strip().replace(" ", ":", 1) for f in RECORD.split(", "))


def structured(html: Column, url: Column, embedded: bool) -> Column:
    """Postings that a page holds as JSON-LD, or (embedded) as objects with a jobTitle in its scripts: structs of title, company, location, description, source_url, apply_url, posted, due, requisition."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>(.*?)</script>" if embedded else r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1)
    if embedded:
        pieces = F.transform(scripts, lambda t: F.slice(F.regexp_extract_all(decode_entities(t), F.lit(r'(?is)(\{[\s\S]{0,1200}"jobTitle"[\s\S]{0,4000}\})'), 1), 1, 20))
        found = F.transform(F.flatten(pieces), lambda t: F.from_json(t, RECORD))
    else:
        found = F.flatten(F.transform(scripts, lambda t: _records(decode_entities(t))))

    def job(r: Column) -> Column:
        t = lambda *names: F.coalesce(*[F.nullif(F.trim(decode_entities(r[n])), F.lit("")) for n in names])
        where = lambda f: F.coalesce(F.get_json_object(r["jobLocation"], f"$[0].address.{f}"), F.get_json_object(r["jobLocation"], f"$.address.{f}"))
        place = F.coalesce(where("addressLocality"), where("addressRegion"), where("streetAddress"), t("location"))
        kind = F.lower(F.coalesce(r["@type"], r["type"], F.lit("")))
        is_job = kind.contains("jobposting") | r["jobTitle"].isNotNull() | r["title"].isNotNull() | r["hiringOrganization"].isNotNull()
        company = F.coalesce(F.nullif(r["hiringOrganization"]["name"], F.lit("")), t("company"))
        return F.struct(
            F.when(is_job, t("title", "jobTitle", "name")).alias("title"), company.alias("company"), place.alias("location"), F.nullif(said(r["description"]), F.lit("")).alias("description"), F.coalesce(t("url"), url).alias("source_url"),
            F.coalesce(t("url", "applicationUrl", "applyUrl"), url).alias("apply_url"), t("datePosted", "postedDate").alias("posted"), t("validThrough", "closeDate").alias("due"), t("identifier", "reqId").alias("requisition"),
        )

    return F.filter(F.transform(F.filter(found, lambda r: r.isNotNull()), job), lambda j: j["title"].isNotNull() & j["description"].isNotNull())


def route(html: Column, url: Column) -> Column:
    """How a page is to be read, and how sure that is: structured data, embedded data, links that look like postings, a page about openings, or not at all."""
    from postforge.functions import rules as R

    n_ld, n_data, n_links = F.size(structured(html, url, False)), F.size(structured(html, url, True)), F.size(job_links(html, url))
    about = F.concat_ws("\n", F.lower(url), F.lower(opening(html))).rlike("|".join(R.CAREER_PAGE))
    name = F.when(n_ld > 0, "STRUCTURED_JSON").when(n_data > 0, "STRUCTURED_API").when((n_links > 0) | about, "HTML_FALLBACK").otherwise("UNKNOWN")
    sure = F.when(n_ld > 0, 0.96).when(n_data > 0, 0.82).when(n_links > 0, F.least(F.lit(0.7), F.lit(0.35) + n_links * 0.02)).when(about, 0.22).otherwise(0.15)
    return F.struct(name.alias("route"), sure.alias("confidence"))


def detail(html: Column, url: Column) -> Column:
    """What a posting's own page says without structured data: struct of title, location, description, apply_url, posted, due; null if it has no heading or hardly a text."""
    text = readable(html)
    title = F.coalesce(F.nullif(said(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)), F.lit("")), F.nullif(said(F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1)), F.lit("")))
    day = lambda words: F.coalesce(*[F.nullif(F.regexp_extract(text, rf"(?i){w}[^0-9a-z]{{0,12}}([a-z]{{3,9}}\s+\d{{1,2}},?\s+\d{{4}})", 1), F.lit("")) for w in words])
    apply_ = F.get(F.filter(site_links(html, url), lambda x: x["text"].rlike("(?i)apply")), 0)["href"]
    place = F.nullif(F.trim(F.regexp_extract(text, r"(?i)location[:\s]+([^\n]+)", 1)), F.lit(""))
    return F.when((F.length(title) >= 4) & (F.length(text) >= 120), F.struct(title.alias("title"), place.alias("location"), text.alias("description"), F.coalesce(apply_, url).alias("apply_url"), day(["posted"]).alias("posted"), day(["deadline", "apply by"]).alias("due")))


def line_diff(pairs: DataFrame, keys: list[str], rows: bool = False) -> DataFrame:
    """keys and added, removed, kept: lines of left and right by a longest common subsequence; or, with rows, the lines side by side: n, left, right, change.

    Null texts are empty. Side by side, changed lines of one place stand next to each other, and a missing one is null. A pair costs one bit of the worker's memory
    and some nanoseconds per line of the one and line of the other, common ends not counted: two texts of 20,000 lines take 50 MB and a second.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def steps(a: list[str], b: list[str]) -> list[tuple[str | None, str | None]]:
        tail = 0
        while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        common, a, b = a[len(a) - tail :], a[: len(a) - tail], b[: len(b) - tail]
        number = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
        right = np.array([number[x] for x in b], np.int64)
        row, left_first = np.zeros(len(b) + 1, np.int32), []
        for x in a:
            now = np.zeros_like(row)
            np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (right == number[x])), out=now[1:])
            left_first.append(np.packbits(now[:-1] >= row[1:]))
            row = now
        i, j, out = len(a), len(b), []
        while i or j:
            if i and j and a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                out.append((a[i], b[j]))
            elif j and (not i or left_first[i - 1][(j - 1) >> 3] >> (7 - ((j - 1) & 7)) & 1):
                j -= 1
                out.append((None, b[j]))
            else:
                i -= 1
                out.append((a[i], None))
        return [*out[::-1], *zip(common, common, strict=True)]

    def side_by_side(done: list[tuple[str | None, str | None]]) -> Iterator[tuple[str | None, str | None, str]]:
        gone, new = [], []
        for x, y in [*done, ("", "")]:
            if x is not None and y is not None:
                for k in range(max(len(gone), len(new))):
                    yield gone[k] if k < len(gone) else None, new[k] if k < len(new) else None, "changed"
                gone, new = [], []
                yield x, y, "equal"
            elif x is not None:
                gone.append(x)
            else:
                new.append(y)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for key, x, y in zip(df[keys].itertuples(index=False, name=None), df["left"], df["right"], strict=True):
                done = steps((x or "").split("\n"), (y or "").split("\n"))
                if rows:
                    found = [(*key, n, *r) for n, r in enumerate(list(side_by_side(done))[:-1])]
                    yield pd.DataFrame(found, columns=[*keys, "n", "left", "right", "change"])
                else:
                    kept = sum(p is not None and q is not None for p, q in done)
                    yield pd.DataFrame([(*key, sum(p is None for p, _ in done), sum(q is None for _, q in done), kept)], columns=[*keys, "added", "removed", "kept"])

    out = "n long, left string, right string, change string" if rows else "added long, removed long, kept long"
    return pairs.select(*keys, "left", "right").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + out)


def career_links(html: Column, base: Column) -> Column:
    """Absolute links of a page that lead to openings: of the page's own domain, or of a careers or jobs host; files and mail left out."""
    from postforge.functions import rules as R
    from postforge.functions.urls import host

    own, root = F.regexp_replace(host(base), r"^www\.", ""), F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    full = F.transform(F.filter(links(html), lambda u: ~u.rlike("(?i)^(?:mailto:|tel:|javascript:)")), lambda u: F.when(u.rlike("(?i)^https?://"), u).when(u.startswith("/"), F.concat(root, u)).otherwise(F.concat(root, F.lit("/"), u)))

    def wanted(u: Column) -> Column:
        h = F.regexp_replace(F.coalesce(host(u), F.lit("")), r"^www\.", "")
        outside = h.startswith("careers.") | h.startswith("jobs.")
        return ~F.regexp_replace(u, "[?#].*$", "").rlike("(?i)" + R.NO_PAGE) & (outside | (u.rlike("(?i)" + R.CAREER_WORDS) & ((h == own) | h.endswith(F.concat(F.lit("."), own)))))

    return F.array_distinct(F.filter(full, wanted))
