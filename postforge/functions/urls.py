"""URL identity, posting ids, source quality and trust."""

from __future__ import annotations

import json
import re
from collections import deque

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postforge.functions import rules as R


def host(url: Column) -> Column:
    """Lower-case host; null if the URL can't be read."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def host_in(h: Column, suffixes: list[str]) -> Column:
    """The host is one of these or below one of them; false for null."""
    found = F.lit(False)
    for s in suffixes:
        found = found | (h == s) | h.endswith("." + s)
    return F.coalesce(found, F.lit(False))


def identity_key(url: Column) -> Column:
    """Host, path and the query parameters that name a posting, in lower case; null if the URL can't be read."""
    path = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))), "/+$", ""), "/{2,}", "/")
    pairs = F.transform(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(p.contains("="), F.trim(F.substring(p, F.instr(p, "=") + F.lit(1), F.length(p)))).otherwise("").alias("v")))
    stable = F.array(*map(F.lit, R.STABLE_QUERY_PARAMS))
    kept = F.array_sort(F.filter(pairs, lambda p: F.array_contains(stable, F.lower(p["k"])) & (p["v"] != "")))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.lower(p["k"]), F.lit("="), F.lower(p["v"]))), "&")
    return F.when(host(url).isNotNull(), F.concat(host(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def source_prefix(name: Column) -> Column:
    return F.substring_index(name, ":", 1)


def source_family(name: Column) -> Column:
    return F.lower(F.trim(source_prefix(name)))


def _is(name: Column, source_url: Column, apply_url: Column, prefixes: list[str], hosts: list[str]) -> Column:
    return source_prefix(name).isin(prefixes) | host_in(host(source_url), hosts) | host_in(host(apply_url), hosts)


def quality(name: Column, source_url: Column, apply_url: Column) -> Column:
    """Struct of kind and rank."""
    kind = (
        F.when(_is(name, source_url, apply_url, R.DIRECT_PREFIXES, R.DIRECT_HOSTS), "DIRECT_COMPANY")
        .when(_is(name, source_url, apply_url, R.BOARD_PREFIXES, R.BOARD_HOSTS), "STRUCTURED_BOARD")
        .when(_is(name, source_url, apply_url, R.AGGREGATOR_PREFIXES, R.AGGREGATOR_HOSTS), "AGGREGATOR_REDIRECT")
        .otherwise("WEAK_SCRAPED_COPY")
    )
    base = F.when(kind == "DIRECT_COMPANY", 400).when(kind == "STRUCTURED_BOARD", 300).when(kind == "AGGREGATOR_REDIRECT", 200).otherwise(100)
    h = host(apply_url)
    own = F.when(h.isNull(), 0).when(host_in(h, R.DIRECT_HOSTS), 40).when(host_in(h, R.BOARD_HOSTS), 20).when(host_in(h, R.AGGREGATOR_HOSTS), 0).otherwise(10)
    return F.struct(kind.alias("kind"), (base + own + F.when(identity_key(source_url).isNotNull(), 5).otherwise(0)).cast("int").alias("rank"))


def lifecycle(name: Column, source_url: Column, apply_url: Column, freshness: Column) -> Column:
    """Struct of source_type, reliability and full_snapshot."""
    kind = (
        F.when(_is(name, source_url, apply_url, R.DIRECT_PREFIXES, R.DIRECT_HOSTS), "ATS")
        .when(_is(name, source_url, apply_url, R.BOARD_PREFIXES, R.BOARD_HOSTS), "BOARD")
        .when(_is(name, source_url, apply_url, R.AGGREGATOR_PREFIXES, R.AGGREGATOR_HOSTS), "AGGREGATOR")
        .when(source_family(name).contains("json"), "COMPANY_JSON")
        .otherwise("COMPANY_HTML")
    )
    base = F.when(kind == "ATS", 0.95).when(kind == "BOARD", 0.82).when(kind == "AGGREGATOR", 0.55).when(kind == "COMPANY_JSON", 0.85).otherwise(0.7)
    full = freshness == "FULL_SNAPSHOT"
    return F.struct(kind.alias("source_type"), F.least(F.lit(0.99), base + F.when(full, 0.05).otherwise(0.0)).alias("reliability"), full.alias("full_snapshot"))


def stable_id(c: Column) -> Column:
    """An identifier's letters, digits, _ and -, if four or more are left."""
    v = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9_-]+", "")
    return F.when(F.length(v) >= 4, v)


def _segments(url: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), "")


def _param(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), f"(?:^|&){name}=([^&]*)", 1), F.lit(""))


def _at(parts: Column, i: int) -> Column:
    return F.try_element_at(parts, F.lit(i))


def looks_stable(c: Column) -> Column:
    """Four characters or more, with a digit, - or _, and no space."""
    return (F.length(c) >= 4) & c.rlike("[0-9_-]") & ~c.rlike(r"\s")


def scope(family: Column, url: Column) -> Column:
    """What a posting's id is unique within: a board's account, else the host."""
    seg, h = _segments(url), host(url)
    first = F.coalesce(_at(seg, 1), h)
    j = F.array_position(F.transform(seg, lambda x: F.lower(x)), "j").cast("int")
    return stable_id(
        F.when(family.isin("greenhouse", "lever", "ashby"), first)
        .when(family == "workable", F.when(j > 1, F.get(seg, j - 2)).otherwise(first))
        .when(family == "recruitee", F.coalesce(_at(F.filter(seg, lambda x: F.lower(x) != "o"), 1), h))
        .otherwise(F.replace(h, F.lit("."), F.lit("-")))
    )


def url_posting_id(url: Column) -> Column:
    """family:scope:id that a URL of a known board names, or any of the usual parameters; null if none."""
    h, seg = host(url), _segments(url)
    last = _at(seg, -1)
    stable = lambda parts: _at(F.filter(parts, looks_stable), -1)
    behind = lambda word: F.get(seg, F.nullif(F.array_position(F.transform(seg, lambda x: F.lower(x)), word), F.lit(0)).cast("int"))
    digits = _at(F.filter(seg, lambda x: x.rlike(r"^\d{5,}$")), -1)
    token = _at(F.filter(F.transform(F.split(F.coalesce(last, F.lit("")), "[_-]"), stable_id), lambda x: x.isNotNull()), -1)
    usual = F.coalesce(*[_param(url, p) for p in R.STABLE_QUERY_PARAMS])
    firm = lambda c: F.when(looks_stable(c), stable_id(c))
    rules = [
        ("greenhouse", h.contains("greenhouse.io"), F.lower(F.coalesce(_param(url, "gh_jid"), digits))), ("lever", h.contains("lever.co"), firm(last)), ("ashby", h.contains("ashbyhq.com"), firm(last)), ("workday", h.contains("myworkdayjobs.com"), token),
        ("taleo", h.contains("taleo.net"), stable_id(_param(url, "job"))), ("smartrecruiters", h.contains("smartrecruiters.com"), stable_id(stable(seg))), ("icims", h.contains("icims.com"), firm(behind("jobs"))),
        ("workable", h.contains("workable.com"), firm(F.coalesce(behind("j"), last))), ("recruitee", h.contains("recruitee.com"), stable_id(stable(seg))),
    ]
    named = [F.when(on & v.isNotNull(), F.concat_ws(":", F.lit(f), scope(F.lit(f), url), v)) for f, on, v in rules]
    guess = F.coalesce(*[F.when(on, f) for f, on, _ in rules], F.lit("unknown"))
    return F.coalesce(*named, F.when(stable_id(usual).isNotNull(), F.concat_ws(":", guess, scope(guess, url), stable_id(usual))))


def _identifiers(payload: str | None) -> str | None:
    """The first identifier of a JSON text, breadth first: texts in fields whose name says so, and texts in lists that look like one."""
    try:
        queue = deque([json.loads(payload or "null")])
    except ValueError:
        return None
    found = []
    while queue:
        now = queue.popleft()
        if isinstance(now, str):
            if len(s := now.strip()) >= 4 and not re.search(r"(?i)^https?://|\s", s) and re.search("[0-9_-]", s):
                found.append(now)
        elif isinstance(now, list):
            queue.extend(now)
        elif isinstance(now, dict):
            for name, value in now.items():
                if isinstance(value, str) and re.search(R.ID_FIELD, name, re.IGNORECASE):
                    found.append(value)
                elif isinstance(value, (dict, list)):
                    queue.append(value)
    return next((v for v in (re.sub("[^a-z0-9_-]+", "", f.strip().lower()) for f in found) if len(v) >= 4), None)


@F.pandas_udf(StringType())
def metadata_id(payload: pd.Series) -> pd.Series:
    """A payload's own identifier, at any depth; null if it has none or isn't JSON. The walk has no schema, so it runs in Arrow batches."""
    return payload.map(_identifiers)


def posting_id(apply_url: Column, source_url: Column, family: Column, source_id: Column, payload: Column | None = None) -> Column:
    """The id by which a posting is known at its board: of either URL, else of its payload, else the source's own id, within its scope."""
    own = F.coalesce(metadata_id(payload), stable_id(source_id)) if payload is not None else stable_id(source_id)
    return F.coalesce(url_posting_id(apply_url), url_posting_id(source_url), F.when(own.isNotNull(), F.concat_ws(":", family, scope(family, F.coalesce(source_url, apply_url)), own)))


def ats_match(url: Column) -> Column:
    """connector/token of the board that a URL belongs to; null if it is no board's."""
    h, seg = host(url), _segments(url)
    s = lambda i: F.lower(_at(seg, i))
    sub = lambda domain: F.nullif(F.regexp_extract(h, f"^([a-z0-9-]+)\\.{domain}$", 1), F.lit(""))
    locale = s(1).rlike("^[a-z]{2}(?:-[a-z]{2})?$")
    site = F.when(locale, s(2)).otherwise(s(1))
    tenant = F.nullif(F.regexp_extract(h, r"^([a-z0-9-]+)\.wd\d+\.(?:myworkdayjobs|myworkdaysite)\.com$", 1), F.lit(""))
    rules = [
        ("rippling", F.when((h == "ats.rippling.com") & F.array_contains(seg, "jobs"), site)), ("rippling", F.when(h == "jobs.rippling.com", s(1))),
        ("successfactors", F.when((h.startswith("jobs.") | h.startswith("careers.")) & s(1).isin("search", "job", "talentcommunity"), h)),
        ("ashby", F.when(h.isin("jobs.ashbyhq.com", "jobs.eu.ashbyhq.com"), F.when(s(1) == "api", F.lower(F.coalesce(_param(url, "organizationSlug"), s(1)))).otherwise(s(1)))),
        ("greenhouse", F.when(h.isin("boards.greenhouse.io", "job-boards.greenhouse.io"), F.when(s(1) == "embed", F.lower(_param(url, "for"))).otherwise(s(1)))), ("greenhouse", F.when((h == "boards-api.greenhouse.io") & (s(2) == "boards"), s(3))),
        ("lever", F.when(h == "jobs.lever.co", s(1))), ("lever", F.when((h == "api.lever.co") & (s(2) == "postings"), s(3))), ("recruitee", sub("recruitee\\.com")),
        ("smartrecruiters", F.when(h.isin("jobs.smartrecruiters.com", "careers.smartrecruiters.com"), s(1))), ("smartrecruiters", F.when((h == "api.smartrecruiters.com") & (s(2) == "companies"), s(3))),
        ("workable", F.when(h == "apply.workable.com", s(1))), ("workable", F.when((h == "www.workable.com") & (s(1) == "api") & (s(2) == "accounts"), s(3))),
        ("taleo", F.when((s(1) == "careersection") & ~s(2).isin("sitemap.jss", "rest"), F.concat(sub("taleo\\.net"), F.lit("/"), s(2)))), ("icims", F.when((s(1) == "jobs") | (F.size(seg) == 0), sub("icims\\.com"))),
        ("workday", F.when(tenant.isNotNull() & (s(1) == "wday"), F.concat_ws("/", h, s(3), s(4)))), ("workday", F.when(tenant.isNotNull() & site.isNotNull(), F.concat_ws("/", h, tenant, site))),
    ]
    return F.coalesce(*[F.when(t.isNotNull(), F.concat(F.lit(c + "/"), t)) for c, t in rules])


def portal(name: Column, apply_url: Column) -> Column:
    n, u = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(apply_url, F.lit("")))
    has = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    return F.when(has(n, R.STRUCTURED_PORTALS[0]) | has(u, R.STRUCTURED_PORTALS[1]), "structured").when(has(n, R.SEMI_PORTALS[0]) | has(u, R.SEMI_PORTALS[1]), "semi_structured").when(has(n, R.AGGREGATOR_PORTALS), "aggregator").otherwise("unknown")


def absolute(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)^https?://[^/]"), F.lit(False))


def trust(url: Column, name: Column, own: Column | None = None, ok: Column | None = None) -> Column:
    """Whether a source's link may be shown: UNAVAILABLE (a demonstration's, a blocked host), TRUSTED (a verified source or host), else CAUTION. own, ok: host(url) and absolute(url), where columns hold them."""
    own, ok = host(url) if own is None else own, absolute(url) if ok is None else ok
    verified = source_prefix(name).isin(R.TRUSTED_PREFIXES) & name.contains(":")
    return (
        F.when(name.isin(R.DEMO_SOURCES), "UNAVAILABLE").when(~ok, "CAUTION").when(host_in(own, R.BLOCKED_HOSTS), "UNAVAILABLE")
        .when(verified | host_in(own, R.TRUSTED_HOSTS), "TRUSTED").otherwise("CAUTION")
    )


def company_domain(urls: Column) -> Column:
    """The first URL's host, without www, that isn't a board's or applicant system's."""
    other = [*R.DIRECT_HOSTS, *R.BOARD_HOSTS, *R.AGGREGATOR_HOSTS]
    return F.try_element_at(F.filter(F.transform(urls, lambda u: F.regexp_replace(host(u), r"^www\.", "")), lambda h: h.isNotNull() & ~host_in(h, other)), F.lit(1))


def urls_in(text: Column) -> Column:
    """Distinct http(s) URLs in a text, in order, without trailing punctuation."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"""(https?://[^\s"'<>]+)"""), 1), lambda u: F.regexp_replace(u, r"[.,;:)\]]+$", "")))
