"""Text keys and classifiers as Column functions. Null arguments give null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postforge.functions import rules as R

#: White space with no-break and other wide spaces, which \s leaves out.
WS = r"[\s   -     　﻿]"
#: Characters of a long text that are tried first for its fingerprint.
HEAD = 2_000
_W = "[A-Za-z0-9_]"
#: A word's edge by ASCII letters alone; \b would take accented letters for word letters.
EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def matches(c: Column, pattern: str) -> Column:
    """Case-insensitive search, with ASCII word edges."""
    return c.rlike("(?iu)" + pattern.replace(r"\b", EDGE))


def first_match(c: Column, pattern: str) -> Column:
    """The first piece that matches, as matches() does; empty if none."""
    return F.regexp_extract(c, "(?iu)" + pattern.replace(r"\b", EDGE), 0)


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def let(value: Column, then) -> Column:
    """then(value), with value worked out once, however often then names it."""
    return F.transform(F.array(value), then)[0]


def compact(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def entity_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def _words(c: Column, pattern: str) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(c), pattern, " "), WS + "+"), "")


def title_core_key(c: Column) -> Column:
    """The title's words without punctuation and seniority, in order."""
    stop = F.array(*map(F.lit, R.TITLE_STOP_WORDS))
    return F.array_join(F.filter(_words(c, r"[^a-z0-9\s]+"), lambda w: ~F.array_contains(stop, w)), "-")


def location_key(c: Column) -> Column:
    """The places between commas, without words of work mode, in order of bytes."""
    c = F.regexp_replace(F.lower(c), f"{EDGE}(remote|hybrid|on-site|onsite|flexible){EDGE}", " ")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[;/]+", ","), WS + "+", " "), "[^a-z0-9, -]+", " ")
    parts = F.array_remove(F.transform(F.split(c, ","), lambda p: F.trim(p)), "")
    return F.array_join(F.array_sort(F.transform(parts, lambda p: F.regexp_replace(p, WS + "+", "-"))), "|")


def content_words(c: Column) -> Column:
    """Words of four characters or more that carry content, tags left out."""
    stop = F.array(*map(F.lit, R.TEXT_STOP_WORDS))
    plain = F.regexp_replace(F.lower(c), "<[^>]+>", " ")
    return F.filter(_words(plain, r"[^a-z0-9\s]+"), lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w))


def description_fingerprint(c: Column, n: int = 24) -> Column:
    """The first n distinct content words. The beginning of a long text is tried first, up to a space and only if no tag begins in it: if it has n, they are those of the whole."""
    first = lambda t: F.slice(F.array_distinct(content_words(t)), 1, n)
    head = F.substring(c, 1, HEAD)
    whole = F.substring(head, F.lit(1), F.length(head) - F.length(F.substring_index(head, " ", -1)))
    begun = F.when((F.length(c) > HEAD) & ~head.contains("<"), first(whole))
    return F.array_join(let(begun, lambda b: F.when(F.size(b) >= n, b).otherwise(first(c))), "-")


def cluster_id(company_key: Column, core_key: Column, place_key: Column, region: Column) -> Column:
    return F.md5(F.concat_ws(":", company_key, core_key, place_key, F.lower(F.coalesce(region, F.lit("unknown")))))


def decode_entities(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def sanitize(c: Column) -> Column:
    """Plain text of HTML: entities first, then block tags to line ends, other tags to spaces, two line ends in a row at most."""
    c = F.regexp_replace(decode_entities(F.coalesce(c, F.lit(""))), r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</?(p|div|section|article|h[1-6]|li|ul|ol|blockquote)[^>]*>", "\n")
    c = F.regexp_replace(c, "<[^>]+>", " ")
    c = F.array_join(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " "))), "\n")
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def region(location: Column) -> Column:
    """US, CA or null. Phrases go before cities, these before trailing codes, and unqualified remote work counts as US."""
    up, low = F.upper(location), F.lower(location)
    parts = F.array_remove(F.transform(F.split(location, ","), lambda p: F.upper(F.trim(p))), "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    before = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    anywhere = contains_any(up, ["WORLDWIDE", "ANYWHERE", "CANADA", *R.CONTINENT_PHRASES]) | (up == "GLOBAL")
    remote = (contains_any(up, R.REMOTE_PHRASES) | (up == "GLOBAL")) & ~contains_any(up, R.REMOTE_ELSEWHERE)
    return (
        F.when(contains_any(up, R.CONTINENT_PHRASES), "CA")
        .when(contains_any(up, R.US_PHRASES), "US")
        .when(up.contains("CANADA"), "CA")
        .when(contains_any(low, R.US_CITIES), "US")
        .when(contains_any(low, R.CA_CITIES), "CA")
        .when((last == "CA") & before.isin(R.CA_PROVINCES), "CA")
        .when(last.isin("US", "USA") & before.isin(R.US_STATES), "US")
        .when((last == "CANADA") & before.isin(R.CA_PROVINCES), "CA")
        .when(last.isin(R.US_STATES), "US")
        .when(last.isin(R.CA_PROVINCES), "CA")
        .when(remote & anywhere, "CA")
        .when(remote, "US")
    )


def role_profile(title: Column) -> Column:
    """Struct of industry and role_family by the first rule that matches; null if none does."""
    kind = "struct<industry:string,role_family:string>"
    rules = [F.when(matches(title, rf"\b({p})\b"), F.struct(F.lit(i).alias("industry"), F.lit(r).alias("role_family")).cast(kind)) for i, r, p in R.ROLES]
    return F.coalesce(*rules)


def work_mode(title: Column, location: Column, description: Column, given: Column) -> Column:
    t = F.lower(F.concat_ws(" ", title, location, description))
    return F.coalesce(given, F.when(t.contains("hybrid"), "HYBRID").when(contains_any(t, ["remote", "work from home"]), "REMOTE").when(t.contains("flexible"), "FLEXIBLE").when(contains_any(t, ["on-site", "onsite"]), "ONSITE").otherwise("UNKNOWN"))


def employment_type(title: Column, description: Column, given: Column) -> Column:
    """Any word with "intern" in it counts, "international" too."""
    t = F.lower(F.concat_ws(" ", title, description))
    return F.coalesce(given, F.when(contains_any(t, ["intern", "co-op"]), "INTERNSHIP").when(contains_any(t, ["contract", "temporary", "fixed-term"]), "CONTRACT").when(contains_any(t, ["part time", "part-time"]), "PART_TIME").otherwise("UNKNOWN"))


def _plain(c: Column) -> Column:
    return compact(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[–—]", "-"))


def career_stages(title: Column, description: Column, employment: Column, family: Column, as_typed: bool = False) -> dict[str, Column]:
    """A boolean per stage; they exclude one another, except that an internship may be administrative.

    as_typed: compare the texts as they are, in lower case (as the search does), else with dashes and spaces evened out
    and a missing employment type taken for full time.
    """
    norm = (lambda c: F.lower(F.coalesce(c, F.lit("")))) if as_typed else _plain
    t, d, f = norm(title), norm(description), norm(family)
    intern = (F.coalesce(employment, F.lit("FULL_TIME")) == "INTERNSHIP") | contains_any(t, R.INTERNSHIP_WORDS) | contains_any(d, R.INTERNSHIP_WORDS)
    admin = contains_any(f, R.ADMIN_FAMILY) | contains_any(t, R.ADMIN_TITLE) | contains_any(d, R.ADMIN_TEXT)
    senior = contains_any(t, R.SENIOR_TITLE) | contains_any(d, R.SENIOR_TEXT)
    associate = contains_any(t, R.ASSOCIATE_TITLE) | contains_any(d, R.ASSOCIATE_TEXT)
    entry = contains_any(t, R.ENTRY_TITLE) | contains_any(d, R.ENTRY_TEXT)
    rest = ~intern & ~admin
    return {"INTERNSHIP": intern, "ADMINISTRATIVE_SUPPORT": admin, "SENIOR_LEVEL": rest & senior, "ASSOCIATE": rest & ~senior & associate, "ENTRY_LEVEL": rest & ~senior & ~associate & entry}


def stage_filter(value: str | None) -> list[str]:
    """Stages named in a comma-separated filter, aliases resolved, each once; unknown names are passed over."""
    alias = {"ENTRY": "ENTRY_LEVEL", "MID": "ASSOCIATE", "SENIOR": "SENIOR_LEVEL", "LEAD": "SENIOR_LEVEL", "EXECUTIVE": "SENIOR_LEVEL"}
    known = ("INTERNSHIP", "ENTRY_LEVEL", "ASSOCIATE", "SENIOR_LEVEL", "ADMINISTRATIVE_SUPPORT")
    names = (alias.get(x, x) for x in (p.strip().upper() for p in (value or "").split(",")))
    return list(dict.fromkeys(n for n in names if n in known))


def experience_level(title: Column, description: Column, employment: Column, family: Column) -> Column:
    t, d = _plain(title), _plain(description)
    s = career_stages(title, description, employment, family)
    return (
        F.when(s["INTERNSHIP"], "ENTRY")
        .when(contains_any(t, R.EXECUTIVE_WORDS) | contains_any(d, R.EXECUTIVE_TEXT), "EXECUTIVE")
        .when(contains_any(t, R.LEAD_WORDS) | contains_any(d, R.LEAD_TEXT), "LEAD")
        .when(contains_any(t, R.SENIOR_WORDS), "SENIOR")
        .when(s["ENTRY_LEVEL"] | s["ASSOCIATE"], "ENTRY")
        .when(contains_any(t, R.MID_WORDS) | contains_any(d, R.MID_TEXT), "MID")
        .otherwise("UNKNOWN")
    )


def is_junk(title: Column, description: Column, apply_url: Column) -> Column:
    """Titles that name a page instead of a job, or an error page's words without a job's."""
    every = F.concat_ws("\n", title, description, apply_url)
    page = reduce(lambda a, b: a | b, [matches(title, p) for p in R.JUNK_TITLES])
    error = reduce(lambda a, b: a | b, [matches(every, p) for p in R.JUNK_CONTENT])
    return page | (error & ~(matches(every, R.JOB_SIGNALS) | (F.length(description) >= 240)))


def dead_reason(title: Column, description: Column, deadline: Column, fetched_at: Column) -> Column:
    """Why a posting is dead, null if it isn't: a deadline that has come, or the first closing phrase."""
    every = F.concat_ws("\n", title, description)
    said = F.coalesce(*[F.when(matches(every, p), F.concat(F.lit("Explicit dead signal detected: "), F.trim(first_match(every, p)))) for p in R.DEAD_CONTENT])
    return F.when(deadline <= fetched_at, "Posting deadline has passed.").otherwise(said)


def short_summary(title: Column, company: Column, mode: Column, description: Column) -> Column:
    """The first full line that is neither a heading nor boilerplate, up to its first sentence's end, and the work mode; 280 characters at most."""

    def clean(line: Column) -> Column:
        line = F.trim(F.regexp_replace(line, r"^[\s>*•\-–—]+", ""))
        line = F.regexp_replace(line, r"\[[^\]]+\]\([^)]+\)", " ")
        return compact(F.regexp_replace(F.regexp_replace(line, r"(?i)https?://\S+", " "), r"(?i)www\.\S+", " "))

    lines = F.filter(F.transform(F.split(description, "\n"), clean), lambda x: (F.length(x) >= 20) & ~x.rlike(R.SUMMARY_HEADING) & ~x.rlike(R.SUMMARY_BOILERPLATE))
    line = F.try_element_at(lines, F.lit(1))
    sentence = F.when(F.regexp_extract(line, r"^([^.!?]+[.!?])", 1) != "", F.trim(F.regexp_extract(line, r"^([^.!?]+[.!?])", 1))).otherwise(line)
    first = F.coalesce(sentence, F.concat(company, F.lit(" is hiring for "), title, F.lit(".")))
    said = F.when(mode == "REMOTE", "Remote-friendly.").when(mode == "HYBRID", "Hybrid schedule.").when(mode == "FLEXIBLE", "Flexible work arrangement.").when(mode == "ONSITE", "On-site expectation.").otherwise("")
    return F.substring(compact(F.concat_ws(" ", first, said)), 1, 280)


def clean_company(c: Column) -> Column:
    """A company's name without import noise before it, (Canada), and legal forms after it, however many."""
    c = F.trim(F.regexp_replace(decode_entities(c), WS + "+", " "))
    prefix = R.COMPANY_PREFIX.removeprefix("^")
    c = F.trim(F.regexp_replace(c, f"(?i)^(?:{prefix})+", ""))
    c = F.trim(F.regexp_replace(c, r"(?i)\((?:canada|ca)\)", ""))
    suffix = R.COMPANY_SUFFIX.removeprefix(r"\b").removesuffix("$")
    c = F.trim(F.regexp_replace(c, f"(?i)(?:{EDGE}{suffix}\\s*)+$", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+-\s+", " "), r"\s{2,}", " "))


def company_key(c: Column) -> Column:
    """Letters and digits of the cleaned name, run together; not the same as entity_key()."""
    return F.regexp_replace(F.replace(F.lower(clean_company(c)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "")


def js_round(c: Column) -> Column:
    """Halves go up, negative ones too."""
    return F.floor(c + 0.5)


def label(c: Column) -> Column:
    """SHOUTED_NAMES as words with capitals."""
    return F.initcap(F.replace(F.lower(c), F.lit("_"), F.lit(" ")))


def snippet(c: Column, longest: int = 1200) -> Column:
    """The beginning of a text on one line; null if there is none."""
    return F.nullif(F.substring(compact(c), 1, longest), F.lit(""))


def tags(c: Column, longest: int = 40) -> Column:
    """Trimmed, cut, distinct, without empties, in order of bytes."""
    return F.array_sort(F.array_distinct(F.array_remove(F.transform(c, lambda x: F.substring(F.trim(x), 1, longest)), "")))


def days_between(later: Column, earlier: Column) -> Column:
    """Days with fractions."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return (us(later) - us(earlier)) / 86_400_000_000.0


def hours_between(later: Column, earlier: Column) -> Column:
    return days_between(later, earlier) * 24.0
