"""Résumés as text: who they are of, their sections and skills, and what a profile takes over from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postforge.functions import rules as R
from postforge.functions.text import compact, let

CONTACT = ("full_name", "email", "phone", "location", "linkedin_url", "github_url", "portfolio_url")


def comparable(c: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def same(a: Column, b: Column) -> Column:
    """Alike but for case, spaces and punctuation; empty texts are like nothing."""
    return (F.trim(a) != "") & (F.trim(b) != "") & (comparable(a) == comparable(b))


def heading(line: Column) -> Column:
    """The section that a line begins; null if it is no heading."""
    return let(F.regexp_replace(F.lower(F.trim(line)), "[^a-z ]+", " "), lambda said: F.coalesce(*[F.when(said.isin(names), s) for s, names in R.RESUME_SECTIONS.items()]))


def sections(text: Column) -> Column:
    """Map of section to its lines, joined by line ends; what stands before the first heading is `header`. A section that comes twice goes on."""
    lines = F.filter(F.transform(F.split(text, "\n"), compact), lambda x: x != "")
    start = F.struct(F.lit("header").alias("at"), F.array().cast("array<struct<s:string,x:string>>").alias("said"))

    def step(a: Column, line: Column) -> Column:
        more = F.struct(a["at"].alias("at"), F.concat(a["said"], F.array(F.struct(a["at"].alias("s"), line.alias("x")))).alias("said"))
        return let(heading(line), lambda h: F.when(h.isNotNull(), F.struct(h.alias("at"), a["said"].alias("said"))).otherwise(more))

    lines_of = lambda said, s: F.array_join(F.transform(F.filter(said, lambda p: p["s"] == s), lambda p: p["x"]), "\n")
    by_name = lambda said: let(F.array_distinct(F.transform(said, lambda p: p["s"])), lambda names: F.map_from_arrays(names, F.transform(names, lambda s: lines_of(said, s))))
    return let(F.aggregate(lines, start, step)["said"], by_name)


def skills(section: Column, most: int = 100) -> Column:
    """Distinct skills of a section, in order, labels before a colon left out."""
    parts = F.flatten(F.transform(F.split(F.coalesce(section, F.lit("")), "\n"), lambda x: F.split(F.regexp_replace(x, r"^[A-Za-z ]+:\s*", ""), "[,|•]")))
    named = F.filter(F.transform(parts, lambda x: F.substring(compact(x), 1, 120)), lambda x: x != "")
    keyed = F.transform(named, lambda x: F.struct(x.alias("x"), comparable(x).alias("key")))
    known = lambda all_, x, i: F.exists(F.slice(all_, 1, i), lambda y: y["key"] == x["key"])
    return F.slice(F.transform(let(keyed, lambda all_: F.filter(all_, lambda x, i: ~known(all_, x, i))), lambda x: x["x"]), 1, most)


def contact(text: Column) -> dict[str, Column]:
    """The viewer's name, mail, phone, place and links; empty where there is none."""
    lines = F.filter(F.transform(F.split(text, "\n"), compact), lambda x: x != "")
    first = lambda cond: F.coalesce(F.get(F.filter(lines, cond), 0), F.lit(""))
    name = first(lambda x: heading(x).isNull() & ~x.contains("@") & ~x.rlike("(?i)^https?://") & ~x.rlike("[0-9]"))
    find = lambda p: F.regexp_extract(text, "(?i)" + p, 0)
    linkedin, github = find(R.LINKEDIN_URL), find(R.GITHUB_URL)
    other = F.filter(F.regexp_extract_all(text, F.lit(r"(?i)(https?://[^\s)]+)"), 1), lambda u: ~same(u, linkedin) & ~same(u, github))
    place = first(lambda x: ~x.contains("@") & (x.rlike("(?i)remote") | x.rlike(r"[A-Za-z]+,\s*[A-Za-z]{2,}")))
    return {"full_name": name, "email": find(R.MAIL), "phone": find(R.PHONE), "location": place, "linkedin_url": linkedin, "github_url": github, "portfolio_url": F.coalesce(F.get(other, 0), F.lit(""))}


def merge_contact(profiles: DataFrame, found: DataFrame) -> DataFrame:
    """profiles (user_id and the contact's fields) with what is missing taken over from found (the same columns), and added, preserved: the fields taken over, and those that differ and were left. An empty field is missing."""
    f = found.select(F.col("user_id").alias("_u"), *[F.coalesce(c, F.lit("")).alias(f"_{c}") for c in CONTACT])
    df = profiles.select("user_id", *[F.coalesce(c, F.lit("")).alias(c) for c in CONTACT]).join(f, F.col("user_id") == F.col("_u"), "left").na.fill("", [f"_{c}" for c in CONTACT])
    takes = {c: (F.col(c) == "") & (F.col(f"_{c}") != "") for c in CONTACT}
    keeps = {c: (F.col(c) != "") & (F.col(f"_{c}") != "") & ~same(F.col(c), F.col(f"_{c}")) for c in CONTACT}
    named = lambda which: F.filter(F.array(*[F.when(v, F.lit(c)) for c, v in which.items()]), lambda x: x.isNotNull())
    return df.select("user_id", *[F.when(takes[c], F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in CONTACT], named(takes).alias("added"), named(keeps).alias("preserved"))
