"""The ranked feed: who sees what, scores, personal taste, variety, search, pages."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postforge.functions import rules as R
from postforge.functions.text import career_stages, days_between, stage_filter
from postforge.operators.lifecycle import steps

PAGE = 20
#: Rows that are scored for a page: the newest, more of them for a search.
WINDOW, SEARCH_WINDOW = 1200, 1800
TASTE_DAYS = 90


def split_values(value: str | None, trim: bool = True) -> list[str]:
    return [p for p in ((x.strip() if trim else x) for x in (value or "").split(",")) if p]


def visible(searching: bool = False) -> Column:
    """Rows a viewer sees without naming a status: alive, and either available enough or never looked at."""
    statuses, least = (["LIVE", "AGING", "STALE"], 20) if searching else (["LIVE", "AGING"], 35)
    unseen = (F.col("availability_score") <= 0) & F.col("last_apply_check_at").isNull() & F.col("last_confirmed_alive_at").isNull() & F.col("dead_signal_at").isNull()
    return F.col("status").isin(statuses) & ((F.col("availability_score") >= least) | unseen)


def role_filter(value: str) -> Column:
    """One value: part of the role family, in any case. Several: exactly one of them."""
    names = split_values(value)
    return F.lower("role_family").contains(names[0].lower()) if len(names) == 1 else F.col("role_family").isin(names)


def category_filter(value: str) -> Column:
    """Manual and review are asked for together."""
    names, both = set(split_values(value)), {"MANUAL_ONLY", "AUTO_FILL_REVIEW"}
    return F.col("category").isin(sorted(names | both if names & both else names))


def stage_is(value: str) -> Column:
    stages = career_stages(F.col("title"), F.col("description"), F.col("employment_type"), F.col("role_family"), as_typed=True)
    return reduce(lambda a, b: a | b, [stages[s] for s in stage_filter(value)], F.lit(False))


def has_real_source(jobs: DataFrame, mappings: DataFrame) -> DataFrame:
    """Jobs with a mapping, removed or not, that isn't a demonstration's."""
    real = mappings.where(~F.col("source_name").isin(R.DEMO_SOURCES)).select(F.col("canonical_id").alias("_c"))
    return jobs.join(real, F.col("id") == F.col("_c"), "left_semi")


def with_eligibility(jobs: DataFrame, eligibility: DataFrame) -> DataFrame:
    """jobs with the columns of their eligibility (id and others, one row an id), null where there is none."""
    e = eligibility.withColumnRenamed("id", "_e")
    return jobs.join(e, F.col("id") == F.col("_e"), "left").drop("_e")


def not_passed(jobs: DataFrame, signals: DataFrame, user: int) -> DataFrame:
    gone = signals.where((F.col("user_id") == user) & (F.col("action") == "PASS")).select(F.col("canonical_id").alias("_c"))
    return jobs.join(gone, F.col("id") == F.col("_c"), "left_anti")


def taste(signals: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """user_id, kind, name: what each viewer liked (role, company) or turned down twice without ever liking it (passed), over TASTE_DAYS."""
    s = signals.where(F.col("action").isin("SAVE", "APPLY", "PASS") & (days_between(as_of, F.col("created_at")) <= TASTE_DAYS))
    s = s.join(jobs.select(F.col("id").alias("canonical_id"), F.lower("role_family").alias("role"), F.lower("company").alias("company")), "canonical_id")
    kinds = F.explode(F.array(F.struct(F.lit("role").alias("kind"), F.col("role").alias("name")), F.struct(F.lit("company").alias("kind"), F.col("company").alias("name"))))
    n = s.select("user_id", F.col("action") != "PASS", kinds.alias("k")).toDF("user_id", "likes", "k").groupBy("user_id", "k.kind", "k.name").agg(F.count_if("likes").alias("likes"), F.count_if(~F.col("likes")).alias("passes"))
    kind = F.when(F.col("likes") > 0, F.col("kind")).when((F.col("kind") == "role") & (F.col("passes") >= 2), "passed")
    return n.where(F.col("name") != "").select("user_id", kind.alias("kind"), "name").where("kind is not null")


def preferences(rows: DataFrame) -> DataFrame:
    """user_id, role_families, work_modes of the rows (user_id, key, value)."""
    of = lambda k: F.filter(F.transform(F.split(F.coalesce(F.max(F.when(F.col("key") == k, F.col("value"))), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.groupBy("user_id").agg(of("softSignal:preferredRoleFamily").alias("role_families"), of("hardFilter:workMode").alias("work_modes"))


def source_summary(mappings: DataFrame) -> DataFrame:
    """canonical_id, strongest (name, reliability of the highest rank, then reliability), n_trusted."""
    best = F.max_by(F.struct("source_name", "source_reliability"), F.struct(F.coalesce("source_quality_rank", F.lit(0)), F.coalesce("source_reliability", F.lit(0.0)), -F.col("id")))
    return mappings.groupBy("canonical_id").agg(best.alias("strongest"), F.count_if(F.col("source_name").rlike(R.TRUSTED_SOURCE)).alias("n_trusted"))


def score(jobs: DataFrame, mappings: DataFrame, as_of: Column, role_families: list[str] = (), work_modes: list[str] = (), liked_roles: list[str] = (), liked_companies: list[str] = (), passed_roles: list[str] = ()) -> DataFrame:
    """Adds the ten parts of the score and total. The lists are one viewer's, and short."""
    sources = source_summary(mappings)
    df = jobs.join(sources, jobs["id"] == sources["canonical_id"], "left").drop("canonical_id")
    age, a = days_between(as_of, F.col("posted_at")), F.col("availability_score")
    fresh = steps(age, [(1, 20), (3, 17), (7, 14), (14, 10), (21, 6), (45, 2), (90, -4), (180, -8), (365, -12)], -16)
    role, company = F.lower(F.coalesce("role_family", F.lit(""))), F.lower(F.coalesce("company", F.lit("")))
    wanted = reduce(lambda x, y: x | y, [role.contains(r.lower()) for r in role_families], F.lit(False))
    pts = lambda cond, n: F.when(cond, n).otherwise(0)
    trust = F.coalesce(F.col("strongest.source_reliability"), F.lit(0.0))
    parts = {
        "eligibility": pts(F.col("category") == "AUTO_SUBMIT_READY", 20), "freshness": F.coalesce(F.when(age.isNotNull(), fresh), F.lit(0.0)).cast("int"),
        "availability": F.when(F.col("status") == "LIVE", 8).when(F.col("status") == "AGING", 3).when(F.col("status") == "STALE", -8).otherwise(-14)
        + F.when(a >= 90, 10).when(a >= 75, 7).when(a >= 60, 4).when(a >= 45, 1).when(a >= 30, -3).otherwise(-6),
        "pref_role": pts(wanted & (role != ""), 15), "pref_mode": pts(F.col("work_mode").isin(list(work_modes)), 10), "liked_role": pts(role.isin(list(liked_roles)), 8),
        "liked_company": pts(company.isin(list(liked_companies)), 6), "passed_role": pts(role.isin(list(passed_roles)), -6),
        "source_trust": F.when(F.col("strongest.source_name").rlike(R.TRUSTED_SOURCE), 5).when(trust >= 0.85, 4).when(trust >= 0.7, 2).otherwise(0), "multi_source": pts(F.col("n_trusted") >= 2, 3),
    }
    return df.withColumns(parts).drop("strongest", "n_trusted").withColumn("total", reduce(lambda x, y: x + y, [F.col(p) for p in parts]))


def scoring_window(jobs: DataFrame, searching: bool = False) -> DataFrame:
    """The newest rows, as many as are scored; a top-k, so each task keeps no more."""
    return jobs.orderBy(F.desc_nulls_first("posted_at"), "id").limit(SEARCH_WINDOW if searching else WINDOW)


def diversify(scored: DataFrame) -> DataFrame:
    """viewer, id, position: greedy order in which companies, titles and sources that come again lose points.

    scored: viewer, id, title, company, posted_at, total, families (of its sources). The order is one of a scoring window: a viewer with
    more than SEARCH_WINDOW rows is an error, since the next pick depends on all picks before. Of equal scores the newer, then the earlier in (total desc, posted_at desc, id) goes first.
    """

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > SEARCH_WINDOW:
            raise ValueError(f"a viewer has {len(rows)} rows; scoring_window() leaves {SEARCH_WINDOW} at most")
        rows = rows.sort_values(["total", "posted_at", "id"], ascending=[False, False, True], na_position="last").reset_index(drop=True)
        key = lambda s: s.fillna("").str.lower().str.replace(r"\s+", " ", regex=True).str.strip()
        company = key(rows["company"])
        title = company + "::" + key(rows["title"].fillna("").str.replace(r"\([^)]*\)", " ", regex=True))
        posted = rows["posted_at"].astype("datetime64[us]").astype("int64").where(rows["posted_at"].notna(), 0)
        n_company, n_title, n_family = {}, {}, {}
        left, out = list(range(len(rows))), []
        while left:
            best, top = None, None
            for i in left:
                c, t = n_company.get(company[i], 0), n_title.get(title[i], 0)
                peak = max([0, *(n_family.get(f, 0) for f in rows["families"][i])])
                points = rows["total"][i] - min(6, 2 * c) - (8 + 2 * (t - 1) if t else 0) - (0 if peak < 6 else 1 if peak < 10 else 2 if peak < 14 else 3)
                if top is None or (points, posted[i]) > top:
                    best, top = i, (points, posted[i])
            left.remove(best)
            out.append(best)
            n_company[company[best]] = n_company.get(company[best], 0) + 1
            n_title[title[best]] = n_title.get(title[best], 0) + 1
            for f in set(rows["families"][best]):
                n_family[f] = n_family.get(f, 0) + 1
        return pd.DataFrame({"viewer": rows["viewer"][out].to_numpy(), "id": rows["id"][out].to_numpy(), "position": range(1, len(out) + 1)})

    cols = ["viewer", "id", "title", "company", "posted_at", "total", "families"]
    return scored.select(*cols).groupBy("viewer").applyInPandas(order, "viewer long, id long, position long")


def page(df: DataFrame, number: int, *order: Column, size: int = PAGE) -> DataFrame:
    """One page by an order that must be total, and has_next on each of its rows: one row more than the page is read, no count."""
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size + 1).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    return rows.withColumn("has_next", F.max("_n").over(Window.partitionBy()) > size).where(F.col("_n") <= size).drop("_n")


def search_terms(query: str) -> list[str]:
    """Up to 12 words of the first 200 characters, letters and digits only."""
    import re

    return [t for t in (re.sub("[^a-zA-Z0-9]", "", w) for w in query[:200].strip().split()) if t][:12]


def search(jobs: DataFrame, query: str) -> DataFrame:
    """Rows in whose title, company, role family or location every term begins a word; if there are none, those whose title, company or role family holds the query.

    Words are taken as they are, without stemming or stop words.
    """
    words = F.split(F.regexp_replace(F.lower(F.concat_ws(" ", "title", "company", "role_family", "location")), "[^a-z0-9]+", " "), " ")
    terms = [t.lower() for t in search_terms(query)]
    begins = lambda t: F.exists(words, lambda w: w.startswith(t))
    hit = reduce(lambda a, b: a & b, map(begins, terms), F.lit(bool(terms)))
    part = reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(query.lower()) for c in ("title", "company", "role_family")])
    marked = jobs.withColumn("_hit", hit).withColumn("_part", part)
    some = marked.agg(F.coalesce(F.max("_hit"), F.lit(False))).scalar()
    return marked.where(F.col("_hit") | (~some & F.col("_part") & F.lit(bool(terms)))).drop("_hit", "_part")
