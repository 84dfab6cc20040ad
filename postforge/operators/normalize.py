"""From landed postings to clean rows, or the reason why a posting is turned away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postforge.functions import rules as R
from postforge.functions import salary, text, urls

REASONS = ("missing_minimum_identity", "missing_apply_or_detail_path", "obvious_junk", "obvious_dead_at_intake")


def normalize(raw: DataFrame) -> DataFrame:
    """Adds reject_reason and the clean columns to raw postings.

    raw: source_name, source_id, source_url, title, company, location, description, apply_url, posted_at, deadline,
    employment_type, work_mode, salary_min, salary_max, salary_currency, fetched_at. Missing texts are empty.
    Rejected rows keep their clean columns; one pass over the rows, no shuffle.
    """
    clean = lambda c: text.compact(F.coalesce(F.col(c), F.lit("")))
    df = raw.withColumns({"title": clean("title"), "description": text.sanitize(F.col("description")), "apply_url": F.coalesce(F.nullif(clean("apply_url"), F.lit("")), clean("source_url"))})
    t, d, u = F.col("title"), F.col("description"), F.col("apply_url")
    df = df.withColumns({
        "reject_reason": F.when(t == "", REASONS[0]).when(u == "", REASONS[1]).when(text.is_junk(t, d, u), REASONS[2]).when(text.dead_reason(t, d, F.col("deadline"), F.col("fetched_at")).isNotNull(), REASONS[3]),
        "company": F.coalesce(F.nullif(clean("company"), F.lit("")), F.lit("Unknown")), "location": F.coalesce(F.nullif(clean("location"), F.lit("")), F.lit("Unknown")),
    })
    role = text.role_profile(t)
    df = df.withColumns({
        "region": text.region(F.col("location")), "role_family": F.coalesce(role["role_family"], F.lit("Unknown")), "industry": role["industry"],
        "work_mode": text.work_mode(t, F.col("location"), d, F.col("work_mode")), "employment_type": text.employment_type(t, d, F.col("employment_type")),
        "posted_at": F.coalesce("posted_at", "fetched_at"), "deadline": F.when(F.col("deadline") > F.col("fetched_at"), F.col("deadline")),
        **keys(F.col("company"), t, d, F.col("location"), u),
    })
    pay = salary.resolve(F.col("salary_min"), F.col("salary_max"), F.col("salary_currency"), d, F.col("region"))
    return df.withColumns({
        "experience_level": text.experience_level(t, d, F.col("employment_type"), F.col("role_family")),
        "short_summary": text.short_summary(t, F.col("company"), F.col("work_mode"), d),
        "duplicate_cluster_id": text.cluster_id(F.col("company_key"), F.col("title_core_key"), F.col("location_key"), F.col("region")), "pay": pay,
    }).withColumns({"salary_min": F.col("pay.low"), "salary_max": F.col("pay.high"), "salary_currency": F.col("pay.currency")}).drop("pay")


def keys(company: Column, title: Column, description: Column, location: Column, apply_url: Column) -> dict[str, Column]:
    """The columns that matching goes by."""
    return {
        "company_key": text.entity_key(company), "title_key": text.entity_key(title), "title_core_key": text.title_core_key(title),
        "description_fingerprint": text.description_fingerprint(description), "location_key": text.location_key(location), "apply_url_key": urls.identity_key(apply_url),
    }


def eligibility(jobs: DataFrame) -> DataFrame:
    """Adds category, reason, four confidences and level by source and seniority. jobs: source_name, apply_url, title, description, experience_level, employment_type, role_family."""
    portal = urls.portal(F.col("source_name"), F.col("apply_url"))
    writing = F.lower(F.coalesce("description", F.lit(""))).rlike(R.CUSTOM_WRITING)
    high = F.col("experience_level").isin("LEAD", "EXECUTIVE") | text.matches(F.col("title"), R.HIGH_TOUCH_TITLE)
    intern = (F.col("role_family") == "Internship") | text.matches(F.col("title"), R.INTERN_TITLE)
    redirect = (portal == "aggregator") & ~text.contains_any(F.col("apply_url"), R.KNOWN_REDIRECTS)
    semi = portal.isin("semi_structured", "aggregator")

    def verdict(category: str, reason: str, level: int, *scores: float) -> Column:
        names = ("job_validity", "form_automation", "package_fit", "submission_quality")
        return F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"), *[F.lit(s).alias(n) for n, s in zip(names, scores, strict=True)], F.lit(level).alias("level"))

    out = (
        F.when(portal == "unknown", verdict("MANUAL_ONLY", "unknown_source_portal", 3, 0.6, 0.15, 0.5, 0.4))
        .when(redirect, verdict("MANUAL_ONLY", "aggregator_external_redirect", 3, 0.82, 0.2, 0.65, 0.5))
        .when(semi & writing, verdict("AUTO_FILL_REVIEW", "custom_writing_semi_structured", 2, 0.84, 0.6, 0.72, 0.65))
        .when(semi & high, verdict("AUTO_FILL_REVIEW", "senior_role_semi_structured", 2, 0.84, 0.6, 0.72, 0.65))
        .when(semi, verdict("AUTO_FILL_REVIEW", "semi_structured_portal", 2, 0.86, 0.68, 0.75, 0.7))
        .when(writing, verdict("AUTO_FILL_REVIEW", "custom_written_response_required", 2, 0.9, 0.78, 0.8, 0.74))
        .when(high, verdict("AUTO_FILL_REVIEW", "higher_touch_role_review", 2, 0.92, 0.82, 0.75, 0.72))
        .when(intern, verdict("AUTO_FILL_REVIEW", "internship_review", 2, 0.9, 0.85, 0.7, 0.75))
        .when(F.col("employment_type") != "FULL_TIME", verdict("AUTO_FILL_REVIEW", "non_standard_employment_review", 2, 0.88, 0.82, 0.78, 0.73))
        .otherwise(verdict("AUTO_SUBMIT_READY", "structured_ats_flow", 1, 0.94, 0.9, 0.86, 0.84))
    )
    return jobs.withColumn("eligibility", out)
