"""What a posting's card and a viewer's package show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postforge.functions import salary, text
from postforge.functions import rules as R
from postforge.operators import links


def with_saved(jobs: DataFrame, saved: DataFrame, user: int) -> DataFrame:
    """Adds is_saved: whether the viewer has saved the posting. saved: user_id, canonical_id."""
    own = saved.where(F.col("user_id") == user).select(F.col("canonical_id").alias("_s")).distinct()
    return jobs.join(own, F.col("id") == F.col("_s"), "left").withColumn("is_saved", F.col("_s").isNotNull()).drop("_s")


def amount(value: Column, currency: Column) -> Column:
    """An amount of money without cents."""
    sign = F.coalesce(*[F.when(F.coalesce(currency, F.lit("USD")) == c, s) for c, s in R.CURRENCY_SIGNS.items()], F.concat(currency, F.lit("\u00a0")))
    return F.concat(sign, F.format_number(value, 0))


def salary_label(low: Column, high: Column, currency: Column) -> Column:
    """A range, its one end, or nothing; 0 counts as missing."""
    a, b = F.nullif(low, F.lit(0)), F.nullif(high, F.lit(0))
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(amount(a, currency), F.lit(" - "), amount(b, currency))).when(a.isNotNull(), F.concat(amount(a, currency), F.lit("+"))).when(b.isNotNull(), F.concat(F.lit("Up to "), amount(b, currency))).otherwise("")


def urgency(deadline: Column, as_of: Column) -> Column:
    """What a card says about a deadline that has passed or is a week off at most; null else."""
    days = F.ceil(text.days_between(deadline, as_of))
    return F.when(days < 0, "Deadline passed").when(days == 0, "Closes today").when(days == 1, "Closes tomorrow").when(days <= 7, F.concat(F.lit("Closes in "), days.cast("string"), F.lit(" days")))


def cards(jobs: DataFrame, mappings: DataFrame, saved: DataFrame, user: int, as_of: Column) -> DataFrame:
    """One card a posting: labels, the salary (of the text, where it has none of its own), link and trust, how many sources, and whether it is saved.

    jobs: id, title, company, work_mode, region, description, salary_min, salary_max, salary_currency, deadline, apply_url. A posting without a source has no link.
    """
    pay = salary.resolve(F.col("salary_min"), F.col("salary_max"), F.col("salary_currency"), F.col("description"), F.col("region"))
    n = mappings.groupBy(F.col("canonical_id").alias("_m")).agg(F.count("*").alias("n_sources"))
    link = links.resolved(jobs, mappings).select(F.col("id").alias("_l"), "href", "kind", "level")
    df = with_saved(jobs.withColumn("pay", pay), saved, user).join(n, F.col("id") == F.col("_m"), "left").join(link, F.col("id") == F.col("_l"), "left")
    return df.select(
        "id", "title", "company", text.label(F.col("work_mode")).alias("work_mode"), F.when(F.col("pay.low").isNotNull() | F.col("pay.high").isNotNull(), salary_label(F.col("pay.low"), F.col("pay.high"), F.col("pay.currency"))).otherwise("").alias("salary"),
        urgency(F.col("deadline"), as_of).alias("urgency"), "href", "kind", F.coalesce("level", F.lit("UNAVAILABLE")).alias("level"), F.coalesce("n_sources", F.lit(0)).cast("long").alias("n_sources"), "is_saved",
    )


def package_preview(profiles: DataFrame) -> DataFrame:
    """user_id, links and answers (arrays of structs label, value): what a viewer's package holds, without what is missing.

    profiles: user_id, linkedin_url, github_url, portfolio_url, work_authorization, salary_min, salary_max, salary_currency, work_mode, automation_mode.
    """
    c = F.col
    one = lambda label, value: F.when(F.nullif(value, F.lit("")).isNotNull() | F.lit(label == "Salary target"), F.struct(F.lit(label).alias("label"), value.alias("value")))
    held = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return profiles.select(
        "user_id", held(one("LinkedIn", c("linkedin_url")), one("GitHub", c("github_url")), one("Portfolio", c("portfolio_url"))).alias("links"),
        held(one("Work authorization", c("work_authorization")), one("Salary target", salary_label(c("salary_min"), c("salary_max"), c("salary_currency"))), one("Preferred work mode", text.label(c("work_mode"))), one("Automation mode", text.label(c("automation_mode")))).alias("answers"),
    )


def contact_json(profiles: DataFrame) -> DataFrame:
    """user_id, contact: the profile's fields as a JSON object without nulls and empty texts; null if nothing is left."""
    fields = [c for c in profiles.columns if c != "user_id"]
    made = F.to_json(F.struct(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in fields]))
    return profiles.select("user_id", F.nullif(made, F.lit("{}")).alias("contact"))
