"""Operational reports: funnels, vendors, coverage, corpus, rankings, reminders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postforge.functions import rules as R
from postforge.functions import text
from postforge.operators.feed import has_real_source
from postforge.operators.network import ratio

REMINDERS = {7: "DEADLINE_D7", 3: "DEADLINE_D3", 1: "DEADLINE_D1", 0: "DEADLINE_TODAY", -1: "DEADLINE_OVERDUE_D1"}


def funnel(sources: DataFrame) -> DataFrame:
    """All counts of the source funnel in one pass. sources: company_id, validated, ready, attempts, successes, created, retained."""
    c = F.col
    return sources.agg(
        F.countDistinct("company_id").alias("companies"), F.count("*").alias("provisioned"), F.count_if(~c("validated")).alias("unvalidated"), F.count_if("validated").alias("validated"),
        F.count_if("ready").alias("ready"), F.count_if(c("attempts") > 0).alias("tracked"), F.count_if(c("successes") > 0).alias("polled"), F.count_if(c("created") > 0).alias("yielded"), F.count_if(c("retained") > 0).alias("retaining"),
    )


def vendors(sources: DataFrame) -> DataFrame:
    """Counts, means and rates by connector. sources: connector, attempts, successes, quality, yield_, fetched, accepted, created, retained."""
    c, s = F.col, lambda n: F.sum(n).alias(n)
    g = sources.groupBy("connector").agg(
        F.count("*").alias("n_sources"), F.count_if(c("attempts") > 0).alias("n_tracked"), F.count_if(c("successes") > 0).alias("n_successful"), F.avg("quality").alias("avg_quality"), F.avg("yield_").alias("avg_yield"),
        *map(s, ("attempts", "successes", "fetched", "accepted", "created", "retained")), F.sum(F.when(c("attempts") > 0, c("retained")).otherwise(0)).alias("tracked_retained"),
    )
    return g.withColumns({"success_rate": ratio(c("successes"), c("attempts")), "accepted_per_success": ratio(c("accepted"), c("successes")), "created_per_success": ratio(c("created"), c("successes"))})


def coverage(scheduled: DataFrame, raws: DataFrame, mappings: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per source that is scheduled or known: raw rows, live and stale postings, the last run and the last success.

    scheduled: source; raws: source; mappings: source, canonical_id, status; runs: source, started_at, status, id.
    """
    r = raws.groupBy("source").agg(F.count("*").alias("n_raw"))
    m = mappings.groupBy("source").agg(F.countDistinct(F.when(F.col("status").isin("LIVE", "AGING"), F.col("canonical_id"))).alias("n_live"), F.countDistinct(F.when(F.col("status") == "STALE", F.col("canonical_id"))).alias("n_stale"))
    latest = F.max_by("status", F.struct("started_at", "id"))
    u = runs.groupBy("source").agg(latest.alias("last_status"), F.max("started_at").alias("last_run"), F.max(F.when(F.col("status") == "SUCCESS", F.col("started_at"))).alias("last_success"))
    every = scheduled.select("source").union(r.select("source")).union(m.select("source")).union(u.select("source")).distinct()
    out = every.join(r, "source", "left").join(m, "source", "left").join(u, "source", "left")
    return out.na.fill(0, ["n_raw", "n_live", "n_stale"])


def latest_runs(runs: DataFrame) -> DataFrame:
    """source, last_id, last_success_id."""
    at = F.struct("started_at", "id")
    return runs.groupBy("source").agg(F.max_by("id", at).alias("last_id"), F.max_by(F.when(F.col("status") == "SUCCESS", F.col("id")), F.when(F.col("status") == "SUCCESS", at)).alias("last_success_id"))


def upper_median(df: DataFrame, value: str, buckets: int = 500) -> DataFrame:
    """hi, lo, median: the value at place n // 2, counted from the largest.

    Values are counted, then dealt into buckets by approximate quantiles; the buckets' counts tell which one holds the place,
    and only that one is put in order. No rows, no result but nulls.
    """
    n = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    cuts = n.agg(F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 20_000).alias("cuts"))
    dealt = n.join(F.broadcast(cuts)).select("v", "n", F.size(F.filter(F.array_distinct("cuts"), lambda c: c > F.col("v"))).alias("b"))
    sums = dealt.groupBy("b").agg(F.sum("n").alias("s"), F.max("v").alias("hi"), F.min("v").alias("lo"))
    every = Window.partitionBy()
    placed = sums.select("b", (F.sum("s").over(Window.orderBy("b")) - F.col("s")).alias("before"), "s", F.sum("s").over(every).alias("total"), F.max("hi").over(every).alias("hi"), F.min("lo").over(every).alias("lo"))
    middle = F.floor(F.col("total") / 2)
    at = placed.where((F.col("before") <= middle) & (middle < F.col("before") + F.col("s")))
    own = dealt.join(F.broadcast(at), "b").withColumn("from", F.col("before") + F.sum("n").over(Window.partitionBy("b").orderBy(F.desc("v"))) - F.col("n"))
    return own.agg(F.max("hi").alias("hi"), F.max("lo").alias("lo"), F.max(F.when((F.col("from") <= middle) & (middle < F.col("from") + F.col("n")), F.col("v"))).alias("median"))


def transitions(df: DataFrame, before: str, after: str) -> DataFrame:
    """How many rows went from what to what; rows that stayed are left out."""
    return df.where(~F.col(before).eqNullSafe(F.col(after))).groupBy(F.concat_ws(" -> ", F.coalesce(before, F.lit("null")), F.coalesce(after, F.lit("null"))).alias("transition")).agg(F.count("*").alias("n"))


def top_company_names(jobs: DataFrame, mappings: DataFrame, companies: DataFrame, limit: int) -> DataFrame:
    """The commonest name of each company key that isn't known yet. A job counts once for each of its active mappings, once without any."""
    m = mappings.where("removed_at is null").select("canonical_id", "source_url")
    j = jobs.where(F.col("company_key") != "").join(m, F.col("id") == F.col("canonical_id"), "left")
    g = j.groupBy("company_key", "company").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("LIVE", "AGING", "STALE")).alias("live"), F.max(F.nullif("apply_url", F.lit(""))).alias("sample_apply_url"), F.max(F.nullif("source_url", F.lit(""))).alias("sample_source_url"))
    w = Window.partitionBy("company_key").orderBy(F.desc("total"), "company")
    top = g.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")
    return top.join(companies.select("company_key"), "company_key", "left_anti").orderBy(F.desc("live"), F.desc("total"), "company_key").limit(limit)


def company_corpus(jobs: DataFrame, catalog: DataFrame, least_ca: int = 1, least_total: int = 1) -> DataFrame:
    """Live companies worth a search, with their place in a catalog of known ones (name, alias_key, ordinal, bonus), and a score.

    """
    ca = F.col("region") == "CA"
    n = jobs.where(F.col("status").isin("LIVE", "AGING")).groupBy("company").agg(F.count("*").alias("total"), F.count_if(ca).alias("ca"), F.count_if(ca & (F.col("work_mode") == "REMOTE")).alias("ca_remote"))
    n = n.where((F.col("total") >= least_total) & (F.col("ca") >= least_ca)).withColumn("name", text.clean_company(F.col("company")))
    n = n.where((F.col("name") != "") & ~text.matches(F.col("name"), R.COMPANY_SKIP)).withColumn("key", text.company_key(F.col("company"))).where(F.col("key") != "")
    shortest = F.min(F.struct(F.length("name").alias("n"), F.col("name").alias("name")))["name"]
    by_key = n.groupBy("key").agg(F.sum("total").alias("total"), F.sum("ca").alias("ca"), F.sum("ca_remote").alias("ca_remote"), shortest.alias("shortest"))
    found = match_catalog(by_key, catalog)
    bonus = F.coalesce("bonus", F.when(F.col("ca_remote") > 0, 5).otherwise(0))
    score = F.col("ca") * 8 + F.col("ca_remote") * 3 + F.col("total") * 1.5 + bonus
    return found.select("key", F.coalesce("catalog_name", "shortest").alias("name"), "total", "ca", "ca_remote", "catalog_name", score.cast("double").alias("score"))


def match_catalog(companies: DataFrame, catalog: DataFrame, shortest: int = 8) -> DataFrame:
    """Adds catalog_name and bonus: an equal key first, then one that contains the other if both are long; of several the first of the catalog.

    What contains a name contains its first letters, so both sides meet by equi-joins on pieces of that length, whatever the size of the catalog.
    """
    k, a = F.col("key"), F.col("alias_key")
    pieces = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - shortest + 1), lambda i: F.substring(c, i, F.lit(shortest))))).alias("_piece")
    keys, names = companies.select("key").distinct(), catalog.select("alias_key", "ordinal", "name", "bonus")
    long_keys, long_names = keys.where(F.length(k) >= shortest), names.where(F.length(a) >= shortest)
    equal = keys.join(names, k == a)
    wider = long_keys.select("key", pieces(k)).join(long_names.withColumn("_piece", F.substring(a, 1, shortest)), "_piece").where(k.contains(a))
    within = long_keys.withColumn("_piece", F.substring(k, 1, shortest)).join(long_names.select("*", pieces(a)), "_piece").where(a.contains(k))
    cols = ["key", "alias_key", "ordinal", "name", "bonus"]
    pairs = equal.select(cols).union(wider.select(cols)).union(within.select(cols))
    best = pairs.groupBy("key").agg(F.min(F.struct((k != a).alias("loose"), F.col("ordinal"), F.col("name"), F.col("bonus"))).alias("b")).select("key", F.col("b.name").alias("catalog_name"), F.col("b.bonus").alias("bonus"))
    return companies.join(best, "key", "left")


def reminders(tracked: DataFrame, as_of: Column, sent: DataFrame) -> DataFrame:
    """Reminders due today that haven't been sent. tracked: id, user_id, deadline; sent: user_id, tracked_id, reminder."""
    days = F.datediff(F.col("deadline").cast("date"), as_of.cast("date"))
    kind = F.coalesce(*[F.when(days == d, k) for d, k in REMINDERS.items()])
    due = tracked.select("user_id", F.col("id").alias("tracked_id"), kind.alias("reminder")).where("reminder is not null").distinct()
    return due.join(sent.select("user_id", "tracked_id", "reminder"), ["user_id", "tracked_id", "reminder"], "left_anti")


def with_all_tags(tagged: DataFrame, wanted: list[str]) -> DataFrame:
    """Ids that have every wanted tag. tagged: id, tag."""
    return tagged.where(F.col("tag").isin(wanted)).groupBy("id").agg(F.countDistinct("tag").alias("n")).where(F.col("n") == len(set(wanted))).select("id")


def first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of tables of one form; of rows with one key that of the first table stays, in it the first by all columns."""
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        every = p if every is None else every.unionByName(p)
    rest = [c for c in parts[0].columns if c != key]
    return every.groupBy(key).agg(F.min(F.struct("_part", *rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def last_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """As first_wins(), but of rows with one key that of the last table stays, in it the last by all columns."""
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        every = p if every is None else every.unionByName(p)
    rest = [c for c in parts[0].columns if c != key]
    return every.groupBy(key).agg(F.max(F.struct("_part", *rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def except_known(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of rows that known doesn't have."""
    return rows.select(*keys).distinct().join(known.select(*keys), keys, "left_anti")


def also_in(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys other has too."""
    return rows.join(other.select(*keys), keys, "left_semi")


def child_counts(parents: DataFrame, children: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """id, n: children of each parent (column id), 0 without any, `most` if there are more."""
    n = children.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    out = parents.select("id").join(n, F.col("id") == F.col("_k"), "left").select("id", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))
    return out if most is None else out.withColumn("n", F.least("n", F.lit(most).cast("long")))


def main_companies(mappings: DataFrame, jobs: DataFrame) -> DataFrame:
    """The company that most of a source's active postings belong to: source_name, company_key, company, n, live. Of equals the last key."""
    m, j = mappings.where("removed_at IS NULL"), jobs.where("company_key <> ''")
    g = m.join(j, m["canonical_id"] == j["id"]).groupBy("source_name", "company_key").agg(F.max("company").alias("company"), F.count("*").alias("n"), F.count_if(F.col("status").isin("LIVE", "AGING")).alias("live"))
    top = F.max(F.struct("n", "company_key", "company", "live")).alias("t")
    return g.groupBy("source_name").agg(top).select("source_name", "t.company_key", "t.company", "t.n", "t.live")


def runs_by_day(runs: DataFrame) -> DataFrame:
    """day, n, ok, fetched."""
    return runs.groupBy(F.to_date("started_at").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "SUCCESS").alias("ok"), F.sum("fetched").alias("fetched"))


def by_json_number(rows: DataFrame, payload: str, path: str, value: str) -> DataFrame:
    """k, n, mean of value by the whole number at a path of a JSON column; null where there is none."""
    return rows.groupBy(F.get_json_object(payload, path).try_cast("long").alias("k")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def feed_summary(jobs: DataFrame, mappings: DataFrame, today: Column) -> DataFrame:
    """live, added, expired, removed: postings with a real source that are visible, or became so, expired or were removed since `today` began. One pass.

    jobs: id, status, posted_at, expired_at, removed_at.
    """
    c = F.col
    real = has_real_source(jobs, mappings)
    seen = c("status").isin("LIVE", "AGING")
    return real.agg(
        F.count_if(seen).alias("live"), F.count_if(seen & (c("posted_at") >= today)).alias("added"), F.count_if((c("status") == "EXPIRED") & (c("expired_at") >= today)).alias("expired"), F.count_if((c("status") == "REMOVED") & (c("removed_at") >= today)).alias("removed"),
    )


def day_start(at: Column, zone: str) -> Column:
    """When the day of a UTC time began in a zone, in UTC."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(at.cast("timestamp"), zone)), zone).cast("timestamp_ntz")


def source_stats(raws: DataFrame, mappings: DataFrame, jobs: DataFrame) -> DataFrame:
    """source, n_raw, n_active, n_live of every source that has raw rows or mappings. raws: source; mappings: source, canonical_id, removed_at; jobs: id, status."""
    r = raws.groupBy("source").agg(F.count("*").alias("n_raw"))
    live = jobs.where(F.col("status").isin("LIVE", "AGING")).select(F.col("id").alias("_j"))
    m = mappings.where("removed_at IS NULL").join(live, F.col("canonical_id") == F.col("_j"), "left")
    m = m.groupBy("source").agg(F.count("*").alias("n_active"), F.countDistinct("_j").alias("n_live"))
    return r.join(m, "source", "full_outer").na.fill(0, ["n_raw", "n_active", "n_live"])


def reason_counts(decided: DataFrame, reason: str) -> DataFrame:
    """One row: n, and a map of each reason to how often it was met; rows without one aren't in the map."""
    n = decided.groupBy(reason).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(reason).isNotNull(), F.struct(F.col(reason).alias("key"), F.col("n").alias("value")))))).alias("reasons"))


def batch_totals(reports: DataFrame, counters: list[str]) -> DataFrame:
    """Sums of counters over JSON reports (column value, a document each), and n, how many there were; texts that aren't reports count 0."""
    return reports.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.get_json_object("value", f"$.{c}").try_cast("long")), F.lit(0)).alias(c) for c in counters])


def in_locale_order(df: DataFrame, column: str, *then: Column) -> DataFrame:
    """df ordered as readers expect names: accents and case decide only between names that are else alike."""
    return df.orderBy(F.collate(F.col(column), "UNICODE"), *then)


def top_children(children: DataFrame, key: str, latest: str, n: int = 5) -> DataFrame:
    """The n latest rows of each key with their place (1 is the latest); of equals the smallest id first."""
    return children.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(latest), "id"))).where(F.col("place") <= n)


def in_given_order(ranked: DataFrame, rows: DataFrame) -> DataFrame:
    """rows whose ids ranked (id, place) names, with the place: details fetched for a page come back in the page's order."""
    return ranked.select("id", "place").join(rows, "id")
