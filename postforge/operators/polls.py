"""A poll's postings in the order in which they arrived: which of them belong together, and what they make of the rows that are known.

A posting joins a known row or an earlier posting of its poll, whichever match goes before. So every posting has one
parent or none, and where it ends is found by following parents, twice as far in every round. What its values do to a row
depends on the ranks before it; that is reduced to one instant per row and rank, and the rest are aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postforge.operators import matching
from postforge.operators.matching import kept as _kept

#: Keys by which postings of a poll meet, with how a match is called and its rung among those of matching.PRECEDENCE.
KEYS = [("apply_url_key", "applyUrlKey", 0), ("source_url_key", "sourceUrlKey", 2), ("posting_id_key", "postingIdKey", 4), ("duplicate_cluster_id", "duplicateCluster", 6)]
#: Postings whose descriptions are folded in one array; arrival is a place in the poll, so no array is longer.
CHUNK = 4096


def _asking(postings: DataFrame, key: str) -> DataFrame:
    rows = postings.where(F.col(key).isNotNull())
    return rows.where(F.col("company_key") != matching.UNKNOWN_COMPANY) if key == "duplicate_cluster_id" else rows


# --- in any order ----------------------------------------------------------------------------------------------------


def components(postings: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of postings that share a key, or share one with one that does, and so on.

    Order plays no part. Every key is a star around its smallest id, so that links are as many as keys and not as pairs; labels fall to
    the least next to them, are handed to the label's own row, and are then followed twice as far, until a round changes nothing.
    """
    spark, links = postings.sparkSession, None
    for key, *_ in KEYS:
        rows = _asking(postings, key).select("id", F.col(key).alias("k"))
        star = rows.join(rows.groupBy("k").agg(F.min("id").alias("hub")), "k").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
        links = star if links is None else links.union(star)
    links = _kept(spark, links.distinct(), "links")
    links = links.union(links.select("b", "a"))
    at = _kept(spark, postings.select("id", F.col("id").alias("component")).distinct(), "labels")
    while True:
        label = at.select(F.col("id").alias("b"), F.col("component").alias("next"))
        near = links.join(label, "b").groupBy(F.col("a").alias("id")).agg(F.min("next").alias("near"))
        low = at.join(near, "id", "left").withColumn("low", F.least("component", F.coalesce("near", "component")))
        own = low.groupBy(F.col("component").alias("id")).agg(F.min("low").alias("handed"))  # to the row that the label names
        low = low.join(own, "id", "left").select("id", F.col("component").alias("before"), F.least("low", F.coalesce("handed", "low")).alias("low"))
        step = _kept(spark, low.join(low.select(F.col("id").alias("low"), F.col("low").alias("far")), "low", "left").select("id", "before", F.least("low", F.coalesce("far", "low")).alias("component")), "labels")
        if not step.where("before <> component").limit(1).count():
            return step.select("id", "component")
        at = step.select("id", "component")


# --- in order --------------------------------------------------------------------------------------------------------


def earlier_matches(postings: DataFrame, asking: DataFrame) -> DataFrame:
    """new_id, earlier_id, how, rung, score, arrival: of each asking posting the first posting of the poll with an equal key, by key.

    postings, asking: rows of one poll with id, arrival and the columns of matching.
    """
    parts = []
    for key, how, rung in KEYS:
        first = _asking(postings, key).groupBy(F.col(key).alias("_k")).agg(F.min(F.struct("arrival", "id")).alias("f"))
        rows = _asking(asking, key).join(first, F.col(key) == F.col("_k")).where(F.col("f.arrival") < F.col("arrival"))
        parts.append(rows.select(F.col("id").alias("new_id"), F.col("f.id").alias("earlier_id"), F.lit(how).alias("how"), F.lit(rung).alias("rung"), F.lit(95 if rung == 6 else 100).alias("score"), F.col("f.arrival").alias("arrival")))
    exact = parts[0]
    for p in parts[1:]:
        exact = exact.union(p)
    return exact


def resolve(postings: DataFrame, settled: DataFrame, mappings: DataFrame, known: DataFrame) -> DataFrame:
    """id, canonical_id, created_by, how of every posting of a poll: the known row it belongs to, or else the posting that makes a new one (itself, or an earlier one that it follows).

    postings: what was accepted, with arrival (its place in the poll) and the columns of matching; settled: id, canonical_id of those that stay where they were.
    Of the matches of a posting the best rung counts, then the score, then known rows before the poll's own, then the smallest id or the first to arrive. A row that the poll
    makes is met by the keys of each of its postings, and compared as each of them is written.
    """
    c = F.col
    asking = postings.join(settled.select(c("id").alias("_s")), c("id") == c("_s"), "left_anti")
    none = F.lit(None).cast("long")
    exact = matching.exact_matches(asking, mappings, known).withColumn("score", F.when(c("how") == "duplicateCluster", 95).otherwise(100))
    old = exact.select("new_id", "rung", (-c("score")).cast("int").alias("s"), F.lit(0).alias("own"), c("known_id").alias("tie"), "how", "known_id", none.alias("earlier_id"))
    new = earlier_matches(postings, asking).select("new_id", "rung", (-c("score")).cast("int").alias("s"), F.lit(1).alias("own"), c("arrival").alias("tie"), "how", none.alias("known_id"), "earlier_id")
    keyed = matching.kept(postings.sparkSession, old.unionByName(new), "keyed")
    # similarity counts for postings that no key matches, and of what is similar the best
    open_, like = matching.unmatched(asking, keyed), F.lit("similarity").alias("how")
    close = matching.closest(known, open_).select("new_id", F.lit(9).alias("rung"), (-c("score")).cast("int").alias("s"), F.lit(0).alias("own"), c("known_id").alias("tie"), like, "known_id", none.alias("earlier_id"))
    near = matching.closest(postings, open_, order="arrival", earlier=True).select("new_id", F.lit(9).alias("rung"), (-c("score")).cast("int").alias("s"), F.lit(1).alias("own"), c("order").alias("tie"), like, none.alias("known_id"), c("known_id").alias("earlier_id"))
    best = keyed.unionByName(close).unionByName(near).groupBy("new_id").agg(F.min(F.struct("rung", "s", "own", "tie", "how", "known_id", "earlier_id")).alias("b"))
    rows = asking.select("id").join(best, c("id") == c("new_id"), "left").select("id", c("b.known_id").alias("canonical_id"), F.when(c("b").isNull(), c("id")).alias("created_by"), c("b.how").alias("how"), c("b.earlier_id").alias("next"))
    rows = rows.unionByName(settled.select("id", "canonical_id", none.alias("created_by"), F.lit(None).cast("string").alias("how"), none.alias("next")))
    rows = _kept(postings.sparkSession, rows, "parents")
    ends = _followed(rows)
    out = rows.join(ends.select(c("id").alias("next"), c("canonical_id").alias("_c"), c("created_by").alias("_b")), "next", "left")
    return out.select("id", F.coalesce("canonical_id", "_c").alias("canonical_id"), F.coalesce("created_by", "_b").alias("created_by"), "how")


def _followed(rows: DataFrame) -> DataFrame:
    """id, canonical_id, created_by of the postings that others follow, each followed to its end; in as many rounds as the longest chain has binary digits."""
    spark = rows.sparkSession
    heads = rows.select(F.col("next").alias("id")).where("id is not null").distinct()
    at = _kept(spark, rows.join(heads, "id", "left_semi").select("id", "canonical_id", "created_by", "next"), "heads")
    while at.where("next is not null").limit(1).count():
        there = at.select(F.col("id").alias("next"), F.col("canonical_id").alias("_c"), F.col("created_by").alias("_b"), F.col("next").alias("_n"))
        at = _kept(spark, at.join(there, "next", "left").select("id", F.coalesce("canonical_id", "_c").alias("canonical_id"), F.coalesce("created_by", "_b").alias("created_by"), F.col("_n").alias("next")), "heads")
    return at


# --- survivorship ----------------------------------------------------------------------------------------------------


def preferred(postings: DataFrame, known: DataFrame) -> DataFrame:
    """postings with preferred: whether the posting's rank is at least that of all before it, the row's own (known: id, rank) included.

    A rank wins until a higher one arrives: one instant per row and rank, whatever the number of postings.
    """
    first = postings.groupBy("target", "rank").agg(F.min("arrival").alias("first"))
    higher = Window.partitionBy("target").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    until = first.withColumn("until", F.min("first").over(higher)).join(known.select(F.col("id").alias("target"), F.col("rank").alias("own")), "target", "left")
    wins = until.select("target", "rank", "until", (F.col("rank") >= F.coalesce("own", F.col("rank"))).alias("enough"))
    return postings.join(wins, ["target", "rank"]).withColumn("preferred", F.col("enough") & (F.col("until").isNull() | (F.col("arrival") < F.col("until")))).drop("until", "enough")


def _reached(length: Column) -> Column:
    return F.floor(length * 0.6)


def described(postings: DataFrame, known: DataFrame) -> DataFrame:
    """target, described: the arrival of the posting whose description the row ends with; null where it keeps its own.

    A preferred text takes the place of one that isn't much longer, so each step depends on the one before. A chunk of the poll is folded for every length that it may
    meet: only those texts matter to it that are longer than all before them in the chunk; then the chunks are folded one after the other.
    """
    c, n = F.col, F.length(F.trim("description"))
    empty = known.where(F.coalesce(F.length(F.trim("description")), F.lit(0)) == 0).select(c("id").alias("target"))
    said = postings.where(n > 0).select("target", "arrival", "preferred", n.alias("n"))
    first = said.join(empty, "target", "left_semi").groupBy("target").agg(F.min(F.struct("arrival", "n")).alias("first"))
    chunks = said.where("preferred").groupBy("target", F.expr(f"arrival div {CHUNK}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("arrival", "n"))).alias("items"))
    items, start = c("items"), F.struct(F.lit(None).cast("long").alias("arrival"), F.lit(0).alias("n"))

    def after(x: Column) -> Column:
        """What the chunk ends with if x is taken."""
        return F.aggregate(F.filter(items, lambda y: y["arrival"] > x["arrival"]), F.struct(x["arrival"].alias("arrival"), x["n"].alias("n")), lambda a, y: F.when(y["n"] >= _reached(a["n"]), F.struct(y["arrival"].alias("arrival"), y["n"].alias("n"))).otherwise(a))

    longer = F.aggregate(items, F.array().cast("array<struct<arrival:bigint,n:int>>"), lambda a, y: F.when((F.size(a) == 0) | (y["n"] > F.element_at(a, -1)["n"]), F.concat(a, F.array(y))).otherwise(a))
    steps = chunks.select("target", "chunk", F.transform(longer, lambda x: F.struct(x["n"].alias("reach"), after(x).alias("then"))).alias("steps"))
    runs = steps.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("chunk", "steps"))).alias("runs"))
    own = known.select(c("id").alias("target"), F.coalesce(F.length(F.trim("description")), F.lit(0)).alias("own"))
    rows = own.join(first, "target", "left").join(runs, "target", "left")
    state = F.when(c("own") > 0, F.struct(start["arrival"].alias("arrival"), c("own").alias("n"))).when(c("first").isNotNull(), c("first")).otherwise(start)
    # what came before the first text of an empty row was empty, too; the text itself is taken once more without effect
    fold = F.aggregate(F.coalesce("runs", F.array().cast("array<struct<chunk:bigint,steps:array<struct<reach:int,then:struct<arrival:bigint,n:int>>>>>")), state, lambda a, r: F.coalesce(F.try_element_at(F.filter(r["steps"], lambda s: s["reach"] >= _reached(a["n"])), F.lit(1))["then"], a))
    return rows.select("target", fold["arrival"].alias("described"))


def fold(postings: DataFrame, known: DataFrame) -> DataFrame:
    """Each known row after its postings of a poll, in the order of their arrival, and the rank that the next one has to reach.

    postings: target (the row's id), arrival, rank and the row's columns; known: id, rank and the columns; for rows that the poll makes, their first posting.
    Targets that aren't known are passed over; rows without postings stay as they are.
    """
    c, rows = F.col, preferred(postings, known.select("id", "rank"))
    p, at = c("preferred"), c("arrival")
    last = lambda v, when: F.max_by(v, F.when(when, at))
    first = lambda v, when: F.min_by(v, F.when(when, at))
    found: dict[str, Column] = {}
    out: dict[str, Column] = {}

    def pick(name: str, v: Column, good: Column, now: Column, now_good: Column, *weak: Column) -> None:
        """The last preferred good value, else the row's own if it is good, else the first good one; then the weak ones."""
        found[f"{name}_1"], found[f"{name}_2"] = last(v, p & good), first(v, good)
        for k, w in enumerate(weak):
            found[f"{name}_w{k}"] = last(v, p & w) if k == 0 else first(v, w)
        out[name] = F.coalesce(c(f"{name}_1"), F.when(now_good, now), c(f"{name}_2"), *([c(f"{name}_w0")] if weak else []), now, *([c(f"{name}_w1")] if len(weak) > 1 else []))

    for name, unknown in (("title", ""), ("company", "unknown"), ("location", "unknown"), ("role_family", "unknown")):
        good = lambda v, u=unknown: F.coalesce((F.trim(v) != "") & (F.lower(F.trim(v)) != u), F.lit(False))
        pick(name, c(name), good(c(name)), c(f"now.{name}"), good(c(f"now.{name}")), F.trim(c(name)) != "")
    pick("region", c("region"), c("region").isNotNull(), c("now.region"), c("now.region").isNotNull())
    for name in ("work_mode", "employment_type"):
        good = lambda v: F.coalesce(v != "UNKNOWN", F.lit(False))
        pick(name, c(name), good(c(name)), c(f"now.{name}"), good(c(f"now.{name}")), c(name).isNotNull(), c(name).isNotNull())
    url, now_url = F.trim("apply_url"), F.trim("now.apply_url")
    pick("apply_url", url, F.coalesce(url != "", F.lit(False)), now_url, F.coalesce(now_url != "", F.lit(False)))
    pay, now_pay = F.struct("salary_min", "salary_max"), F.struct("now.salary_min", "now.salary_max")
    pick("pay", pay, F.coalesce("salary_min", "salary_max").isNotNull(), now_pay, F.coalesce("now.salary_min", "now.salary_max").isNotNull())
    sums = rows.groupBy("target").agg(*[v.alias(k) for k, v in found.items()], F.min("posted_at").alias("posted"), F.min("deadline").alias("due"), F.max("rank").alias("top"), F.count("*").alias("n_merged"))
    ends = described(rows, known).where("described is not null")
    texts = rows.select("target", F.col("arrival").alias("described"), F.col("description").alias("said")).join(ends, ["target", "described"])
    k = known.select(F.col("id").alias("target"), F.struct(*known.columns).alias("now")).join(sums, "target", "left").join(texts.select("target", "said"), "target", "left")
    return k.select(
        F.col("target").alias("id"), *[out[n].alias(n) for n in ("title", "company", "location", "role_family", "region", "work_mode", "employment_type")], F.coalesce("said", "now.description").alias("description"), out["apply_url"].alias("apply_url"),
        out["pay"]["salary_min"].alias("salary_min"), out["pay"]["salary_max"].alias("salary_max"), F.least("now.posted_at", "posted").alias("posted_at"), F.least("now.deadline", "due").alias("deadline"),
        F.greatest("now.rank", "top").alias("rank"), F.coalesce("n_merged", F.lit(0)).alias("n_merged"),
    )
