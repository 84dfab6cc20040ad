"""One poll of a source as a whole: what is accepted, where each posting goes, what is counted and what is withdrawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postforge.operators import matching, polls


def _staying(postings: DataFrame, before: DataFrame, known: DataFrame) -> DataFrame:
    """_kept, _where of postings that still fit where they were."""
    c = F.col
    n, k = matching.prepared(postings).alias("n"), matching.prepared(known).alias("k")
    return before.join(n, c("raw_id") == c("n.id")).join(k, c("canonical_id") == c("k.id")).where(matching.compatible("k", "n")).select(c("raw_id").alias("_kept"), c("canonical_id").alias("_where"))


def decide(postings: DataFrame, said: DataFrame, before: DataFrame, mappings: DataFrame, known: DataFrame) -> DataFrame:
    """id, reject_reason, decision, canonical_id, how, previous of each posting of a poll.

    postings: id and the keys of matching; said: id, reject_reason (null: accepted); before: raw_id, canonical_id of earlier polls; mappings, known: as for best_match().
    rejected: turned away. kept: where it was, since it still fits there. matched: with the best match. created: canonical_id is null, a new one is due. previous is where
    a posting was before if it isn't there any more. The poll is decided as one: its postings don't match what it creates; decide_in_order() has that.
    """
    c = F.col
    kept = lambda df, name: polls._kept(postings.sparkSession, df, name)  # noqa: E731 - each is read many times below
    said, same = kept(said.select("id", "reject_reason"), "said"), kept(_staying(postings, before, known), "staying")
    open_ = kept(postings.join(said.where("reject_reason is null").select(c("id").alias("_ok")), c("id") == c("_ok"), "left_semi").join(same, c("id") == c("_kept"), "left_anti"), "open")
    best = matching.best_match(open_, mappings, known).select("new_id", "known_id", "how")
    df = said.select("id", "reject_reason").join(before, c("id") == c("raw_id"), "left").join(same, c("id") == c("_kept"), "left").join(best, c("id") == c("new_id"), "left")
    decision = F.when(c("reject_reason").isNotNull(), "rejected").when(c("_kept").isNotNull(), "kept").when(c("known_id").isNotNull(), "matched").otherwise("created")
    to = F.when(c("reject_reason").isNull(), F.coalesce("_where", "known_id"))
    how = F.when(c("reject_reason").isNull() & c("_kept").isNull(), c("how"))
    return df.select("id", "reject_reason", decision.alias("decision"), to.alias("canonical_id"), how.alias("how"), F.when(~c("canonical_id").eqNullSafe(to), c("canonical_id")).alias("previous"))


def decide_in_order(postings: DataFrame, said: DataFrame, before: DataFrame, mappings: DataFrame, known: DataFrame) -> DataFrame:
    """As decide(), but postings also match what those that came before them in the poll (by arrival) create; adds created_by.

    created: the posting makes a new row, created_by is its own id. matched with a null canonical_id: it belongs to the row that the posting created_by makes.
    """
    c = F.col
    kept = lambda df, name: polls._kept(postings.sparkSession, df, name)  # noqa: E731 - each is read many times below
    said = kept(said.select("id", "reject_reason"), "said")
    accepted = kept(postings.join(said.where("reject_reason is null").select(c("id").alias("_ok")), c("id") == c("_ok"), "left_semi"), "accepted")
    same = kept(_staying(accepted, before, known), "staying")
    settled = same.join(accepted.select("id"), c("_kept") == c("id"), "left_semi").select(c("_kept").alias("id"), c("_where").alias("canonical_id"))
    found = polls.resolve(accepted, settled, mappings, known).select(c("id").alias("_id"), c("canonical_id").alias("_to"), "created_by", "how")
    df = said.select("id", "reject_reason").join(before, c("id") == c("raw_id"), "left").join(found, c("id") == c("_id"), "left")
    own = c("created_by") == c("id")
    decision = F.when(c("reject_reason").isNotNull(), "rejected").when(own, "created").when(c("how").isNull(), "kept").otherwise("matched")
    return df.select("id", "reject_reason", decision.alias("decision"), c("_to").alias("canonical_id"), "created_by", "how", F.when(~c("canonical_id").eqNullSafe(c("_to")), c("canonical_id")).alias("previous"))


def metrics(decided: DataFrame) -> DataFrame:
    """The counts of a run, one row."""
    n = lambda *d: F.count_if(F.col("decision").isin(*d))
    return decided.agg(F.count("*").alias("fetched"), n("kept", "matched", "created").alias("accepted"), n("rejected").alias("rejected"), n("created").alias("created"), n("kept", "matched").alias("updated"), n("matched").alias("deduped"), F.count("previous").alias("moved"))


def dead_on_arrival(decided: DataFrame) -> DataFrame:
    """canonical_id of postings that were known and are now said to be dead."""
    return decided.where("reject_reason = 'obvious_dead_at_intake' AND previous IS NOT NULL").select(F.col("previous").alias("canonical_id")).distinct()


def unseen(mappings: DataFrame, seen: DataFrame, source: str, complete: bool, freshness: str) -> DataFrame:
    """Active mappings of a source that a poll didn't see: none unless the poll was a full snapshot taken to its end; all if it saw nothing."""
    m = mappings.where((F.col("source_name") == source) & F.col("removed_at").isNull() & F.lit(complete and freshness == "FULL_SNAPSHOT"))
    return m.join(seen.select(F.col("source_id").alias("_s")), F.col("source_id") == F.col("_s"), "left_anti")
