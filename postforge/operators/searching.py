"""Search by words: an inverted table of stemmed terms, kept current by postings, and ranked hits of a query."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postforge.functions import rules as R
from postforge.functions.text import let
from postforge.operators.feed import search_terms
from postforge.sources.store import Store, Table

_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_SHORT = f"(?:{_OTHER}{_VOWEL}[^aeiouywxY]|^{_VOWEL}{_OTHER})$"


def table(buckets: int = 64) -> Table:
    """The index as a table of a store: a bucket holds all terms of its postings, sorted, so that a prefix is a range of its file."""
    return Table("id long, term string, weight int", ["id"], buckets, many=True, order=("term",))


def _region(w: Column, whole: list[str] = ()) -> Column:
    """How much of w stands before the region behind the first vowel and the letter after it; all of it if there is none."""
    n = F.length(F.regexp_extract(w, f"^(?:{'|'.join([*whole, f'.*?{_VOWEL}{_OTHER}'])})", 0))
    return F.when(n > 0, n).otherwise(F.length(w))


def _ending(w: Column, endings: list[str]) -> Column:
    """The longest of these that w ends with, empty if none; two of them only behind certain letters."""
    behind = {"li": "(?<=[cdeghkmnrt])li", "ogi": "(?<=l)ogi", "ion": "(?<=[st])ion"}
    return F.regexp_extract(w, f"(?:{'|'.join(behind.get(e, e) for e in endings)})$", 0)


def stem(word: Column) -> Column:
    """The English stem of a lower-case word (Porter's second stemmer); words of one or two letters and those with a digit stay.

    Built-in expressions only. Every step's result is bound by let(): a filter on stems that is pushed below them would otherwise write each step out anew wherever the next one names it.
    """
    cut = lambda w, e: F.substring(w, F.lit(1), F.length(w) - F.length(e))
    less = lambda w, n: F.substring(w, F.lit(1), F.length(w) - n)
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])

    def step(endings: list[str], then) -> Callable[[Column], Column]:
        """w to then(what stands before its ending, the ending), or w where that is null or there is no ending."""
        return lambda w: let(_ending(w, endings), lambda e: F.when(e == "", w).otherwise(F.coalesce(let(cut(w, e), lambda b: then(b, e)), w)))

    def plural(w: Column) -> Column:
        return F.when(w.endswith("sses"), less(w, 2)).when(w.rlike("..(?:ied|ies)$"), less(w, 2)).when(w.rlike("(?:ied|ies)$"), less(w, 1)).when(w.rlike("(?:us|ss)$"), w).when(w.rlike(f"{_VOWEL}.+s$"), less(w, 1)).otherwise(w)

    def steps(w: Column, p1: Column, p2: Column) -> Column:
        mended = lambda b: F.when(b.rlike("(?:at|bl|iz)$"), F.concat(b, F.lit("e"))).when(b.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), less(b, 1)).when((F.length(b) == p1) & b.rlike(_SHORT), F.concat(b, F.lit("e"))).otherwise(b)
        to = lambda m, b, e, p: F.when(F.length(b) >= p, F.concat(b, table(m)[e]))
        chain = [
            step(["eed", "eedly", "ed", "edly", "ing", "ingly"], lambda b, e: F.when(e.isin("eed", "eedly"), F.when(F.length(b) >= p1, F.concat(b, F.lit("ee")))).when(b.rlike(_VOWEL), mended(b))),
            lambda w: F.regexp_replace(w, f"(?<=.{_OTHER})[yY]$", "i"),
            step(list(R.STEM_ENDINGS_2), lambda b, e: to(R.STEM_ENDINGS_2, b, e, p1)),
            step(list(R.STEM_ENDINGS_3), lambda b, e: to(R.STEM_ENDINGS_3, b, e, F.when(e == "ative", p2).otherwise(p1))),
            step(R.STEM_ENDINGS_4, lambda b, e: F.when(F.length(b) >= p2, b)),
            step(["e", "l"], lambda b, e: F.when((F.length(b) >= p2) & ((e == "e") | b.endswith("l")), b).when((e == "e") & (F.length(b) >= p1) & ~b.rlike(_SHORT), b)),
        ]
        return F.when(w.isin(R.STEM_KEPT), w).otherwise(F.lower(reduce(let, chain, w)))

    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), f"({_VOWEL})y", "$1Y")
    made = let(marked, lambda m: let(_region(m, R.STEM_BEGINNINGS), lambda p1: let(p1 + _region(F.substring(m, p1 + 1, F.length(m))), lambda p2: let(plural(m), lambda w: steps(w, p1, p2)))))
    return F.when((F.length(word) <= 2) | word.rlike("[0-9]"), word).otherwise(F.coalesce(table(R.STEM_EXCEPTIONS)[word], made))


def terms(jobs: DataFrame) -> DataFrame:
    """id, term, weight: the stems of each posting's title, company, role family and location, each with the weight of the best place where it stands.

    Words are runs of letters and digits; those of R.SEARCH_STOP_WORDS don't count. A posting without words has one row without a term, which takes what an index has of it.
    """
    words = lambda c: F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ")
    placed_at = lambda c, n: F.transform(words(F.col(c)), lambda x: F.struct(x.alias("word"), F.lit(n).alias("weight")))
    placed = F.concat(*[placed_at(c, n) for c, n in R.SEARCH_WEIGHTS.items()])
    told = F.filter(placed, lambda x: (x["word"] != "") & ~x["word"].isin(R.SEARCH_STOP_WORDS))
    rows = jobs.select("id", F.explode_outer(told).alias("x")).select("id", "x.word", "x.weight")
    return rows.select("id", stem(F.col("word")).alias("term"), "weight").groupBy("id", "term").agg(F.max("weight").cast("int").alias("weight"))


def refresh(store: Store, jobs: DataFrame, name: str = "terms", stream: str | None = None, number: int | None = None) -> int | None:
    """Postings that are new or changed take the place of what the index has of them; only their buckets are written."""
    return store.commit(lambda at: {name: terms(jobs)}, stream, number)


def prefixes(df: DataFrame, query: str) -> list[str]:
    """What a query's words (twelve at most) must begin with: their stems, without stop words."""
    said = [t for t in (x.lower() for x in search_terms(query)) if t not in R.SEARCH_STOP_WORDS]
    rows = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, word string")
    return [r["stem"] for r in rows.select("i", stem(F.col("word")).alias("stem")).orderBy("i").collect()]


def search(index: DataFrame, jobs: DataFrame, query: str) -> DataFrame:
    """jobs in which a term begins with each of the query's stems, and rank: the weights of the best such terms, added up, in tenths.

    index: rows of terms(). If nothing is hit, those whose title, company or role family holds the query as it is, with rank 0. A query without words hits nothing.
    """
    if not search_terms(query):
        return jobs.withColumn("rank", F.lit(0).cast("long")).where(F.lit(False))
    begin = prefixes(index, query)
    if begin:
        met = index.where(reduce(lambda a, b: a | b, [F.col("term").startswith(p) for p in begin]))
        best = [F.max(F.when(F.col("term").startswith(p), F.col("weight"))).alias(f"_{i}") for i, p in enumerate(begin)]
        found = met.groupBy("id").agg(*best).select(F.col("id").alias("_hit"), reduce(lambda a, b: a + b, [F.col(f"_{i}") for i in range(len(begin))]).cast("long").alias("rank")).where("rank IS NOT NULL")
        hits = jobs.join(found, F.col("id") == F.col("_hit")).drop("_hit")
        if not hits.isEmpty():
            return hits
    holds = reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(query.lower()) for c in ("title", "company", "role_family")])
    return jobs.where(holds).withColumn("rank", F.lit(0).cast("long"))
