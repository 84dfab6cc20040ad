"""Benchmark decontamination: documents' words against the windows of benchmark items, with DataFrame functions only.

Each window of an item is known by the hash of two neighbouring words, the pair that is rarest in the benchmark (a
template's words are common there, what fills it isn't). The pairs of the documents are looked up among those, and where
one is met the whole window is compared in place, so that only true occurrences leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import settled, table, text_hash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Words in a window.
WINDOW = 10
#: UTF-8 bytes of items up to which the windows are broadcast; those of larger benchmarks meet the documents' pairs in a shuffled join.
BROADCAST_BYTES = 4 << 20


def words(text: Column) -> Column:
    """Lower-cases A-Z and takes [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+; null has no words."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BREAKS), "")


def pair(w: Column, at: Column) -> Column:
    """Hash of the word at a 0-based place and the next one; behind the last word stands none."""
    return F.xxhash64(F.get(w, at), F.get(w, at + 1))


def benchmark_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per distinct window: key (of its rarest pair of neighbours, the first of equals; of a window of one word, that word alone), at (the pair's 0-based place), n, window, items (ids as strings)."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0 and item is not null")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    w = w.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i + 1, window))).alias("window"))
    w = w.groupBy("window").agg(F.collect_set("item").alias("items"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("window") - 2, F.lit(0))), lambda i: F.struct(F.when(F.size("window") > 1, pair(F.col("window"), i)).otherwise(F.xxhash64(F.get("window", i))).alias("key"), i.alias("at")))
    each = w.select("window", "items", F.explode(pairs).alias("p")).select("window", "items", "p.*")
    common = each.groupBy("key").agg(F.count("*").alias("uses"))
    best = each.join(common, "key").groupBy("window").agg(F.first("items").alias("items"), F.min(F.struct("uses", "at", "key")).alias("b"))
    return best.select("b.key", "b.at", F.size("window").alias("n"), "window", "items")


def _places(docs: DataFrame, single: bool) -> DataFrame:
    """doc_id, text_hash, w, p, key of every place in every document; with `single`, by one word instead of two."""
    place = docs.select("doc_id", text_hash().alias("text_hash"), words(F.col("text")).alias("w"))
    place = place.select("doc_id", "text_hash", "w", F.posexplode("w").alias("p", "word"))
    return place.withColumn("key", F.xxhash64("word") if single else F.xxhash64("word", F.get("w", F.col("p") + 1)))


def _true(met: DataFrame) -> DataFrame:
    """Of places that met a window's key, doc_id, text_hash, span, items of those where the whole window stands."""
    first = F.col("p") - F.col("at")
    hits = met.where((first >= 0) & (first + F.col("n") <= F.size("w")))
    hits = hits.where(F.slice(F.col("w"), F.greatest(first, F.lit(0)) + 1, F.col("n")) == F.col("window"))
    return hits.select("doc_id", "text_hash", F.struct(first.alias("first"), F.col("n")).alias("span"), "items")


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Occurrences of item windows, one row per document with any.

    docs needs doc_id and text. Returns doc_id, text_hash, spans (distinct structs of 0-based first
    word and length), items (distinct ids as strings, sorted).
    Rows equal in doc_id and text share one row here. Items with a null id or without words find nothing.
    One scan of the documents, and one more if an item is a single word. Items of up to broadcast_bytes are broadcast;
    else places travel as numbers to the windows' keys, and only documents where a key was met are read again.
    """
    texts = items.where(F.col("item_id").isNotNull())
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.max((F.size(words(F.col("text"))) == 1).cast("int")), F.lit(0))).first()
    found, hits = benchmark_windows(items, window), None
    for single in [False, True] if size[1] or window == 1 else [False]:
        some = found.where("n = 1" if single else "n > 1")
        if size[0] <= broadcast_bytes:
            met = _places(docs, single).join(F.broadcast(some), "key")
        else:
            keys = _places(docs, single).select("doc_id", "text_hash", "p", "key")
            near = keys.join(some, "key").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "p", "at", "n", "window", "items")
            own = docs.select("doc_id", text_hash().alias("text_hash"), words(F.col("text")).alias("w")).dropDuplicates(["doc_id", "text_hash"])
            met = own.join(near, own["doc_id"].eqNullSafe(near["_id"]) & (own["text_hash"] == near["_hash"]))
        hits = _true(met) if hits is None else hits.union(_true(met))
    return hits.groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds n_words, n_hit, hit_spans, hit_items to every row of docs (doc_id, text and any other columns).

    A null or empty text has no words and no hits. Equal rows each keep their row. A null doc_id is a
    document of its own text. Columns of docs named like the added ones are replaced.
    """
    added = ("n_words", "n_hit", "hit_spans", "hit_items")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    hits = find_hits(docs.select("doc_id", "text"), items, window)
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans"), F.col("items").alias("hit_items"))
    counted = docs.withColumn("n_words", F.size(words(F.col("text"))).cast("long")).withColumn("__text_hash", text_hash())
    out = counted.join(hits, counted["doc_id"].eqNullSafe(hits["_id"]) & (counted["__text_hash"] == hits["_hash"]), "left")
    places = F.flatten(F.transform(hits["spans"], lambda s: F.sequence(s["first"], s["first"] + s["n"] - 1)))
    none = F.array().cast("array<string>")
    return out.select(*[counted[c] for c in docs.columns], counted["n_words"], F.coalesce(F.size(F.array_distinct(places)), F.lit(0)).cast("long").alias("n_hit"), hits["spans"].alias("hit_spans"), F.coalesce(hits["hit_items"], none).alias("hit_items"))


def remove_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows that hold an occurrence; columns as they were. Null and empty texts stay; equal rows stay or go together."""
    hits = settled(find_hits(docs.select("doc_id", "text"), items, window).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "decontamination")
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["_id"]) & (text_hash() == hits["_hash"]), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items. Null and empty texts have no words and no hits, repeated rows each keep their row."""
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = "[x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> '']"

ORACLE = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(g) AS n, array_to_string(g, ' ') AS g FROM (
  SELECT item_id, unnest([list_slice(w, i, i + 9) for i in range(1, greatest(len(w) - 8, 2))]) AS g FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens)),
h AS (SELECT doc_id, p, dw.n AS n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM h)) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
