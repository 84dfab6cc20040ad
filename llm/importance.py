"""Importance resampling towards a target: documents are drawn by how much likelier their n-grams are in the target texts.

DuckDB cuts each slice of a partition into n-grams and counts them per bucket, the counts are written as Parquet, and Spark
adds them up, weighs the documents and draws the best by weight plus Gumbel noise, which is a draw without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import settled, slices, table

SEED, PERCENT, MIN_WORDS, BUCKETS, SHORTEST, LONGEST = "2024", 10, 20, 10_000, 1, 1

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ADDED = "n_words long, n_features long, buckets array<int>, counts array<long>"


def _counting(shortest: int, longest: int, buckets: int) -> str:
    """DuckDB SQL: of each row of `slice` (r, t) its words, its n-grams, and how many of them are in which bucket."""
    sizes = range(shortest, longest + 1)
    grown = ["w"] + [f"w || {' || '.join(chr(39) + ' ' + chr(39) + f' || lead(w, {k}) over o' for k in range(1, n))}" for n in range(2, longest + 1)]
    return f"""
        with words as (
            select r, unnest(w) w, generate_subscripts(w, 1) i from (select r, regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '{WORD}') w from slice where t is not null)
        ), grams as (select r, unnest([{", ".join(grown[n - 1] for n in sizes)}]) g from words window o as (partition by r order by i)),
        places as (select g, crc(g) % {buckets} b from (select distinct g from grams where g is not null)),
        counted as (select r, b, count(*) n from grams join places using (g) group by r, b),
        listed as (select r, sum(n)::bigint n_features, list(b::int order by b) buckets, list(n order by b) counts from counted group by r),
        long as (select r, count(*) n_words from words group by r)
        select coalesce(n_words, 0) n_words, coalesce(n_features, 0) n_features, coalesce(buckets, []) buckets, coalesce(counts, []) counts
        from slice left join long using (r) left join listed using (r) order by r"""


def _crc(words: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(w.encode()) for w in words.to_pylist()], pa.int64())


def counted(docs: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """Adds n_words, n_features and the counts per bucket to every row of docs, and leaves the text out. Null texts have no words."""
    rest = [c for c in docs.columns if c != "text"]
    sql, kinds = _counting(shortest, longest, buckets), T._parse_datatype_string(ADDED).fields
    schema = T.StructType([*(docs.schema[c] for c in rest), *kinds])
    arrow = pa.schema([("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        con.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
        for b in slices(batches):
            con.register("slice", pa.table({"r": pa.array(range(b.num_rows), pa.int64()), "t": b.column("text")}))
            out = con.sql(sql).to_arrow_table().select(arrow.names).cast(arrow).combine_chunks()
            con.unregister("slice")
            added = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in out.columns]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *added], names=schema.names)
        con.close()

    return docs.mapInArrow(run, schema)


def _totals(counts: DataFrame, name: str) -> DataFrame:
    """One row per bucket that occurs."""
    return counts.select(F.inline(F.arrays_zip("buckets", "counts"))).groupBy(F.col("buckets").alias("bucket")).agg(F.sum("counts").alias(name))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row per bucket: floor(1000 ln of how much likelier the bucket is in target than in docs, each with one added to every bucket); both are results of `counted`."""
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    every = every.join(_totals(docs, "s"), "bucket", "left").join(_totals(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    total = docs.agg(F.coalesce(F.sum("n_features"), F.lit(0)).alias("n")).scalar(), target.agg(F.coalesce(F.sum("n_features"), F.lit(0)).alias("n")).scalar()
    here, there = (F.col(c).cast("double") + 1 for c in "st")
    return every.select("bucket", F.floor(1000 * F.log(there * (total[0].cast("double") + buckets) / (here * (total[1].cast("double") + buckets)))).alias("gain"))


def scored(counts: DataFrame, gain: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds weight (floored mean gain of a document's n-grams; 0 without any) and score (weight plus noise from seed and doc_id; a null id is an empty one)."""
    table_ = gain.agg(F.sort_array(F.collect_list(F.struct("bucket", "gain")))["gain"].alias("g")).scalar()
    total = F.aggregate(F.zip_with("buckets", "counts", lambda b, n: n * F.element_at(F.col("_gain"), b + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    out = counts.withColumn("_gain", table_).withColumn("_total", total).drop("_gain", "buckets", "counts")
    out = out.withColumn("weight", F.expr("if(n_features = 0, 0, (_total - pmod(_total, n_features)) div n_features)").cast("long")).drop("_total")
    h = F.conv(F.substring(F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    return out.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """Every row of docs without its text, and n_words, n_features, weight, score and rank: 1, 2, 3 … for the drawn percentage of those with min_words words at least, else null.

    Equal scores go by doc_id, null last; of rows equal in both any may be drawn. Null and empty texts have no n-grams and are never drawn while min_words is positive; neither do they count.
    Without target texts a bucket's gain depends on docs alone. Columns of docs with the added names are replaced. A text stands whole in its worker.
    """
    own = {"n_words", "n_features", "buckets", "counts", "weight", "score", "rank", "_gain", "_total", "_score", "_above", "_draw"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in own])
    counts, goal = settled(counted(docs, shortest, longest, buckets), "importance-counts"), settled(counted(target.select("text"), shortest, longest, buckets), "importance-target")
    rows = settled(scored(counts, gains(counts, goal, buckets), seed), "importance-scores")
    # scores are whole numbers between some -40,000 and 60,000, however many documents there are: their counts fit in one task
    per = rows.where(F.col("n_words") >= min_words).groupBy(F.col("score").alias("_score")).agg(F.count("*").alias("n"))
    every = "rows between unbounded preceding and unbounded following"
    cut = per.select("_score", F.expr("sum(n) over (order by _score desc) - n").alias("_above"), F.expr(f"sum(n) over (order by _score desc {every}) * {percent} div 100").alias("_draw")).where("_above < _draw")
    met = rows.join(cut, (F.col("score") == F.col("_score")) & (F.col("n_words") >= min_words), "left")
    place = F.col("_above") + F.expr("row_number() over (partition by score order by doc_id nulls last)")
    best = met.where("_above is not null").withColumn("rank", place).withColumn("rank", F.expr("if(rank <= _draw, rank, null)"))
    return best.unionByName(met.where("_above is null").withColumn("rank", F.lit(None).cast("long"))).drop("_score", "_above", "_draw")


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id is drawn; rows that share a doc_id are drawn together, null ids never."""
    drawn = ranked(docs.select("doc_id", "text"), target, **options).where("rank is not null").select("doc_id").distinct()
    return docs.join(settled(drawn, "importance-drawn"), "doc_id", "left_semi")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, towards the benchmark's texts. Null texts have no words: weight 0, score from the id alone, no rank. Repeated rows count and are ranked each; a null doc_id is an empty one in the noise."""
    out = ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = rf"""
with recursive bits(k, v, i) as (
    select k, k, 0 from range(256) t(k)
    union all select k, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, i + 1 from bits where i < 8
), byte_table as (select k, v from bits where i = 8),
docs as materialized (select row_number() over () r, doc_id, text from documents),
doc_words as materialized (select r, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}')) w from docs),
goal_words as materialized (select unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}')) w from benchmark),
crc(w, h, i, c) as (
    select w, hex(encode(w)), 1, 4294967295 from (select w from doc_words union select w from goal_words)
    union all
    select w, h, i + 1, xor(c >> 8, v) from crc join byte_table on k = xor(c & 255, 16 * (instr('0123456789ABCDEF', substr(h, 2 * i - 1, 1)) - 1) + instr('0123456789ABCDEF', substr(h, 2 * i, 1)) - 1)
    where 2 * i <= length(h)
), place as materialized (select w, xor(c, 4294967295) % {BUCKETS} b from crc where 2 * (i - 1) = length(h)),
here as (select b, count(*) s from doc_words join place using (w) group by b),
there as (select b, count(*) t from goal_words join place using (w) group by b),
gain as (
    select b, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from doc_words)::double + {BUCKETS}) / ((coalesce(s, 0) + 1)::double * ((select count(*) from goal_words)::double + {BUCKETS}))))::bigint g
    from here full join there using (b)
), totals as (select r, count(*) n, sum(g)::bigint g from doc_words join place using (w) join gain using (b) group by r),
weighed as (
    select r, doc_id, coalesce(n, 0) n_features, case when n is null then 0 else (g - ((g % n) + n) % n) // n end weight,
        (instr('0123456789abcdef', substr(h, 1, 1)) - 1) * 268435456 + (instr('0123456789abcdef', substr(h, 2, 1)) - 1) * 16777216 + (instr('0123456789abcdef', substr(h, 3, 1)) - 1) * 1048576 + (instr('0123456789abcdef', substr(h, 4, 1)) - 1) * 65536
        + (instr('0123456789abcdef', substr(h, 5, 1)) - 1) * 4096 + (instr('0123456789abcdef', substr(h, 6, 1)) - 1) * 256 + (instr('0123456789abcdef', substr(h, 7, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, 8, 1)) - 1 v
    from (select *, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) h from docs) left join totals using (r)
), noisy as (select *, (weight + floor(-1000 * ln(-ln((v + 0.5::double) / 4294967296::double))))::bigint score from weighed),
drawn as (select r, row_number() over (order by score desc, doc_id nulls last) k, count(*) over () n from noisy where n_features >= {MIN_WORDS})
select doc_id, n_features::bigint n_features, weight::bigint weight, score, case when k <= n * {PERCENT} // 100 then k end::bigint "rank" from noisy left join drawn using (r)"""
