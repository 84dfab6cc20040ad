"""From raw documents to token ids: five of the text operators, one after the other.

Each stage takes what the one before kept, written as Parquet in the shared folder, and all but the last return the
columns of `documents`.
"""

from __future__ import annotations

import math

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import bpe, decontaminate, langid, minhash, suffix
from llm.common import shared_dir, table

#: A text of at least LETTERS letters has to make its language MARGIN (a natural logarithm) likelier than the next one, on the mean of its windows; otherwise its language counts as unknown. Shorter texts stay whatever their language.
LETTERS, MARGIN = 80, math.log(1.25)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null texts among them), and those of LETTERS letters or more between whose two likeliest languages the odds are below MARGIN, go; lang becomes the predicted one.

    How many languages were learned makes no difference; with one only, nothing is rejected for its margin. Repeated rows stay or go together.
    """
    found = langid.predict(docs, langid.train(docs))
    short = F.length(F.regexp_replace("text", r"\P{L}", "")) < LETTERS
    found = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.coalesce(F.col("lang_margin") >= MARGIN, F.lit(True)) | short))
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that with the smallest doc_id. Null texts and null ids stay; rows that share a doc_id stay or go together."""
    return minhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that stand in two places are taken out of the texts; n_chars follows. No row goes; a null text stays null, an emptied one stays empty."""
    return suffix.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of a benchmark item in a row go. Null and empty texts stay; an empty benchmark takes nothing out."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the text that the ids decode to. A null text is empty."""
    return bpe.encode_checked(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE", encode_tokens),
]

#: The trained model and the tokenizer have no SQL; tests hold the pipeline against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the others return is written below the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
