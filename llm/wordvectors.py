"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with a temperature.

A piece of a text (a run of letters, of digits or of signs) falls into a slot by its hash. Every slot has a fixed sparse
index vector of a few +1 and -1; its word vector is the sum of the index vectors of what stands around it, over the whole
corpus. So pieces that stand in like surroundings get like vectors, whether a labelled document holds them or not.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import slices, table, texts

#: Slots of the vectors, their length, how many places of an index vector aren't 0, and how far surroundings reach.
SLOTS, DIM, PLACES, REACH = 1 << 14, 32, 4, 2
#: Labelled documents that the network is fitted on at most: those with the smallest hashes of doc_id; every fourth sets the temperature.
FIT_DOCS = 4000
HIDDEN, STEPS, RATE, DECAY, SEED = 24, 600, 0.02, 1e-4, 13
#: predicted is 1 from this score on.
GOOD = 0.7
PIECE = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\s]+")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of each slot the places of its index vector that aren't 0, and their signs."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (SLOTS, PLACES)), rng.choice(np.array([-1.0, 1.0]), (SLOTS, PLACES))


def pieces(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all pieces of the texts, one text after the other, and how many each text has."""
    slot: dict[bytes, int] = {}
    out, n = [], []
    for t in raw:
        found = PIECE.findall(t)
        n.append(len(found))
        for w in found:
            if w not in slot:
                slot[w] = zlib.crc32(w) % SLOTS
        out.append(np.array([slot[w] for w in found], np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64), np.array(n, np.int64)


def _surroundings(x: np.ndarray, n: np.ndarray, at: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """What the texts add to each slot's word vector: the index vectors of the piece itself and of those up to REACH away in the same text."""
    text = np.repeat(np.arange(len(n)), n)
    total = np.zeros(SLOTS * DIM)
    for apart in range(-REACH, REACH + 1):
        a, b = max(0, -apart), min(len(x), len(x) - apart)
        if b <= a:
            continue
        same = text[a:b] == text[a + apart : b + apart]
        here, there = x[a:b][same], x[a + apart : b + apart][same]
        for k in range(PLACES):
            total += np.bincount(here * DIM + at[there, k], sign[there, k], SLOTS * DIM)
    return total.reshape(SLOTS, DIM)


def word_vectors(docs: DataFrame) -> DataFrame:
    """One row (slot, v0, v1 …) for each slot that occurs in the texts of docs, with whole numbers; tasks add up what they see before the shuffle, and a slot has one row per task there."""
    at, sign = index_vectors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((SLOTS, DIM)), np.zeros(SLOTS, bool)
        for b in slices(batches):
            x, n = pieces(texts(b))
            total += _surroundings(x, n, at, sign)
            seen[x] = True
        rows = np.flatnonzero(seen)
        vectors = total[rows].astype(np.int64)
        for a in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(rows[a : a + 4096], pa.int32()), *(pa.array(c) for c in vectors[a : a + 4096].T)], ["slot", *(f"v{k}" for k in range(DIM))])

    parts = docs.select("text").mapInArrow(run, "slot int, " + ", ".join(f"v{k} long" for k in range(DIM)))
    return parts.groupBy("slot").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(DIM)))


def unit_vectors(sums: DataFrame) -> np.ndarray:
    """SLOTS x DIM: word vectors of length 1, without what all have in common. The table has SLOTS rows at most, whatever the corpus."""
    got = sums.toArrow()
    v = np.zeros((SLOTS, DIM))
    rows = got.column("slot").to_numpy()
    if not len(rows):
        return v.astype(np.float32)
    own = np.stack([got.column(f"v{k}").to_numpy() for k in range(DIM)], 1).astype(float)
    own /= np.maximum(1e-9, np.linalg.norm(own, axis=1, keepdims=True))
    own -= own[np.argsort(rows)].mean(0)
    v[rows] = own / np.maximum(1e-9, np.linalg.norm(own, axis=1, keepdims=True))
    return v.astype(np.float32)


def pooled(raw: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Per text the mean and the spread of its pieces' vectors, how alike neighbours at most REACH apart are on average, and the logarithm of the number of pieces; zeros for a text without a piece."""
    x, n = pieces(raw)
    out, start = np.zeros((len(raw), 2 * DIM + REACH + 1)), np.cumsum(n) - n
    for k in range(len(raw)):
        if n[k]:
            v = vectors[x[start[k] : start[k] + n[k]]]
            out[k, :DIM], out[k, DIM : 2 * DIM], out[k, -1] = v.mean(0, dtype=np.float64), v.std(0, dtype=np.float64), np.log1p(n[k])
            for j in range(1, min(REACH + 1, len(v))):
                out[k, 2 * DIM + j - 1] = np.einsum("ij,ij->", v[j:], v[:-j], dtype=np.float64) / (len(v) - j)
    return out


class Network:
    """Sigmoid over tanh over standardized pooled vectors. Without both classes (net is None) every text scores the share of good ones; so does a text without a piece."""

    def __init__(self, share: float):
        self.share, self.net, self.temperature = share, None, 1.0

    def margin(self, f: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.net
        return np.tanh((f - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, f: np.ndarray) -> np.ndarray:
        out = np.full(len(f), self.share)
        some = f[:, -1] > 0
        if self.net is not None and some.any():
            out[some] = 1 / (1 + np.exp(-np.clip(self.margin(f[some]) / self.temperature, -30, 30)))
        return out


def fit(f: np.ndarray, y: np.ndarray) -> Network:
    """Trains on three quarters of the rows and sets the temperature (1 at least) on the rest. The share of good rows has one of either kind added."""
    m = Network((float(y.sum()) + 1) / (len(y) + 2))
    some = f[:, -1] > 0
    f, y = f[some], y[some].astype(float)
    held = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[~held])) < 2 or not held.any():
        return m
    x, t = f[~held], y[~held]
    m.mean, m.scale = x.mean(0), x.std(0) + 1e-6
    rng = np.random.default_rng(SEED)
    x = (x - m.mean) / m.scale
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for step in range(1, STEPS + 1):
        h = np.tanh(x @ p[0] + p[1])
        g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t) / len(t)
        dh = g[:, None] * p[2] * (1 - h * h)
        for q, d, a, b in zip(p, [x.T @ dh + DECAY * p[0], dh.sum(0), h.T @ g + DECAY * p[2], g.sum(keepdims=True)], first, second, strict=True):
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    m.net = p
    z, t = m.margin(f[held]), y[held]
    tried = np.exp(np.linspace(0, 3, 61))
    m.temperature = float(min(tried, key=lambda k: np.logaddexp(0, z / k).mean() - (t * z / k).mean()))
    return m


def learnable(docs: DataFrame) -> DataFrame:
    """Adds held_out: crc32 of doc_id as text, mod 4, is 2 (false for a null doc_id, which has no label either)."""
    rest = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4
    return docs.withColumn("held_out", F.coalesce(rest == 2, F.lit(False)))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, fit_docs: int = FIT_DOCS) -> Network:
    """A network from at most fit_docs labelled documents that aren't held out; labels other than 0 and 1 are passed over, of several for one id the smallest counts.

    Tasks pool the documents; only vectors of fixed length come to the driver. A bound on the hash, by the number of labelled ids, keeps tasks from sending many more ids than are taken.
    """
    known = learnable(labels).where("doc_id is not null and quality in (0, 1) and not held_out").groupBy("doc_id").agg(F.min("quality").alias("_y")).withColumn("_h", F.xxhash64("doc_id"))
    n = known.count()
    if n > fit_docs:
        known = known.where(F.pmod(F.xxhash64("_h"), F.lit(n)) < int(fit_docs + 6 * fit_docs**0.5))
    ids = sorted((r["_h"], r["doc_id"], r["_y"]) for r in known.collect())[:fit_docs]
    if not ids:
        return Network(0.5)
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("_y", T.IntegerType())])
    chosen = docs.sparkSession.createDataFrame([(d, y) for _, d, y in ids], kind)
    packed = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_y"), pa.array(pooled(texts(b), packed.value).tolist(), pa.list_(pa.float64()))], ["doc_id", "_y", "f"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(run, kind.add("f", T.ArrayType(T.DoubleType())))
    # an id that many rows share counts once: with its least vector
    got = rows.groupBy("doc_id", "_y").agg(F.min("f").alias("f")).collect()
    if not got:
        return Network(0.5)
    got.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return fit(np.array([r["f"] for r in got]), np.array([r["_y"] for r in got]))


def score(docs: DataFrame, vectors: np.ndarray, model: Network) -> DataFrame:
    """Adds score and predicted to every row of docs by its whole text; nothing but the text counts.

    Null and empty texts, and texts of white space only, score the share of good documents among those learned from. A text stands whole in its worker, at some thirty times its bytes.
    Columns of docs with the added names are replaced; repeated rows stay.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps((vectors, model)))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = pickle.loads(packed.value)
        for b in slices(batches):
            s = m.scores(pooled(texts(b), v))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= GOOD).astype(np.int32), pa.int32())], [*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by its whole text; word vectors come from all texts, labels only from documents that aren't held out.

    Null and empty texts score the share of good ones; a null doc_id is scored like any other, repeated rows stay. Without labels every score is 0.5.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = unit_vectors(word_vectors(docs))
    out = score(learnable(docs), vectors, train(docs, table(spark, sf_dir, "labels"), vectors))
    return out.select("doc_id", "held_out", "score", "predicted")
