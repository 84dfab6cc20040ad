"""Language identification by a small convolutional network over bytes, written and trained in numpy.

Bytes are folded into 64 classes; filters of several widths run over windows of fixed length, the largest
response of each goes through a softmax layer, and a text's windows vote with their mean log probability.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import slices, table, texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Documents that the model is fitted on at most (one of each language at least), chosen by hashes in equal shares.
FIT_DOCS = 2000
STEPS, BATCH, RATE, SEED = 500, 64, 0.01, 7
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def byte_classes() -> np.ndarray:
    """64 classes: white space and the rest of ASCII, digits, punctuation, 26 letters in either case, three kinds of lead bytes, 32 kinds of others."""
    c = np.zeros(256, np.uint8)
    c[33:127] = 2
    c[48:58] = 1
    for i in range(26):
        c[65 + i] = c[97 + i] = 3 + i
    c[0xC0:0xE0], c[0xC3], c[0xE0:] = 29, 30, 31
    c[0x80:0xC0] = 32 + (np.arange(0x80, 0xC0) & 31)
    return c


CLASSES = byte_classes()


def windows(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Class matrix of all windows (short ends filled with white space), and how many each text has (one at least)."""
    n = np.array([max(1, -(-len(t) // WINDOW)) for t in raw])
    joined = b"".join(t.ljust(k * WINDOW) for t, k in zip(raw, n.tolist(), strict=True))
    return CLASSES[np.frombuffer(joined, np.uint8)].reshape(-1, WINDOW), n


class Model:
    def __init__(self, langs: list[str], rng: np.random.Generator):
        self.langs = langs
        self.w = [rng.normal(0, 0.3, (k, 64, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def pooled(self, x: np.ndarray, where: bool = False):
        """Largest responses (windows, filters), cut off at 0; with `where`, their positions too."""
        top, at = [], []
        for k, w, b in zip(WIDTHS, self.w, self.b, strict=True):
            t = WINDOW - k + 1
            r = w[0].take(x[:, :t], axis=0)
            for j in range(1, k):
                r += w[j].take(x[:, j : t + j], axis=0)
            if where:
                i = r.argmax(1)
                at.append(i)
                top.append(np.take_along_axis(r, i[:, None], 1)[:, 0] + b)
            else:
                top.append(r.max(1) + b)
        h = np.maximum(np.concatenate(top, 1), 0)
        return (h, at) if where else h

    def fold_pairs(self) -> None:
        """Tables of two classes at once, which halve the look-ups; the responses stay the same."""
        self.pairs = [[(w[j][:, None] + w[j + 1][None]).reshape(4096, FILTERS) for j in range(0, k - 1, 2)] + ([w[k - 1]] if k % 2 else []) for k, w in zip(WIDTHS, self.w, strict=True)]

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.langs)), np.float32)
        for a in range(0, len(x), 32):
            c = x[a : a + 32]
            two = c[:, :-1].astype(np.int32) * 64 + c[:, 1:]
            top = []
            for k, tables, b in zip(WIDTHS, self.pairs, self.b, strict=True):
                t, r = WINDOW - k + 1, None
                for j, tab in zip(range(0, k, 2), tables, strict=True):
                    part = tab.take(two[:, j : j + t] if len(tab) == 4096 else c[:, j : j + t], axis=0)
                    r = part if r is None else np.add(r, part, out=r)
                top.append(r.max(1) + b)
            z = np.maximum(np.concatenate(top, 1), 0) @ self.out + self.bias
            z -= z.max(1, keepdims=True)
            out[a : a + 32] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out


def fit(rows: list[tuple[bytes, str]], seed: int = SEED) -> Model | None:
    """Trains on (text, language), on all windows of whole texts; None without rows. Batches draw each language equally often, and of its windows each with the same chance."""
    rows = [(t, lang) for t, lang in rows if t.strip()]
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    by: list[list[np.ndarray]] = [[] for _ in langs]
    for t, lang in rows:
        by[langs.index(lang)].append(windows([t])[0])
    data = [np.concatenate(v) for v in by]
    m = Model(langs, rng)
    params = [*m.w, *m.b, m.out, m.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        y = rng.integers(0, len(langs), BATCH)
        x = np.stack([data[c][rng.integers(len(data[c]))] for c in y])
        h, at = m.pooled(x, where=True)
        z = h @ m.out + m.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(BATCH), y] -= 1
        p /= BATCH
        dh = (p @ m.out.T) * (h > 0)
        gw, gb = [np.zeros_like(w) for w in m.w], []
        for i, (k, g) in enumerate(zip(WIDTHS, gw, strict=True)):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(k):
                np.add.at(g[j], (np.take_along_axis(x, at[i] + j, 1), np.arange(FILTERS)[None]), d)
            gb.append(d.sum(0))
        for q, g, a, b in zip(params, [*gw, *gb, h.T @ p, p.sum(0)], first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    m.fold_pairs()
    return m


def learnable(docs: DataFrame) -> DataFrame:
    """Adds held_out: crc32 of doc_id as text, mod 3, is 1 (false for a null doc_id, which is not learned from either)."""
    rest = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3
    return docs.withColumn("held_out", F.coalesce(rest == 1, F.lit(False)))


def train(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model | None:
    """A model from documents with text, language and doc_id that aren't held out: of each language an equal share of fit_docs (one at least), or all of a rarer one.

    Whole texts of those documents are brought to the driver. They are the least by a hash of doc_id and text. A bound on the hash, by each language's number of distinct documents,
    keeps tasks from sending the driver many more; it is so wide that the share is there although that number is an estimate.
    """
    own = learnable(docs).where("not held_out and doc_id is not null and lang is not null").where(F.col("text").rlike(r"\S")).select(F.xxhash64("doc_id", "text").alias("_h"), "text", "lang")
    found = own.groupBy("lang").agg(F.approx_count_distinct("_h", 0.02).alias("n"))
    langs = found.collect()
    if not langs:
        return None
    share = max(1, fit_docs // len(langs))
    wide = int(1.2 * share + 4 * share**0.5) + 8
    bound = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], max(1, r["n"])) for r in langs], "_lang string, _n long"))
    chosen = own.join(bound, F.col("lang") == F.col("_lang")).where(F.pmod("_h", "_n") < wide)
    chosen = chosen.select("_h", F.col("text").alias("t"), "lang").distinct()
    rows, taken = [], Counter()
    for h, t, lang in sorted((r["_h"], r["t"], r["lang"]) for r in chosen.collect()):
        taken[lang] += 1
        if taken[lang] <= share:
            rows.append((t, lang))
    return fit([(t.encode(), lang) for t, lang in rows])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred, lang_score, lang_margin to every row of docs by its whole text.

    Null texts and texts without a letter: `und`, 0, null. Without a model (nothing to learn from) all: `und`, 0, null.
    The score is the mean probability that the text's windows give lang_pred; of equal languages the first by name wins.
    The margin is by how much lang_pred's mean log probability is above the next language's, null if only one was learned: unlike the score it means the same whatever the number of languages.
    Columns of docs with the added names are replaced; repeated rows stay.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "lang_score", "lang_margin")])
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_margin", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(packed.value)
        for b in slices(batches):
            raw = texts(b)
            lang, score, margin = [UNKNOWN] * len(raw), [0.0] * len(raw), [None] * len(raw)
            known = [i for i, t in enumerate(raw) if m is not None and LETTER.search(t.decode("utf-8", "replace"))]
            if known:
                x, n = windows([raw[i] for i in known])
                lp = m.log_probs(x)
                ends = np.cumsum(n)
                mean = np.add.reduceat(lp, ends - n, axis=0) / n[:, None]
                best = mean.argmax(1)
                sure = np.add.reduceat(np.exp(lp), ends - n, axis=0)[np.arange(len(n)), best] / n
                two = np.sort(mean, 1)[:, -2:]
                ahead = (two[:, -1] - two[:, 0]).tolist() if len(m.langs) > 1 else [None] * len(n)
                for i, k, s, a in zip(known, best.tolist(), sure.tolist(), ahead, strict=True):
                    lang[i], score[i], margin[i] = m.langs[k], min(1.0, s), a
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], [*b.schema.names, "lang_pred", "lang_score", "lang_margin"])

    return docs.mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by its whole text. Null texts and texts without a letter: `und`, 0. A null doc_id is not held out and is learned from by nobody; repeated rows stay."""
    docs = table(spark, sf_dir, "documents")
    out = predict(learnable(docs.select("doc_id", "text")), train(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
