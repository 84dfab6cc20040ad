"""Quality rules: counted text statistics with fixed limits, and a calibrated logistic regression over hashed word and character n-grams."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import slices, table, texts

SYMBOLS = b"#*$%&|<>"
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document stays if its calibrated probability of good quality is at least this.
KEEP = 0.3
#: Labelled documents that the model is fitted on at most: those with the smallest hashes of doc_id; every fourth calibrates.
FIT_DOCS = 2000
BITS = 15
KINDS = 3  # words, word pairs, character 4-grams
STEPS, RATE, DECAY, SEED = 80, 0.5, 1e-5, 11


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of REPEAT_WINDOW words found twice or more in the text."""
    n = len(ids) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    own = _mix(ids + 1) * np.uint64(0xBF58476D1CE4E5B9)
    own ^= own >> np.uint64(31)
    h = np.zeros(n, np.uint64)
    for j in range(REPEAT_WINDOW):
        h = h * np.uint64(0x100000001B3) + own[j : j + n]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    step = np.zeros(len(ids) + 1, np.int32)
    step[:n] += twice
    step[REPEAT_WINDOW : n + REPEAT_WINDOW] -= twice
    return int((np.cumsum(step)[:-1] > 0).sum())


def statistics(raw: bytes) -> tuple[int, int, int, int, int, np.ndarray, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; then each word's number and each number's crc32."""
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    chars = len(raw.decode("utf-8", "replace")) - (len(raw) - len(raw.translate(None, SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    crc = np.array([zlib.crc32(w) for w in number], np.uint64)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(ids), ids, crc


def features(raw: bytes, ids: np.ndarray, crc: np.ndarray) -> list[np.ndarray]:
    """Places in the weight table of the text's words, word pairs and 4-grams of characters (code points)."""
    shift, out = np.uint64(64 - BITS), []
    of = crc[ids] if len(ids) else np.empty(0, np.uint64)
    out.append((of * np.uint64(0x9E3779B97F4A7C15)) >> shift)
    out.append(((of[:-1] * np.uint64(31) + of[1:]) * np.uint64(0xD6E8FEB86659FD93)) >> shift)
    c = np.frombuffer(raw if raw.isascii() else raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint8 if raw.isascii() else np.uint32).astype(np.uint32)
    n = max(0, len(c) - 3)
    four = c[:n].copy()
    for j in (1, 2, 3):
        four *= np.uint32(0x01000193)
        four ^= c[j : n + j]
    out.append((four * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    return [np.asarray(x, np.int64) if x.dtype != np.uint32 else x for x in out]


class Model:
    """weights[kind, place]; a kind counts with the mean of its n-grams' weights."""

    def __init__(self) -> None:
        self.weights = np.zeros((KINDS, 1 << BITS), np.float32)
        self.bias, self.slope, self.offset = 0.0, 1.0, 0.0

    def margin(self, parts: list[np.ndarray]) -> float:
        return self.bias + sum(float(w.take(p).mean()) for w, p in zip(self.weights, parts, strict=True) if len(p))

    def probability(self, parts: list[np.ndarray]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(parts) + self.offset, -30, 30))))


def _sparse(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place (over all kinds) and value of the rows' feature frequencies."""
    r, c, v = [], [], []
    for i, raw in enumerate(rows):
        *_, ids, crc = statistics(raw)
        for kind, part in enumerate(features(raw, ids, crc)):
            if len(part):
                places, n = np.unique(part, return_counts=True)
                r.append(np.full(len(places), i, np.int32))
                c.append(places.astype(np.int64) + (kind << BITS))
                v.append((n / len(part)).astype(np.float32))
    return np.concatenate(r), np.concatenate(c), np.concatenate(v)


def fit(rows: list[tuple[bytes, int]]) -> Model | None:
    """Logistic regression with the classes weighted alike, then a sigmoid fitted on the documents kept back. None if there is one class only."""
    rows = [(t, y) for t, y in rows if t.strip()]
    part = [[x for i, x in enumerate(rows) if (i % 4 == 3) == kept] for kept in (False, True)]
    if any(len({y for _, y in p}) < 2 for p in part):
        return None
    m = Model()
    r, c, v = _sparse([t for t, _ in part[0]])
    y = np.array([q for _, q in part[0]], np.float32)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    w, bias = np.zeros(KINDS << BITS, np.float32), 0.0
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.bincount(r, v * w[c], len(y)) + bias
        g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share).astype(np.float32)
        grad = np.bincount(c, v * g[r], len(w)).astype(np.float32) + DECAY * w
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        bias -= 0.5 * float(g.sum())
    m.weights, m.bias = w.reshape(KINDS, -1), bias
    z, y = np.array([m.margin(features(t, *statistics(t)[-2:])) for t, _ in part[1]]), np.array([q for _, q in part[1]], float)
    a, b = 1.0, 0.0
    scale = max(1e-9, np.abs(z).std() + np.abs(z).mean())
    for _ in range(2000):  # Platt's two parameters, on margins of unit size
        p = 1 / (1 + np.exp(-np.clip(a * z / scale + b, -30, 30)))
        a -= 0.5 * float(((p - y) * z / scale).mean() + 1e-3 * a)
        b -= 0.5 * float((p - y).mean())
    m.slope, m.offset = a / scale, b
    return m


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model | None:
    """A model from the whole texts of at most fit_docs labelled documents; labels other than 0 and 1 and null ids are passed over.

    The ids are chosen before the texts are read, and there are at most fit_docs of them to broadcast.
    """
    chosen = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.encode("text", "UTF-8").alias("t"), "quality").orderBy(F.xxhash64("doc_id"), "t").limit(fit_docs).collect()
    return fit([(bytes(r["t"]), r["quality"]) for r in rows])


ADDED = ["n_words long", "word_chars long", "n_symbols long", "n_dup_lines long", "n_repeat_words long", "base_failed boolean", "quality double", "kept boolean"]


def judge(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """Adds the statistics, base_failed, quality and kept to every row of docs, over its whole text.

    Null texts have no words and fail. A text stands whole in its worker, with its words and the places of its n-grams: some thirty
    times its bytes. Without a model quality is null and the statistics decide alone.
    Columns of docs with the added names are replaced; repeated rows stay.
    """
    names = [a.split()[0] for a in ADDED]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(", ".join(ADDED)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(packed.value)
        for b in slices(batches):
            rows = []
            for raw in texts(b):
                n, chars, symbols, dup, repeat, ids, crc = statistics(raw)
                failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
                q = None if m is None else m.probability(features(raw, ids, crc))
                rows.append((n, chars, symbols, dup, repeat, failed, q, not failed and (q is None or q >= keep)))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by its whole text. Null and empty texts have no words and fail; a null doc_id is judged like any other, repeated rows stay. Labels without both classes leave the verdict to the statistics."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *[a.split()[0] for a in ADDED[:6]], "kept", "quality")
