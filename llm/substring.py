"""Repeated passages of words by difference-cover anchors.

Of every PERIOD word places, those in COVER begin an anchor of GRAM words, and only anchors are hashed. For any
two places of equal windows some step of less than PERIOD leads from both to an anchor, and it is one and
the same text, so equal windows always share an anchor; from there the match is extended to whole windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import slices, table, text_hash, texts

WINDOW = 50
PERIOD = 31
#: Every remainder is the difference of two of these (fixed values: a perfect difference set).
COVER = (0, 1, 3, 8, 12, 18)
GRAM = WINDOW - PERIOD + 1
#: Anchors, or windows, that a task holds to find copies among them before the shuffle.
HELD = 300_000
#: Rows of one anchor that a task sends under the anchor's own key at a time; if it holds more, all but its extremes go elsewhere.
FEW = 8
NO_ID = -(2**63)

_COVERED = np.isin(np.arange(PERIOD), COVER)
_TO_SPACE = bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d", b"     ")


class Words:
    """A text's words, joined by one space, and where each begins and ends in that. No object per word: a text costs its bytes a few times over, and 16 bytes a word."""

    def __init__(self, raw: bytes):
        joined = raw.translate(_TO_SPACE)
        while b"  " in joined:
            joined = joined.replace(b"  ", b" ")
        self.joined = joined.strip(b" ")
        gaps = np.flatnonzero(np.frombuffer(self.joined, np.uint8) == 32)
        self.n = len(gaps) + 1 if self.joined else 0
        self.begin = np.concatenate([[0], gaps + 1])
        self.end = np.append(gaps, len(self.joined))


def around(p: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word, and last + 1, of all windows that hold the anchor at p in a text of n words."""
    return np.maximum(p - (WINDOW - GRAM), 0), np.minimum(p + WINDOW, n)


def anchors(w: Words) -> tuple[np.ndarray, list[int], list[int]]:
    """Places of the anchors that lie in a window, their hashes, and hashes of the words of all those windows with the anchor's place among them."""
    if w.n < WINDOW:
        return np.empty(0, np.int64), [], []
    p = np.arange(w.n - GRAM + 1)
    p = p[_COVERED[p % PERIOD]]
    a, z = around(p, w.n)
    view, key = memoryview(w.joined), xxhash.xxh3_64_intdigest
    keys = [key(view[x:y]) for x, y in zip(w.begin[p].tolist(), w.end[p + GRAM - 1].tolist(), strict=True)]
    near = [key(view[x:y], s) for x, y, s in zip(w.begin[a].tolist(), w.end[z - 1].tolist(), (p - a).tolist(), strict=True)]
    return p, keys, near


def _first_of_like(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row, whether a row with the same two hashes has a smaller document."""
    order = np.lexsort((doc, h2, h1))
    a, b, d = h1[order], h2[order], doc[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    least = d[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]
    out = np.empty(len(d), bool)
    out[order] = d > least
    return out


def _spread(doc: np.ndarray, th: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (doc * np.int64(31) ^ th) + place * np.int64(0x9E3779B97F4A7C1)


def _extremes(key: np.ndarray, near: np.ndarray, doc: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the open rows, which belong to keys with several surroundings and documents among them and more than FEW rows (known), and which of those hold the key's least or greatest of either (kept)."""
    known, kept = np.zeros(len(key), bool), np.zeros(len(key), bool)
    at = np.flatnonzero(open_)
    at = at[np.argsort(key[at], kind="stable")]
    start = np.flatnonzero(np.concatenate([[True], key[at][1:] != key[at][:-1]])) if len(at) else at
    size = np.diff(np.append(start, len(at)))
    at = at[np.repeat(size > FEW, size)]
    if not len(at):
        return known, kept
    size = size[size > FEW]
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    group, several = np.repeat(np.arange(len(size)), size), np.ones(len(size), bool)
    for values in (near[at], doc[at]):
        several &= np.minimum.reduceat(values, start) != np.maximum.reduceat(values, start)
        order = np.lexsort((values, group))
        kept[at[order[start]]] = kept[at[order[start + size - 1]]] = True
    known[at] = several[group]
    return known, kept & known


def anchor_rows(docs: DataFrame) -> DataFrame:
    """One row per anchor. Where a task has met the same surroundings in a smaller document, the row is settled, and its key is spread so that copies don't meet in one task.

    Where a task holds more than FEW rows of an anchor in different surroundings, that is known (several) before the
    shuffle: only the rows from which other tasks learn it keep the key, and the others go by key and surroundings. So an
    anchor that very many documents have in ever different surroundings sends each reader a few rows a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def pack() -> pa.RecordBatch:
            key, near, doc, th, p = (np.concatenate(c) for c in zip(*held, strict=True))
            settled = _first_of_like(key, near, doc)
            known, kept = _extremes(key, near, doc, ~settled)
            key = np.where(settled, _spread(doc, th, p), np.where(known & ~kept, key * np.int64(31) + near, key))
            cols = [key, np.where(settled, p, near), doc, th, p.astype(np.int32), settled, known]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "near", "doc_id", "th", "p", "settled", "known"])

        with np.errstate(over="ignore"):
            for b in slices(batches):
                for raw, doc, th in zip(texts(b), b.column("doc_id").to_pylist(), b.column("th").to_pylist(), strict=True):
                    p, key, near = anchors(Words(raw))
                    if len(p):
                        held.append((np.array(key, np.uint64).view(np.int64), np.array(near, np.uint64).view(np.int64), np.full(len(p), doc), np.full(len(p), th), p))
                        n += len(p)
                    if n > HELD:
                        yield pack()
                        held, n = [], 0
            if held:
                yield pack()

    return docs.select("doc_id", "th", "text").mapInArrow(run, "key long, near long, doc_id long, th long, p int, settled boolean, known boolean")


def _marks(found: pa.Array) -> Iterator[list[np.ndarray]]:
    """Fields of each row's list of structs."""
    flat, at = found.flatten(), found.offsets.to_numpy() - found.offsets[0].as_py()
    cols = [f.to_numpy(zero_copy_only=False) for f in flat.flatten()]
    for a, z, known in zip(at[:-1].tolist(), at[1:].tolist(), found.is_valid().to_pylist(), strict=True):
        yield [c[a:z] if known else c[:0] for c in cols]


def _union(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges of ranges that may overlap or touch."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, far = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], start[1:] > far[:-1]])
    return start[new], far[np.append(np.flatnonzero(new)[1:] - 1, len(far) - 1)]


def extend(found: DataFrame) -> DataFrame:
    """From texts with their shared anchors (column found: p, settled) to word ranges: settled ones, and single windows with their hashes.

    A window of a document that, in the same task, a smaller document has is settled at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["settled", "h1", "h2", "doc_id", "th", "start", "stop"]
        held, n = [], 0

        def pack() -> pa.RecordBatch:
            h1, h2, doc, th, s = (np.concatenate(c) for c in zip(*held, strict=True))
            done = _first_of_like(h1, h2, doc)
            cols = [done, np.where(done, _spread(doc, th, s), h1), np.where(done, s, h2), doc, th, s.astype(np.int32), (s + WINDOW).astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

        with np.errstate(over="ignore"):
            for b in slices(batches):
                runs = []
                for raw, doc, th, (p, settled) in zip(texts(b), b.column("doc_id").to_pylist(), b.column("th").to_pylist(), _marks(b.column("found")), strict=True):
                    w, p, settled = Words(raw), p.astype(np.int64), settled.astype(bool)
                    x, y = _union(*around(p[settled], w.n))
                    if len(x):
                        runs.append((x, y, np.full(len(x), doc), np.full(len(x), th)))
                    a, z = around(p[~settled], w.n)
                    if not len(a):
                        continue
                    step = np.zeros(w.n + 1, np.int32)  # places where a window begins that holds an open anchor
                    np.add.at(step, a, 1)
                    np.add.at(step, z - WINDOW + 1, -1)
                    s = np.flatnonzero(np.cumsum(step) > 0)
                    if len(x):  # those within a settled range are settled
                        i = np.searchsorted(x, s, side="right") - 1
                        s = s[~((i >= 0) & (s + WINDOW <= y[i]))]
                    if not len(s):
                        continue
                    view, key = memoryview(w.joined), xxhash.xxh3_128_digest
                    h = np.frombuffer(b"".join([key(view[i:j]) for i, j in zip(w.begin[s].tolist(), w.end[s + WINDOW - 1].tolist(), strict=True)]), np.int64).reshape(-1, 2)
                    held.append((h[:, 0], h[:, 1], np.full(len(s), doc), np.full(len(s), th), s))
                    n += len(s)
                if runs:
                    x, y, doc, th = (np.concatenate(c) for c in zip(*runs, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.ones(len(x), bool), _spread(doc, th, x), x, doc, th, x.astype(np.int32), y.astype(np.int32))], names)
                if n > HELD:
                    yield pack()
                    held, n = [], 0
            if held:
                yield pack()

    return found.mapInArrow(run, "settled boolean, h1 long, h2 long, doc_id long, th long, start int, stop int")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, th, text, runs of every row of docs (doc_id, text): runs are word ranges (start, stop) that windows cover which a document with a smaller doc_id has too; null if none.

    Null and empty texts have none. A null doc_id counts as smaller than any other and shows as NO_ID. Rows that
    share a doc_id are no smaller than each other.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_hash().alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    one, alike = Window.partitionBy("key"), Window.partitionBy("key", "near")
    rows = anchor_rows(docs).withColumns({
        "several": F.col("known") | (F.min("near").over(one) != F.max("near").over(one)) & (F.min("doc_id").over(one) != F.max("doc_id").over(one)),
        "settled": F.col("settled") | (F.col("doc_id") > F.min("doc_id").over(alike)),
    })
    # surroundings that a smaller document shares are settled; if others differ, windows decide
    by_doc = rows.where("settled or several").groupBy("doc_id", "th").agg(F.collect_list(F.struct("p", "settled")).alias("found"))
    ranges = extend(docs.join(by_doc, ["doc_id", "th"]).select("doc_id", "th", "text", "found"))
    least = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    runs = ranges.withColumn("least", least).where("settled or doc_id > least").groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    return docs.join(runs, ["doc_id", "th"], "left")


def rest_of(w: Words, start: np.ndarray, stop: np.ndarray) -> tuple[bytes, int]:
    """The words outside the ranges, joined by one space, and how many the ranges hold."""
    ends, begins = np.append(0, stop), np.append(start, w.n)
    kept = [w.joined[w.begin[a] : w.end[z - 1]] for a, z in zip(ends.tolist(), begins.tolist(), strict=True) if z > a]
    return b" ".join(kept), int((stop - start).sum())


def remove_repeats(docs: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, and text (the words that are left, joined by one space) or, with digests, its kept_sha256."""
    last = "kept_sha256" if digests else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for raw, doc, (start, stop) in zip(texts(b), b.column("doc_id").to_pylist(), _marks(b.column("runs")), strict=True):
                w = Words(raw)
                kept, gone = rest_of(w, *_union(start.astype(np.int64), stop.astype(np.int64)))
                rows.append((None if doc == NO_ID else doc, w.n, gone, hashlib.sha256(kept).hexdigest() if digests else kept.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], ["doc_id", "n_words", "n_removed", last])

    return with_repeats(docs).select("doc_id", "text", "runs").mapInArrow(run, f"doc_id long, n_words long, n_removed long, {last} string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. Null and empty texts have no words; rows that share a doc_id are no smaller than each other, and each keeps its row."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)


ORACLE = """
WITH d AS (SELECT doc_id, [w for w in string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if w <> ''] AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, p, sha256(array_to_string(list_slice(w, p, p + 49), ' ')) AS g FROM x),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS m FROM g) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM hit),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT words.doc_id, count(*) FILTER (gone.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS kept
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
