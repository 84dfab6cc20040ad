"""Periodic runs: stretches of words that repeat with a period, found by divide and conquer over interned words.

A slice's documents are one array of word numbers. Every level halves the segments of the one above; a run lies whole in
the segment whose midpoint it is the first to cross. At a midpoint four Z-functions tell how far each period reaches to
either side (Main and Lorentz). They are worked out only where some period agrees over a few words next to the midpoint,
which is tested for all midpoints of a level at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import slices, table, texts

#: A run is at least LEAST words and EXPONENT periods long.
EXPONENT, LEAST = 4, 6
#: Words next to a midpoint that are compared before the Z-functions are worked out.
LOOK = 16
SLICE = 1 << 19

RUN = "array<struct<start:long,length:long,period:long>>"


def z_function(s: list[int]) -> np.ndarray:
    """Of each suffix of s, how many first items it shares with s; the whole of s counts as 0."""
    n = len(s)
    z = [0] * n
    a = b = 0  # s[a:b] is the prefix found that reaches farthest
    for i in range(1, n):
        k = min(z[i - a], b - i) if i < b else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > b:
            a, b = i, i + k
    return np.array(z, np.int64)


def _needed(p: np.ndarray) -> np.ndarray:
    """Pairs of words p apart that a run of period p has at least."""
    return np.maximum(LEAST, EXPONENT * p) - p


def _agreeing(words: np.ndarray, left: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """How many pairs (i, i + apart) agree without a gap around the border before `left`, up to LOOK on either side."""
    total = np.zeros(len(left), np.int64)
    for step in (1, -1):
        at = left if step == 1 else left - 1
        on, here = np.arange(len(left)), at
        for k in range(LOOK):
            i = here + step * k
            j = i + apart[on]
            ok = (i >= 0) & (j < len(words))
            ok[ok] = words[i[ok]] == words[j[ok]]
            on, here = on[ok], here[ok]
            if not len(on):
                break
            total[on] += 1
        total[on] += len(words)  # still agreeing: how far, the Z-functions tell
    return total


def _midpoints(words: np.ndarray, half: int, longest: int) -> np.ndarray:
    """Midpoints of segments of 2 * half words around which some period may reach far enough."""
    pad = np.concatenate([words, np.full(-len(words) % (2 * half), -1, np.int64)])
    grid, most = pad.reshape(-1, 2 * half), min(2 * half, longest) // EXPONENT
    found = []
    for ahead in (True, False):  # a run agrees at the word left of the midpoint with one ahead, or else at the word right of it with one behind
        own, cells = (half - 1, grid[:, half : half + most]) if ahead else (half, grid[:, half - most : half])
        k, c = np.nonzero(cells == grid[:, own : own + 1])
        p, m = c + 1 if ahead else most - c, 2 * half * k + half
        found.append(m[_agreeing(words, m if ahead else m - p, p) >= _needed(p)])
    return np.unique(np.concatenate(found))


def _crossing(words: np.ndarray, lo: int, m: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, end and period of the repetitions in [lo, hi) that touch m and are long enough."""
    most = (hi - lo) // EXPONENT
    u, v = words[lo:m].tolist(), words[m:hi].tolist()
    back, none = u[::-1], [-2]
    for right in (True, False):
        near, far = (v, back) if right else (back, v)
        p = np.arange(1, min(most, len(near)) + 1)
        if not len(p):
            continue
        along = np.append(z_function(near), 0)[p]  # the near side with itself, p further on
        other = near[: len(p)][::-1] + far  # the far side with itself, p nearer
        over = z_function(far + none + other)[len(far) + 1 + len(p) - p]
        before, after = (over, along) if right else (along, over)
        # pairs (i, i + p) agree from border - before to border + after
        border = np.full(len(p), m) if right else m - p
        good = before + after >= _needed(p)
        yield (border - before)[good], (border + after + p)[good], p[good]


def find(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and period. Each document in `words` closes with a separator of its own; `ends` are the places after those."""
    parts, half = [], LEAST // 2 + 1
    longest = int(np.diff(ends, prepend=0).max(initial=0))
    same = np.concatenate([[0], np.cumsum(words[1:] == words[:-1])])
    while half < len(words):
        mids = _midpoints(words, half, longest)
        doc = np.searchsorted(ends, mids, side="right")
        begin, end = np.where(doc > 0, ends[doc - 1], 0), ends[doc] - 1
        for m, first, last in zip(mids.tolist(), begin.tolist(), end.tolist(), strict=True):
            lo, hi = max(m - half, first), min(m + half, last)
            if lo >= m or hi <= m or (lo > first and hi < last and same[hi] - same[lo - 1] == hi - lo + 1):
                continue  # a border of documents, or one word throughout and beyond: its run crosses a higher midpoint
            for s, e, p in _crossing(words, lo, m, hi):
                # what goes on past the segment crosses a higher midpoint, and is found whole there
                cut = ((s == lo) & (lo > first) & (words[s - 1] == words[s - 1 + p])) | ((e == hi) & (hi < last) & (words[np.minimum(e, len(words) - 1)] == words[e - p]))
                parts.append(np.stack([s, e, p], 1)[~cut])
        half *= 2
    if not parts:
        return np.empty((0, 3), np.int64)
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)  # of equal intervals the smallest period stays
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _slice(raw: list[bytes]) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
    """Of each text its number of words, its runs (start, length, period), and its kept words joined by one space."""
    number: dict[bytes, int] = {}
    cut = [t.split() for t in raw]
    words = np.concatenate([np.array([*(number.setdefault(w, len(number)) for w in c), -3 - k], np.int64) for k, c in enumerate(cut)])
    counts = [len(c) for c in cut]
    ends = np.cumsum(np.array(counts) + 1)
    rows = find(words, ends)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, rows[:, 0] + rows[:, 2], 1)
    np.add.at(step, rows[:, 1], -1)
    kept = np.cumsum(step)[:-1] == 0
    bounds = np.searchsorted(rows[:, 0], np.concatenate([[0], ends]))
    runs, collapsed = [], []
    for k, c in enumerate(cut):
        base = int(ends[k]) - len(c) - 1
        own = rows[bounds[k] : bounds[k + 1]]
        runs.append([(s - base, e - s, p) for s, e, p in own.tolist()])
        collapsed.append(b" ".join([w for w, keep in zip(c, kept[base : base + len(c)].tolist(), strict=True) if keep] if len(own) else c))
    return counts, runs, collapsed


def with_runs(docs: DataFrame, column: str = "text") -> DataFrame:
    """Adds n_words, runs (by start, then period) and collapsed to every row: the text's words `[^\\x20\\x09-\\x0D]+`, its runs, and the words that no run
    repeats, joined by one space.

    A run is a stretch of words with smallest period q that keeps q and can't be longer, of LEAST words and EXPONENT * q at least. Of each run the words after its first q go.
    Null and empty texts: no words, no runs, the empty string. A text stands whole in its worker, at some forty times its bytes. Repeated rows stay;
    columns of docs with the added names are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_words", "runs", "collapsed") and c != column])
    kinds = T._parse_datatype_string(f"n_words long, runs {RUN}, collapsed string").fields
    schema = T.StructType([*docs.schema.fields, *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for b in slices(batches, column, SLICE):
            counts, runs, collapsed = _slice(texts(b, column))
            found = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
            added = [pa.array(counts, pa.int64()), pa.array(found, pa.list_(item)), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], [*b.schema.names, *(f.name for f in kinds)])

    return docs.mapInArrow(run, schema)


def planted(text: Column, doc_id: Column) -> Column:
    """The text whose words from some place on repeat, both chosen by the document's id; nine of ten texts are left as they are."""
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    g, words = F.floor(h / 10), F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.get(w, a + (i - a) % p)).otherwise(x)), " ")

    once = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w))), 1)
    return F.when(h % 10 == 0, F.coalesce(once, text)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole, with the contract's repetitions put in. Null texts: no words, no runs, four nulls, digests of the empty string. A null doc_id gets nothing put in; repeated rows stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(*(x for c in ("start", "length", "period") for x in (r[c].cast("string"), F.lit("\n" if c == "period" else ","))))), "")
    return with_runs(docs).withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.p")).alias("period"),
        F.floor(F.lit(1000) * F.col("top.length") / -F.col("top.p")).alias("exponent_milli"), F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
