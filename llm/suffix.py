"""Repeated byte strings by column-wise construction over many aligned texts.

Every window of WINDOW bytes has an anchor, the least of its GRAM-byte hashes, and windows that are equal
have equal anchors at equal places. So all texts around one anchor form a collection that is aligned at
it: a suffix need only be compared with those that begin in the same column. The collection's order is built
from the last column to the first, one symbol of each text a round: the symbols, read in the
order so far, are that column of the Burrows-Wheeler transform, they give the next order by a stable sort, and
the common prefixes of neighbours follow from the last round's. Columns come from one file and what is found
goes to another, each written and read from end to end; memory holds a few numbers a text.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import partitions, slices, table, text_hash, texts

WINDOW = 200
GRAM = 32
#: Grams of a window, and so the places where its anchor can be.
SPAN = WINDOW - GRAM + 1
COLUMNS = SPAN - 1 + WINDOW
#: Texts around one anchor to a collection; larger ones are split, and what the parts can't settle goes by hashes of whole windows.
COLLECTION = 200_000
#: Anchors that a task holds to find copies among them before the shuffle.
HELD = 100_000
#: Bytes of texts that are hashed, or compared, at a time; some sixty times this are held in arrays meanwhile.
PIECE_BYTES = 1 << 19
NO_ID = -(2**63)

_BYTE = np.random.default_rng(99).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [np.uint64(pow(0x9E3779B97F4A7C15, 2**i, 2**64)) for i in range(5)]


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on; GRAM - 1 fewer than bytes."""
    h = _BYTE[b]
    for i in range(5):
        h = h[: -(1 << i)] * _STEP[i] + h[1 << i :]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def least_places(h: np.ndarray) -> np.ndarray:
    """The place of the least (of equals, the first) of SPAN neighbours, from each place on. Up to 2**24 places."""
    n = len(h) - SPAN + 1
    rows = -(-len(h) // SPAN)
    k = np.full(rows * SPAN, np.uint64(2**64 - 1))
    k[: len(h)] = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    k = k.reshape(rows, SPAN)
    ahead = np.minimum.accumulate(k, axis=1).ravel()
    back = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[SPAN - 1 : SPAN - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)


def _pieces(raw: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, first byte, bytes) in lots of about PIECE_BYTES; longer texts in pieces that overlap by WINDOW - 1."""
    lot, held = [], 0
    for i, t in enumerate(raw):
        for at in range(0, max(1, len(t) - WINDOW + 1), PIECE_BYTES):
            part = t[at : at + PIECE_BYTES + WINDOW - 1] if at or len(t) > PIECE_BYTES + WINDOW else t
            if len(part) >= WINDOW:
                lot.append((i, at, part))
                held += len(part)
            if held >= PIECE_BYTES:
                yield lot
                lot, held = [], 0
            if part is t:
                break
    if lot:
        yield lot


def anchors(raw: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """key (hash of the anchor), around (hash of the bytes of its windows), text, first (first window's place), count (of windows), lead (anchor's place from there)."""
    for lot in _pieces(raw):
        joined = b"".join(p for _, _, p in lot)
        h = gram_hashes(np.frombuffer(joined, np.uint8))
        at = least_places(h)
        valid = np.ones(len(at), bool)
        size = np.array([len(p) for _, _, p in lot])
        ends = np.cumsum(size)
        for e in ends[:-1].tolist():
            valid[e - WINDOW + 1 : e] = False
        s = np.flatnonzero(valid)
        p = at[s]
        new = np.concatenate([[0], np.flatnonzero((p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)) + 1])
        first, count, place = s[new], np.diff(np.append(new, len(s))), p[new]
        piece = np.searchsorted(ends, first, side="right")
        view = memoryview(joined)
        around = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (first + count + WINDOW - 1).tolist(), strict=True)], np.uint64)
        base = np.array([b for _, b, _ in lot]) - (ends - size)
        yield h[place].view(np.int64), around.view(np.int64), np.array([i for i, _, _ in lot])[piece], first + base[piece], count, place - first


ANCHORS = "key long, around long, doc_id long, th long, first int, count int, lead int, twice boolean"


def anchor_rows(docs: DataFrame) -> DataFrame:
    """One row per anchor of every text. Of those that are alike in one task, one keeps its key; all are marked twice, and the others' keys are spread so that copies don't meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def pack() -> pa.RecordBatch:
            key, around, doc, th, first, count, lead = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((around, key))
            same = (key[order][1:] == key[order][:-1]) & (around[order][1:] == around[order][:-1])
            again, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
            again[order[1:]] = same
            twice[order[1:]] = same
            twice[order[:-1]] |= same
            spread = ((key ^ (doc * 31 + first)) * np.int64(0x9E3779B97F4A7C1) + th).astype(np.int64)
            cols = [np.where(again, spread, key), np.where(again, doc ^ first, around), doc, th, first.astype(np.int32), count.astype(np.int32), lead.astype(np.int32), twice]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "around", "doc_id", "th", "first", "count", "lead", "twice"])

        with np.errstate(over="ignore"):
            for b in slices(batches):
                doc, th = b.column("doc_id").to_numpy(), b.column("th").to_numpy()
                for key, around, i, first, count, lead in anchors(texts(b)):
                    held.append((key, around, doc[i], th[i], first, count, lead))
                    n += len(key)
                if n > HELD:
                    yield pack()
                    held, n = [], 0
            if held:
                yield pack()

    return docs.select("doc_id", "th", "text").mapInArrow(run, ANCHORS)


def repeated_windows(raw: list[bytes], lead: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts aligned at their anchors: whether the window from each column on is found twice in its group, and whether it is the first of its kind.

    raw: a text's bytes from its first window to the end of its last; lead: where its anchor begins; group:
    numbers in ascending order. Returns two (texts, SPAN) arrays of bits; column c of a text is SPAN - 1 - lead bytes after its first.
    """
    n = len(raw)
    begin = SPAN - 1 - lead
    end = begin + np.array([len(t) for t in raw])
    found, heads = np.zeros((n, SPAN), bool), np.zeros((n, SPAN), bool)
    with tempfile.TemporaryFile() as columns, tempfile.TemporaryFile() as results:
        for a in range(0, n, 1 << 14):  # texts in rows to columns, some at a time; a block's columns stand together
            to = min(n, a + (1 << 14))
            block = np.zeros((to - a, COLUMNS), np.uint8)
            for i in range(a, to):
                block[i - a, begin[i] : end[i]] = np.frombuffer(raw[i], np.uint8)
            columns.write(np.ascontiguousarray(block.T).tobytes())
        starts = list(range(0, n, 1 << 14))
        read = lambda c: np.concatenate([_column(columns, a, min(n, a + (1 << 14)), c) for a in starts])
        enter = np.argsort(-end, kind="stable")
        entered = 0
        order = np.empty(0, np.int64)
        prefix = np.empty(0, np.int32)  # common with the one before, 0 at a group's first
        for c in range(int(end.max()) - 1, -1, -1):
            upto = int(np.searchsorted(-end[enter], -c, side="left"))  # those with end > c
            if upto > entered:  # texts whose last symbol is in this column: empty suffixes come first in their group
                new = np.sort(enter[entered:upto])
                entered = upto
                g = np.concatenate([group[new], group[order]])
                o, pre = np.concatenate([new, order]), np.concatenate([np.zeros(len(new), np.int32), prefix])
                k = np.argsort(g, kind="stable")
                order, prefix = o[k], pre[k]
            gone = begin[order] > c
            if gone.any():
                keep = np.flatnonzero(~gone)
                prefix = least_between(prefix, keep)
                order = order[keep]
            if not len(order):
                continue
            symbol = read(c)[order]
            g = group[order]
            longer = np.zeros(len(order), np.int32)
            for s in np.unique(symbol):
                at = np.flatnonzero(symbol == s)
                if len(at) > 1:
                    least = least_between(prefix, at)[1:]
                    longer[at[1:]] = np.where(g[at[1:]] == g[at[:-1]], least + 1, 0)
            k = np.lexsort((symbol, g))
            order, prefix = order[k], longer[k]
            if c < SPAN:
                like = prefix >= WINDOW
                next_ = np.append(like[1:], False)
                results.write(np.int64([c, len(order)]).tobytes() + order.astype(np.int32).tobytes() + np.packbits(like | next_).tobytes() + np.packbits(~like).tobytes())
        results.seek(0)
        while head := results.read(16):
            c, m = np.frombuffer(head, np.int64).tolist()
            o = np.frombuffer(results.read(4 * m), np.int32)
            two = [np.unpackbits(np.frombuffer(results.read(-(-m // 8)), np.uint8), count=m).astype(bool) for _ in range(2)]
            found[o, c], heads[o, c] = two
    return found, heads


def least_between(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Least of x up to at[0], then of what lies behind at[i - 1], up to at[i]; at ascends."""
    return np.minimum.reduceat(x[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1])) if len(at) else x[:0]


def _column(file, a: int, to: int, c: int) -> np.ndarray:
    file.seek(a * COLUMNS + c * (to - a))
    return np.frombuffer(file.read(to - a), np.uint8)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column + 1 of each run of true flags."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, a = np.nonzero(edge == 1)
    return row, a, np.nonzero(edge == -1)[1]


FOUND = "kind int, h1 long, h2 long, doc_id long, th long, start int, stop int"


def compare(rows: DataFrame) -> DataFrame:
    """What is repeated in the texts of each collection. rows: grp, split, doc_id, th, first, lead, raw (null: nothing to compare, a run from first to lead that is settled).

    kind 0: bytes start to stop are repeated. kind 1: in a split collection, a window met once here; kind 2: one met twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "h1", "h2", "doc_id", "th", "start", "stop"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        pack = lambda *c: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], names)
        hold: list[tuple] = []

        def settle(hold: list[tuple]) -> Iterator[pa.RecordBatch]:
            grp, split, doc, th, first, lead, raw = zip(*hold, strict=True)
            group = np.cumsum(np.concatenate([[0], np.array(grp[1:]) != np.array(grp[:-1])]).astype(np.int64))
            doc, th, first, lead = np.array(doc, np.int64), np.array(th, np.int64), np.array(first, np.int64), np.array(lead, np.int64)
            found, heads = repeated_windows(list(raw), lead, group)
            r, a, b = _runs(found)
            start = first[r] + a - (SPAN - 1 - lead[r])
            h = start * np.int64(7919) ^ doc[r]
            yield pack(np.zeros(len(r), np.int32), h, th[r], doc[r], th[r], start, start + (b - a) + WINDOW - 1)
            out = []
            for i in np.flatnonzero(np.array(split)).tolist():
                begin = SPAN - 1 - int(lead[i])
                for c in np.flatnonzero(heads[i]).tolist():
                    w = raw[i][c - begin : c - begin + WINDOW]
                    if len(w) == WINDOW:
                        d = xxhash.xxh3_128_intdigest(w)
                        out.append((1 + int(found[i, c]), (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63, int(doc[i]), int(th[i]), int(first[i]) + c - begin, int(first[i]) + c - begin + WINDOW))
                if len(out) > 20_000:
                    yield pack(*zip(*out, strict=True))
                    out = []
            if out:
                yield pack(*zip(*out, strict=True))

        size, last = 0, None
        for b in batches:
            d = [c.to_pylist() for c in b.columns]
            done = [x for x in zip(*d, strict=True) if x[6] is None]
            if done:
                _, _, doc, th, start, stop, _ = zip(*done, strict=True)
                s = np.array(start, np.int64)
                yield pack(np.zeros(len(s), np.int32), s * np.int64(7919) ^ np.array(doc, np.int64), th, doc, th, start, stop)
            for x in zip(*d, strict=True):
                if x[6] is not None:
                    if size > PIECE_BYTES * 4 and x[0] != last:
                        yield from settle(hold)
                        hold, size = [], 0
                    hold.append(x)
                    size += len(x[6])
                    last = x[0]
        if hold:
            yield from settle(hold)

    cols = ["grp", "split", "doc_id", "th", "first", "lead", "raw"]
    return rows.select(*cols).repartition(partitions(rows.sparkSession), "grp").sortWithinPartitions("grp").mapInArrow(run, FOUND)


def around_rows(found: DataFrame) -> DataFrame:
    """From texts with their anchors (column found) to compare()'s rows: settled runs, and the bytes around the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("grp", pa.int64()), ("split", pa.bool_()), ("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("lead", pa.int32()), ("raw", pa.binary())])
        for b in slices(batches):
            rows = []
            for t, doc, th, marks in zip(texts(b), b.column("doc_id").to_pylist(), b.column("th").to_pylist(), b.column("found").to_pylist(), strict=True):
                settled = []
                for m in sorted(marks, key=lambda m: m["first"]):
                    a, z = m["first"], m["first"] + m["count"] + WINDOW - 1
                    if m["grp"] is not None:
                        rows.append((m["grp"], m["split"], doc, th, a, m["lead"], t[a:z]))
                    if not m["settled"]:
                        continue
                    if settled and a <= settled[-1][1]:
                        settled[-1][1] = max(z, settled[-1][1])
                    else:
                        settled.append([a, z])
                rows += [(th ^ a, False, doc, th, a, z, None) for a, z in settled]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return found.mapInArrow(run, "grp long, split boolean, doc_id long, th long, first int, lead int, raw binary")


def with_repeats(docs: DataFrame, collection: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """doc_id, th, text, runs of every row of docs (doc_id, text), and with `carry` a struct `rest` of those columns: runs are the byte ranges (start, stop) that strings of WINDOW bytes found elsewhere cover; null if none.

    Ranges may touch or overlap. Null and empty texts have none. A null doc_id shows as NO_ID. Rows that are
    alike in doc_id and text are copies of one another.
    """
    collection = collection or COLLECTION
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_hash().alias("th"), F.coalesce("text", F.lit("")).alias("text"), *([F.struct(*[docs[c] for c in carry]).alias("rest")] if carry else []))
    rows = anchor_rows(docs)
    one, alike = Window.partitionBy("key"), Window.partitionBy("key", "around")
    first = F.row_number().over(alike.orderBy("doc_id", "th", "first")) == 1
    rows = rows.withColumns({"n": F.count("*").over(one), "m": F.count("*").over(alike), "several": F.min("around").over(one) != F.max("around").over(one), "one_of": first})
    rows = rows.withColumn("settled", F.col("twice") | (F.col("m") > 1)).where("settled or several")
    # anchors whose surroundings differ are compared; of surroundings that are alike, one takes part
    parts = F.ceil(F.col("n") / collection)
    part = F.when(parts > 1, F.pmod(F.xxhash64("doc_id", "first"), parts)).otherwise(F.lit(0))
    grp = F.when(F.col("several") & F.col("one_of"), F.xxhash64("key", part))
    mark = F.struct("first", "count", "lead", "settled", grp.alias("grp"), (parts > 1).alias("split"))
    by_doc = rows.groupBy("doc_id", "th").agg(F.collect_list(mark).alias("found"))
    # both joins take the same columns of docs, so that its one exchange serves them both
    around = around_rows(docs.join(by_doc, ["doc_id", "th"]).select(*docs.columns, "found"))
    same = Window.partitionBy("h1", "h2")
    found = compare(around).withColumns({"w": F.count("*").over(same), "d": F.max("kind").over(same)}).where("kind = 0 or (kind = 1 and (w > 1 or d = 2))")
    runs = found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    return docs.join(runs, ["doc_id", "th"], "left")


def merged(runs: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal ranges."""
    out: list[list[int]] = []
    for r in sorted(runs or [], key=lambda r: r["start"]):
        if out and r["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r["stop"])
        else:
            out.append([r["start"], r["stop"]])
    return [(a, b) for a, b in out]


def rest_of(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the spans."""
    ends = [0, *(b for _, b in spans)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(text)], strict=True))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any other columns) with the repeats taken out of the texts; parts of characters at the cuts go too. Nulls stay null, emptied texts stay as empty ones."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            left = [rest_of(t, merged(r)).decode("utf-8", "ignore") for t, r in zip(texts(b), b.column("runs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), b.column("rest")], ["text", "rest"])

    packed = docs.withColumn("__text_is_null", F.col("text").isNull())
    found = with_repeats(packed, carry=[*others, "__text_is_null"]).select("text", "runs", "rest")
    kind = next(f for f in found.schema.fields if f.name == "rest").dataType
    out = found.mapInArrow(run, T.StructType([T.StructField("text", T.StringType()), T.StructField("rest", kind)]))
    return out.select(*[F.when(~F.col("rest.__text_is_null"), F.col("text")).alias("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. Null and empty texts have no bytes and no spans; rows that are alike in doc_id and text are copies of one another, and each keeps its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc, t, r in zip(b.column("doc_id").to_pylist(), texts(b), b.column("runs").to_pylist(), strict=True):
                spans = merged(r)
                rows.append((None if doc == NO_ID else doc, len(t), sum(y - x for x, y in spans), len(spans), hashlib.sha256(rest_of(t, spans)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM d WHERE length(h) >= 400)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY g) AS n FROM w) WHERE n > 1),
i AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS first FROM r),
s AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM i) GROUP BY doc_id, k),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM s),
k AS (SELECT t.doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM t JOIN d ON t.doc_id = d.doc_id GROUP BY t.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
