"""Near-duplicate documents by min-max hashing: the least and the greatest value under each permutation, banded.

Documents with equal shingle sets are one class. Classes that share a band are compared by their
signatures; those that may be links join into families, and within a family links are confirmed on full
sets until no link between two components can be left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import checkpoint_root, partitions, settled, slices, table, texts
from llm.graph import components

SHINGLE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Bands of four values (two permutations, least and greatest): a pair at 0.75 shares none of them once in four million.
PERMUTATIONS, BANDS, ROWS = 80, 40, 4
#: Share of equal signature bytes from which a pair is looked at closely: over four standard deviations below 0.75.
NEAR = 0.6
#: Members of a band's bucket to a block; each block of a larger bucket also gets its smallest member, and what they leave apart is compared across blocks.
BUCKET_BLOCK = 4000
#: Shingles of a family to a block; each block of a larger family also gets HUBS common members.
FAMILY_BLOCK, HUBS = 3_000_000, 64

_SEEDS = np.random.default_rng(20240501).integers(1, 2**63, (PERMUTATIONS, 2), dtype=np.uint64) | np.uint64(1)


def shingle_hashes(raw: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: A-Z lower-cased, words by white space, SHINGLE words each; a shorter text is one shingle."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    of = np.array([xxhash.xxh3_64_intdigest(w) for w in number], np.uint64)[ids]
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    n = len(of) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        h = (h ^ of[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 2 * PERMUTATIONS): least and greatest value of each permutation side by side. Sets must not be empty."""
    x = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    for i, (a, b) in enumerate(_SEEDS):
        v = x * a
        v ^= v >> np.uint64(31)
        v *= b
        np.minimum.reduceat(v, starts, out=out[:, 2 * i])
        np.maximum.reduceat(v, starts, out=out[:, 2 * i + 1])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(sets, BANDS) hashes of ROWS values each, different from band to band."""
    v = sig.reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), v.shape[:2]).copy()
    for j in range(ROWS):
        h = (h ^ v[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash, bytes (a byte of each signature value), bands; the last three null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_hashes(t) for t in texts(b)]
            full = [i for i, s in enumerate(sets) if len(s)]
            hashes, short, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                sig = signatures([sets[i] for i in full])
                low = (sig >> np.uint64(8)).astype(np.uint8)
                for i, own, keys in zip(full, low, band_keys(sig), strict=True):
                    hashes[i], short[i], bands[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), own.tobytes(), keys
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()), pa.array(short, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_hash", "bytes", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, bytes binary, bands array<long>")


def _joined(n: int, near) -> np.ndarray:
    """Components of n nodes; near(i) tells which nodes are linked with i.

    A node is asked only while it stands outside the largest component, so no link between components is
    left unseen, and few nodes are asked where most hang together.
    """
    label, asked = np.arange(n), np.zeros(n, bool)
    at = 0
    while True:
        asked[at] = True
        linked = np.unique(label[near(at)])
        if len(linked) > 1:
            label[np.isin(label, linked)] = linked[0]
        open_ = np.flatnonzero(~asked & (label != np.bincount(label, minlength=n).argmax()))
        if not len(open_):
            return label
        at = int(open_[0])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray | pa.Array]]:
    """Columns of whole groups (equal in the first `keys` columns) of sorted batches, one or more groups at a time."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        t = t.combine_chunks()
        cols = [t.column(k).to_numpy() for k in range(keys)]
        differs = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in cols])) if t.num_rows else []
        cut = int(differs[-1]) + 1 if len(differs) else 0
        if cut:
            yield [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.slice(0, cut).columns]
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield [c.combine_chunks() for c in held.combine_chunks().columns]


def _bounds(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours begin, and the end."""
    n = len(keys[0])
    new = np.logical_or.reduce([k[1:] != k[:-1] for k in keys]) if n > 1 else np.empty(0, bool)
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]])


def near_edges(classes: DataFrame) -> DataFrame:
    """Edges (a, b) that join all classes which share a band and may be links; fewer in a bucket than it has members.

    classes: cid, bytes, bands. Buckets of one leave before the signatures travel. Members are in the order of cid and
    hang on the smallest, so that a group's bands agree on few centres and its edges stay few. A bucket of more than
    BUCKET_BLOCK is dealt into blocks that share its smallest member; then what stands outside its largest
    component meets all of the bucket (see across_blocks).
    """
    key = classes.select("cid", F.explode("bands").alias("key"))
    many = key.groupBy("key").agg(F.count("*").alias("n"), F.min("cid").alias("hub")).where("n > 1").withColumn("k", F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")).checkpoint()
    own = F.pmod(F.xxhash64("cid", "key"), F.col("k")).cast("int")
    dealt = key.join(many, "key").select("key", "cid", F.explode(F.when(F.col("cid") == F.col("hub"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(own))).alias("block"))
    rows = dealt.join(classes.select("cid", "bytes"), "cid").select("key", "block", "cid", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key_, block, cid, raw in _groups(batches, 2):
            key_, block, cid = key_.to_numpy(), block.to_numpy(), cid.to_numpy()
            sig = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(len(cid), -1)
            at = _bounds(key_, block)
            first = np.repeat(at[:-1], np.diff(at))
            like = (sig == sig[first]).mean(1) >= NEAR
            a, b = [cid[first[like]]], [cid[like]]
            for g in np.flatnonzero(~np.logical_and.reduceat(like, at[:-1])):
                s = sig[at[g] : at[g + 1]]
                label = _joined(len(s), lambda i, s=s: (s == s[i]).mean(1) >= NEAR)
                a.append(cid[at[g] + label])
                b.append(cid[at[g] : at[g + 1]])
            a, b = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    n = partitions(classes.sparkSession)
    edges = rows.repartition(n, "key", "block").sortWithinPartitions("key", "block", "cid").mapInArrow(run, "a long, b long").distinct()
    large = many.where("k > 1")
    return edges if large.isEmpty() else across_blocks(key.join(large.select("key", "k"), "key").distinct(), classes.select("cid", "bytes"), components(edges))


def across_blocks(members: DataFrame, sigs: DataFrame, first: DataFrame) -> DataFrame:
    """first (node, label: the components that blocks have found) as edges (a, b), and those that blocks left open.

    members: key, cid, k (blocks) of the split buckets; sigs: cid, bytes. What isn't in its bucket's largest
    component is dealt into chunks, and each chunk meets each block of the bucket.
    """
    now = members.join(first, F.col("cid") == F.col("node"), "left").select("key", "cid", "k", F.coalesce("label", "cid").alias("comp")).checkpoint()
    sizes = now.groupBy("key", "comp").agg(F.count("*").alias("n"))
    rest = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"), F.ceil((F.sum("n") - F.max("n")) / BUCKET_BLOCK).cast("int").alias("j")).where("j > 0")
    rows = now.join(rest, "key").join(sigs, "cid")
    places = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("cid", "key"), F.col(n)).cast("int")
    every = rows.select("key", own("k").alias("_k"), places("j").alias("_j"), F.lit(False).alias("asks"), "comp", "bytes")
    asked = rows.where("comp <> most").select("key", places("k").alias("_k"), own("j").alias("_j"), F.lit(True).alias("asks"), "comp", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, asks, comp, raw in _groups(batches, 1):
            asks, comp = asks.to_numpy(zero_copy_only=False), comp.to_numpy()
            sig = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(len(comp), -1)
            at = _bounds(grp.to_numpy())
            a, b = [comp[:0]], [comp[:0]]
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                names, label = np.unique(comp[x:y], return_inverse=True)
                block = np.flatnonzero(~asks[x:y])
                s = np.ascontiguousarray(sig[x:y][block].T)
                for i in np.flatnonzero(asks[x:y]):
                    both = (s == sig[x + i][:, None]).sum(0, dtype=np.uint8)
                    linked = np.unique(np.append(label[block[both >= NEAR * len(s)]], label[i]))
                    if len(linked) > 1:
                        a.append(np.repeat(names[linked[0]], len(linked) - 1))
                        b.append(names[linked[1:]])
                        label[np.isin(label, linked)] = linked[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    met = every.unionByName(asked).select(F.xxhash64("key", "_k", "_j").alias("grp"), "asks", "comp", "bytes")
    second = met.repartition(partitions(members.sparkSession), "grp").sortWithinPartitions("grp").mapInArrow(run, "a long, b long")
    return first.select(F.col("node").alias("a"), F.col("label").alias("b")).union(second.distinct())


def confirm(members: DataFrame) -> DataFrame:
    """Edges (a, b) that join the members of each group (columns grp, cid, text) whose full sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, cid, text in _groups(batches, 1):
            cid, at = cid.to_numpy(), _bounds(grp.to_numpy())
            a, b = [], []
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                sets = [shingle_hashes(t or b"") for t in text.slice(x, y - x).cast(pa.binary()).to_pylist()]
                size = np.array([len(s) for s in sets])
                starts = np.concatenate([[0], np.cumsum(size)[:-1]])
                _, own = np.unique(np.concatenate(sets), return_inverse=True)
                mark = np.zeros(int(own.max(initial=0)) + 1, bool)

                def near(i: int, own=own, size=size, starts=starts, mark=mark) -> np.ndarray:
                    mine = own[starts[i] : starts[i] + size[i]]
                    mark[mine] = True
                    both = np.add.reduceat(mark[own], starts, dtype=np.int64)
                    mark[mine] = False
                    return 100 * both >= PERCENT * (size + size[i] - both)

                label = _joined(y - x, near)
                a.append(cid[x + label])
                b.append(cid[x:y])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[a != b]), pa.array(np.maximum(a, b)[a != b])], ["a", "b"])

    return members.select("grp", "cid", "text").repartition(partitions(members.sparkSession), "grp").sortWithinPartitions("grp", "cid").mapInArrow(run, "a long, b long")


def link_families(family: DataFrame, docs: DataFrame, block: int | None = None) -> DataFrame:
    """(node, label) of the classes that have links. family: cid, label, n_shingles; docs: doc_id, text.

    A family of up to `block` shingles is one group. A larger one is dealt into blocks that share HUBS members;
    then what stands outside its largest component meets all of the family, block by block, so that every
    link which could join two components has been looked at.
    """
    block = block or FAMILY_BLOCK
    total = family.groupBy("label").agg(F.sum("n_shingles").alias("total"))
    family = family.join(total, "label").withColumn("k", F.ceil(F.col("total") / block).cast("int")).checkpoint()
    own = F.pmod(F.xxhash64("cid"), F.col("k")).cast("int")
    grp = lambda *c: F.xxhash64("label", *c)
    with_text = family.join(docs.select(F.col("doc_id").alias("cid"), "text"), "cid")
    split = not family.where("k > 1").isEmpty()
    if not split:
        return components(confirm(with_text.select(grp(F.lit(0)).alias("grp"), "cid", "text")))
    with_text = with_text.checkpoint()
    hub = F.col("k") > 1
    ranks = family.where(hub).groupBy("label").agg(F.slice(F.sort_array(F.collect_set(F.when(F.pmod(F.xxhash64("cid"), F.greatest(F.lit(1), F.floor(F.col("total") / block))) == 0, F.xxhash64("cid")))), 1, HUBS).alias("hubs"))
    dealt = with_text.join(ranks, "label", "left")
    places = F.when(F.array_contains("hubs", F.xxhash64("cid")), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(own))
    first = components(confirm(dealt.withColumn("_p", F.explode(places)).select(grp("_p").alias("grp"), "cid", "text")))
    # what isn't in its family's largest component
    now = family.where(hub).join(first.select(F.col("node").alias("cid"), F.col("label").alias("comp")), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    sizes = now.groupBy("label", "comp").agg(F.count("*").alias("n"))
    most = sizes.groupBy("label").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"))
    rest = now.join(most, "label").where("comp <> most").select("cid", "label", "k", "n_shingles")
    chunks = rest.groupBy("label").agg(F.ceil(F.sum("n_shingles") / block).cast("int").alias("j"))
    every = with_text.where(hub).join(chunks, "label").select("label", "cid", "text", own.alias("_k"), F.explode(F.sequence(F.lit(0), F.col("j") - 1)).alias("_j"))
    asked = rest.join(chunks, "label").join(with_text.select("cid", "text"), "cid").select("label", "cid", "text", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("_k"), F.pmod(F.xxhash64("cid"), F.col("j")).cast("int").alias("_j"))
    second = confirm(every.unionByName(asked).select(grp("_k", "_j").alias("grp"), "cid", "text"))
    return components(second.union(first.select("node", "label")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Null or empty texts have no shingles and are linked with nothing. Rows with a null doc_id take no part:
    component_id is null and kept true. Rows that share a doc_id are one document and share its links.
    """
    spark = docs.sparkSession
    checkpoint_root(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = sketch(docs).checkpoint()
    known = sig.where("doc_id is not null and set_hash is not null")
    classes = known.groupBy("set_hash").agg(F.min(F.struct("doc_id", "n_shingles", "bytes", "bands")).alias("c"))
    classes = classes.select("set_hash", F.col("c.doc_id").alias("cid"), "c.n_shingles", "c.bytes", "c.bands").checkpoint()
    label = components(near_edges(classes)).select(F.col("node").alias("cid"), "label")
    family = label.join(classes.groupBy("cid").agg(F.max("n_shingles").alias("n_shingles")), "cid")
    linked = link_families(family, docs.where("doc_id is not null and text is not null"))
    of_class = classes.select("set_hash", "cid").join(linked, F.col("cid") == F.col("node"), "left").select(F.col("set_hash").alias("_h"), F.coalesce("label", "cid").alias("comp"))
    out = sig.select("doc_id", "n_shingles", "set_hash").join(of_class, F.col("set_hash") == F.col("_h"), "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows whose document isn't the first of its component; columns as they were.

    Rows with a null doc_id, and documents without a word, stay; rows that share a doc_id stay or go together.
    """
    gone = settled(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "near-dedup")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by near_duplicates(): null and empty texts have no shingles and are linked with nothing, equal rows each keep their row."""
    return near_duplicates(table(spark, sf_dir, "documents"))


_S = """
WITH RECURSIVE t AS (SELECT doc_id, [w for w in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if w <> ''] AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(list_slice(w, i, i + 4), ' ') for i in range(1, len(w) - 3)]) END AS s FROM t),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 75 * (na + nb - i)),
r(a, c) AS (SELECT a, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
c AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept FROM s LEFT JOIN c ON doc_id = a
"""
ORACLE = _S
