"""WARC archives from page rows, and back, as a table of chunks.

Each task streams its rows into one gzip archive (a member per record) in the shared folder and reports it
in a manifest; what a lost task left behind is in no manifest and never read. Reading cuts every payload
into chunk rows with a running digest, so no record is ever whole in a reader's memory.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import shared_dir, slices, table

CHUNK_BYTES = 1 << 20
#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 100
#: Tasks that pages with one payload are spread over at least, when they learn which page is the first.
SALTS = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "path string, records long"
CHUNKS = "page_id long, url string, record_type string, refers_to long, chunk_no long, chunk binary, payload_bytes long, running_digest string, last boolean, header_digest string, header_bytes long"


def with_kinds(pages: DataFrame) -> DataFrame:
    """Adds digest, refers_to to page_id, url, html: of rows with equal payloads of REVISIT_BYTES or more, the smallest page_id is the response.

    Null html is empty. A null page_id is never referred to; if a whole group has none, all are responses.
    Rows that repeat the smallest page_id are responses too. Groups are reduced on the map side first, so
    a payload that a third of all pages share is one row per task; then its first page travels once per salt, so that
    those pages don't meet in one task.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html"), 256))
    first = p.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("_d"), "first")
    first = first.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = p.withColumn("_p", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    out = salted.join(first, (F.col("digest") == F.col("_d")) & (F.col("_p") == F.col("_s")), "left")
    return out.select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def _header(page_id: int | None, url: str | None, digest: str, n: int, refers: int | None) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    rows = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(n))]
    if refers is not None:
        rows += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers}>")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"Content-Length: %d\r\n" % n if refers is None else b"") + b"\r\n"
    rows += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + (n if refers is None else 0)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in rows) + "\r\n").encode() + http


def write_archives(kinds: DataFrame, folder: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Writes rows of with_kinds() as archives below `folder` (a URI all workers reach); returns the manifest, already written there."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        path, out, n = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in slices(batches, "html"):
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                body, pack = memoryview(html.encode()), zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(pack.compress(_header(page_id, url, digest, len(body), refers)))
                for at in range(0, len(body) if refers is None else 0, chunk):
                    out.write(pack.compress(body[at : at + chunk]))
                out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    spark = kinds.sparkSession
    kinds.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, MANIFEST).write.parquet(f"{folder}-manifest")
    return spark.read.parquet(f"{folder}-manifest")


def _records(stream, chunk: int) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Headers and block pieces of each record; a block must be read to its end before the next record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should begin: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()

        def block(left: int = int(head["content-length"])) -> Iterator[bytes]:
            while left:
                if not (piece := stream.read(min(left, chunk))):
                    raise EOFError("a WARC record is cut short")
                left -= len(piece)
                yield piece

        yield head, block()


def _payload(block: Iterator[bytes]) -> Iterator[bytes]:
    """The block's pieces after the HTTP headers."""
    head = b""
    for piece in block:
        if head is None:
            yield piece
            continue
        head += piece
        if (at := head.find(b"\r\n\r\n")) >= 0:
            rest, head = head[at + 4 :], None
            if rest:
                yield rest


def read_chunks(manifest: DataFrame, folder: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The archives' records as chunk rows: every record has one with last = true, which holds the digest and length of the whole payload read so far.

    A revisit has no payload: its last chunk is empty, and what it repeats is in header_digest, header_bytes.
    """

    def number(uri: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
        return int(m[1]) if m else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("payload_bytes", pa.int64()), ("running_digest", pa.string()), ("last", pa.bool_()), ("header_digest", pa.string()), ("header_bytes", pa.int64())])
        rows, held = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in _records(stream, chunk):
                        own = (number(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], number(head.get("warc-refers-to")))
                        told = (head["warc-payload-digest"].partition(":")[2], int(head["warc-payload-length"]))
                        so_far, n, k, before = hashlib.sha256(), 0, 0, b""
                        for piece in _payload(block):
                            if k or before:
                                rows.append((*own, k, before, n, so_far.hexdigest(), False, *told))
                                held += len(before)
                                k += 1
                            so_far.update(piece)
                            n, before = n + len(piece), piece
                            if held > 4 * chunk:
                                yield pack()
                                rows, held = [], 0
                        rows.append((*own, k, before, n, so_far.hexdigest(), True, *told))
                        held += len(before) + 400
                        if held > 4 * chunk:
                            yield pack()
                            rows, held = [], 0
        if rows:
            yield pack()

    # a manifest row stands for a whole archive, so rows are dealt out singly
    n = max(1, manifest.count())
    return manifest.repartitionByRange(n, "path").mapInArrow(read, CHUNKS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an archive and back; rows with a null page_id come back with a null."""
    folder = shared_dir(spark, "warc")
    manifest = write_archives(with_kinds(table(spark, sf_dir, "pages")), folder)
    last = read_chunks(manifest, folder).where("last")
    revisit = F.col("record_type") == "revisit"
    return last.select(
        "page_id", F.when(revisit, F.col("header_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("header_digest")).otherwise(F.col("running_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
