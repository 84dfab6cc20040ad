"""Byte-level BPE with the tokenizers library: encoding and decoding of Arrow batches.

A text is cut by the vocabulary's pattern, each distinct piece is encoded once per worker (as characters
that stand for bytes) and kept with its ids and the character at which each token begins.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from llm.common import slices, table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores

#: Distinct pieces that a worker keeps; then it begins anew with those of the slice at hand.
CACHE = 100_000
#: Pieces that the tokenizer encodes at a time.
BATCH = 4096
#: Longer texts are cut where no piece can go on: before a space that follows a non-space and leads a letter.
LONG = 1 << 20
SPACES = r"\t-\r\x20\x85\xa0  -     　"


def byte_table() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it has one of its own, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encodes and decodes by a file of ranks."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        ranks, chars = read_ranks(path), byte_table()
        shown = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
        merges = []
        for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):  # every pair that makes a token, at the token's rank
            cuts = [(max(ranks[token[:i]], ranks[token[i:]]), i) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(shown[token[:i]], shown[token[i:]]) for _, i in sorted(cuts)]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        own = pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]")
        self.pieces = regex.compile(own)
        self.cut = regex.compile(rf"(?<=[^{SPACES}])(?= \p{{L}})")
        back = {c: b for b, c in chars.items()}
        self.token_bytes: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token_bytes[r] = bytes(back[c] for c in shown[t])
        self.known: dict[str, bytes] = {}
        self.places: dict[str, np.ndarray] = {}

    def _learn(self, used: set[str]) -> None:
        if new := list(used.difference(self.known)):
            if len(self.known) + len(new) > CACHE:
                self.known = {p: i for p in used if (i := self.known.get(p)) is not None}
            for a in range(0, len(new), BATCH):  # an encoding takes some hundred bytes
                lot = new[a : a + BATCH]
                for piece, e in zip(lot, self.tokenizer.encode_batch_fast(lot, add_special_tokens=False), strict=True):
                    self.known[piece] = array("I", e.ids).tobytes()

    def _starts(self, piece: str) -> np.ndarray:
        if (at := self.places.get(piece)) is None:
            if len(self.places) > CACHE:
                self.places.clear()
            at = self.places[piece] = np.array([a for a, _ in self.tokenizer.encode(piece, add_special_tokens=False).offsets], np.int64)
        return at

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > LONG:
            m = self.cut.search(text, at + LONG)
            if m is None:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        parts = [[self.pieces.findall(p) for p in self._parts(t)] for t in texts]
        self._learn(set().union(*(pieces for part in parts for pieces in part)))
        get = self.known.__getitem__
        return [b"".join([b"".join(map(get, pieces)) for pieces in part]) for part in parts]

    def char_starts(self, text: str) -> np.ndarray:
        """The character at which each token begins; tokens that share a character begin at the same one."""
        found, base = [np.empty(0, np.int64)], 0
        for part in self._parts(text):
            for piece in self.pieces.findall(part):
                found.append(self._starts(piece) + base)
                base += len(piece)
        return np.concatenate(found)

    def decode(self, ids: bytes) -> bytes:
        """The tokens' bytes."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode_text(pieces: Iterator[bytes]) -> Iterator[str]:
    """Text of byte pieces as they come: a character that tokens split waits for the rest of its bytes; bytes that are none become U+FFFD."""
    d = codecs.getincrementaldecoder("utf-8")("replace")
    for piece in pieces:
        yield d.decode(piece)
    yield d.decode(b"", True)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, char_starts (arrays of int) of each row's whole text; null is empty. Repeated rows stay; a null doc_id stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches):
            own = [t or "" for t in b.column("text").to_pylist()]
            both = [np.frombuffer(i, "<u4") for i in c.encode(own)], [c.char_starts(t) for t in own]
            cols = [pa.array([x.astype(np.int32) for x in col], pa.list_(pa.int32())) for col in both]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "ids", "char_starts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, char_starts array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes, text of rows with ids; null ids are none, ids outside the vocabulary raise. Bytes that aren't UTF-8 show as U+FFFD in text only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            raw = [c.decode(np.array(x or [], "<u4").tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary()), pa.array(["".join(decode_text(iter([r]))) for r in raw], pa.string())], ["doc_id", "bytes", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoding and decoding in one pass, so that ids don't go through the JVM between them. Null is empty; repeated rows and null ids stay, other columns play no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches):
            ids = c.encode([t or "" for t in b.column("text").to_pylist()])
            n = pa.array([len(i) // 4 for i in ids], pa.int64())
            hexes = [pa.array([hashlib.sha256(x).hexdigest() for x in col]) for col in (ids, map(c.decode, ids))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, *hexes], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)


def encode_checked(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 of each row's whole text: the token ids, and the digest of what they decode to. Null is empty; repeated rows and null ids stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches):
            ids = c.encode([t or "" for t in b.column("text").to_pylist()])
            n = pa.array([len(i) // 4 for i in ids], pa.int64())
            arrays = pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, arrays, pa.array([hashlib.sha256(c.decode(i)).hexdigest() for i in ids])], ["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents, by digests(). path: a file of ranks; the contract's by default."""
    return digests(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
