"""Chat formatting by event sourcing: each conversation's log, in order of its sequence numbers, is folded into final messages and rendered.

Rendered turns look like
    <s>[ROLE]user[/ROLE][INST]text[/INST]</s><s>[ROLE]assistant[/ROLE]text</s>
A control string inside a text or role gets a backslash after its first character, and one that already
has some gets one more, so that unescaping gives back exactly what was there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import partitions, table

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_INSIDE = re.compile(r"([<\[])(\\*)(?=/?s>|/?INST\]|/?ROLE\])")
_TOKEN = re.compile("|".join(map(re.escape, CONTROLS)))
#: Rendered characters to a row; a longer conversation goes on in further rows.
PIECE_CHARS = 1 << 20

EVENTS = ("message", "delta", "edit", "regenerate")
RENDERED = "conv_id long, piece long, formatted string, loss_spans array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    return _INSIDE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return re.sub(r"([<\[])\\(\\*)(?=/?s>|/?INST\]|/?ROLE\])", r"\1\2", text)


def fold(events: list[tuple[str, int | None, str, str]]) -> list[tuple[str, str]]:
    """Final (role, text) of events (kind, target, role, text) in order.

    message: a new message; delta: more text for message number `target` (null: the last), which begins
    one if there is none; edit: its new text; regenerate: it and all after it go, and a new message of
    that role with the given text takes its place. Targets that don't exist are as null. An unknown kind is a message.
    """
    out: list[tuple[str, str]] = []
    for kind, target, role, text in events:
        at = len(out) - 1 if target is None or not 0 <= target < len(out) else target
        if at < 0 or kind not in EVENTS[1:]:
            out.append((role, text))
        elif kind == "delta":
            out[at] = (out[at][0], out[at][1] + text)
        elif kind == "edit":
            out[at] = (out[at][0], text)
        else:
            out[at:] = [(role or out[at][0], text)]
    return out


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn's rendering, and where the text begins and ends in it."""
    head = f"<s>[ROLE]{escape(role)}[/ROLE]" + "[INST]" * (role == "user")
    body = escape(text)
    return head + body + "[/INST]" * (role == "user") + "</s>", len(head), len(head) + len(body)


def format_conversations(log: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Renders a log of conv_id, seq, kind, target, role, text into rows of conv_id, piece, formatted, loss_spans.

    Null texts and roles are empty; a null conv_id is a conversation of its own; null sequence numbers
    come first; events of one number go by kind, role and text; repeated rows are repeated events.
    loss_spans: where the assistant's (escaped) texts stand in `formatted`. Rows of a conversation follow
    one another in one partition, in order; it is streamed, and a log of messages only is never whole in memory
    (edits need the conversation's messages at hand).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        none = object()
        conv, events, piece, done = none, [], 0, []

        def flush() -> None:
            """The messages so far become rows."""
            nonlocal events, piece
            parts, spans, n = [], [], 0
            for role, text in fold(events):
                s, a, b = render(role, text)
                if parts and n + len(s) > piece_chars:
                    done.append((conv, piece, "".join(parts), spans))
                    piece, parts, spans, n = piece + 1, [], [], 0
                if role == "assistant":
                    spans.append({"start": n + a, "end": n + b})
                parts.append(s)
                n += len(s)
            if parts:
                done.append((conv, piece, "".join(parts), spans))
                piece += 1
            events = []

        def pack() -> pa.RecordBatch:
            nonlocal done
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done = []
            return out

        held = 0
        for batch in batches:
            for cid, _, kind, target, role, text, plain in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cid != conv or conv is none:
                    if events:
                        flush()
                    conv, piece, held = cid, 0, 0
                if plain and held > piece_chars:
                    flush()
                    held = 0
                events.append((kind or "message", target, role or "", text or ""))
                held += len(text or "")
            if sum(len(x[2]) for x in done) > 4 * piece_chars:
                yield pack()
        if events:
            flush()
        if done:
            yield pack()

    cols = ["conv_id", "seq", "kind", "target", "role", "text"]
    dealt = log.select(F.col("conv_id").cast("long").alias("conv_id"), "seq", "kind", F.col("target").cast("int").alias("target"), "role", "text")
    dealt = dealt.repartition(partitions(log.sparkSession), "conv_id")
    plain = F.min(F.coalesce(F.col("kind"), F.lit("message")) == "message").over(Window.partitionBy("conv_id"))  # nothing comes that changes what has been
    return dealt.withColumn("plain", plain).sortWithinPartitions(*cols).select(*cols, "plain").mapInArrow(run, RENDERED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendering, unescaped."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith("<s>[ROLE]", at):
            raise ValueError(f"no turn at {at}")
        m = _TOKEN.search(formatted, at + 9)
        role, at = unescape(formatted[at + 9 : m.start()]), m.end()
        if role == "user":
            at += 6
        m = _TOKEN.search(formatted, at)
        out.append((role, unescape(formatted[at : m.start()])))
        at = m.end() + (4 if role == "user" else 0)
    return out


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests per conversation, from format_conversations()'s rows alone, in their order. No rows, no digests; a null conv_id is a conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, state, done = none, None, []
        for batch in batches:
            for cid, _, formatted, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv is none or cid != conv:
                    if conv is not none:
                        done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    conv, state = cid, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    text = unescape(formatted[span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []
        if conv is not none:
            done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    return rendered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more of its own. Null texts are empty; rows of one conversation with equal turns stand in the order of role and text; other columns play no part."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, seq long, role string, text string")
    log = rows.unionByName(own).withColumns({"kind": F.lit("message"), "target": F.lit(None).cast("int")})
    return read_back(format_conversations(log))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\])', '\1\2\\\3', 'g') AS esc FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(esc) + length(role) + 3 + 6 + 7 + 4 + CASE WHEN role = 'user' THEN 13 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
