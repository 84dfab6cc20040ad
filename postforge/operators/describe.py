"""Descriptions: cleaned of the page around them, as blocks by a fold over their lines, and what they are worth."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from postforge.functions import rules as R
from postforge.functions.text import EDGE, compact, contains_any, let, sanitize

BLOCK = "array<struct<kind:string,text:string>>"
_HEADING = r"^(?:#{1,3}\s+\S.*|\*\*[^*]+\*\*:?|[A-Z][A-Z\s&'/():-]{3,}|[A-Z][^.!?]{0,55}:)$"
#: Possessive, so that a long text costs no stack.
_DESCRIPTION = r'"description"\s*:\s*"([^"\\]*+(?:\\[\s\S][^"\\]*+)*+)"'
_ITEM = r"^(?:[-•*–·]|\d{1,2}\.)\s+(.+)$"


def _replace(c: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, by in pairs:
        c = F.regexp_replace(c, pattern.replace(r"\b", EDGE), by)
    return c


def blocks(description: Column) -> Column:
    """Array of structs kind (header, list, paragraph) and text; the items of a list are lines of its text.

    A short line under a list goes to it, as in lists whose marks were lost.
    """
    lines = F.filter(F.transform(F.split(sanitize(description), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & (x != ":"))

    def shape(line: Column) -> Column:
        said = lambda head, item: F.when(head, F.trim(F.regexp_replace(line, r"^#+\s+|\*\*|:$", ""))).when(item != "", item).otherwise(line)
        of = lambda head, item: F.struct(head.alias("head"), (item != "").alias("item"), (F.length(line) <= 180).alias("short"), said(head, item).alias("said"))
        return let(F.regexp_extract(line, _ITEM, 1), lambda item: let((item == "") & line.rlike(_HEADING), lambda head: of(head, item)))

    def step(done: Column, line: Column) -> Column:
        last, head, said = F.try_element_at(done, F.lit(-1)), line["head"], line["said"]
        listed = line["item"] | (~head & (last["kind"] == "list") & line["short"])
        kind = F.when(head, "header").when(listed, "list").otherwise("paragraph")
        one = F.struct(kind.alias("kind"), said.alias("text"))
        joined = F.struct(F.lit("list").alias("kind"), F.concat_ws("\n", last["text"], said).alias("text"))
        grow = (kind == "list") & F.coalesce(last["kind"] == "list", F.lit(False))
        head_again = head & F.coalesce((last["kind"] == "header") & (F.lower(last["text"]) == F.lower(said)), F.lit(False))
        return F.when(head_again, done).when(grow, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(one))).cast(BLOCK)

    return F.aggregate(F.transform(lines, shape), F.array().cast(BLOCK), step)


def worth(description: Column, found: Column | None = None) -> Column:
    """Points for structure and length, less those for signs of page chrome. found: the description's blocks, if they are at hand."""
    b = blocks(description) if found is None else found
    n = lambda kind: F.size(F.filter(b, lambda x: x["kind"] == kind))
    noise = sum((F.when(F.lower(description).contains(w), 1).otherwise(0) for w in R.NOISE_WORDS), F.lit(0))
    return n("header") * R.HEADER_POINTS + n("list") * R.LIST_POINTS + n("paragraph") * R.PARAGRAPH_POINTS + F.least(F.length(description), F.lit(R.LENGTH_MOST)) / R.LENGTH_PART - noise * R.NOISE_POINTS


def low_quality(cleaned: Column, found: Column) -> Column:
    """Whether a cleaned description is cut short or has too little in it. found: its blocks."""
    n = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind))
    cut = cleaned.rlike(r"(?:…|\.\.\.)\s*$")
    shaped = ((n("header") > 0) | (n("list") > 0)) & (F.length(cleaned) >= 180)
    return F.coalesce((cleaned == "") | cut | (~shaped & ((F.length(cleaned) < 260) | (n("paragraph") <= 1))), F.lit(True))


def best(candidates: Column) -> Column:
    """Of several texts the one that is worth most, the first of equals; those of low quality and nulls don't count. Null if none is left."""
    said = F.array_distinct(F.filter(F.transform(candidates, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    clean = F.transform(said, lambda x: F.struct(x.alias("said"), cleanup(x).alias("clean")))
    shaped = F.transform(clean, lambda x: F.struct(x["said"].alias("said"), x["clean"].alias("clean"), blocks(x["clean"]).alias("own"), blocks(x["said"]).alias("raw")))
    good = F.filter(shaped, lambda x: ~low_quality(x["clean"], x["own"]))
    scored = F.transform(good, lambda x, i: F.struct(worth(x["said"], x["raw"]).alias("points"), (-i).alias("at"), x["said"].alias("said")))
    return F.array_max(scored)["said"]


def _first(low: Column, words: list[str]) -> Column:
    """The 1-based place of the first of these words; null if there is none."""
    return F.array_min(F.filter(F.array(*[F.instr(low, F.lit(w)) for w in words]), lambda x: x > 0))


def _embedded(raw: Column) -> Column:
    """A page's description in its data, decoded: the first behind a marker, else the longest, the first of equals; null if none is long enough."""

    def decoded(m: Column) -> Column:
        one_line = F.replace(F.replace(m, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
        return F.trim(F.coalesce(F.from_json(F.concat(F.lit('{"d":"'), one_line, F.lit('"}')), "d string")["d"], m))

    long = lambda x: F.when(F.length(x) >= R.EMBEDDED_LEAST, x)
    at = [F.instr(raw, F.lit(m)) for m in R.EMBEDDED_MARKERS]
    marked = [F.when(i > 0, long(decoded(F.regexp_extract(F.substring(raw, i, F.lit(R.EMBEDDED_REACH)), _DESCRIPTION, 1)))) for i in at]
    found = F.transform(F.transform(F.regexp_extract_all(raw, F.lit(_DESCRIPTION), 1), decoded), long)
    longest = F.array_max(F.transform(found, lambda x, i: F.when(x.isNotNull(), F.struct(F.length(x).alias("n"), (-i).alias("at"), x.alias("x")))))["x"]
    return F.coalesce(*marked, longest)


def primary(raw: Column) -> Column:
    """The description within a page's text: from the first heading of one to the first sign of what follows it, without lines of scripts, data and page chrome.

    An embedded description goes before the text around it: the one behind a page's marker, else the longest of all.
    """

    def begun(said: Column) -> Column:
        bare = F.length(F.regexp_extract(said, r"(?is)^(.*?)(?:^|\n)\s*description\s*(?:\n|$)", 1)) + 1
        bare = F.when(said.rlike(r"(?i)(?:^|\n)\s*description\s*(?:\n|$)"), bare)
        return F.substring(said, F.coalesce(F.least(let(F.lower(said), lambda low: _first(low, R.START_MARKERS)), bare), F.lit(1)), F.length(said))

    def ended(text: Column) -> Column:
        ends = let(F.lower(text), lambda low: F.array_min(F.filter(F.array(*[F.instr(low, F.lit(w)) for w in R.END_MARKERS]), lambda x: x > 121)))
        return F.substring(text, F.lit(1), F.coalesce(ends - 1, F.length(text)))

    said = let(raw, lambda r: F.replace(F.coalesce(_embedded(r), r), F.lit("\r"), F.lit("")))
    body = let(let(said, begun), ended)

    def noise(line: Column) -> Column:
        marks = F.length(line) - F.length(F.translate(line, "{}[];", ""))
        return (marks >= 3) | line.rlike("(?i)" + R.SCRIPT_LINE) | line.rlike('^["\\[{]') | F.lower(line).rlike(R.JSON_LINE) | F.lower(line).isin(R.CHROME_LINES)

    lines = F.filter(F.transform(F.split(body, "\n"), compact), lambda x: ~noise(x))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def _inline_headings(c: Column) -> Column:
    """Labels at the beginning of a line and their values: on two lines if the label is a heading and the value short, on one if not."""
    label = f"({R.INLINE_LABEL})"
    plain = [h for h in R.SECTION_HEADINGS if "'" not in h]  # a label's apostrophes don't count, so headings with one are never met
    letters = lambda h: "['’]*".join(re.escape(x) for x in h).replace(r"\ ", "[ ,]+")
    heading = "(?:{})".format("|".join([rf"(?i:['’]*(?:{'|'.join(map(letters, plain))})['’ ,]*):", R.LABEL_OF_TWO_WORDS, f"[^:\n]*(?i:{'|'.join(R.LABEL_WORDS)})"]))
    # the mark tells what is a label here from what only looks like one in a value; it is no character of a text that was sanitized
    marked = F.regexp_replace(F.replace(c, F.lit("\x01"), F.lit("")), rf"(?m)^{label}:\s+(\S.*)$", "$1:\x01$2")
    return F.replace(F.regexp_replace(marked, rf"(?m)^(?={heading}){label}:\x01(\S.{{0,{R.INLINE_VALUE_MOST - 1}}}?)[ \t]*$", "$1:\n$2"), F.lit("\x01"), F.lit(" "))


def _section_headings(c: Column) -> Column:
    """Headings of sections before a colon, each on a line of its own; only those that the text has are looked for as patterns."""
    every = F.array(*[F.struct(F.lit(h).alias("said"), F.lit(rf"(?i)\s*({re.escape(h)})\s*:").alias("pattern")) for h in R.SECTION_HEADINGS])
    there = let(F.lower(c), lambda low: F.filter(every, lambda h: F.contains(low, h["said"])))
    return F.aggregate(there, c, lambda done, h: F.regexp_replace(done, h["pattern"], F.lit("\n\n$1:\n")))


def cleanup(raw: Column) -> Column:
    """A description as text: the page around it and its markup taken away, headings of sections on lines of their own, items on lines with a mark."""
    trimmed = F.trim(raw)
    shaped = trimmed.contains("\n") & trimmed.rlike(r"(?m)^([A-Z][^.!?]{0,60}:|\*\*.+\*\*|[-•*–·]\s+)") & ~contains_any(F.lower(trimmed), R.MARKUP_SIGNS)
    c = F.when(shaped, raw).otherwise(primary(raw))
    c = _replace(
        F.replace(c, F.lit("\r"), F.lit("")), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(p|div|section|article|li|ul|ol|h1|h2|h3|h4|h5|h6)>", "\n"), ("(?i)<li[^>]*>", "\n• "), ("<[^>]+>", " "), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
        ("(?i)" + R.CALLS_TO_APPLY, ""), (r"(?m)^[=\-*_]{3,}\s*$", ""), ("[“”]", '"'), ("[‘’]", "'"), ("[ \t]+\n", "\n"), ("\n[ \t]+", "\n"), ("[ \t]{2,}", " "),
    )
    c = _inline_headings(c)
    c = let(c, _section_headings)
    return F.regexp_replace(_replace(
        c, (r"(?i)^description\s*\n+", ""), (r"\n+\s*:\s*\n+", ":\n"), (r"\s+[•·▪◦]\s+", "\n• "), (r"\s+[-–—]\s+(?=[A-Z0-9])", "\n- "), (r"\s+(\d{1,2}\.\s+)", "\n$1"), (R.BARE_HEADINGS, "\n\n$1\n"), (r"(?im)^About the job\s+.+$", "About the job"), ("\n{3,}", "\n\n"),
    ), r"^\s+|\s+$", "")
