"""Salary ranges from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postforge.functions import rules as R
from postforge.functions.text import compact, js_round, matches


def default_currency(region: Column) -> Column:
    return F.when(region == "CA", "CAD").otherwise("USD")


def let(value: Column, f) -> Column:
    """f(value), with the value worked out once however often f names it: inside functions over arrays Spark works each mention out anew."""
    return F.element_at(F.transform(F.array(value), f), 1)


def snippets(text: Column) -> Column:
    """Places that may name a salary: lines with a salary word or a range, each with the two after it, then such paragraphs; distinct, six characters or more."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)<br\s*/?>", "\n"), r"(?i)</?(p|div|section|article|li|ul|ol|h[1-6])[^>]*>", "\n")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), "\r", ""), "\n{3,}", "\n\n")
    hint = lambda x: matches(x, R.SALARY_WORDS) | matches(x, R.RANGE_HINT)
    lines = lambda t: F.filter(F.transform(F.split(t, "\n"), compact), lambda x: x != "")
    near = lambda t: let(lines(t), lambda all_: F.transform(all_, lambda x, i: F.when(hint(x), F.array_join(F.slice(all_, i + 1, 3), " "))))
    whole = lambda t: F.transform(F.transform(F.split(t, r"\n\s*\n"), compact), lambda p: F.when(hint(p), p))
    return F.array_distinct(F.filter(let(t, lambda t: F.concat(near(t), whole(t))), lambda s: s.isNotNull() & (F.length(s) >= 6)))


def _read(s: Column, at: Column) -> Column:
    """Struct of what a snippet says, each pattern tried once: its place, currency, the factor to a year, whether it names pay, money, a range, a currency, something else, and its amounts."""
    number = F.transform(F.regexp_extract_all(s, F.lit(R.AMOUNT), 1), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    suffix = F.transform(F.regexp_extract_all(s, F.lit(R.AMOUNT), 2), F.lower)
    amounts = F.filter(F.zip_with(number, suffix, lambda v, k: v * F.when(k == "m", 1_000_000).when(k == "k", 1_000).otherwise(1)), lambda v: v > 0)
    times = F.lit(1)
    for n, p in reversed(R.PERIODS):
        times = F.when(matches(s, p), n).otherwise(times)
    own = F.when(matches(s, r"\bCAD\b|CA\$|C\$"), "CAD").when(matches(s, r"\bUSD\b|US\$"), "USD").when(matches(s, r"\bEUR\b|€"), "EUR").when(matches(s, r"\bGBP\b|£"), "GBP").when(matches(s, r"\bAUD\b"), "AUD").when(matches(s, r"\bNZD\b"), "NZD")
    named = matches(s, r"\b(CAD|USD|EUR|GBP|AUD|NZD|US\$|CA\$|C\$)\b")
    return F.struct(
        (-at).alias("at"), own.alias("own"), times.alias("times"), matches(s, R.SALARY_WORDS).alias("word"), matches(s, R.MONEY_HINT).alias("money"), matches(s, R.RANGE_HINT).alias("span"), named.alias("named"), matches(s, R.NOT_SALARY).alias("other"), amounts.alias("amounts"),
    )


def _ranged(x: Column) -> Column:
    """The snippet's range: its first two plausible amounts."""
    plausible = F.filter(F.transform(x["amounts"], lambda v: js_round(v * x["times"])), lambda v: (v >= R.SALARY_LEAST) & (v <= R.SALARY_MOST))
    return F.struct(*[x[c].alias(c) for c in ("at", "own", "times", "word", "money", "span", "named", "other")], F.exists(x["amounts"], lambda v: v >= 1000).alias("large"), F.slice(plausible, 1, 2).alias("range"))


def _scored(x: Column) -> Column:
    """Struct of score, place, low, high, currency; null if the snippet names no plausible salary."""
    low, high = F.try_element_at(x["range"], F.lit(1)), F.try_element_at(x["range"], F.lit(-1))
    score = F.when(x["word"], 4).otherwise(0) + F.when(x["span"], 3).otherwise(0) + F.when(x["money"], 2).otherwise(0) + F.when(x["times"] != 1, 1).otherwise(0) + F.when(x["named"], 1).otherwise(0)
    good = ~x["other"] & (x["word"] | x["span"]) & (x["money"] | x["large"]) & (high >= low)
    return F.when(good, F.struct(score.alias("score"), x["at"].alias("at"), low.cast("long").alias("low"), high.cast("long").alias("high"), x["own"].alias("own")))


def from_text(text: Column, hint: Column, region: Column) -> Column:
    """Struct of low, high, currency of the best snippet (the first of equals); null if none is plausible."""
    best = F.array_max(F.transform(F.transform(F.transform(snippets(text), _read), _ranged), _scored))
    given = F.nullif(F.upper(F.trim(hint)), F.lit(""))
    return let(best, lambda b: F.when(b.isNotNull(), F.struct(b["low"].alias("low"), b["high"].alias("high"), F.coalesce(b["own"], given, default_currency(region)).alias("currency"))))


def resolve(low: Column, high: Column, currency: Column, text: Column, region: Column) -> Column:
    """The structured salary if there is one, else the text's, which is read only then."""
    own = F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), F.coalesce(currency, default_currency(region)).alias("currency"))
    none = F.lit(None).cast("long")
    said = let(from_text(text, currency, region), lambda f: F.struct(F.coalesce(f["low"], none).alias("low"), F.coalesce(f["high"], none).alias("high"), F.coalesce(f["currency"], currency, default_currency(region)).alias("currency")))
    return F.when(low.isNotNull() | high.isNotNull(), own).otherwise(said)
