"""Lengths, token estimates and line splitting as column expressions."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources import jvm

#: Characters a token, by encoding.
RATIOS = {"cl100k_base": 3.5, "o200k_base": 4.0, "p50k_base": 3.2, "r50k_base": 3.2}
VOCABULARY_SIZES = {"cl100k_base": 100_256, "o200k_base": 200_000, **dict.fromkeys(("p50k_base", "r50k_base"), 50_257)}

_WORDS = "abstract as async await case catch class const default declare delete else enum export extends finally for from function if implements import in instanceof interface let module namespace new of override private protected public readonly return satisfies static switch throw try type typeof using var while with yield"
KEYWORDS = sorted(_WORDS.split(), key=lambda w: (-len(w), w))

#: White space as scripts see it, beyond ASCII.
SPACES = "\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
NO_LINE_END = "[^\\n\\r\\x{2028}\\x{2029}]"
COMMENT = f"//{NO_LINE_END}*|/\\*(?s:.*?)\\*/"
LITERAL = "|".join(f"{q}(?:[^{q}\\\\]|\\\\{NO_LINE_END})*{q}" for q in "\"'`")


def lexeme_pattern(end: str) -> str:
    """One match a lexeme. end: what ends a keyword or a big-integer suffix."""
    number = f"\\d+\\.?\\d*(?:[eE][+-]?\\d+)?(?:n{end})?"
    name = "[A-Za-z_$#][A-Za-z0-9_$\\x{80}-\\x{10FFFF}]*"
    return f"(?s)(?:[\\r\\n \\t]|\\.\\.\\.|(?:{'|'.join(KEYWORDS)}){end}|{number}|{name}|.)"


def js_round(x: Column) -> Column:
    """Half goes up, below zero too."""
    return F.floor(x + F.lit(0.5))


_MADE: dict = {}


def _java(name: str, returns: str, x: Column, *args: object) -> Column:
    """x through the class of that name in lexemes.java. Expressions would take a text apart by patterns and weigh each match by itself, about ten times as dear."""
    spark = SparkSession.active()
    key = spark.sparkContext.applicationId, spark.sparkContext.startTime, spark._jsparkSession.sessionUUID(), name
    if key not in _MADE:
        _MADE[key] = jvm.function(spark, Path(__file__).parent / "lexemes.java", f"lexforge.lexemes.{name}", returns, *args)
    return _MADE[key](x)


def units(x: Column) -> Column:
    """UTF-16 code units."""
    return _java("Units", "int", x)


def ceil_div(x: Column, ratio: float) -> Column:
    return F.ceil(x.cast("double") / F.lit(float(ratio)))


def fast_tokens(x: Column, encoding: str = "cl100k_base") -> Column:
    """Units by a fixed ratio; at least 1, but 0 for an empty text."""
    return F.when(F.length(x) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), ceil_div(units(x), RATIOS[encoding]))).cast("long")


def at_least(x: Column, least: int, ratio: float = 3.5) -> Column:
    """max(least, ceil(units / ratio))."""
    return F.greatest(F.lit(least), ceil_div(units(x), ratio)).cast("long")


def tokens(x: Column) -> Column:
    """Estimate by lexemes: weights summed, times 0.88, rounded up. Signs outside words weigh their UTF-8 bytes, or 8 if these are 4."""
    total = _java("Weight", "long", x, " ".join(KEYWORDS))
    return F.when(F.length(x) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(total.cast("double") * F.lit(0.88)))).cast("long")


def lines(x: Column) -> Column:
    return F.when(F.length(x) == 0, F.lit(0)).otherwise(F.size(F.split(x, "\n")))


def words(x: Column) -> Column:
    return _java("Words", "int", x)


def breakdown(x: Column) -> dict[str, Column]:
    """The eight figures of a text."""
    comments, strings = _java("Comments", "long", x), _java("Literals", "long", x)
    return {
        "tokens": tokens(x),
        "characters": units(x).cast("long"),
        "words": words(x).cast("long"),
        "lines": lines(x).cast("long"),
        "code_tokens": F.greatest(F.lit(0), tokens(x) - comments - strings).cast("long"),
        "comment_tokens": comments,
        "string_tokens": strings,
        "whitespace_tokens": F.floor(lines(x) * F.lit(0.3)).cast("long"),
    }


def split_to_fit(x: Column, most: int) -> Column:
    """The text if it fits; else chunks of whole lines, filled in order. A line over the limit is a chunk."""
    rows = F.transform(F.split(x, "\n"), lambda r: F.struct(r.alias("line"), tokens(r).alias("cost")))
    start = F.struct(
        F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).cast("long").alias("cost")
    )

    def step(acc, r):
        over = (acc["cost"] + r["cost"] > most) & (F.size(acc["open"]) > 0)
        return F.struct(
            F.when(over, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(over, F.array(r["line"])).otherwise(F.concat(acc["open"], F.array(r["line"]))).alias("open"),
            F.when(over, r["cost"]).otherwise(acc["cost"] + r["cost"]).alias("cost"),
        )

    def finish(acc):
        return F.transform(F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]), lambda c: F.array_join(c, "\n"))

    return F.when(tokens(x) <= most, F.array(x)).otherwise(F.aggregate(rows, start, step, finish))


#: Shares of a budget.
SHARES = {"symbols": 0.80, "dependencies": 0.12, "footer": 0.05, "header": 0.03}


def budget(total: Column) -> dict[str, Column]:
    return {k: F.ceil(total * F.lit(s)).cast("long") for k, s in SHARES.items()}


def chars_of_tokens(n: Column) -> Column:
    return js_round(n * F.lit(3.5)).cast("long")


def chars_per_token(x: Column) -> Column:
    return F.round(units(x) / tokens(x), 2)


def comparison(before: Column, after: Column) -> Column:
    share = F.when(before > 0, (before - after) / before * 100).otherwise(F.lit(0.0))
    return F.format_string("tokens: %d → %d (saved %d, %.1f%%)", before, after, before - after, share)


def split_words(x: str) -> list[str]:
    """Lower-cased ASCII words of more than two characters."""
    import re

    return [w for w in re.split(r"[^A-Za-z0-9_]+", x.lower()) if len(w) > 2]
