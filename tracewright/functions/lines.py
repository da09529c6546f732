"""Text lines: the shared primitive of every line scanner."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The Unicode White_Space characters, which a plain trim() does not cover.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def split_lines(text: Column) -> Column:
    """Lines without terminators; a final newline adds no line and empty text has none."""
    plain = F.split(F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text), "\n", -1)
    mixed = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).when(text.contains("\r"), mixed).otherwise(plain)


def line_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(
        F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
        + F.when(text.endswith("\n"), 0).otherwise(1)
    )


def explode_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per line with a 1-based ``line_number``; the whole text column is dropped."""
    keep = [c for c in files.columns if c != content]
    return files.select(*keep, F.posexplode(split_lines(F.col(content))).alias("_pos", "line")).select(
        *keep, (F.col("_pos") + 1).alias("line_number"), "line"
    )


def any_match(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def any_contains(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def occurrences(text: Column, token: str) -> Column:
    """Non-overlapping count of a literal token."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("long")
