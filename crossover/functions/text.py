"""Column helpers for text: regex counting, match contexts and trimming, all JVM-side."""

from __future__ import annotations

import re
import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Java needs the flags spelled out: case-insensitive, with Unicode classes for \w, \b and \s.
FLAGS = "(?iU)"
# Every character that ends a line, and every one that counts as blank at the ends of a string.
LINE_ENDS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}"
BLANKS = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())


# Letters outside ASCII that equal an ASCII letter when case is ignored: long s, Kelvin sign, dotted and dotless i.
ODD_LETTERS = "[\u017f\u212a\u0130\u0131]"


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def match_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(FLAGS + pattern))


def with_word_search(df: DataFrame, text: str) -> DataFrame:
    """Add the lower-case text and whether it has letters that lower case does not fold, for :func:`may_match`."""
    return df.withColumns({"_low": F.lower(text), "_odd": F.col(text).rlike(ODD_LETTERS)})


def may_match(words: list[str] | None) -> Column:
    """False only for texts that cannot match a pattern whose every match holds one of ``words``.

    A search for a plain word costs a fraction of a Unicode regex, and most texts hold none of the words.
    """
    if not words:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.col("_low").contains(w) for w in words], F.col("_odd"))


# The line ends that a dot in a Java regex does not stop at.
RARE_LINE_ENDS = "\x0b\x0c\x1c\x1d\x1e"


def lines_of_code(text: Column) -> Column:
    """Lines that hold more than blanks: a match starts at the first visible character and eats the rest of the line.

    A dot is about ten times as fast as the class of all line ends, which only texts with one of the rare ends need.
    """
    rare = reduce(lambda a, b: a | b, [text.contains(c) for c in RARE_LINE_ENDS])
    return F.when(rare, F.regexp_count(text, F.lit(f"[^{BLANKS}][^{LINE_ENDS}]*"))).otherwise(F.regexp_count(text, F.lit(f"[^{BLANKS}].*")))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def match_contexts(text: Column, pattern: str, width: int = 20) -> Column:
    """All matches of ``pattern`` with up to ``width`` characters on both sides, as an array of strings.

    A look-behind catches the characters before a match and a look-ahead the match with the ones after it. Neither
    uses up text, so contexts may overlap. The work is linear in the number of matches.
    """
    inner = re.compile(pattern).groups
    regex = (
        rf"(?={pattern_group(pattern)})(?<=(\A(?s:.){{0,{width - 1}}}|(?s:.){{{width}}}))"
        rf"(?=({pattern_group(pattern)}(?s:.){{0,{width}}})){pattern_group(pattern)}"
    )
    before = F.regexp_extract_all(text, F.lit(FLAGS + regex), F.lit(inner + 1))
    after = F.regexp_extract_all(text, F.lit(FLAGS + regex), F.lit(inner + 2))
    return F.zip_with(before, after, lambda a, b: F.concat(a, b))


def pattern_group(pattern: str) -> str:
    return f"(?:{pattern})"


def fixed_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A lookup frame of fixed size. It is marked for broadcast, since its size does not depend on any input."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a small fixed map, NULL when the key is absent; stays inside the projection, no join."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def rows_of(df: DataFrame, keep: list, *conditional: Column) -> DataFrame:
    """One row per conditional struct that is not NULL, next to the columns to ``keep``.

    The plain array stays inside generated code, and its NULLs are dropped row by row after it is unfolded. Filtering
    the array itself would leave generated code, and the optimizer would evaluate it once more to test its size.
    """
    rows = df.select(*keep, F.explode(F.array(*conditional)).alias("_row")).where(F.col("_row").isNotNull())
    return rows.select(*rows.columns[:-1], "_row.*")
