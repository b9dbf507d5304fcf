"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of words: space and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the parts only: 52 bits of an MD5 digest."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\n\x0b\f\r")) != ""
