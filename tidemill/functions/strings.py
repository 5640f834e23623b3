"""String functions with streaming-SQL semantics where Spark's differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def regexp_extract(c: Column, pattern: str, group: int = 0) -> Column:
    """NULL when nothing matches (Spark gives '')."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def regexp_full_match(c: Column, pattern: str) -> Column:
    return c.rlike(f"\\A(?:{pattern})\\z")


def split_index(c: Column, delimiter: str, index: int) -> Column:
    """0-based piece between literal delimiters; NULL out of range."""
    return F.get(F.split(c, F.lit(f"\\Q{delimiter}\\E")), F.lit(index)) if index >= 0 else F.lit(None).cast("string")


def initcap(c: Column) -> Column:
    """Upper-cases after every character that is no letter or digit (Spark: after spaces only)."""
    # Words are split so that each starts with its separators, then re-joined.
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([^\p{L}\p{N}]*[\p{L}\p{N}]*)"), F.lit(1))

    def cap(word: Column) -> Column:
        lead = F.regexp_extract(word, r"^([^\p{L}\p{N}]*)", 1)
        body = F.substr(word, F.length(lead) + 1)
        return F.concat(lead, F.upper(F.substring(body, 1, 1)), F.substr(body, F.lit(2)))

    return F.array_join(F.transform(words, cap), "")


def elt(index: Column, *values: Column) -> Column:
    """The index-th value (from 1); NULL out of range."""
    return F.get(F.array(*values), index - 1)


def str_to_map(c: Column, pair: str = ",", key_value: str = "=") -> Column:
    return F.str_to_map(c, F.lit(f"\\Q{pair}\\E"), F.lit(f"\\Q{key_value}\\E"))


def parse_url(c: Column, part: str, key: str | None = None) -> Column:
    """NULL for a text that is no URL."""
    return F.try_parse_url(c, F.lit(part), F.lit(key)) if key else F.try_parse_url(c, F.lit(part))


def concat(*columns: Column) -> Column:
    """NULL when any part is NULL."""
    return F.concat(*columns)


def btrim(c: Column, chars: str = " ") -> Column:
    return F.btrim(c, F.lit(chars))


def to_base64(c: Column) -> Column:
    """One line of text (Spark breaks lines after 76 characters)."""
    return F.translate(F.base64(c.cast("binary")), "\r\n", "")


def from_base64(c: Column) -> Column:
    """The decoded bytes as text; NULL for text that is no base64."""
    return F.try_to_binary(c, F.lit("base64"))
