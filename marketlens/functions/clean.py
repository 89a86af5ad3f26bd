"""Column cleaning: lenient numbers, dates, text and Python-literal cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed date formats tried after the ISO cast.
DATE_FORMATS = ["yyyy.MM.dd", "yyyy/MM/dd", "yyyyMMdd", "yyyy.MM.dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy/MM/dd HH:mm"]

# Cell texts that stand for "no value".
NULL_WORDS = ["", "nan", "none"]

# Every character that counts as white space, as a pattern and one by one.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Decimal number text; the cast alone would also take suffixes such as 1d.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACES))


def squash(c: Column) -> Column:
    """Collapse runs of white space to one blank and strip."""
    return F.btrim(F.regexp_replace(c, f"{SPACE}+", " "), F.lit(" "))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_number(c: Column) -> Column:
    """Text to double; what is not a decimal number becomes null."""
    text = c.cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_id(df: DataFrame, name: str) -> Column:
    """Identifier as bigint; fractional text is truncated, what does not fit is null."""
    if isinstance(df.schema[name].dataType, INTEGRAL):
        return F.col(name).cast("bigint")
    return to_number(F.col(name)).try_cast("bigint")


def numeric(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, INTEGRAL):
        return F.col(name).cast("double")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
    return to_number(F.col(name))


def to_timestamp_lenient(c: Column) -> Column:
    """Text to timestamp: ISO first, then the fixed formats; years have four digits; else null."""
    text = strip(c.cast("string"))
    tries = [text.try_cast("timestamp_ntz")]
    tries += [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS]
    found = F.coalesce(*tries)
    return F.when(F.year(found) <= 9999, found)


def parse_iso(c: Column) -> Column:
    """ISO date or date-time; anything else is null."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp_ntz"))


def brand_of(c: Column) -> Column:
    """Stripped brand, null when blank."""
    return F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))


def positive(c: Column) -> Column:
    """The value when it is above zero, else null."""
    return F.when(c > 0, c)


def sentiment(c: Column) -> Column:
    """Rating of 4 or more is positive, 2 or less negative, else neither."""
    return F.when(c >= 4, "positive").when(c <= 2, "negative")


def literal_text(c: Column) -> Column:
    """Cell text, null for the words that mean no value."""
    text = strip(c)
    return F.when(~F.lower(text).isin(NULL_WORDS), text)


def as_json_words(c: Column) -> Column:
    """Python's True, False and None in value position, written as JSON words."""
    for word, json_word in [("True", "true"), ("False", "false"), ("None", "null")]:
        c = F.regexp_replace(c, r"([:\[,]\s*)" + word + r"(?=\s*[,}\]])", "$1" + json_word)
    return c


def parse_literal(c: Column, kind: str) -> Column:
    """Nested value of a Python literal such as ``{'a': 1}``; null for blank or bad text."""
    text = literal_text(c)
    options = {"allowUnquotedFieldNames": "true", "allowBackslashEscapingAnyCharacter": "true"}
    return F.coalesce(F.from_json(text, kind, options), F.from_json(as_json_words(text), kind, options))
