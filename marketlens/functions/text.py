"""Text functions: tokens, truncation, counting and word overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.clean import squash, strip

# Fixed patterns: runs of two or more Hangul syllables, runs of two or more Latin letters.
HANGUL_WORD = "[가-힣]{2,}"
LATIN_WORD = "[a-zA-Z]{2,}"

# Fixed patterns of the overlapping number counts.
NUMBER_PATTERNS = [r"\p{Nd}+\.\p{Nd}+%", r"\p{Nd}+%", r"\p{Nd}+\.\p{Nd}+점", r"\p{Nd}+\.\p{Nd}+"]


def found_words(c: Column) -> Column:
    """Hangul and Latin words as written, with repeats. The two classes are disjoint, so one scan finds both."""
    return F.regexp_extract_all(c, F.lit(f"{HANGUL_WORD}|{LATIN_WORD}"), F.lit(0))


def tokens(c: Column) -> Column:
    """The words of a text with Latin ones in lower case."""
    return F.transform(found_words(c), F.lower)


def word_rows(texts: DataFrame, keys, text: Column) -> DataFrame:
    """One row per word. Lower case is applied after the explode, where it is compiled code."""
    return texts.select(*keys, F.explode(found_words(text)).alias("word")).withColumn("word", F.lower("word"))


def squash_truncate(c: Column, size: int) -> Column:
    """Collapse white space; a text over ``size`` characters keeps ``size - 1`` and an ellipsis."""
    flat = squash(F.coalesce(c, F.lit("")))
    if size <= 0:
        return flat
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size - 1), F.lit("…"))).otherwise(flat)


def pieces(c: Column, mark: str) -> Column:
    """Non-blank pieces between marks."""
    return F.filter(F.split(c, mark), lambda p: strip(p) != "")


def sentence_count(c: Column) -> Column:
    """Pieces by full stop plus pieces by ! plus pieces by ?, at least 1; 0 for empty text."""
    stops = F.size(pieces(F.replace(c, F.lit("。"), F.lit(".")), r"\."))
    total = stops + F.size(pieces(c, "!")) + F.size(pieces(c, r"\?"))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(0)).otherwise(F.greatest(total, F.lit(1)))


def key_number_count(c: Column) -> Column:
    """Matches of the four number patterns, added up although they overlap."""
    text = F.coalesce(c, F.lit(""))
    total = F.lit(0)
    for pattern in NUMBER_PATTERNS:
        total = total + F.regexp_count(text, F.lit(pattern))
    return total


def words(c: Column) -> Column:
    """Distinct white-space separated words."""
    flat = squash(F.coalesce(c, F.lit("")))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(flat, " ")))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; 0 when either side has none."""
    left, right = words(a), words(b)
    shared, union = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), shared / union).otherwise(F.lit(0.0))


def mentions_proxy(a: Column, b: Column) -> Column:
    """Either text admits to the proxy measure."""
    def one(c):
        text = F.coalesce(c, F.lit(""))
        return F.contains(text, F.lit("대리 지표")) | F.contains(F.lower(text), F.lit("proxy"))
    return one(a) | one(b)
