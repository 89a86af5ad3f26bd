"""Repair of generated summaries: finding the JSON object, unwrapping, trimming, removing repeats.

Braces are found by one regular-expression split, so the depth scan steps over pieces and not over
characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.clean import SPACE, let, squash, strip
from marketlens.plans.phrases import NO_GROWTH_TEXT

# The end token, the two keys, the foreign markers and the openers of a proper summary.
END_TOKEN = "<|im_end|>"
OVERVIEW_KEY, GROWTH_KEY = "marketOverviewSummary", "growthSummary"
FOREIGN_MARKERS = ["与你提供的", "对应的", "分析如下", "市场概况", "增长概况", "群与"]
OPENERS = ["본 ", "그림", "전체", "리뷰", "이 ", "연도", "대리"]
VALUE_OPENERS = ['\\":\\"', '": "', '":"', ':\\"']
VALUE_ENDS = ["群", "与", "与你", '", "growthSummary"', '\\", \\"growthSummary\\"', '", "marketOverviewSummary"']
PREFIX_PAST = 50
LONG_VALUE = 30
SHORTEST_SENTENCE = 10
REPEAT_PREFIX = 50
MOST_SENTENCES = 12
FIRST_PART = 500
#: JSON as the standard has it: Spark's parser would take more.
STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def drop_token(c: Column) -> Column:
    return strip(F.replace(strip(c), F.lit(END_TOKEN), F.lit("")))


def balanced_object(c: Column) -> Column:
    """Text from the first ``{`` to the brace that closes it; null without one. Quotes are not special."""
    pieces = F.regexp_extract_all(F.substr(c, F.greatest(F.locate("{", c), F.lit(1))), F.lit(r"[{}]|[^{}]+"), F.lit(0))
    return F.when(F.contains(c, F.lit("{")), let(pieces, closed_part))


def closed_part(pieces: Column) -> Column:
    """The pieces up to the one that brings the depth back to zero."""
    depths = F.transform(pieces, lambda p, i: F.struct((i + 1).alias("i"), F.when(p == "{", 1).when(p == "}", -1).otherwise(0).alias("d")))

    def step(a, x):
        depth = a["depth"] + x["d"]
        return F.when(a["end"] > 0, a).otherwise(F.struct(depth.alias("depth"), F.when((x["d"] < 0) & (depth == 0), x["i"]).otherwise(F.lit(0)).alias("end")))

    end = F.aggregate(depths, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("end")), step, lambda a: a["end"])
    return let(end, lambda n: F.when(n > 0, F.array_join(F.slice(pieces, F.lit(1), n), "")))


def is_object(c: Column) -> Column:
    """Whether a text is a JSON object. Keys may repeat in it."""
    parsed = F.from_json(c, "_any string, _broken string", {**STRICT, "columnNameOfCorruptRecord": "_broken"})
    return F.coalesce(c.startswith("{") & c.endswith("}") & parsed.isNotNull() & parsed["_broken"].isNull(), F.lit(False))


def first_json_object(c: Column, drop_end_token: bool = True) -> Column:
    """Text of the first balanced object when it is valid JSON with at least one key, else null."""
    text = balanced_object(drop_token(c) if drop_end_token else strip(c))
    return let(text, lambda x: F.when(is_object(x) & (strip(F.substr(x, F.lit(2))) != "}"), x))


def json_text(obj: Column, key: str) -> Column:
    """A key's value when it is a string, else null; of a repeated key the last value."""
    # Only the one key is read as a variant, in the order of the text: a later value replaces an earlier one.
    value = F.from_json(obj, f"{key} variant", STRICT)[key]
    return let(value, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))


def bare_tail(c: Column) -> Column:
    """The text without quotes, backslashes and white space at its end."""
    return F.regexp_replace(drop_token(c), SPACE + '*(["\\\\]' + SPACE + "*)+$", "")


def nested_object(c: Column) -> Column:
    """The value as JSON object text when it is one, else null."""
    return let(bare_tail(c), lambda x: F.when(is_object(x), x))


def unwrap_nested(overview: Column, growth: Column, levels: int = 3) -> Column:
    """Replace a value that is itself a JSON object by that object's values, up to three levels.

    Struct of the two texts. Within a level the first key that holds an object wins.
    """
    pair = F.struct(overview.alias("overview"), growth.alias("growth"))
    for _ in range(levels):
        pair = let(pair, unwrap_once)
    return pair


def unwrap_once(pair: Column) -> Column:
    inner = F.coalesce(nested_object(pair["overview"]), nested_object(pair["growth"]))
    return let(
        inner,
        lambda x: F.struct(
            F.coalesce(json_text(x, OVERVIEW_KEY), pair["overview"]).alias("overview"),
            F.coalesce(json_text(x, GROWTH_KEY), pair["growth"]).alias("growth"),
        ),
    )


def first_hit(c: Column, marks: list[str], make) -> Column:
    """``make(mark, position)`` for the first listed mark that occurs, else the text."""
    out = c
    for mark in reversed(marks):
        out = F.when(F.contains(c, F.lit(mark)), make(mark, F.locate(mark, c))).otherwise(out)
    return out


def trim_foreign_tail(c: Column) -> Column:
    """Cut at the end token, then at the first listed foreign marker.

    The part before the marker is kept when it is long enough, else the part after it from the first
    listed opener on.
    """

    def cut(text, mark, at):
        rest = let(strip(F.substr(text, at + len(mark))), lambda after: first_hit(after, OPENERS, lambda opener, j: F.substr(after, j)))
        return F.when(at - 1 > PREFIX_PAST, strip(F.left(text, at - 1))).otherwise(rest)

    return let(
        strip(F.substring_index(strip(c), END_TOKEN, 1)),
        lambda text: first_hit(text, FOREIGN_MARKERS, lambda mark, at: cut(text, mark, at)),
    )


def after_key(c: Column) -> Column:
    """What follows the overview key, plain or with escaped quotes; null without the key."""
    rest = F.lit(None).cast("string")
    for key in [f'\\"{OVERVIEW_KEY}\\"', f'"{OVERVIEW_KEY}"']:
        rest = F.when(F.contains(c, F.lit(key)), F.substr(c, F.locate(key, c) + len(key))).otherwise(rest)
    return rest


def opened_value(rest: Column) -> Column:
    """What follows the first listed opening that occurs."""
    value = F.lit(None).cast("string")
    for opener in reversed(VALUE_OPENERS):
        value = F.when(F.contains(rest, F.lit(opener)), F.substr(rest, F.locate(opener, rest) + len(opener))).otherwise(value)
    return value


def before_end(value: Column) -> Column:
    """The part before the nearest end mark."""
    nearest = F.least(*[F.nullif(F.locate(mark, value), F.lit(0)) for mark in VALUE_ENDS])
    return let(nearest, lambda n: strip(F.when(n.isNotNull(), F.left(value, n - 1)).otherwise(value)))


def recover_value(c: Column) -> Column:
    """Summary text out of a value that still is broken or whole JSON; other text stays as it is."""

    def parsed(text):
        return let(balanced_object(text), lambda obj: F.coalesce(json_text(obj, OVERVIEW_KEY), json_text(obj, GROWTH_KEY), text))

    def best(text):
        broken = strip(text).startswith("{") & (F.contains(text, F.lit(OVERVIEW_KEY)) | F.contains(text, F.lit(GROWTH_KEY)))
        chunk = let(let(after_key(text), opened_value), before_end)
        return let(chunk, lambda x: F.when(broken & (F.length(x) > LONG_VALUE) & x.rlike("[가-힣]"), x).otherwise(text))

    return let(let(c, best), lambda text: F.when(strip(text).startswith("{"), parsed(text)).otherwise(text))


def dedupe_sentences(c: Column, most: int = MOST_SENTENCES) -> Column:
    """Sentences of ten characters or more, without repeats of a 50-character start, at most twelve."""
    marked = F.regexp_replace(c, f"([가-힣a-zA-Z]){SPACE}*[.。]{SPACE}+", "$1\u0001")
    parts = F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda s: F.length(s) >= SHORTEST_SENTENCE)

    def joined(sentences):
        starts = F.transform(sentences, lambda s: F.left(s, F.lit(REPEAT_PREFIX)))
        kept = F.slice(F.array_distinct(starts), 1, most)
        return let(starts, lambda all_starts: F.array_join(F.transform(kept, lambda k: F.element_at(sentences, F.array_position(all_starts, k).cast("int"))), ". "))

    return let(let(parts, joined), lambda text: squash(F.when((text != "") & ~text.endswith("."), F.concat(text, F.lit("."))).otherwise(text)))


def clean_summary(c: Column) -> Column:
    """The whole repair of one summary text."""
    return F.coalesce(dedupe_sentences(recover_value(trim_foreign_tail(c))), F.lit(""))


def strip_markdown(c: Column) -> Column:
    """Lines joined to one paragraph, without headings, list marks, bold and code marks."""
    lines = F.filter(F.transform(F.split(c, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"), strip), lambda t: (t != "") & ~t.startswith("#"))
    bare = F.transform(lines, lambda t: F.when(t.startswith("- "), strip(F.substr(t, F.lit(3)))).otherwise(t))
    plain = F.transform(bare, lambda t: F.replace(F.replace(t, F.lit("**"), F.lit("")), F.lit("`"), F.lit("")))
    return squash(F.array_join(plain, " "))


def coerce_markdown(c: Column) -> Column:
    """Struct of two texts from output without JSON: split at the two headings when both occur."""

    def split(raw):
        low = F.lower(raw)
        i, j = F.locate("market overview", low), F.locate("growth", low)
        both = (i > 0) & (j > 0)
        # A growth heading before the overview heading leaves nothing in between.
        overview = F.when(both, F.substr(raw, i, F.greatest(j - i, F.lit(0)))).otherwise(raw)
        growth = strip_markdown(F.when(both, F.substr(raw, j)).otherwise(F.lit("")))
        return let(growth, lambda x: F.struct(strip_markdown(overview).alias("overview"), F.when(x == "", F.lit(NO_GROWTH_TEXT)).otherwise(x).alias("growth")))

    return let(strip(c), split)


def split_500(c: Column) -> Column:
    """Struct of the first 500 characters and the rest."""
    text = strip(F.coalesce(c, F.lit("")))
    return F.struct(F.left(text, F.lit(FIRST_PART)).alias("overview"), F.substr(text, F.lit(FIRST_PART + 1)).alias("growth"))


def ensure_text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))
