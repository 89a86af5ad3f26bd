"""Nested product cells: star counts, channel counts, tags, price trend, specifications, unit price."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.clean import let, parse_literal, strip, to_number

STARS = ["1", "2", "3", "4", "5"]

# Fixed period names of the price trend.
RECENT_PERIOD = "1개월"
PAST_PERIOD = "6개월"

# Specification keys per rule, the label each gives, and the words that mark a type.
AGE_KEYS = ["연령", "사용연령", "적용연령", "대상연령"]
CAPACITY_KEYS = ["용량", "규격", "크기", "사이즈"]
COMPOSITION_KEYS = ["구성", "포함내용", "구성품"]
TYPE_WORDS = ["유기농", "무첨가", "무향", "프리미엄", "세트", "단품", "대용량", "소용량"]
AGE_LABEL, CAPACITY_LABEL, COMPOSITION_LABEL, TYPE_LABEL, UNIT_LABEL = "연령", "용량", "구성", "타입", "단위"
CAPACITY_PATTERN = r"\p{Nd}+[mlkgL매개권조각세트팩]+"
UNIT_PATTERN = "원/([가-힣a-zA-Z]+)"
LONGEST_COMPOSITION = 29

NO_TEXTS = "array<string>"


def whole_number(c: Column) -> Column:
    """Number text truncated to a whole number; 0 when it is not a number."""
    return F.coalesce(to_number(c).try_cast("bigint"), F.lit(0))


def text_map(c: Column) -> Column:
    return parse_literal(c, "map<string,string>")


def star_counts(cell: Column) -> Column:
    """Counts for one to five stars of a parsed cell; null without a readable map."""
    return F.when(cell.isNotNull(), F.array(*[whole_number(cell[k]) for k in STARS]))


def channel_counts(cell: Column) -> Column:
    return F.transform_values(cell, lambda k, v: whole_number(v))


def tag_list(c: Column) -> Column:
    return parse_literal(c, "array<string>")


def tags(cell: Column) -> Column:
    """Stripped non-blank tags of a parsed cell, repeats kept."""
    return F.filter(F.transform(cell, lambda t: strip(F.coalesce(t, F.lit("None")))), lambda t: t != "")


def price_points(c: Column) -> Column:
    return parse_literal(c, "array<struct<period:string,price:string>>")


def price_change(cell: Column) -> Column:
    """Relative change from the past to the recent period, from the first valid price of each."""
    points = F.transform(cell, lambda x: F.struct(strip(x["period"]).alias("period"), to_number(x["price"]).alias("price")))
    valid = F.filter(points, lambda x: x["price"] > 0)

    def first_price(items, period):
        return F.get(F.filter(items, lambda x: x["period"] == period), F.lit(0))["price"]

    return let(valid, lambda items: let(first_price(items, PAST_PERIOD), lambda past: (first_price(items, RECENT_PERIOD) - past) / past))


def spec_object(c: Column) -> Column:
    return parse_literal(c, "variant")


def label(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def entries(c: Column) -> Column:
    """Key, value and kind of every entry of a VARIANT object; null for anything else."""
    pairs = F.map_entries(F.try_variant_get(c, "$", "map<string,variant>"))
    return F.transform(pairs, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.schema_of_variant(e["value"]).alias("kind")))


def spec_labels(cell: Column) -> Column:
    """Age, capacity, composition and type labels of a parsed specification cell, repeats kept.

    A value counts when it is text, directly or inside a nested map; a nested true counts for type words.
    """

    def text(x):
        return F.when(x["kind"] == "STRING", F.try_variant_get(x["value"], "$", "string"))

    def leaf(key, inner, x):
        flag = (x["kind"] == "BOOLEAN") & F.try_variant_get(x["value"], "$", "boolean")
        return F.struct(key.alias("key"), inner.alias("inner"), text(x).alias("text"), flag.alias("flag"))

    def leaves(x):
        nested = F.transform(entries(x["value"]), lambda y: leaf(x["key"], y["key"], y))
        return F.when(x["kind"].startswith("OBJECT"), nested).otherwise(F.array(leaf(x["key"], F.lit(None).cast("string"), x)))

    def found(x):
        return let(strip(x["text"]), lambda trimmed: chosen(x, trimmed, F.length(trimmed)))

    def chosen(x, trimmed, size):
        return (
            F.when(x["key"].isin(AGE_KEYS) & (size > 0), label(AGE_LABEL, trimmed))
            .when(x["key"].isin(CAPACITY_KEYS) & x["text"].rlike(CAPACITY_PATTERN), label(CAPACITY_LABEL, trimmed))
            .when(x["key"].isin(COMPOSITION_KEYS) & size.between(1, LONGEST_COMPOSITION), label(COMPOSITION_LABEL, trimmed))
            .when(x["inner"].isin(TYPE_WORDS) & x["flag"], label(TYPE_LABEL, x["inner"]))
        )

    all_leaves = F.flatten(F.transform(entries(cell), leaves))
    return F.coalesce(F.array_compact(F.transform(all_leaves, found)), F.array().cast(NO_TEXTS))


def unit_labels(c: Column) -> Column:
    """The unit name after the currency sign, as an array of at most one label."""
    unit = F.regexp_extract(strip(c), UNIT_PATTERN, 1)
    return F.when(unit != "", F.array(label(UNIT_LABEL, unit))).otherwise(F.array().cast(NO_TEXTS))
