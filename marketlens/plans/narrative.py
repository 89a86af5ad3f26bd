"""Texts of a report: findings first, then the wording of each finding.

Everything here is an expression over one metrics row, so the texts add no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions import bands
from marketlens.functions.clean import strip
from marketlens.functions.numbers import fixed, fmt_int, pct
from marketlens.operators.growth import END_YEAR, START_YEAR
from marketlens.plans.phrases import BULLETS, ENTRY, GROWTH, OVERVIEW


def say(pattern: str, *args: Column) -> Column:
    return F.format_string(pattern, *args) if args else F.lit(pattern)


def by_code(code: Column, table: dict, args: dict[str, list[Column]]) -> Column:
    """The phrase of whichever code the row has, filled with the arguments given for that code."""
    out = F.lit(None).cast("string")
    for key, values in args.items():
        out = F.when(code == key, say(table[key], *values)).otherwise(out)
    return out


def present(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def field(items: str, name: str, n: int) -> Column:
    return F.transform(F.slice(F.col(items), 1, n), lambda x: x[name])


def listing(items: Column) -> Column:
    return F.array_join(items, ", ")


def has(items: str) -> Column:
    return F.size(F.col(items)) > 0


def market_overview() -> Column:
    top3, zero, hhi = F.coalesce("top3_brand_share", F.lit(0.0)), F.coalesce("zero_review_ratio", F.lit(0.0)), F.col("hhi_top10")
    named = F.col("category_name") != ""
    premise = F.when(named, say(OVERVIEW["premise_named"], F.col("category_name"))).otherwise(F.lit(OVERVIEW["premise_unnamed"]))

    share = F.when(top3 > 0, pct(top3)).otherwise(F.lit(OVERVIEW["share_unknown"]))
    leaders = by_code(bands.concentration_band(top3), OVERVIEW, {"strong": [share], "mixed": [share], "dispersed": [share]})
    maturity = by_code(bands.maturity_band(zero), OVERVIEW, {"emerging": [pct(zero)], "mature": [pct(zero)], "transitional": []})

    points = [fixed(F.bround(hhi), 0)]
    structure = by_code(bands.hhi_band(hhi), OVERVIEW, {"monopoly": points, "concentrated": points, "competitive": points, "none": []})

    quality = by_code(bands.rating_band(F.col("low_rating_ratio")), OVERVIEW, {"uneven": [], "stable": []})
    rating = F.when(F.col("avg_rating").isNotNull(), F.concat(say(OVERVIEW["rating"], fixed(F.col("avg_rating"), 1)), quality))

    cues = F.slice(F.concat(field("top_segments", "segment", 3), field("top_tags", "tag", 3)), 1, 3)
    volume = F.when(F.col("total_review_count") != 0, say(OVERVIEW["review_volume"], fmt_int(F.col("total_review_count")))).otherwise(F.lit(""))
    decision = F.when(F.size(cues) > 0, F.concat(volume, say(OVERVIEW["decision"], listing(cues))))

    first_step = by_code(bands.action_band(zero), OVERVIEW, {"gather_reviews": [], "niche_position": []})
    second_step = F.when(has("top_segments"), F.lit(OVERVIEW["with_segments"])).otherwise(F.lit(OVERVIEW["without_segments"]))
    return F.array_join(
        present(
            premise,
            say(OVERVIEW["conclusion"], leaders, maturity),
            say(OVERVIEW["competition"], structure),
            rating,
            decision,
            say(OVERVIEW["action"], first_step, second_step),
        ),
        " ",
    )


def growth_summary(start_year: int = START_YEAR, end_year: int = END_YEAR) -> Column:
    """Text over the columns of ``growth_extremes``, of a series over the given years; those are null for a group without one."""
    moving = F.col("max_growth").isNotNull()
    text = F.array_join(
        present(
            F.lit(GROWTH["premise"]),
            F.when(moving, F.lit(GROWTH["flow"] % (start_year, end_year))),
            F.when(moving, say(GROWTH["best_year"], F.col("max_growth_year").cast("string"))),
            F.when(F.col("min_growth") < 0, F.lit(GROWTH["decline"])),
            F.when(moving & (F.col("recent_years") >= 2) & (F.col("recent_rates") >= 1), F.lit(GROWTH["momentum"])),
            F.when(moving, F.lit(GROWTH["caveat"])),
        ),
        " ",
    )
    return F.when(F.coalesce("n_points", F.lit(0)) > 0, text).otherwise(F.lit(GROWTH["no_data"]))


def summary_bullets(limit: int = 8) -> Column:
    """Up to nine conditional lines, cut to ``limit``."""
    name, count = F.col("category_name"), [fmt_int(F.col(c)) for c in ("product_count", "brand_count", "total_review_count")]
    size = F.when(F.col("brand_count") > 0, say(BULLETS["size_brands"], name, *count)).otherwise(say(BULLETS["size"], name, count[0], count[2]))

    average = fixed(F.col("avg_rating"), 2)
    rating = F.when(F.col("low_rating_ratio").isNotNull(), say(BULLETS["rating_low"], average, pct(F.col("low_rating_ratio")))).otherwise(say(BULLETS["rating"], average))

    change = F.when(F.col("price_change_6m_median").isNotNull(), say(BULLETS["price_change"], pct(F.col("price_change_6m_median")))).otherwise(F.lit(""))
    price = F.concat(say(BULLETS["price"], *[fmt_int(F.col(c)) for c in ("price_p50", "price_p25", "price_p75")]), change)

    def channel(i):
        x = F.get(F.col("top_platforms"), F.lit(i))
        return [x["platform"], pct(x["count"] / F.col("platform_total"))]

    channels = F.when(F.size("top_platforms") == 1, say(BULLETS["channel_one"], *channel(0))).otherwise(say(BULLETS["channel_two"], *channel(0), *channel(1)))

    leaders = listing(F.transform(F.slice(F.col("top_brands"), 1, 3), lambda b: F.concat(b["name"], F.lit("("), pct(b["share"]), F.lit(")"))))
    top3 = F.col("top3_brand_share")
    brand_line = F.when(top3.isNotNull(), say(BULLETS["brands_share"], leaders, pct(top3))).otherwise(say(BULLETS["brands"], leaders))

    values = F.transform(field("top_segments", "segment", 3), lambda s: strip(F.regexp_replace(s, r"^[^:]*:", "")))
    lines = present(
        size,
        F.when(F.col("zero_review_ratio").isNotNull(), say(BULLETS["zero_reviews"], pct(F.col("zero_review_ratio")))),
        F.when(F.col("avg_rating").isNotNull() & (F.col("total_review_count") > 0), rating),
        F.when(F.col("price_p50").isNotNull(), price),
        F.when(F.col("platform_total") > 0, channels),
        F.when(has("top_brands"), brand_line),
        F.when(has("top_segments"), say(BULLETS["segments"], listing(values))),
        F.when(has("top_tags"), say(BULLETS["keywords"], listing(field("top_tags", "tag", 6)))),
        F.when(
            F.col("period_from").isNotNull(),
            say(BULLETS["period"], F.date_format("period_from", "yyyy-MM-dd"), F.date_format("period_to", "yyyy-MM-dd")),
        ),
    )
    return F.slice(lines, 1, limit)


def entry_insight() -> Column:
    zero, brand_count = F.col("zero_review_ratio"), F.col("brand_count")
    sizes = [fmt_int(brand_count), fmt_int(F.col("product_count"))]
    barrier = by_code(bands.entry_band(zero, brand_count), ENTRY, {"open": [pct(zero), *sizes], "hard": sizes, "medium": sizes})

    ages = F.transform(bands.age_segments(F.transform(F.col("top_segments"), lambda x: x["segment"])), lambda s: strip(F.element_at(F.split(s, ":"), -1)))
    reviews = fmt_int(F.col("total_review_count"))
    unsegmented = F.when(F.col("avg_rating").isNotNull(), say(ENTRY["no_segments"], reviews, fixed(F.col("avg_rating"), 2))).otherwise(
        say(ENTRY["no_segments_no_rating"], reviews)
    )
    demand = F.when(~has("top_segments"), unsegmented).when(F.size(ages) > 0, say(ENTRY["ages"], listing(ages))).otherwise(F.lit(ENTRY["no_ages"]))

    tier = by_code(bands.price_tier(F.col("price_p50")), ENTRY, {"low": [], "middle": [], "premium": []})
    price = F.when(
        F.col("price_p50").isNotNull(), say(ENTRY["price"], tier, *[fmt_int(F.col(c)) for c in ("price_p50", "price_p25", "price_p75")])
    )

    low = F.when(F.col("low_rating_ratio") > 0, pct(F.col("low_rating_ratio"))).otherwise(F.lit(ENTRY["low_ratio_unknown"]))
    decision = (
        F.when(has("top_tags"), say(ENTRY["keywords"], listing(field("top_tags", "tag", 4))))
        .when(F.col("avg_rating") > 4.5, say(ENTRY["high_rating"], fixed(F.col("avg_rating"), 2), low))
        .otherwise(F.lit(ENTRY["no_keywords"]))
    )
    top3 = F.col("top3_brand_share")
    rivals = F.when(has("top_brands") & top3.isNotNull(), say(ENTRY["share"], pct(top3))).otherwise(F.lit(ENTRY["no_share"]))
    return F.array_join(present(barrier, demand, price, decision, rivals), " ")
