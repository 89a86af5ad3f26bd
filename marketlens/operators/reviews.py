"""Measures from review rows.

Reviews are summed per group, brand, year and channel, which yields every numeric measure. A catalog that can be sent to
all tasks is met row by row, where reviews are read. Beyond that reviews are first reduced to one row per product, year and
channel, and that table joins the catalog with no hot key left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.cells import STARS
from marketlens.operators import keywords
from marketlens.operators.products import BY_CATEGORY, total
from marketlens.operators.selection import product_lookup
from marketlens.session import materialise

FACT_SUMS = ["n", "n_rated", "rating_sum"] + [f"stars_{k}" for k in STARS]


def fact_measures() -> list[Column]:
    # least and greatest skip nulls: without the condition an unrated review would count as five stars.
    star = F.when(F.col("rating").isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.col("rating"))).cast("int"))
    return [
        F.count("*").alias("n"),
        F.count("rating").alias("n_rated"),
        total(F.col("rating")).alias("rating_sum"),
        *[F.count_if(star == int(k)).alias(f"stars_{k}") for k in STARS],
    ]


def review_facts(reviews: DataFrame) -> DataFrame:
    """Counts, rating sums and star counts per product, year and channel."""
    return reviews.groupBy("product_id", F.year("review_date").alias("year"), "platform").agg(*fact_measures())


def group_facts(facts: DataFrame, products: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """Facts summed per group, brand, year and channel: a small table that all review measures read."""
    return place_facts(facts, product_lookup(products, keys), keys)


def place_facts(facts: DataFrame, lookup: DataFrame, keys) -> DataFrame:
    placed = facts.join(lookup, "product_id")
    return placed.groupBy(*keys, "brand", "year", "platform").agg(*[F.sum(c).alias(c) for c in FACT_SUMS])


def facts_of_groups(reviews: DataFrame, products: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """What ``group_facts`` gives, without a row per product, year and channel where the counted lookup can be sent.

    Of those there are nearly as many as reviews, and all were shuffled twice.
    """
    lookup = materialise(product_lookup(products, keys), "lookup")
    if lookup.count() > keywords.SENT_PRODUCTS:
        return place_facts(review_facts(reviews), lookup, keys)
    placed = reviews.select("product_id", F.year("review_date").alias("year"), "platform", "rating").join(F.broadcast(lookup), "product_id")
    return placed.groupBy(*keys, "brand", "year", "platform").agg(*fact_measures())


def review_measures(grouped: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """Total rows, mean rating and star counts."""
    return grouped.groupBy(*keys).agg(
        F.sum("n").alias("total_reviews_rows"),
        (F.sum("rating_sum") / F.nullif(F.sum("n_rated"), F.lit(0))).alias("mean_rating"),
        *[F.sum(f"stars_{k}").alias(f"row_stars_{k}") for k in STARS],
    )


def platform_dist_rows(grouped: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    return grouped.filter(F.col("platform").isNotNull()).groupBy(*keys, "platform").agg(F.sum("n").alias("review_count"))


def brand_scores_rows(grouped: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    return grouped.filter(F.col("brand").isNotNull()).groupBy(*keys, "brand").agg(F.sum("n").alias("score"))


def yearly_review_counts(grouped: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    return grouped.filter(F.col("year").isNotNull()).groupBy(*keys, "year").agg(F.sum("n").alias("review_count"))
