"""Measures from product summary columns. Every function yields rows per group of ``keys``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.cells import STARS
from marketlens.functions.clean import positive
from marketlens.operators.quantiles import exact_quantiles, quantiles_of_counts, value_counts

BY_CATEGORY = ("category_id",)
QUARTILES = {"price_p25": 0.25, "price_p50": 0.5, "price_p75": 0.75}
PRICE, CHANGE, DAY = "price", "change", "day"
PLACES = {"lowest": 0.0, **QUARTILES, "highest": 1.0}
LARGEST = (1 << 63) - 1


def total(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def counted(c: Column) -> Column:
    """The sum of whole numbers, 0 without any; a sum beyond 64 bits is the largest number."""
    return F.when(F.count(c) == 0, F.lit(0)).otherwise(F.coalesce(F.try_sum(c), F.lit(LARGEST)))


def product_sums() -> list[Column]:
    """What adds up over products: the summary measures of any part are quotients of these."""
    n = F.coalesce(F.col("review_count"), F.lit(0.0))
    rated = F.col("average_rating").isNotNull() & (n > 0)
    return [
        F.count("*").alias("product_count"),
        total(n).alias("review_sum"),
        total(F.when(rated, F.col("average_rating") * n)).alias("rating_weighted"),
        total(F.when(rated, n)).alias("rating_weights"),
        F.count_if(n == 0).alias("zero_products"),
        *rating_hist_product_measures(),
    ]


def summaries_of_sums() -> list[Column]:
    """The summary measures from columns of ``product_sums``, under their published names."""
    return [
        F.col("product_count"),
        F.col("review_sum").try_cast("bigint").alias("total_reviews_product"),
        (F.col("rating_weighted") / F.nullif(F.col("rating_weights"), F.lit(0.0))).alias("weighted_rating"),
        (F.col("zero_products") / F.col("product_count")).alias("zero_review_ratio"),
        *[F.col(f"product_stars_{k}") for k in STARS],
    ]


def summary_measures() -> list[Column]:
    """Aggregates of one pass over products: counts, weighted rating, zero-review share, dates, price range."""
    n = F.coalesce(F.col("review_count"), F.lit(0.0))
    rated = F.col("average_rating").isNotNull() & (n > 0)
    price = positive(F.col("min_price"))
    return [
        F.count("*").alias("product_count"),
        total(n).try_cast("bigint").alias("total_reviews_product"),
        (F.sum(F.when(rated, F.col("average_rating") * n)) / F.sum(F.when(rated, n))).alias("weighted_rating"),
        F.avg(F.when(n == 0, 1.0).otherwise(0.0)).alias("zero_review_ratio"),
        F.min(F.col("updated_at").cast("date")).alias("period_from"),
        F.max(F.col("updated_at").cast("date")).alias("period_to"),
        F.min(price).alias("price_min"),
        F.max(price).alias("price_max"),
    ]


def rating_hist_product_measures() -> list[Column]:
    return [counted(F.col("stars")[i]).alias(f"product_stars_{k}") for i, k in enumerate(STARS)]


def rating_hist_product(products: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """Sum of the star counts in the distribution cells; bad or missing counts add nothing."""
    return products.groupBy(*keys).agg(*rating_hist_product_measures())


def platform_dist_product(products: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """Sum of the channel counts in the distribution cells."""
    cells = products.select(*keys, F.explode("channels").alias("platform", "_n"))
    return cells.groupBy(*keys, "platform").agg(counted(F.col("_n")).alias("review_count"))


def brand_scores_product(products: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """Review counts summed per brand."""
    branded = products.filter(F.col("brand").isNotNull())
    return branded.groupBy(*keys, "brand").agg(total(F.coalesce(F.col("review_count"), F.lit(0.0))).try_cast("bigint").alias("score"))


def tag_counts(products: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """Review tags with their counts."""
    return products.select(*keys, F.explode("tags").alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))


def product_values(products: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """Counts of prices, price changes and update days: everything that is not a sum."""
    day = F.unix_date(F.col("updated_at").cast("date"))
    return value_counts(products, keys, {PRICE: positive(F.col("min_price")), CHANGE: F.col("price_change"), DAY: day})


def price_stats(products: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """Lowest, highest and quartile prices, from one count of the positive prices."""
    counts = value_counts(products, keys, {PRICE: positive(F.col("min_price"))})
    return quantiles_of_counts(counts, keys, {"price_min": 0.0, "price_max": 1.0, **QUARTILES}).drop("measure")


def price_quantiles(products: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """Quartiles of the positive prices."""
    return quantiles_of_counts(value_counts(products, keys, {PRICE: positive(F.col("min_price"))}), keys, QUARTILES).drop("measure")


def price_change_median(products: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """Median over products of the six-month price change."""
    return exact_quantiles(products, keys, "price_change", {"price_change_6m_median": 0.5})


def value_measures(found: DataFrame, keys) -> DataFrame:
    """Quantiles of all measures as one row per group."""
    keys = list(keys)

    def of(measure, c):
        return F.max(F.when(F.col("measure") == measure, F.col(c)))

    return found.groupBy(*keys).agg(
        *[of(PRICE, q).alias(q) for q in QUARTILES],
        of(CHANGE, "price_p50").alias("price_change_6m_median"),
        of(PRICE, "lowest").alias("price_min"),
        of(PRICE, "highest").alias("price_max"),
        F.date_from_unix_date(of(DAY, "lowest").cast("int")).alias("period_from"),
        F.date_from_unix_date(of(DAY, "highest").cast("int")).alias("period_to"),
    )


def price_measures(products: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """Price quartiles and extremes, the change median and the update period from one run of the quantile levels."""
    return value_measures(quantiles_of_counts(product_values(products, keys), keys, PLACES), keys)
