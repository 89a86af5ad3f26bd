"""Choosing categories, products and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_category_id(products: DataFrame, category_id: int) -> DataFrame:
    return products.filter(F.col("category_id") == int(category_id))


def filter_category_contains(products: DataFrame, needle: str) -> DataFrame:
    """Rows whose path matches the pattern, of the largest matching category only (ties: smallest id)."""
    hits = products.filter(F.col("category").rlike(needle))
    largest = hits.groupBy("category_id").agg(F.count("*").alias("_size")).orderBy(F.desc("_size"), "category_id").limit(1)
    return hits.join(largest.select("category_id"), "category_id", "left_semi")


def pick_category(products: DataFrame, category_id: int | None = None, needle: str | None = None) -> DataFrame:
    """Products of one category, by id or by path pattern; an empty choice is an error.

    The check reads a single row, so it is the one place that runs before the caller's own action.
    """
    if (category_id is None) == (needle is None):
        raise ValueError("give exactly one of category_id and needle")
    chosen = filter_category_id(products, category_id) if needle is None else filter_category_contains(products, needle)
    if chosen.isEmpty():
        raise ValueError(f"no product for category {category_id if needle is None else needle!r}")
    return chosen


def filter_category_like(products: DataFrame, needle: str) -> DataFrame:
    """Rows whose path contains the text, of all categories, under the category of the lowest product id."""
    hits = products.filter(F.contains(F.col("category"), F.lit(needle)))
    label = hits.agg(F.min_by("category_id", F.struct("id", "category_id")).alias("label"))
    # one row by construction: a global aggregate
    return hits.withColumn("picked_category_id", label.scalar())


def category_path(products: DataFrame, keys=("category_id",)) -> DataFrame:
    """The path of the lowest product id that has one, else empty text."""
    # The few distinct paths first: picking a text by id over all rows would sort them.
    paths = products.groupBy(*keys, "category").agg(F.min("id").alias("id"))
    order = F.when(F.col("category").isNotNull(), F.struct("id", "category"))
    return paths.groupBy(*keys).agg(F.coalesce(F.min_by("category", order), F.lit("")).alias("category_path"))


def category_sizes(products: DataFrame, min_products: int = 10, need_path: bool = True) -> DataFrame:
    """Products per category, categories with at least ``min_products`` only."""
    rows = products.filter(F.col("category").isNotNull()) if need_path else products
    return rows.groupBy("category_id").agg(F.count("*").alias("product_count")).filter(F.col("product_count") >= min_products)


def largest_categories(products: DataFrame, n: int | None, min_products: int = 10, need_path: bool = True) -> DataFrame:
    """The ``n`` largest categories, size descending, ties by id; all of them without ``n``."""
    sizes = category_sizes(products, min_products, need_path)
    return sizes if n is None else sizes.orderBy(F.desc("product_count"), "category_id").limit(n)


def products_of(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Products of the chosen categories."""
    return products.join(categories.select("category_id"), "category_id", "left_semi")


def reviews_of(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Reviews of the chosen products; a product listed twice does not multiply them."""
    return reviews.join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")


def product_lookup(products: DataFrame, keys=("category_id",)) -> DataFrame:
    """One row per group and product id with its brand, so a join on it cannot multiply rows."""
    return products.filter(F.col("id").isNotNull()).groupBy(*keys, F.col("id").alias("product_id")).agg(F.max("brand").alias("brand"))


def reviews_with_brand(reviews: DataFrame, products: DataFrame, keys=("category_id",)) -> DataFrame:
    """Review rows with the group and brand of their product.

    Which side is broadcast, if any, is left to the measured size of the lookup; past that size the
    sort-merge join is split on hot products by the skew-join rule.
    """
    return reviews.join(product_lookup(products, keys), "product_id")
