"""Exporting the raw tables of the largest categories."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marketlens.operators.selection import largest_categories, products_of, reviews_of
from marketlens.session import materialise
from marketlens.sources.catalog import write_catalog_csv


def export_largest(products: DataFrame, reviews: DataFrame, folder: str, n: int | None = None, min_products: int = 10) -> None:
    """Products of the n largest categories (all of at least min_products without n) and their reviews, as CSV folders.

    The tables keep their raw columns. Products are chosen once and written before they meet the reviews.
    """
    chosen = materialise(products_of(products, largest_categories(products, n, min_products)), "export")
    write_catalog_csv(chosen, f"{folder}/products")
    write_catalog_csv(reviews_of(reviews, chosen), f"{folder}/reviews")
