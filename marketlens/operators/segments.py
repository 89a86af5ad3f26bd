"""Segment label frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.operators.products import BY_CATEGORY
from marketlens.operators.ranking import by_score, top_k


def segment_bag(products: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """Specification and unit labels together, repeats kept."""
    return products.select(*keys, F.explode(F.concat("spec_segments", "unit_segments")).alias("segment"))


def segment_counts(products: DataFrame, column: str, keys=BY_CATEGORY) -> DataFrame:
    return products.select(*keys, F.explode(column).alias("segment")).groupBy(*keys, "segment").agg(F.count("*").alias("n"))


def top_segments(products: DataFrame, keys=BY_CATEGORY, k: int = 10, least: int = 2) -> DataFrame:
    """The ``k`` most frequent labels, of which those below ``least`` are then left out."""
    counts = segment_bag(products, keys).groupBy(*keys, "segment").agg(F.count("*").alias("n"))
    return top_k(counts, keys, by_score("n", "segment"), k).filter(F.col("n") >= least)
