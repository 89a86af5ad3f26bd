"""Brand shares and concentration from a table of (group, brand, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators.products import BY_CATEGORY
from marketlens.operators.ranking import by_score, top_k


def brand_top_share(scores: DataFrame, keys=BY_CATEGORY, k: int = 10) -> DataFrame:
    """The top ``k`` brands with their share of the score of all brands; 0 when that is 0."""
    sums = scores.groupBy(*keys).agg(F.sum("score").alias("brand_total"))
    share = F.coalesce(F.col("score") / F.nullif(F.col("brand_total"), F.lit(0)), F.lit(0.0))
    return top_k(scores, keys, by_score("score", "brand"), k).join(sums, list(keys)).withColumn("share", share)


def concentration_measures() -> list[Column]:
    """Top-3 share (null without any score) and the sum of squared percent shares of the listed brands."""
    top3 = F.sum(F.when(F.col("rn") <= 3, F.col("score")).otherwise(0)) / F.nullif(F.max("brand_total"), F.lit(0))
    return [top3.alias("top3_brand_share"), F.sum(F.pow(F.col("share") * 100, F.lit(2.0))).alias("hhi_top10")]


def brand_concentration(top: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    return top.groupBy(*keys).agg(*concentration_measures())
