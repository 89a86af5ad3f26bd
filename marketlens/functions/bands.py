"""Threshold findings. Each returns a short code; the wording for a code is in plans/phrases.py."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concentration_band(top3: Column) -> Column:
    share = F.coalesce(top3, F.lit(0.0))
    return F.when(share >= 0.65, "strong").when(share >= 0.45, "mixed").otherwise("dispersed")


def maturity_band(zero: Column) -> Column:
    ratio = F.coalesce(zero, F.lit(0.0))
    return F.when(ratio >= 0.35, "emerging").when(ratio <= 0.15, "mature").otherwise("transitional")


def hhi_band(hhi: Column) -> Column:
    return F.when(hhi.isNull(), "none").when(hhi >= 5000, "monopoly").when(hhi >= 2500, "concentrated").otherwise("competitive")


def rating_band(low_ratio: Column) -> Column:
    return F.when(low_ratio > 0.1, "uneven").otherwise("stable")


def entry_band(zero: Column, brands: Column) -> Column:
    return F.when(zero > 0.3, "open").when(brands > 100, "hard").otherwise("medium")


def price_tier(p50: Column) -> Column:
    return F.when(p50 < 50000, "low").when(p50 < 150000, "middle").when(p50.isNotNull(), "premium")


def action_band(zero: Column) -> Column:
    return F.when(F.coalesce(zero, F.lit(0.0)) >= 0.3, "gather_reviews").otherwise("niche_position")


def age_segments(segments: Column) -> Column:
    """The first two segment labels that speak of an age."""
    return F.slice(F.filter(segments, lambda s: F.contains(s, F.lit("연령")) | F.contains(s, F.lit("개월")) | F.contains(s, F.lit("세"))), 1, 2)
