"""Number formats and the estimates made from review counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.clean import strip

DEFAULT_UNITS_PER_REVIEW = 3.0
UNNAMED_CATEGORY = "카테고리"


def fixed(c: Column, digits: int) -> Column:
    """Decimal text with half-even rounding of the exact binary value and no grouping."""
    return F.call_function("format_number", c.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def pct(c: Column, digits: int = 1) -> Column:
    return F.concat(fixed(c * 100, digits), F.lit("%"))


def fmt_int(c: Column) -> Column:
    """Rounded half-even with thousands separators; null prints as 0."""
    return F.coalesce(F.format_number(F.bround(c.cast("double")).try_cast("bigint"), 0), F.lit("0"))


def category_display_name(path: Column) -> Column:
    """Last part of ``A > B > C``; a fixed word when there is no path."""
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit(UNNAMED_CATEGORY)).otherwise(strip(F.element_at(F.split(path, ">"), -1)))


def estimate_units(review_count: Column, units_per_review=DEFAULT_UNITS_PER_REVIEW) -> Column:
    """Reviews times units per review, rounded half-even."""
    factor = units_per_review if isinstance(units_per_review, Column) else F.lit(units_per_review)
    factor = F.when(factor > 0, factor.cast("double")).otherwise(F.lit(DEFAULT_UNITS_PER_REVIEW))
    return F.bround(F.greatest(review_count, F.lit(0)).cast("double") * factor).try_cast("bigint")


def estimate_revenue(units: Column, price: Column) -> Column:
    """Units times price; a missing price counts as 1 so that the series keeps its shape."""
    return units.cast("double") * F.when(price > 0, price).otherwise(F.lit(1.0))
