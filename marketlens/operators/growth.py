"""The yearly series estimated from review counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.numbers import DEFAULT_UNITS_PER_REVIEW, estimate_revenue, estimate_units
from marketlens.operators.products import BY_CATEGORY

START_YEAR, END_YEAR, RECENT_YEAR = 2020, 2025, 2023


def year_spine(groups: DataFrame, yearly: DataFrame, keys=BY_CATEGORY, start_year=START_YEAR, end_year=END_YEAR) -> DataFrame:
    """Every group with every year; years without reviews count 0."""
    years = groups.withColumn("year", F.explode(F.sequence(F.lit(start_year), F.lit(end_year))))
    return years.join(yearly, [*keys, "year"], "left").withColumn("review_count", F.coalesce("review_count", F.lit(0)))


def yearly_growth(
    yearly: DataFrame,
    price_ref: DataFrame,
    keys=BY_CATEGORY,
    units_per_review: float = DEFAULT_UNITS_PER_REVIEW,
    start_year: int = START_YEAR,
    end_year: int = END_YEAR,
) -> DataFrame:
    """Units, revenue and growth per year for every group that has a dated review in any year.

    The first year has no growth: a year before the range is not used as its base.
    """
    dated = yearly.select(*keys).distinct().join(price_ref, list(keys), "left")
    spine = year_spine(dated, yearly, keys, start_year, end_year)
    estimated = spine.withColumn("estimated_units", estimate_units(F.col("review_count"), units_per_review)).withColumn(
        "estimated_revenue", estimate_revenue(F.col("estimated_units"), F.col("price_ref"))
    )
    before = F.lag("estimated_revenue").over(Window.partitionBy(*keys).orderBy("year"))
    rate = F.when(before > 0, (F.col("estimated_revenue") - before) / before * 100)
    return estimated.withColumn("growth_rate", rate)


def growth_extremes(growth: DataFrame, keys=BY_CATEGORY, recent_year: int = RECENT_YEAR) -> DataFrame:
    """Highest and lowest growth, the first year of the highest, and the recent momentum."""
    rate, recent = F.col("growth_rate"), F.col("year") >= recent_year
    return growth.groupBy(*keys).agg(
        F.count("*").alias("n_points"),
        F.max(rate).alias("max_growth"),
        F.min(rate).alias("min_growth"),
        F.max_by("year", F.when(rate.isNotNull(), F.struct(rate.alias("r"), (-F.col("year")).alias("y")))).alias("max_growth_year"),
        F.count_if(recent).alias("recent_years"),
        F.count_if(recent & rate.isNotNull()).alias("recent_rates"),
        F.avg(F.when(recent, rate)).alias("recent_mean_growth"),
    )


def recent_momentum(growth: DataFrame, keys=BY_CATEGORY, recent_year: int = RECENT_YEAR) -> DataFrame:
    """Mean growth of the recent years, for groups with at least two such years and one growth rate."""
    found = growth_extremes(growth, keys, recent_year)
    return found.filter((F.col("recent_years") >= 2) & (F.col("recent_rates") >= 1)).select(*keys, "recent_years", "recent_mean_growth")


def latest_year(growth: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """The last point: units, rounded revenue and growth."""
    point = F.max_by(F.struct("year", "estimated_units", "estimated_revenue", "growth_rate"), F.col("year"))
    return growth.groupBy(*keys).agg(point.alias("p")).select(
        *keys, "p.year", "p.estimated_units", F.floor(F.col("p.estimated_revenue") + 0.5).alias("revenue_rounded"), "p.growth_rate"
    )


def axis_range(growth: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """Revenue axis: from at most 0 to at least 1, span at least 1."""
    low, high = F.least(F.min("estimated_revenue"), F.lit(0.0)), F.greatest(F.max("estimated_revenue"), F.lit(1.0))
    return growth.groupBy(*keys).agg(low.alias("axis_min"), high.alias("axis_max")).withColumn(
        "axis_span", F.greatest(F.lit(1.0), F.col("axis_max") - F.col("axis_min"))
    )
