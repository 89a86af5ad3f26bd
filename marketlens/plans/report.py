"""Report documents for all categories in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.catalog import canonical_products, canonical_reviews
from marketlens.functions.numbers import DEFAULT_UNITS_PER_REVIEW
from marketlens.operators import growth as gr
from marketlens.operators.keywords import keyword_counts
from marketlens.operators.products import BY_CATEGORY
from marketlens.operators.reviews import facts_of_groups, yearly_review_counts
from marketlens.operators.selection import category_path, largest_categories, pick_category, products_of, reviews_of
from marketlens.plans import narrative
from marketlens.plans.metrics import metrics
from marketlens.session import materialise


@dataclass(frozen=True)
class Settings:
    start_year: int = gr.START_YEAR
    end_year: int = gr.END_YEAR
    recent_year: int = gr.RECENT_YEAR
    units_per_review: float = DEFAULT_UNITS_PER_REVIEW


def growth_points(growth: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """The series of a group as one array in year order; the number of years bounds its length."""
    point = F.struct(
        "year",
        F.col("review_count").alias("reviewCount"),
        F.col("estimated_units").alias("estimatedUnits"),
        F.col("estimated_revenue").alias("estimatedRevenue"),
        F.col("growth_rate").alias("growthRate"),
    )
    return growth.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("points"))


def with_growth(rows: DataFrame, grouped: DataFrame, settings: Settings, keys=BY_CATEGORY) -> DataFrame:
    """Metrics rows with their yearly series and its extremes."""
    yearly = yearly_review_counts(grouped, keys)
    growth = gr.yearly_growth(yearly, rows.select(*keys, "price_ref"), keys, settings.units_per_review, settings.start_year, settings.end_year)
    extremes = gr.growth_extremes(growth, keys, settings.recent_year)
    return rows.join(growth_points(growth, keys), list(keys), "left").join(extremes, list(keys), "left")


def category_rows(products: DataFrame, reviews: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Everything a report needs, one row per category, from canonical tables.

    Reviews are read twice at most: the numeric columns once into the facts table, the texts once.
    The facts and metrics are written out because several branches read them.
    """
    grouped = materialise(facts_of_groups(reviews, products), "facts")
    words = keyword_counts(reviews, products)
    rows = materialise(metrics(products, grouped, words, category_path(products)), "metrics")
    return with_growth(rows, grouped, settings).withColumns(
        {"market_overview": narrative.market_overview(), "growth_summary": narrative.growth_summary(settings.start_year, settings.end_year)}
    )


def donut_items() -> Column:
    return F.transform("top_brands", lambda b: F.struct(b["name"].alias("name"), b["reviewCount"].alias("value"), b["share"].alias("share")))


def category_report(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One report document per row of ``category_rows``."""
    points = F.coalesce("points", F.array().cast("array<struct<year:int,reviewCount:bigint,estimatedUnits:bigint,estimatedRevenue:double,growthRate:double>>"))
    return rows.select(
        F.col("category_id").alias("categoryId"),
        F.col("category_name").alias("categoryName"),
        F.struct(
            F.struct(donut_items().alias("items")).alias("brandTop10Donut"),
            F.struct(F.lit("estimatedRevenue").alias("unit"), points.alias("points")).alias("growthLine"),
        ).alias("charts"),
        F.struct(
            F.col("market_overview").alias("marketOverviewSummary"),
            F.col("growth_summary").alias("growthSummary"),
        ).alias("summaries"),
        F.struct(
            F.lit("review_count").alias("proxy"),
            F.lit(float(settings.units_per_review)).alias("unitsPerReview"),
            F.col("price_ref").alias("priceRef"),
        ).alias("assumptions"),
    )


def template_summary(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("category_id").alias("categoryId"),
        F.col("category_name").alias("categoryName"),
        F.col("market_overview").alias("marketOverviewSummary"),
        F.col("growth_summary").alias("growthSummary"),
    )


def overlay_summaries(reports: DataFrame, generated: DataFrame) -> DataFrame:
    """Reports whose texts are replaced by generated ones; what was not generated becomes empty text."""
    texts = generated.select(
        F.col("category_id").alias("categoryId"),
        F.struct(F.coalesce("market_overview", F.lit("")).alias("marketOverviewSummary"), F.coalesce("growth_summary", F.lit("")).alias("growthSummary")).alias("_texts"),
    )
    empty = F.struct(F.lit("").alias("marketOverviewSummary"), F.lit("").alias("growthSummary"))
    joined = reports.join(texts, "categoryId", "left")
    return joined.withColumn("summaries", F.coalesce("_texts", empty)).drop("_texts")


def donut_fraction(top: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """Share of a shown item among the shown items; the divisor is 1 when they add up to 0."""
    shown = F.sum("score").over(Window.partitionBy(*keys))
    return top.withColumn("fraction", F.col("score") / F.when(shown == 0, 1).otherwise(shown))


def reports_of_largest(products: DataFrame, reviews: DataFrame, n: int | None = None, min_products: int = 10, settings: Settings = Settings()) -> DataFrame:
    """Reports of the ``n`` largest categories, all by default, in one pass."""
    chosen = products_of(products, largest_categories(products, n, min_products))
    return category_report(category_rows(chosen, reviews, settings), settings)


def report_of_category(
    products: DataFrame, reviews: DataFrame, category_id: int | None = None, needle: str | None = None, settings: Settings = Settings()
) -> DataFrame:
    """The report of one category, picked by id or by a pattern of its path; an error when there is none."""
    chosen = pick_category(products, category_id, needle)
    return category_report(category_rows(chosen, reviews_of(reviews, chosen), settings), settings)


def reports(products: DataFrame, reviews: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Reports of all categories from raw tables. Cells are parsed once: several branches read the canonical catalog."""
    catalog = materialise(canonical_products(products), "catalog")
    return category_report(category_rows(catalog, canonical_reviews(reviews), settings), settings)
