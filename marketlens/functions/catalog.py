"""Raw tables to the canonical columns all operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import schema
from marketlens.functions import cells
from marketlens.functions.clean import brand_of, numeric, parse_iso, strip, to_id, to_timestamp_lenient


def stamp(df: DataFrame, name: str, parse) -> Column:
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp_ntz")
    return parse(F.col(name))


def canonical_products(df: DataFrame) -> DataFrame:
    """Typed products with parsed cells; rows without a category id drop out.

    Columns the table lacks become null. Cells are parsed here once, before any later step multiplies rows.
    """
    schema.require_columns(df, ["id", "category_id", "category", "manufacturer"], "products")

    def num(name):
        return (numeric(df, name) if name in df.columns else F.lit(None).cast("double")).alias(name)

    def text(name):
        return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")

    # Two steps: a parsed cell is used several times below and must not be parsed for each use.
    parsed = df.select(
        to_id(df, "id").alias("id"),
        to_id(df, "category_id").alias("category_id"),
        text("category").alias("category"),
        brand_of(text("manufacturer")).alias("brand"),
        num("review_count"),
        num("average_rating"),
        num("min_price"),
        cells.price_points(text("price_trend")).alias("_trend"),
        cells.spec_object(text("specifications")).alias("_spec"),
        text("unit_price").alias("_unit"),
        cells.tag_list(text("review_tags")).alias("_tags"),
        cells.text_map(text("review_rating_distribution")).alias("_stars"),
        cells.text_map(text("review_platform_distribution")).alias("_channels"),
        (stamp(df, "updated_at", parse_iso) if "updated_at" in df.columns else F.lit(None).cast("timestamp_ntz")).alias("updated_at"),
    ).filter(F.col("category_id").isNotNull())
    return parsed.select(
        "id",
        "category_id",
        "category",
        "brand",
        "review_count",
        "average_rating",
        "min_price",
        cells.price_change(F.col("_trend")).alias("price_change"),
        cells.spec_labels(F.col("_spec")).alias("spec_segments"),
        cells.unit_labels(F.col("_unit")).alias("unit_segments"),
        cells.tags(F.col("_tags")).alias("tags"),
        cells.star_counts(F.col("_stars")).alias("stars"),
        cells.channel_counts(F.col("_channels")).alias("channels"),
        "updated_at",
    )


def canonical_reviews(df: DataFrame) -> DataFrame:
    """Typed reviews. The date and text columns are the first of the known names that the table has."""
    schema.require_columns(df, ["product_id"], "reviews")
    date = next((n for n in schema.DATE_COLUMNS if n in df.columns), None)
    body = next((n for n in schema.TEXT_COLUMNS if n in df.columns), None)
    key = F.col("review_id") if "review_id" in df.columns else F.xxhash64(*[F.col(c) for c in df.columns])
    blank = F.lit(None).cast("string")
    platform = F.nullif(strip(F.col("platform").cast("string")), F.lit("")) if "platform" in df.columns else blank
    return df.select(
        key.alias("review_id"),
        to_id(df, "product_id").alias("product_id"),
        (numeric(df, "rating") if "rating" in df.columns else F.lit(None).cast("double")).alias("rating"),
        platform.alias("platform"),
        (stamp(df, date, to_timestamp_lenient) if date else F.lit(None).cast("timestamp_ntz")).alias("review_date"),
        (F.col(body).cast("string") if body else blank).alias("review_text"),
    ).filter(F.col("product_id").isNotNull())
