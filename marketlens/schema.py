"""Declared input schemas. Everything that may arrive as text is declared as text and cast leniently."""

from __future__ import annotations

from pyspark.sql import types as T

PRODUCTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("category_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("manufacturer", T.StringType()),
        T.StructField("review_count", T.StringType()),
        T.StructField("average_rating", T.StringType()),
        T.StructField("min_price", T.StringType()),
        T.StructField("price_trend", T.StringType()),
        T.StructField("specifications", T.StringType()),
        T.StructField("unit_price", T.StringType()),
        T.StructField("review_tags", T.StringType()),
        T.StructField("review_rating_distribution", T.StringType()),
        T.StructField("review_platform_distribution", T.StringType()),
        T.StructField("updated_at", T.StringType()),
    ]
)

REVIEWS = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("rating", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("review_date", T.StringType()),
        T.StructField("review_text", T.StringType()),
    ]
)

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
RECORDS = T.StructType([T.StructField("messages", T.ArrayType(MESSAGE))])

# Columns a table must have before any job starts.
REQUIRED_PRODUCT_COLUMNS = ["category_id", "category", "manufacturer", "review_count", "average_rating"]
REQUIRED_REVIEW_COLUMNS = ["review_date"]

# Column names tried in order; the first one a table has is used for all its rows.
DATE_COLUMNS = ["review_date", "first_seen_at", "last_seen_at", "created_at", "updated_at"]
TEXT_COLUMNS = ["review_text", "review_content", "content", "text", "body"]


def require_columns(df, names, what):
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks required columns: {', '.join(missing)}")
    return df
