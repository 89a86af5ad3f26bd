"""Repair and scoring of a table of generated summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import generated as g
from marketlens.functions.text import key_number_count, mentions_proxy, sentence_count, token_jaccard
from marketlens.session import materialise


def repaired(generations: DataFrame, text: str = "raw") -> DataFrame:
    """Generated texts as two clean summaries: from the JSON object when there is one, else from markdown."""
    obj = g.first_json_object(F.col(text))
    found = generations.withColumn("_obj", obj)
    pair = g.unwrap_nested(g.json_text(F.col("_obj"), g.OVERVIEW_KEY), g.json_text(F.col("_obj"), g.GROWTH_KEY))
    fallback = g.coerce_markdown(F.col(text))
    both = found.withColumn("_pair", pair).withColumn("_md", fallback)
    has = F.col("_obj").isNotNull()

    def choose(name):
        return F.when(has, g.clean_summary(F.col(f"_pair.{name}"))).otherwise(F.col(f"_md.{name}"))

    return both.withColumn("market_overview", choose("overview")).withColumn("growth_summary", choose("growth")).drop("_obj", "_pair", "_md")


def scored_texts(generations: DataFrame, text: str = "raw") -> DataFrame:
    """The scoring variant: both keys of the object as they are, else the text split at 500 characters."""
    found = generations.withColumn("_obj", g.first_json_object(F.col(text), drop_end_token=False))
    rest = g.split_500(F.col(text))
    has = F.col("_obj").isNotNull()
    return (
        found.withColumn("_rest", rest)
        .withColumn("market_overview", F.when(has, g.json_text(F.col("_obj"), g.OVERVIEW_KEY)).otherwise(F.col("_rest.overview")))
        .withColumn("growth_summary", F.when(has, g.json_text(F.col("_obj"), g.GROWTH_KEY)).otherwise(F.col("_rest.growth")))
        .drop("_obj", "_rest")
    )


def pair_template_generated(templates: DataFrame, generated: DataFrame, keys=("category_id",), extra=()) -> DataFrame:
    """Template and generated texts side by side; a group missing on either side is skipped."""
    left = templates.select(*keys, F.col("market_overview").alias("template_overview"), F.col("growth_summary").alias("template_growth"))
    return generated.select(*keys, *extra, "market_overview", "growth_summary").join(left, list(keys))


def template_similarity():
    """Mean overlap of the two texts with their templates; null when neither shares a word."""
    a = token_jaccard(F.col("market_overview"), F.col("template_overview"))
    b = token_jaccard(F.col("growth_summary"), F.col("template_growth"))
    return F.when((a > 0) | (b > 0), (a + b) / 2)


def quality_rows(pairs: DataFrame, keys=("category_id",)) -> DataFrame:
    """Ten scores per pair. A null text means that its key was missing."""
    overview, growth = F.coalesce("market_overview", F.lit("")), F.coalesce("growth_summary", F.lit(""))
    return pairs.select(
        *keys,
        (F.col("market_overview").isNotNull() & F.col("growth_summary").isNotNull()).alias("json_valid"),
        (overview != "").alias("has_market_overview"),
        (growth != "").alias("has_growth_summary"),
        F.length(overview).alias("market_overview_length"),
        F.length(growth).alias("growth_summary_length"),
        sentence_count(overview).alias("market_overview_sentences"),
        sentence_count(growth).alias("growth_summary_sentences"),
        mentions_proxy(overview, growth).alias("contains_proxy_disclaimer"),
        (key_number_count(overview) + key_number_count(growth)).alias("contains_key_numbers"),
        template_similarity().alias("template_similarity"),
    )


def evaluation_summary(scores: DataFrame) -> DataFrame:
    """Rates and means over all scored rows; zeros when there are none."""
    def mean(c):
        return F.coalesce(F.avg(c), F.lit(0.0))

    return scores.agg(
        F.count("*").alias("total_categories"),
        mean(F.col("json_valid").cast("int")).alias("json_valid_rate"),
        mean(F.col("contains_proxy_disclaimer").cast("int")).alias("proxy_disclaimer_rate"),
        mean("market_overview_length").alias("avg_market_overview_length"),
        mean("growth_summary_length").alias("avg_growth_summary_length"),
        mean("contains_key_numbers").alias("avg_key_numbers"),
        mean("template_similarity").alias("avg_template_similarity"),
    )


def evaluation(generations: DataFrame, templates: DataFrame, keys, text: str = "raw") -> tuple[DataFrame, DataFrame]:
    """From raw generated texts to a quality row each and their summary: extraction, pairing with the template, scores.

    ``generations`` holds the keys, category_id and the raw text.
    """
    found = scored_texts(generations, text)
    pairs = pair_template_generated(templates, found, extra=[k for k in keys if k != "category_id"])
    rows = materialise(quality_rows(pairs, keys), "quality")
    return rows, evaluation_summary(rows)
