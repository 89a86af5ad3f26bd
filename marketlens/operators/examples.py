"""Example review texts per group and sentiment.

Reviews are ranked on narrow rows; texts are fetched for the picked ones only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.clean import sentiment
from marketlens.operators.ranking import hash_rank, top_k
from marketlens.session import materialise

#: Picked ids that may be sent to all tasks; with more, both sides are shuffled by id.
SENT_IDS = 500_000
ID = ["product_id", "review_id"]


def with_sentiment(reviews: DataFrame) -> DataFrame:
    """Reviews with a positive or negative rating."""
    return reviews.withColumn("sentiment", sentiment(F.col("rating"))).filter(F.col("sentiment").isNotNull())


def rated_texts(reviews: DataFrame, blank: bool = True) -> DataFrame:
    """Narrow rows of the reviews with a text and a positive or negative rating; empty texts count unless ``blank`` is off."""
    texts = reviews.filter(F.col("review_text").isNotNull() if blank else F.col("review_text") != "")
    return with_sentiment(texts.select(*ID, "rating"))


def first_examples(pool: DataFrame, keys, k: int) -> DataFrame:
    """The first ``k`` by review id."""
    return top_k(pool, [*keys, "sentiment"], ["review_id"], k)


def sample_examples(pool: DataFrame, keys, k: int, seed: int = 42) -> DataFrame:
    """``k`` random reviews per group and sentiment, all when there are fewer."""
    marked = pool.withColumn("_hash", hash_rank(F.col("review_id"), F.lit(seed)))
    return top_k(marked, [*keys, "sentiment"], ["_hash", "review_id"], k).drop("_hash")


def fetch_texts(picked: DataFrame, reviews: DataFrame) -> DataFrame:
    """Picked rows with their review_text. Of reviews that share both ids the smallest text is taken.

    The picked ids are few, a handful per group; they are counted, and sent to all tasks up to SENT_IDS. Texts then
    stay where they are read. Beyond that both sides meet by a hash of the id, without sorting texts.
    """
    picked = materialise(picked, "picked")
    ids = picked.select(*ID).distinct()
    ids = F.broadcast(ids) if picked.count() <= SENT_IDS else ids.hint("shuffle_hash")
    texts = reviews.select(*ID, "review_text").join(ids, ID).groupBy(*ID).agg(F.min("review_text").alias("review_text"))
    return picked.join(texts, ID)
