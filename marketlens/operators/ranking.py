"""Top k per group and hash ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys, order, k: int, rank: str = "rn") -> DataFrame:
    """The first ``k`` rows per group in the given order.

    A bare ``row_number() <= k`` lets Spark cut every map partition to k rows per group before the
    shuffle, so a hot group never reaches one task whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def by_score(score: str, name: str):
    """Highest score first, ties by name."""
    return [F.col(score).desc(), F.col(name).asc()]


def hash_rank(key: Column, seed: Column) -> Column:
    """A reproducible random order that does not depend on partitioning."""
    return F.md5(F.concat(key.cast("string"), F.lit(":"), seed.cast("string")))
