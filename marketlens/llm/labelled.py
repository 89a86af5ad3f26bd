"""A bounded sample of labelled rows for fitting, and the logistic fit that several classifiers end in."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, usable, per_class: int, id_col: str = "doc_id", columns: tuple[str, ...] = ("text",)
) -> list[tuple]:
    """(doc_id, label, columns...) of at most per_class rows of each label, in the order of a hash of the id.

    usable: a condition on doc_id that says which labels may be learned. Ids with several labels
    take the largest. The ids are at most 2 * per_class, so they are sent to all tasks; so many rows come back.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & usable)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = None
    for value in (0, 1):
        some = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *columns).join(F.broadcast(picked), "doc_id")
    found = one_row_an_id(rows, ["doc_id", "label"], columns).collect()
    return sorted((tuple(row) for row in found), key=lambda row: row[0])


def one_row_an_id(rows: DataFrame, keys: list[str], columns) -> DataFrame:
    """Of rows that share the keys the one with the smallest columns, so that no more rows come back than ids were picked."""
    # The smallest is found in the map tasks already: an id with very many rows sends one from each.
    least = rows.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("least"))
    return least.select(*keys, *[F.col(f"least.{c}").alias(c) for c in columns])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression, the intercept last, by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    keep = ridge * len(x) * np.append(np.ones(x.shape[1]), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + keep * w
        bend = (z * (p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-9)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
