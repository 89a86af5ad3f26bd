"""Exact quantiles that never hold a whole group in one task.

Rows become counts of distinct values, of any number of measures, in one table that is written once.
Each level then counts coarse slices of the value range, finds the slices that hold a wanted rank, and only
those are cut finer. Slices are floating-point exponent plus 10 fraction bits, then 21 more bits, then
the value itself, so no window sees more than about two million rows per group however many rows the
group has. Counts may be given less other counts: parts of a group then need only what they leave out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.session import materialise

COARSE = 1024.0
FINE = 2097152.0


def slices(v: Column):
    """Two nested, order-preserving slice numbers of a double."""
    size = F.abs(v)
    exponent = F.floor(F.log2(size))
    scaled = (size / F.pow(F.lit(2.0), exponent) - 1) * COARSE
    step = F.floor(scaled)
    sign = F.signum(v)
    coarse = F.when(v == 0, F.lit(0)).otherwise(sign * ((exponent + 1200) * 2 * COARSE + step + 1))
    fine = F.when(v == 0, F.lit(0)).otherwise(sign * F.floor((scaled - step) * FINE))
    return coarse.cast("bigint"), fine.cast("bigint")


def value_counts(df: DataFrame, keys, values: dict[str, Column]) -> DataFrame:
    """(keys, measure, value, n): how often each value of each measure occurs; null values drop out."""
    items = F.array(*[F.struct(F.lit(name).alias("measure"), value.cast("double").alias("value")) for name, value in values.items()])
    rows = df.select(*keys, F.inline(items)).filter(F.col("value").isNotNull())
    return rows.groupBy(*keys, "measure", "value").agg(F.count("*").alias("n"))


def sliced(counts: DataFrame) -> DataFrame:
    coarse, fine = slices(F.col("value"))
    return materialise(counts.withColumn("_coarse", coarse).withColumn("_fine", fine), "value-counts")


def quantiles_of_counts(counts: DataFrame, keys, probs: dict[str, float], parts: DataFrame | None = None, less: DataFrame | None = None) -> DataFrame:
    """One row per group and measure with a linearly interpolated quantile column for each entry of ``probs``.

    With ``parts`` (keys and further columns that name a part of the group) there is one row per part and
    measure, over the group's counts without those of ``less`` (keys, further columns, measure, value, n).
    """
    keys = list(keys)
    counts = sliced(counts)
    more = [] if parts is None else [c for c in parts.columns if c not in keys]
    less = None if less is None else sliced(less)
    out = [*keys, *more, "measure"]

    def place(p):
        return F.lit(p) * (F.col("_size") - 1)

    slots = F.array(*[F.struct(F.lit(f"{name}:{end}").alias("slot"), rank.alias("rank")) for name, p in probs.items() for end, rank in [("lo", F.floor(place(p))), ("hi", F.ceil(place(p)))]])

    def summed(by, hit, kept=()):
        """Counts by the given columns within the hit slices, less what the parts leave out."""
        shared = [*keys, "measure", *[c for c in by if hit is not None and c in hit.columns]]
        if hit is not None:
            rows = counts.join(hit, shared)
        else:
            rows = counts.groupBy(*keys, "measure", *by).agg(F.sum("n").alias("n"))
            rows = rows if parts is None else rows.join(parts, keys)
        rows = rows.select(*out, *by, *kept, "n")
        if less is not None:
            gone = less if hit is None else less.join(hit, [*more, *shared])
            rows = rows.unionByName(gone.select(*out, *by, *kept, (-F.col("n")).alias("n")))
        left = rows.groupBy(*out, *by, *kept).agg(F.sum("n").alias("_n"))
        return left if less is None else left.filter(F.col("_n") > 0)

    def held(steps, scope, level):
        """Slices that hold a wanted rank, with the count of rows before them."""
        upto = F.col("_base") + F.sum("_n").over(Window.partitionBy(*scope).orderBy(level))
        marked = steps.withColumn("_upto", upto).withColumn("_base", F.col("_upto") - F.col("_n"))
        return marked.withColumn("_slots", F.filter(slots, lambda s: (s["rank"] >= F.col("_base")) & (s["rank"] < F.col("_upto")))).filter(F.size("_slots") > 0)

    steps = summed(["_coarse"], None).withColumn("_size", F.sum("_n").over(Window.partitionBy(*out))).withColumn("_base", F.lit(0).cast("bigint"))
    hit = held(steps, out, "_coarse").select(*out, "_coarse", "_size", "_base")
    cut = summed(["_coarse", "_fine"], hit, ["_size", "_base"])
    hit = held(cut, [*out, "_coarse"], "_fine").select(*out, "_coarse", "_fine", "_size", "_base")
    last = held(summed(["_coarse", "_fine", "value"], hit, ["_size", "_base"]), [*out, "_coarse", "_fine"], "value").select(*out, "_size", "value", F.explode("_slots.slot").alias("_slot"))

    ends = [F.max(F.when(F.col("_slot") == f"{name}:{end}", F.col("value"))).alias(f"_{name}_{end}") for name in probs for end in ("lo", "hi")]
    found = last.groupBy(*out, "_size").agg(*ends)
    columns = []
    for name, p in probs.items():
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        columns.append((low + (high - low) * (place(p) - F.floor(place(p)))).alias(name))
    return found.select(*out, *columns)


def exact_quantiles(df: DataFrame, keys, value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with the quantiles of one column."""
    return quantiles_of_counts(value_counts(df, keys, {value: F.col(value)}), keys, probs).drop("measure")
