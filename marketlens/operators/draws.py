"""Random parts of categories, known by where the draw ends and by what it leaves out.

A sample draws products of a category in the order of a hash of product id and sample. Where it ends is
found by a histogram of hashes, on narrow keys; then membership of any row is one comparison, and the tenth
that a sample leaves out is a small table. Whatever adds up over products is summed once per category, and a
sample's sum is that less the sum over what it leaves out, so work and shuffles grow with the left-out share
and not with the number of samples times all products. Rows of one product id are drawn together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.operators.ranking import by_score, hash_rank, top_k
from marketlens.session import materialise

SAMPLE_KEYS = ["category_id", "sample_idx"]
#: Hex digits of the histogram that finds where a draw ends.
DIGITS = 4
#: Hex digits of a place on the ring of review hashes, and draws' worth of rows in one of its arcs.
RING_DIGITS, ARC_DRAWS, ARCS = 13, 4, 4
RING = 16**RING_DIGITS


def draw_key() -> Column:
    """What a product row is drawn by: its id, without one its plain values."""
    plain = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("category", "brand", "review_count", "average_rating", "min_price")])
    return F.coalesce(F.col("id").cast("string"), F.concat(F.lit("no id: "), F.md5(plain)))


def sample_numbers(samples: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(max(1, samples) - 1)))


def draw_ends(products: DataFrame, samples: int, ratio: float, min_products: int = 10, seed: int = 42) -> DataFrame:
    """(category_id, sample_idx, _last, _last_key): the last drawn hash and key of every sample that leaves something out.

    A sample draws ``max(min_products, floor(rows * ratio))`` rows, and those that share the last one's id.
    """
    keys = materialise(products.groupBy("category_id", draw_key().alias("draw_key")).agg(F.count("*").alias("_rows")), "draw-keys")
    sizes = keys.groupBy("category_id").agg(F.sum("_rows").alias("_size"))
    take = F.least(F.col("_size"), F.greatest(F.lit(min_products), F.floor(F.col("_size") * F.lit(float(ratio)))))
    some = sizes.withColumn("_take", take).filter((F.lit(samples) > 1) & (F.col("_size") > min_products) & (F.col("_take") < F.col("_size")))
    hashed = keys.join(some.drop("_size"), "category_id").withColumn("sample_idx", sample_numbers(samples))
    hashed = hashed.withColumn("_hash", hash_rank(F.col("draw_key"), F.col("sample_idx") + seed)).withColumn("_d", F.substring("_hash", 1, DIGITS))

    def upto(scope, order):
        return F.sum("_n").over(Window.partitionBy(*SAMPLE_KEYS, *scope).orderBy(*order))

    counts = hashed.groupBy(*SAMPLE_KEYS, "_take", "_d").agg(F.sum("_rows").alias("_n"))
    counts = counts.withColumn("_upto", upto([], ["_d"]))
    edge = counts.filter((F.col("_upto") >= F.col("_take")) & (F.col("_upto") - F.col("_n") < F.col("_take")))
    edge = edge.select(*SAMPLE_KEYS, "_d", (F.col("_take") - F.col("_upto") + F.col("_n")).alias("_need"))
    # About one key in 65,536 has the digits at which a draw ends.
    near = hashed.join(edge, [*SAMPLE_KEYS, "_d"]).withColumn("_n", F.col("_rows")).withColumn("_upto", upto([], ["_hash", "draw_key"]))
    last = near.filter((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
    return materialise(last.select(*SAMPLE_KEYS, F.col("_hash").alias("_last"), F.col("draw_key").alias("_last_key")), "draw-ends")


def beyond(seed: int) -> Column:
    """Whether a row with a draw_key comes after the end of a sample."""
    mine = F.struct(hash_rank(F.col("draw_key"), F.col("sample_idx") + seed), F.col("draw_key"))
    return mine > F.struct("_last", "_last_key")


def left_out(products: DataFrame, ends: DataFrame, seed: int = 42) -> DataFrame:
    """(category_id, sample_idx, draw_key, id) of the products that samples do not draw, each id once."""
    keys = products.select("category_id", draw_key().alias("draw_key"), "id").distinct()
    return keys.join(ends, "category_id").filter(beyond(seed)).select(*SAMPLE_KEYS, "draw_key", "id")


def subsample_products(products: DataFrame, samples: int, ratio: float, min_products: int = 10, seed: int = 42) -> DataFrame:
    """Per category and sample index a draw without replacement; small categories are taken whole."""
    ends = draw_ends(products, samples, ratio, min_products, seed)
    marked = products.withColumn("draw_key", draw_key()).withColumn("sample_idx", sample_numbers(samples))
    drawn = marked.join(ends, SAMPLE_KEYS, "left").filter(F.col("_last").isNull() | ~beyond(seed))
    return drawn.select(*products.columns, "sample_idx")


def sums_of_samples(totals: DataFrame, gone: DataFrame, samples: DataFrame, by: list[str], counts: list[str]) -> DataFrame:
    """Sums per sample: those of the category less those of what the sample leaves out.

    ``totals`` has category_id, ``by`` and ``counts``; ``gone`` sample_idx as well; ``samples`` names all samples.
    """
    plus = totals.join(samples, "category_id").select(*SAMPLE_KEYS, *by, *counts)
    minus = gone.select(*SAMPLE_KEYS, *by, *[(-F.col(c)).alias(c) for c in counts])
    return plus.unionByName(minus).groupBy(*SAMPLE_KEYS, *by).agg(*[F.sum(c).alias(c) for c in counts])


def top_candidates(totals: DataFrame, rows_of: Callable[[DataFrame], DataFrame], excluded: DataFrame, samples: DataFrame, k: int) -> DataFrame:
    """(category_id, sample_idx, kind, name, n): every name that can be among a sample's k most frequent of its kind.

    ``totals`` holds (category_id, kind, name, n) of whole categories; ``rows_of`` gives (category_id, draw_key,
    kind, name, n) per product for given (category_id, kind, name). The category's k first, counted in a sample,
    bound from below what a name must reach in it; names whose total is below that bound need no further count.
    """
    group = ["category_id", "kind"]

    def counted(names: DataFrame) -> DataFrame:
        gone = rows_of(names.select(*group, "name")).join(excluded.select(*SAMPLE_KEYS, "draw_key"), ["category_id", "draw_key"])
        gone = gone.groupBy(*SAMPLE_KEYS, "kind", "name").agg(F.sum("n").alias("n"))
        return sums_of_samples(names.select(*group, "name", "n"), gone, samples, ["kind", "name"], ["n"])

    first = top_k(totals, group, by_score("n", "name"), k)
    reached = counted(first).groupBy(*SAMPLE_KEYS, "kind").agg(F.min("n").alias("_least"), F.count("*").alias("_names"))
    bound = F.when(F.col("_names") < k, F.lit(1)).otherwise(F.greatest(F.col("_least"), F.lit(1)))
    bounds = reached.groupBy(*group).agg(F.min(bound).alias("_bound"))
    names = materialise(totals.join(bounds, group).filter(F.col("n") >= F.col("_bound")).select(*group, "name", "n"), "candidates")
    return counted(names).filter(F.col("n") > 0)


def ring_place(key: Column, seed: Column) -> Column:
    """A place on a ring of 16^13, from a hash."""
    return F.conv(F.substring(hash_rank(F.coalesce(key.cast("string"), F.lit("")), seed), 1, RING_DIGITS), 16, 10).cast("bigint")


def ring_examples(rated: DataFrame, lookup: DataFrame, excluded: DataFrame, available: DataFrame, totals: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """For every sample and sentiment k random reviews of its products: the first ones after the sample's place on the ring.

    ``rated``: (product_id, review_id, sentiment); ``lookup``: (category_id, product_id, draw_key); ``available`` the
    count per sample and sentiment, ``totals`` per category and sentiment, both as ``_n``. A review's place does
    not depend on the sample, so only reviews on the arcs that follow a sample's place are looked at. Where those
    hold too few, as when a sample leaves most of them out, all reviews of the group are.
    """
    groups = [*SAMPLE_KEYS, "sentiment"]
    sized = totals.withColumn("_arcs", F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.lit(1.0), F.col("_n") / (ARC_DRAWS * k))))).cast("bigint"))
    placed = rated.withColumn("_place", ring_place(F.col("review_id"), F.lit(seed)))
    start = ring_place(F.concat(F.lit("sample "), F.col("sample_idx")), F.lit(seed))
    wanted = available.filter(F.col("_n") > 0).select(*groups, F.col("_n").alias("_available"), start.alias("_start"))

    def arc(place):
        return F.floor(place / F.lit(float(RING)) * F.col("_arcs"))

    def first(rows: DataFrame) -> DataFrame:
        members = rows.join(excluded.select(*SAMPLE_KEYS, "draw_key"), [*SAMPLE_KEYS, "draw_key"], "left_anti")
        return top_k(members, groups, ["_after", "review_id", "product_id"], k)

    after = F.pmod(F.col("_place") - F.col("_start"), F.lit(RING)).alias("_after")

    arcs = wanted.join(sized.select("category_id", "sentiment", "_arcs"), ["category_id", "sentiment"])
    arcs = arcs.withColumn("_step", F.explode(F.sequence(F.lit(0), F.least(F.lit(ARCS), F.col("_arcs")).cast("int") - 1)))
    arcs = arcs.withColumn("_arc", F.pmod(arc(F.col("_start")) + F.col("_step"), F.col("_arcs"))).select(*groups, "_start", "_arc")
    known = placed.join(lookup, "product_id").join(sized.select("category_id", "sentiment", "_arcs"), ["category_id", "sentiment"])
    near = known.withColumn("_arc", arc(F.col("_place"))).join(arcs, ["category_id", "sentiment", "_arc"])
    # Where only some arcs are looked at, what lies before the start on the first of them is not next but last.
    near = near.select("*", after).filter((F.col("_arcs") <= ARCS) | (F.col("_after") < RING // 2))
    out = [*groups, "product_id", "review_id", "rn"]
    found = materialise(first(near).select(*out), "examples")
    got = found.groupBy(*groups).agg(F.count("*").alias("_got"))
    short = wanted.join(got, groups, "left").filter(F.coalesce("_got", F.lit(0)) < F.least(F.col("_available"), F.lit(k)))
    if short.isEmpty():
        return found
    short = materialise(short.select(*groups, "_start"), "short")
    rest = first(placed.join(lookup, "product_id").join(short, ["category_id", "sentiment"]).select("*", after))
    return found.join(short, groups, "left_anti").unionByName(rest.select(*out))
