"""One wide metrics row per group, from product columns or from review rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.cells import STARS
from marketlens.functions.numbers import category_display_name
from marketlens.operators import products as prod, reviews as rev
from marketlens.operators.products import BY_CATEGORY
from marketlens.operators.ranking import by_score, top_k
from marketlens.operators.segments import segment_bag

LIST_SIZE = 10
LEAST_SEGMENT = 2
BRAND, CHANNEL, WORD, SEGMENT = "brand", "channel", "word", "segment"


def by_mode(from_rows: DataFrame, from_products: DataFrame, reviewed: DataFrame, keys) -> DataFrame:
    """Review-row results for groups that have review rows, product-column results for the others."""
    return from_rows.unionByName(from_products.join(reviewed, list(keys), "left_anti"))


def listed(top: DataFrame, keys, name: str, fields: dict[str, str], *more: Column) -> DataFrame:
    """The at most ten ranked rows of a group as one array of structs in rank order."""
    items = F.array_sort(F.collect_list(F.struct("rn", *[F.col(c).alias(n) for n, c in fields.items()])))
    plain = F.transform(items, lambda x: F.struct(*[x[n].alias(n) for n in fields]))
    return top.groupBy(*keys).agg(plain.alias(name), *more)


def price_reference(p25: Column, p50: Column, p75: Column) -> Column:
    """The median price, else the lower, else the upper quartile."""
    return F.coalesce(p50, p25, p75)


def chosen_brand_scores(products: DataFrame, grouped: DataFrame, reviewed: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    return by_mode(rev.brand_scores_rows(grouped, keys), prod.brand_scores_product(products, keys), reviewed, keys)


def chosen_platforms(products: DataFrame, grouped: DataFrame, reviewed: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """The full channel distribution of the mode that the metrics row takes."""
    return by_mode(rev.platform_dist_rows(grouped, keys), prod.platform_dist_product(products, keys), reviewed, keys)


def named_counts(kind: str, counts: DataFrame, keys, name: str, n: str) -> DataFrame:
    return counts.select(*keys, F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(n).cast("bigint").alias("n"))


def product_names(products: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """(keys, kind, name, n): brands, channels, tags and segments counted from product columns, in one long table."""
    segments = segment_bag(products, keys).groupBy(*keys, "segment").agg(F.count("*").alias("n"))
    counts = [
        named_counts(BRAND, prod.brand_scores_product(products, keys), keys, "brand", "score"),
        named_counts(CHANNEL, prod.platform_dist_product(products, keys), keys, "platform", "review_count"),
        named_counts(WORD, prod.tag_counts(products, keys), keys, "word", "n"),
        named_counts(SEGMENT, segments, keys, "segment", "n"),
    ]
    return reduce(DataFrame.unionAll, counts)


def count_lists(names: DataFrame, grouped: DataFrame, words: DataFrame, reviewed: DataFrame, keys) -> DataFrame:
    """Top brands, channels, words and segments with the sums of the first two, one row per group.

    The four counts share one long table, so that one ranking and one final grouping serve them all.
    """
    from_rows = [
        named_counts(BRAND, rev.brand_scores_rows(grouped, keys), keys, "brand", "score"),
        named_counts(CHANNEL, rev.platform_dist_rows(grouped, keys), keys, "platform", "review_count"),
        named_counts(WORD, words, keys, "word", "n"),
    ]
    is_segment = F.col("kind") == SEGMENT
    chosen = by_mode(reduce(DataFrame.unionAll, from_rows), names.filter(~is_segment), reviewed, keys)
    ranked = top_k(chosen.unionByName(names.filter(is_segment)), [*keys, "kind"], by_score("n", "name"), LIST_SIZE)
    # Sums need only the cheap kinds: the filter keeps the words out of this branch altogether.
    sums = chosen.filter(F.col("kind").isin(BRAND, CHANNEL)).groupBy(*keys, "kind").agg(F.sum("n").alias("n"))
    rows = ranked.unionByName(sums.withColumns({"name": F.lit(None).cast("string"), "rn": F.lit(None).cast("int")}))

    def of(kind):
        return F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & F.col("rn").isNotNull(), F.struct("rn", "name", "n"))))

    def sum_of(kind):
        return F.max(F.when((F.col("kind") == kind) & F.col("rn").isNull(), F.col("n")))

    return rows.groupBy(*keys).agg(
        of(BRAND).alias("_brands"),
        of(CHANNEL).alias("_channels"),
        of(WORD).alias("_words"),
        of(SEGMENT).alias("_segments"),
        sum_of(BRAND).alias("_brand_total"),
        F.coalesce(sum_of(CHANNEL), F.lit(0)).alias("platform_total"),
    )


def renamed(items: Column, name: str, n: str) -> Column:
    return F.coalesce(F.transform(items, lambda x: F.struct(x["name"].alias(name), x["n"].alias(n))), F.array().cast(f"array<struct<{name}:string,{n}:bigint>>"))


def with_lists(wide: DataFrame) -> DataFrame:
    """The ranked lists in their published shape, with brand shares and concentration."""
    total = F.nullif("_brand_total", F.lit(0))
    share = lambda b: F.struct(b["name"].alias("name"), b["n"].alias("reviewCount"), F.coalesce(b["n"] / total, F.lit(0.0)).alias("share"))
    top_brands = F.coalesce(F.transform("_brands", share), F.array().cast("array<struct<name:string,reviewCount:bigint,share:double>>"))
    first_three = F.aggregate(F.slice("_brands", 1, 3), F.lit(0).cast("bigint"), lambda a, b: a + b["n"])
    squares = F.aggregate("top_brands", F.lit(0.0), lambda a, b: a + F.pow(b["share"] * 100, F.lit(2.0)))
    frequent = F.filter("_segments", lambda x: x["n"] >= LEAST_SEGMENT)
    return wide.withColumns(
        {
            "top_brands": top_brands,
            "top_platforms": F.slice(renamed(F.col("_channels"), "platform", "count"), 1, 2),
            "top_tags": renamed(F.col("_words"), "tag", "count"),
            "top_segments": renamed(frequent, "segment", "count"),
            "top3_brand_share": first_three / total,
        }
    ).withColumn("hhi_top10", F.when(F.size("top_brands") > 0, squares))


def metrics(products: DataFrame, grouped: DataFrame, words: DataFrame, paths: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """The metrics row of every group.

    ``grouped`` is the result of ``facts_of_groups`` or ``group_facts``, ``words`` the keyword counts per group,
    ``paths`` the path per category. A group without review rows takes every value from product columns.
    The full channel distribution stays a long table (``chosen_platforms``); the row holds its total and
    the top two.
    """
    keys = list(keys)
    sums = products.groupBy(*keys).agg(*prod.product_sums(), F.countDistinct("brand").alias("brand_count"))
    return metrics_of_parts(sums, prod.price_measures(products, keys), product_names(products, keys), grouped, words, paths, keys)


def metrics_of_parts(sums: DataFrame, values: DataFrame, names: DataFrame, grouped: DataFrame, words: DataFrame, paths: DataFrame, keys) -> DataFrame:
    """The metrics row from sums (``product_sums`` and brand_count), value measures, name counts and review facts."""
    keys = list(keys)
    rows = rev.review_measures(grouped, keys)
    core = sums.select(*keys, *prod.summaries_of_sums(), "brand_count").join(values, keys, "left")
    wide = core.join(paths, "category_id", "left").join(rows, keys, "left")
    wide = with_lists(wide.join(count_lists(names, grouped, words, rows.select(*keys), keys), keys, "left"))

    has_reviews = F.col("total_reviews_rows").isNotNull()
    total = F.when(has_reviews, F.col("total_reviews_rows")).otherwise(F.col("total_reviews_product"))
    star = {k: F.when(has_reviews, F.col(f"row_stars_{k}")).otherwise(F.col(f"product_stars_{k}")) for k in STARS}

    return wide.select(
        *keys,
        category_display_name(F.col("category_path")).alias("category_name"),
        "category_path",
        has_reviews.alias("has_reviews"),
        "product_count",
        "brand_count",
        total.alias("total_review_count"),
        F.when(has_reviews, F.col("mean_rating")).otherwise(F.col("weighted_rating")).alias("avg_rating"),
        F.struct(*[star[k].alias(k) for k in STARS]).alias("rating_hist"),
        F.coalesce("platform_total", F.lit(0)).alias("platform_total"),
        "top_platforms",
        "top_brands",
        "top_tags",
        "top_segments",
        "period_from",
        "period_to",
        "zero_review_ratio",
        ((star["1"] + star["2"]) / F.nullif(total, F.lit(0))).alias("low_rating_ratio"),
        "top3_brand_share",
        "hhi_top10",
        "price_min",
        "price_max",
        "price_p25",
        "price_p50",
        "price_p75",
        "price_change_6m_median",
        price_reference(F.col("price_p25"), F.col("price_p50"), F.col("price_p75")).alias("price_ref"),
    )
