"""Training records: model input, review insights, chat messages, and their checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.clean import sentiment, squash
from marketlens.functions.text import squash_truncate
from marketlens.operators import draws
from marketlens.operators.draws import SAMPLE_KEYS
from marketlens.operators.examples import fetch_texts, first_examples, with_sentiment
from marketlens.operators.keywords import words_of_groups
from marketlens.operators.products import BY_CATEGORY, PLACES, product_sums, product_values, value_measures
from marketlens.operators.quantiles import quantiles_of_counts
from marketlens.operators.ranking import by_score, top_k
from marketlens.operators.reviews import FACT_SUMS, review_facts
from marketlens.operators.selection import category_path, largest_categories, product_lookup, products_of
from marketlens.plans import narrative
from marketlens.plans.metrics import BRAND, CHANNEL, LIST_SIZE, WORD, listed, metrics_of_parts, product_names
from marketlens.plans.report import Settings, with_growth
from marketlens.session import materialise

REPORT_TYPE = "market_report_summary"
KEYWORDS, POSITIVE, NEGATIVE, EXAMPLE_CHARS = 10, 3, 2, 180
#: Words of a category that are counted per product before it is known which can come first in a sample; any others are counted then.
FIRST_WORDS = 3 * LIST_SIZE
JSON = {"ignoreNullFields": "false"}


def model_input_fields() -> list[Column]:
    points = F.transform(
        F.coalesce("points", F.array().cast("array<struct<year:int,reviewCount:bigint,estimatedUnits:bigint,estimatedRevenue:double,growthRate:double>>")),
        lambda p: F.struct(
            p["year"].alias("year"),
            p["reviewCount"].alias("reviewCount"),
            p["estimatedUnits"].alias("estimatedUnits"),
            p["estimatedRevenue"].alias("estimatedRevenue"),
            F.col("price_ref").alias("priceRef"),
            p["growthRate"].alias("growthRate"),
        ),
    )
    measures = F.struct(
        F.col("product_count").alias("productCount"),
        F.col("brand_count").alias("brandCount"),
        F.col("total_review_count").alias("totalReviewCount"),
        F.col("avg_rating").alias("avgRatingWeighted"),
        F.col("rating_hist").alias("ratingHistogram"),
        F.col("zero_review_ratio").alias("zeroReviewRatio"),
        F.col("low_rating_ratio").alias("lowRatingRatio"),
        F.col("top3_brand_share").alias("top3BrandShare"),
        F.col("top_brands").alias("topBrands"),
        F.col("top_tags").alias("topTags"),
        F.col("top_segments").alias("topSegments"),
    )
    return [
        F.lit(REPORT_TYPE).alias("reportType"),
        F.col("category_id").alias("categoryId"),
        F.col("category_name").alias("categoryName"),
        measures.alias("metrics"),
        points.alias("growthData"),
    ]


def model_input(rows: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """The structured input of a summary, one row per row of ``category_rows``."""
    return rows.select(*keys, F.struct(*model_input_fields()).alias("input"))


def insight_columns() -> Column:
    """Insights as a struct in output order; null when the group has no text. Keywords are [word, count] pairs."""
    pairs = F.transform("top_keywords", lambda x: F.concat(F.lit('["'), x["tag"], F.lit('",'), x["count"].cast("string"), F.lit("]")))
    no_texts = F.array().cast("array<string>")
    body = F.struct(
        F.parse_json(F.concat(F.lit("["), F.array_join(F.coalesce(pairs, no_texts), ","), F.lit("]"))).alias("topKeywords"),
        F.coalesce("positive_examples", no_texts).alias("positiveExamples"),
        F.coalesce("negative_examples", no_texts).alias("negativeExamples"),
        F.lit(True).alias("hasReviewText"),
        F.col("text_count").alias("reviewTextCount"),
    )
    return F.when(F.col("text_count") > 0, body)


def example_lists(picked: DataFrame, keys) -> DataFrame:
    """Picked texts as one array per sentiment; at most a handful per group."""
    ordered = F.array_sort(F.collect_list(F.struct("sentiment", "rn", "text")))

    def of(kind):
        return F.transform(F.filter(ordered, lambda x: x["sentiment"] == kind), lambda x: x["text"])

    return picked.groupBy(*keys).agg(of("positive").alias("positive_examples"), of("negative").alias("negative_examples"))


def keep_limits(picked: DataFrame, positive: int, negative: int) -> DataFrame:
    return picked.filter(F.col("rn") <= F.when(F.col("sentiment") == "positive", positive).otherwise(negative))


def with_text(reviews: DataFrame) -> DataFrame:
    return reviews.filter(F.col("review_text").isNotNull())


def shown(picked: DataFrame, reviews: DataFrame, chars: int) -> DataFrame:
    """Picked reviews with their text in the short form that examples are shown in."""
    return fetch_texts(picked, reviews).withColumn("text", squash_truncate(F.col("review_text"), chars))


def keyword_text(cut: int | None) -> Column:
    """What keywords are counted on: whole texts, or their first ``cut`` characters as an example would show them."""
    return F.col("review_text") if cut is None else squash_truncate(F.col("review_text"), cut)


def insights_of_categories(
    products: DataFrame, reviews: DataFrame, keywords=KEYWORDS, positive=POSITIVE, negative=NEGATIVE, chars=EXAMPLE_CHARS, keyword_chars: int | None = None
) -> DataFrame:
    """Insights for inference: blank texts dropped, first examples by review id, keywords of whole texts.

    ``keyword_chars`` counts keywords on texts cut to that length instead.
    """
    keys = list(BY_CATEGORY)
    texts = with_text(reviews).filter(squash(F.col("review_text")) != "")
    lookup = product_lookup(products, keys).drop("brand")
    # Narrow rows first: texts are counted where they are read and fetched for the picked few.
    pool = materialise(texts.select("product_id", "review_id", "rating").join(lookup, "product_id"), "rated")
    counts = pool.groupBy(*keys).agg(F.count("*").alias("text_count"))
    found = words_of_groups(texts, lookup, keys, keyword_text(keyword_chars))
    words = listed(top_k(found, keys, by_score("n", "word"), keywords), keys, "top_keywords", {"tag": "word", "count": "n"})
    picked = first_examples(with_sentiment(pool), keys, max(positive, negative))
    shorts = shown(keep_limits(picked, positive, negative), texts, chars)
    return counts.join(words, keys, "left").join(example_lists(shorts, keys), keys, "left")


@dataclass(frozen=True)
class WordCounts:
    """Words as (category_id, branded, word, n); the first of each category, with counts per left-out product; how to count others."""

    totals: DataFrame
    first: DataFrame
    of_first: DataFrame
    per_product: Callable[[DataFrame], DataFrame]


class Samples:
    """Samples of the chosen categories, known by what they leave out; what their measures share is written once."""

    def __init__(self, products: DataFrame, samples: int, ratio: float, min_products: int, seed: int):
        self.products = products.withColumn("draw_key", draws.draw_key())
        self.seed = seed
        ends = draws.draw_ends(products, samples, ratio, min_products, seed)
        self.excluded = materialise(draws.left_out(products, ends, seed), "left-out")
        self.names = products.select("category_id").distinct().withColumn("sample_idx", draws.sample_numbers(samples))
        lookup = products.filter(F.col("id").isNotNull()).groupBy("category_id", F.col("id").alias("product_id"))
        self.lookup = lookup.agg(F.max("brand").alias("brand")).withColumn("draw_key", F.col("product_id").cast("string"))

    def gone(self, rows: DataFrame) -> DataFrame:
        """Rows (category_id, draw_key, ...) of left-out products, once for every sample that leaves them out."""
        return rows.join(self.excluded.select(*SAMPLE_KEYS, "draw_key"), ["category_id", "draw_key"])

    def sums(self, rows: DataFrame, by: list[str], totals) -> DataFrame:
        """Aggregates that add up, by further columns: of the whole category, less those of what a sample leaves out."""
        counts = [c for c in rows.limit(0).groupBy(*by).agg(*totals).columns if c not in by]
        whole = rows.groupBy("category_id", *by).agg(*totals)
        gone = self.gone(rows).groupBy(*SAMPLE_KEYS, *by).agg(*totals)
        return draws.sums_of_samples(whole, gone, self.names, by, counts)

    def facts(self, reviews: DataFrame) -> DataFrame:
        """What ``group_facts`` gives for every sample."""
        per_product = materialise(review_facts(reviews), "facts")
        placed = per_product.join(self.lookup, "product_id")
        return self.sums(placed, ["brand", "year", "platform"], [F.sum(c).alias(c) for c in FACT_SUMS]).filter(F.col("n") > 0)

    def values(self) -> DataFrame:
        keys = ["category_id"]
        less = product_values(self.gone(self.products), SAMPLE_KEYS)
        return value_measures(quantiles_of_counts(product_values(self.products, keys), keys, PLACES, self.names, less), SAMPLE_KEYS)

    def product_sums(self) -> DataFrame:
        sums = self.sums(self.products, [], product_sums())
        brands = self.sums(self.products.filter(F.col("brand").isNotNull()), ["brand"], [F.count("*").alias("n")])
        return sums.join(brands.filter(F.col("n") > 0).groupBy(*SAMPLE_KEYS).agg(F.count("*").alias("brand_count")), SAMPLE_KEYS, "left").fillna(0, ["brand_count"])

    def names_of_products(self) -> DataFrame:
        """What ``product_names`` gives for every sample: brands and channels in full, of tags and segments all that can be listed."""
        per_product = materialise(product_names(self.products, ["category_id", "draw_key"]), "names")
        in_full = F.col("kind").isin(BRAND, CHANNEL)
        full = self.sums(per_product.filter(in_full), ["kind", "name"], [F.sum("n").alias("n"), F.count("*").alias("_products")])
        return full.filter(F.col("_products") > 0).drop("_products").unionByName(self.most_frequent(per_product.filter(~in_full), LIST_SIZE))

    def most_frequent(self, per_product: DataFrame, k: int) -> DataFrame:
        """Names that can be among a sample's k most frequent, from (category_id, draw_key, kind, name, n)."""
        totals = materialise(per_product.groupBy("category_id", "kind", "name").agg(F.sum("n").alias("n")), "totals")
        names = ["category_id", "kind", "name"]
        return draws.top_candidates(totals, lambda some: per_product.join(some, names), self.excluded, self.names, k)

    def word_counts(self, reviews: DataFrame) -> WordCounts:
        """Words of texts summed per category; per left-out product only those that come first in their category."""
        keys = ["category_id", "word"]
        texts = with_text(reviews)
        lookup = self.lookup.withColumn("branded", F.col("brand").isNotNull()).drop("brand")
        totals = materialise(words_of_groups(texts, lookup, ["category_id", "branded"]), "words")
        first = [top_k(rows.groupBy(*keys).agg(F.sum("n").alias("n")), ["category_id"], by_score("n", "word"), FIRST_WORDS) for rows in (totals, totals.filter("branded"))]
        first = materialise(first[0].unionByName(first[1]).select(*keys).distinct(), "first-words")
        left_out = materialise(lookup.join(self.excluded.select("category_id", "draw_key"), ["category_id", "draw_key"], "left_semi"), "left-out-lookup")

        def per_product(some: DataFrame) -> DataFrame:
            return materialise(words_of_groups(texts, left_out, ["category_id", "draw_key", "branded"], only=some), "product-words")

        return WordCounts(totals, first, per_product(first), per_product)

    def words(self, words: WordCounts, k: int, branded: bool) -> DataFrame:
        """(sample, word, n) of the words that can be among a sample's k most frequent."""

        def of_kind(rows: DataFrame, *by: str) -> DataFrame:
            kept = rows.filter("branded") if branded else rows
            return kept.groupBy("category_id", *by, F.lit(WORD).alias("kind"), F.col("word").alias("name")).agg(F.sum("n").alias("n"))

        def rows_of(some: DataFrame) -> DataFrame:
            wanted = materialise(some.select("category_id", F.col("name").alias("word")), "wanted-words")
            rest = materialise(wanted.join(words.first, ["category_id", "word"], "left_anti"), "other-words")
            rows = words.of_first if rest.isEmpty() else words.of_first.unionByName(words.per_product(rest))
            return of_kind(rows.join(wanted, ["category_id", "word"], "left_semi"), "draw_key")

        totals = materialise(of_kind(words.totals), "totals")
        return draws.top_candidates(totals, rows_of, self.excluded, self.names, k).select(*SAMPLE_KEYS, F.col("name").alias("word"), "n")


def insights_of_samples(
    samples: Samples, reviews: DataFrame, words: WordCounts, keywords=KEYWORDS, positive=POSITIVE, negative=NEGATIVE, chars=EXAMPLE_CHARS
) -> DataFrame:
    """Insights for training, per category and sample: blanks kept, examples drawn by hash.

    ``words`` are those of ``word_counts``. Counts are those of the category less what a sample leaves out; examples
    are drawn on review ids, and only the texts of the drawn are looked up.
    """
    keys = SAMPLE_KEYS
    texts = with_text(reviews)
    rated = materialise(texts.select("product_id", "review_id", sentiment(F.col("rating")).alias("sentiment")), "rated")
    per_product = rated.groupBy("product_id").agg(
        F.count("*").alias("text_count"), F.count_if(F.col("sentiment") == "positive").alias("positive"), F.count_if(F.col("sentiment") == "negative").alias("negative")
    )
    placed = materialise(per_product.join(samples.lookup.drop("brand"), "product_id"), "texts-per-product")
    counts = [F.sum(c).alias(c) for c in ("text_count", "positive", "negative")]
    sizes = materialise(samples.sums(placed, [], counts).filter(F.col("text_count") > 0), "text-counts")

    def by_sentiment(rows: DataFrame, by) -> DataFrame:
        both = F.create_map(F.lit("positive"), F.col("positive"), F.lit("negative"), F.col("negative"))
        return rows.select(*by, F.explode(both).alias("sentiment", "_n"))

    found = samples.words(words, keywords, branded=False)
    top = listed(top_k(found, keys, by_score("n", "word"), keywords), keys, "top_keywords", {"tag": "word", "count": "n"})
    picked = draws.ring_examples(
        rated.filter(F.col("sentiment").isNotNull()),
        samples.lookup.drop("brand"),
        samples.excluded,
        by_sentiment(sizes, keys),
        by_sentiment(placed.groupBy("category_id").agg(*counts), ["category_id"]),
        max(positive, negative),
        samples.seed,
    )
    shorts = shown(keep_limits(picked, positive, negative), texts, chars)
    return sizes.select(*keys, "text_count").join(top, keys, "left").join(example_lists(shorts, keys), keys, "left")


def sample_rows(
    products: DataFrame,
    reviews: DataFrame,
    min_products: int = 10,
    max_categories: int | None = None,
    samples: int = 100,
    ratio: float = 0.9,
    seed: int = 42,
    settings: Settings = Settings(),
    use_texts: bool = True,
) -> DataFrame:
    """Metrics, growth, texts and insights per category and sample.

    Products and reviews are read once for whole categories; a sample is those totals less the products it
    leaves out, so what is shuffled grows with the left-out share.
    """
    chosen = materialise(products_of(products, largest_categories(products, max_categories, min_products, need_path=False)), "chosen")
    drawn = Samples(chosen, samples, ratio, min_products, seed)
    grouped = materialise(drawn.facts(reviews), "sample-facts")
    words = drawn.word_counts(reviews)
    top = drawn.words(words, LIST_SIZE, branded=True)
    # The name of a sample is that of its whole category.
    measured = metrics_of_parts(drawn.product_sums(), drawn.values(), drawn.names_of_products(), grouped, top, category_path(chosen), SAMPLE_KEYS)
    rows = materialise(measured, "metrics")
    full = with_growth(rows, grouped, settings, SAMPLE_KEYS).withColumns(
        {"market_overview": narrative.market_overview(), "growth_summary": narrative.growth_summary(settings.start_year, settings.end_year)}
    )
    if use_texts:
        found = insights_of_samples(drawn, reviews, words).withColumn("insights", insight_columns())
        full = full.join(found.select(*SAMPLE_KEYS, "text_count", "top_keywords", "positive_examples", "negative_examples", "insights"), SAMPLE_KEYS, "left")
    return full


def chat_records(rows: DataFrame, system: str) -> DataFrame:
    """System, user and assistant message per row; the two latter hold JSON."""
    fields = model_input_fields()
    user = F.to_json(F.struct(*fields), JSON)
    if "insights" in rows.columns:
        with_texts = F.to_json(F.struct(*fields, F.col("insights").alias("reviewInsights")), JSON)
        user = F.when(F.col("insights").isNotNull(), with_texts).otherwise(user)
    target = F.to_json(F.struct(F.col("market_overview").alias("marketOverviewSummary"), F.col("growth_summary").alias("growthSummary")))

    def message(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    messages = F.array(message("system", F.lit(system)), message("user", user), message("assistant", target))
    kept = [c for c in SAMPLE_KEYS if c in rows.columns]
    return rows.select(*kept, messages.alias("messages"))


def validate_chat_records(records: DataFrame) -> DataFrame:
    """Flag records with at least two messages of which the last is the assistant's."""
    last = F.try_element_at("messages", F.lit(-1))["role"]
    return records.withColumn("is_valid", F.coalesce((F.size("messages") >= 2) & (last == "assistant"), F.lit(False)))


def split_prompt_answer(records: DataFrame) -> DataFrame:
    """All messages but the last are the prompt, the last one's content is the answer."""
    size = F.greatest(F.size("messages") - 1, F.lit(0))
    return records.withColumn("prompt", F.slice("messages", F.lit(1), size)).withColumn("answer", F.try_element_at("messages", F.lit(-1))["content"])
