"""Joins, aggregations, windows, sampling and set-like combinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import cells
from marketlens.functions.text import tokens, words
from marketlens.operators import brands, draws, examples, growth as gr, products as prod, reviews as rev, selection as sel
from marketlens.operators.keywords import keyword_counts
from marketlens.operators.ranking import by_score, top_k
from marketlens.operators.segments import segment_bag, segment_counts, top_segments
from marketlens.plans.metrics import chosen_brand_scores, metrics
from marketlens.plans.report import donut_fraction
from marketlens.registry import tables as t
from marketlens.registry.base import SETTINGS, query, squash_sql, strip_sql
from marketlens.session import materialise


def grouped(spark, d):
    return rev.group_facts(rev.review_facts(t.reviews(spark, d)), t.products(spark, d))


def summary(spark, d, *names):
    return t.products(spark, d).groupBy("category_id").agg(*prod.summary_measures()).select("category_id", *names)


def brand_scores(spark, d):
    """Brand scores of every category: review rows where there are any, else product columns."""
    facts = materialise(grouped(spark, d), "facts")
    return chosen_brand_scores(t.products(spark, d), facts, facts.select("category_id").distinct())


def brand_top(spark, d):
    return brands.brand_top_share(brand_scores(spark, d))


def growth(spark, d):
    facts = materialise(grouped(spark, d))
    prices = prod.price_quantiles(t.products(spark, d)).select("category_id", F.coalesce("price_p50", "price_p25", "price_p75").alias("price_ref"))
    return gr.yearly_growth(rev.yearly_review_counts(facts), prices, start_year=SETTINGS.start_year, end_year=SETTINGS.end_year)


# Joins


@query("j1_reviews_of", "select review_id, product_id from reviews where product_id in (select id from products where category like '%SMALL%')")
def j1(spark, d):
    chosen = t.products(spark, d).filter(F.contains("category", F.lit("SMALL")))
    return sel.reviews_of(t.reviews(spark, d), chosen).select("review_id", "product_id")


@query("j2_reviews_with_brand", "select review_id, category_id, brand from placed")
def j2(spark, d):
    return sel.reviews_with_brand(t.reviews(spark, d), t.products(spark, d)).select("review_id", "category_id", "brand")


@query("j3_year_spine", "select category_id, year, review_count from spine")
def j3(spark, d):
    yearly = rev.yearly_review_counts(grouped(spark, d))
    return gr.year_spine(yearly.select("category_id").distinct(), yearly, start_year=SETTINGS.start_year, end_year=SETTINGS.end_year).select("category_id", "year", "review_count")


@query("j6_products_of_categories", "select id, category_id from products where category_id in (select category_id from products where category is not null group by 1 having count(*) >= 42)")
def j6(spark, d):
    products = t.products(spark, d)
    return sel.products_of(products, sel.category_sizes(products, 42)).select("id", "category_id")


# Aggregations

for _name, _column in [
    ("a1_product_count", "product_count"),
    ("a3_total_reviews_product", "total_reviews_product"),
    ("a18_zero_review_ratio", "zero_review_ratio"),
]:
    query(_name, f"select category_id, round({_column}, 6) as {_column} from core" if "ratio" in _column else f"select category_id, {_column} from core")(
        lambda spark, d, c=_column: summary(spark, d, c)
    )


@query("a2_brand_count", "select category_id, brand_count from core")
def a2(spark, d):
    return t.products(spark, d).groupBy("category_id").agg(F.countDistinct("brand").alias("brand_count"))


@query("a4_total_reviews_rows", "select category_id, total_reviews_rows from review_sums")
def a4(spark, d):
    return rev.review_measures(grouped(spark, d)).select("category_id", "total_reviews_rows")


@query("a5_weighted_rating", "select category_id, round(weighted_rating, 6) as weighted_rating from core")
def a5(spark, d):
    return summary(spark, d, "weighted_rating")


@query("a6_mean_rating", "select category_id, round(mean_rating, 6) as mean_rating from review_sums")
def a6(spark, d):
    return rev.review_measures(grouped(spark, d)).select("category_id", "mean_rating")


STAR_COLUMNS = ", ".join(f"stars_{k}" for k in cells.STARS)


@query("a7_rating_hist_product", f"select category_id, {STAR_COLUMNS} from hist_product")
def a7(spark, d):
    return prod.rating_hist_product(t.products(spark, d)).select("category_id", *[F.col(f"product_stars_{k}").alias(f"stars_{k}") for k in cells.STARS])


@query("a8_rating_hist_rows", f"select category_id, {STAR_COLUMNS} from hist_rows")
def a8(spark, d):
    return rev.review_measures(grouped(spark, d)).select("category_id", *[F.col(f"row_stars_{k}").alias(f"stars_{k}") for k in cells.STARS])


@query("a9_platform_dist_product", "select category_id, platform, review_count from platform_product")
def a9(spark, d):
    return prod.platform_dist_product(t.products(spark, d))


@query("a10_platform_dist_rows", "select category_id, platform, review_count from platform_rows")
def a10(spark, d):
    return rev.platform_dist_rows(grouped(spark, d))


@query("a11_brand_scores_product", "select category_id, brand, score from brand_product")
def a11(spark, d):
    return prod.brand_scores_product(t.products(spark, d))


@query("a12_brand_scores_rows", "select category_id, brand, score from brand_rows")
def a12(spark, d):
    return rev.brand_scores_rows(grouped(spark, d))


@query("a13_brand_top10_share", "select category_id, brand, score, rn, round(share, 6) as share from brand_top")
def a13(spark, d):
    return brand_top(spark, d).select("category_id", "brand", "score", "rn", "share")


@query("a14_top3_share", "select category_id, round(top3_brand_share, 6) as top3_brand_share from concentration")
def a14(spark, d):
    return brands.brand_concentration(brand_top(spark, d)).select("category_id", "top3_brand_share")


@query("a15_tag_counts", "select category_id, word, n, rn from (select *, row_number() over (partition by category_id order by n desc, word) as rn from tag_counts) where rn <= 10")
def a15(spark, d):
    return top_k(prod.tag_counts(t.products(spark, d)), ["category_id"], by_score("n", "word"), 10)


@query("a16_keyword_counts", "select category_id, word, n, rn from (select *, row_number() over (partition by category_id order by n desc, word) as rn from word_counts) where rn <= 10")
def a16(spark, d):
    counts = keyword_counts(t.reviews(spark, d, texts=True), t.products(spark, d))
    return top_k(counts, ["category_id"], by_score("n", "word"), 10)


@query("a17_update_period", "select category_id, strftime(period_from, '%Y-%m-%d') as period_from, strftime(period_to, '%Y-%m-%d') as period_to from core")
def a17(spark, d):
    return summary(spark, d, "period_from", "period_to")


def metrics_rows(spark, d):
    products, reviews = t.stored_products(spark, d), t.reviews(spark, d, texts=True)
    facts = materialise(rev.facts_of_groups(reviews, products), "facts")
    return metrics(products, facts, keyword_counts(reviews, products), sel.category_path(products))


@query(
    "a19_low_rating_ratio",
    "select category_id, round((stars_1 + stars_2) / cast(total_reviews_rows as double), 6) as low_rating_ratio from hist_rows join review_sums using (category_id)",
)
def a19(spark, d):
    sums = rev.review_measures(grouped(spark, d))
    return sums.select("category_id", ((F.col("row_stars_1") + F.col("row_stars_2")) / F.col("total_reviews_rows")).alias("low_rating_ratio"))


@query("a20_price_stats", "select category_id, " + ", ".join(f"round({c}, 6) as {c}" for c in ("price_min", "price_max", "price_p25", "price_p50", "price_p75")) + " from prices")
def a20(spark, d):
    return prod.price_stats(t.products(spark, d))


@query("a21_price_change_6m", "select category_id, round(price_change_6m_median, 6) as price_change_6m_median from changes")
def a21(spark, d):
    return prod.price_change_median(t.products(spark, d))


@query("a22_spec_segments", "select category_id, segment, count(*) as n from spec_segments where segment is not null group by all")
def a22(spark, d):
    return segment_counts(t.products(spark, d), "spec_segments")


@query("a23_unit_segments", "select category_id, segment, count(*) as n from unit_segments group by all")
def a23(spark, d):
    return segment_counts(t.products(spark, d), "unit_segments")


@query("a24_top_segments", "select category_id, segment, n, rn from segment_top")
def a24(spark, d):
    return top_segments(t.products(spark, d))


@query("a25_yearly_review_counts", "select category_id, year, review_count from yearly")
def a25(spark, d):
    return rev.yearly_review_counts(grouped(spark, d))


@query("a26_hhi_top10", "select category_id, round(hhi_top10, 6) as hhi_top10 from concentration")
def a26(spark, d):
    return brands.brand_concentration(brand_top(spark, d)).select("category_id", "hhi_top10")


@query("a27_growth_extremes", "select category_id, round(max_growth, 6) as max_growth, round(min_growth, 6) as min_growth, max_growth_year from extremes")
def a27(spark, d):
    return gr.growth_extremes(growth(spark, d)).select("category_id", "max_growth", "min_growth", "max_growth_year")


@query("a28_recent_momentum", "select category_id, recent_years, round(recent_mean_growth, 6) as recent_mean_growth from extremes where recent_years >= 2 and recent_rates >= 1")
def a28(spark, d):
    return gr.recent_momentum(growth(spark, d), recent_year=SETTINGS.recent_year)


@query("a29_category_sizes", "select category_id, count(*) as product_count from products where category is not null group by 1 having count(*) >= 10")
def a29(spark, d):
    return sel.category_sizes(t.products(spark, d), 10)


METRIC_DOUBLES = ["avg_rating", "zero_review_ratio", "low_rating_ratio", "top3_brand_share", "hhi_top10", "price_min", "price_max", "price_p25", "price_p50", "price_p75", "price_change_6m_median", "price_ref"]


@query(
    "a30_metrics",
    "select category_id, category_name, has_reviews, product_count, brand_count, total_review_count, stars_1, stars_2, stars_3, stars_4, stars_5, strftime(period_from, '%Y-%m-%d') as period_from, strftime(period_to, '%Y-%m-%d') as period_to, "
    + "(select brand from brand_top b where b.category_id = m.category_id and rn = 1) as first_brand, "
    + "(select word from word_top w where w.category_id = m.category_id and rn = 1) as first_tag, (select segment from segment_top s where s.category_id = m.category_id and rn = 1) as first_segment, "
    + "cast(coalesce((select sum(review_count) from platforms p where p.category_id = m.category_id), 0) as bigint) as platform_total, "
    + ", ".join(f"round({c}, 6) as {c}" for c in METRIC_DOUBLES)
    + " from metrics m",
)
def a30(spark, d):
    stars = [F.col("rating_hist")[k].alias(f"stars_{k}") for k in cells.STARS]
    firsts = [F.get(F.col(a), F.lit(0))[f].alias(n) for a, f, n in [("top_brands", "name", "first_brand"), ("top_tags", "tag", "first_tag"), ("top_segments", "segment", "first_segment")]]
    names = ["category_id", "category_name", "has_reviews", "product_count", "brand_count", "total_review_count", "period_from", "period_to", "platform_total"]
    return metrics_rows(spark, d).select(*names, *stars, *firsts, *METRIC_DOUBLES)


# Windows


@query(
    "w1_yoy_growth",
    "select category_id, year, review_count, estimated_units, round(estimated_revenue, 6) as estimated_revenue, round(growth_rate, 6) as growth_rate from growth",
)
def w1(spark, d):
    return growth(spark, d).select("category_id", "year", "review_count", "estimated_units", "estimated_revenue", "growth_rate")


@query("w2_top_k", "select platform, product_id, n, rn from (select *, row_number() over (partition by platform order by n desc, product_id) as rn from (select platform, product_id, count(*) as n from reviews group by all)) where rn <= 5")
def w2(spark, d):
    counts = t.reviews(spark, d).groupBy("platform", "product_id").agg(F.count("*").alias("n"))
    return top_k(counts, ["platform"], by_score("n", "product_id"), 5)


@query("w3_donut_fraction", "select category_id, brand, round(score / (case when sum(score) over (partition by category_id) = 0 then 1.0 else cast(sum(score) over (partition by category_id) as double) end), 6) as fraction from brand_top")
def w3(spark, d):
    return donut_fraction(brand_top(spark, d)).select("category_id", "brand", "fraction")


@query(
    "w4_latest_year_kpi",
    "select category_id, year, estimated_units, cast(floor(estimated_revenue + 0.5) as bigint) as revenue_rounded, round(growth_rate, 6) as growth_rate from growth where year = 2001",
)
def w4(spark, d):
    return gr.latest_year(growth(spark, d))


@query(
    "w5_axis_range",
    """select category_id, round(least(min(estimated_revenue), 0.0), 6) as axis_min, round(greatest(max(estimated_revenue), 1.0), 6) as axis_max,
 round(greatest(1.0, greatest(max(estimated_revenue), 1.0) - least(min(estimated_revenue), 0.0)), 6) as axis_span from growth group by category_id""",
)
def w5(spark, d):
    return gr.axis_range(growth(spark, d))


# Sort, limit, sampling


@query("l1_largest_categories", "select category_id, count(*) as product_count from products where category is not null group by 1 having count(*) >= 10 order by 2 desc, 1 limit 12")
def l1(spark, d):
    return sel.largest_categories(t.products(spark, d), 12)


SAMPLES, RATIO = 4, 0.9

DRAWS = f"""select category_id, sample_idx, id from (select *, row_number() over (partition by category_id, sample_idx order by md5(concat(id, ':', sample_idx + 42)), id) as place
 from (select category_id, id, count(*) over (partition by category_id) as size from products), (select cast(unnest(generate_series(0, {SAMPLES - 1})) as bigint) as sample_idx))
 where size <= 10 or place <= least(size, greatest(10, cast(floor(size * {RATIO}e0) as bigint)))"""


@query("l2_subsample_products", DRAWS)
def l2(spark, d):
    return draws.subsample_products(t.products(spark, d), SAMPLES, RATIO).select("category_id", "sample_idx", "id")


RATED = """select category_id, review_id, review_text, case when rating >= 4 then 'positive' when rating <= 2 then 'negative' end as sentiment from placed where review_text is not null"""


EXAMPLE = ["category_id", "sentiment", "review_id", "rn", "md5(review_text) as text_md5"]


@query(
    "l3_sample_examples",
    f"""select category_id, sentiment, review_id, rn, md5(review_text) as text_md5 from (select *, row_number() over (partition by category_id, sentiment order by md5(concat(review_id, ':42')), review_id) as rn
 from ({RATED}) where sentiment is not null) where rn <= 3""",
)
def l3(spark, d):
    reviews = t.reviews(spark, d, texts=True)
    pool = sel.reviews_with_brand(examples.rated_texts(reviews), t.products(spark, d))
    return examples.fetch_texts(examples.sample_examples(pool, ["category_id"], 3), reviews).selectExpr(*EXAMPLE)


@query(
    "l4_first_examples",
    f"""select category_id, sentiment, review_id, rn, md5(review_text) as text_md5 from (select *, row_number() over (partition by category_id, sentiment order by review_id) as rn
 from ({RATED}) where sentiment is not null and review_text <> '') where rn <= 3""",
)
def l4(spark, d):
    reviews = t.reviews(spark, d, texts=True)
    pool = sel.reviews_with_brand(examples.rated_texts(reviews, blank=False), t.products(spark, d))
    return examples.fetch_texts(examples.first_examples(pool, ["category_id"], 3), reviews).selectExpr(*EXAMPLE)


# Set-like combinations


@query(
    "u1_token_bag",
    "select doc_id, count(*) as n_tokens, count(distinct lower(w)) as n_distinct, min(lower(w)) as first_word from (select doc_id, unnest(regexp_extract_all(text, '[가-힣]{2,}|[a-zA-Z]{2,}')) as w from documents) group by doc_id",
)
def u1(spark, d):
    bags = t.table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("bag")).filter(F.size("bag") > 0)
    return bags.select("doc_id", F.size("bag").alias("n_tokens"), F.size(F.array_distinct("bag")).alias("n_distinct"), F.array_min("bag").alias("first_word"))


@query("u2_segment_bag", "select category_id, segment, count(*) as n from segment_bag group by all")
def u2(spark, d):
    return segment_bag(t.products(spark, d)).groupBy("category_id", "segment").agg(F.count("*").alias("n"))


WORDS = "list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


def words_sql(x: str) -> str:
    return WORDS.format(x=squash_sql(f"coalesce({x}, '')"))


@query(
    "u3_word_sets",
    f"""select conv_id, turn, len(list_intersect(a, b)) as n_shared, len(list_distinct(list_concat(a, b))) as n_union
 from (select conv_id, turn, {words_sql('question')} as a, {words_sql('answer')} as b from turn_texts)""",
)
def u3(spark, d):
    a, b = words(F.col("question")), words(F.col("answer"))
    return t.turn_texts(spark, d).select("conv_id", "turn", F.size(F.array_intersect(a, b)).alias("n_shared"), F.size(F.array_union(a, b)).alias("n_union"))
