"""Report assembly, training records and template texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from marketlens.operators import growth as gr
from marketlens.operators.draws import RING_DIGITS, SAMPLE_KEYS
from marketlens.plans import narrative, records
from marketlens.operators.reviews import group_facts, review_facts
from marketlens.plans.metrics import chosen_platforms, listed
from marketlens.plans.phrases import BULLETS, ENTRY, GROWTH, OVERVIEW
from marketlens.plans.report import category_report, category_rows, growth_points, overlay_summaries, report_of_category, reports_of_largest, template_summary
from marketlens.registry import base, tables as t
from marketlens.registry.base import ORACLES, SETTINGS, int_sql, pct_sql, query, strip_sql, text_sql
from marketlens.registry.cleaning import REPORT_ENTRIES
from marketlens.registry.measures import DRAWS, RATIO, SAMPLES, brand_top, growth, metrics_rows
from marketlens.session import materialise


def rows(spark, d):
    return category_rows(t.stored_products(spark, d), t.reviews(spark, d, texts=True), SETTINGS)


def fixed_sql(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {x})"


TOP3, ZERO = "coalesce(top3_brand_share, 0)", "coalesce(zero_review_ratio, 0)"
SHARE = f"(case when {TOP3} > 0 then {pct_sql(TOP3)} else '{OVERVIEW['share_unknown']}' end)"
HHI = "printf('%d', cast(round_even(hhi_top10, 0) as bigint))"
LEADERS = f"(case when {TOP3} >= 0.65 then {text_sql(OVERVIEW['strong'], SHARE)} when {TOP3} >= 0.45 then {text_sql(OVERVIEW['mixed'], SHARE)} else {text_sql(OVERVIEW['dispersed'], SHARE)} end)"
MATURITY = f"(case when {ZERO} >= 0.35 then {text_sql(OVERVIEW['emerging'], pct_sql(ZERO))} when {ZERO} <= 0.15 then {text_sql(OVERVIEW['mature'], pct_sql(ZERO))} else {text_sql(OVERVIEW['transitional'])} end)"
STRUCTURE = f"(case when hhi_top10 is null then {text_sql(OVERVIEW['none'])} when hhi_top10 >= 5000 then {text_sql(OVERVIEW['monopoly'], HHI)} when hhi_top10 >= 2500 then {text_sql(OVERVIEW['concentrated'], HHI)} else {text_sql(OVERVIEW['competitive'], HHI)} end)"
RATING = f"case when avg_rating is not null then {text_sql(OVERVIEW['rating'], fixed_sql('avg_rating', 1))} || (case when low_rating_ratio > 0.1 then {text_sql(OVERVIEW['uneven'])} else {text_sql(OVERVIEW['stable'])} end) end"
VOLUME = f"(case when total_review_count <> 0 then {text_sql(OVERVIEW['review_volume'], int_sql('total_review_count'))} else '' end)"
DECISION = f"case when len(cues) > 0 then {VOLUME} || {text_sql(OVERVIEW['decision'], 'array_to_string(cues, chr(44) || chr(32))')} end"
FIRST_STEP = f"(case when {ZERO} >= 0.3 then {text_sql(OVERVIEW['gather_reviews'])} else {text_sql(OVERVIEW['niche_position'])} end)"
SECOND_STEP = f"(case when len(segs) > 0 then {text_sql(OVERVIEW['with_segments'])} else {text_sql(OVERVIEW['without_segments'])} end)"

base.STEPS.update(
    {
        "labelled": """select *, list_concat(segs[1:3], tags[1:3])[1:3] as cues from (select metrics.*,
 coalesce((select list(segment order by rn) from segment_top s where s.category_id = metrics.category_id), []) as segs,
 coalesce((select list(word order by rn) from word_top w where w.category_id = metrics.category_id), []) as tags,
 coalesce((select list(brand order by rn) from brand_top b where b.category_id = metrics.category_id), []) as brand_names,
 coalesce((select list(share order by rn) from brand_top b where b.category_id = metrics.category_id), []) as brand_shares,
 coalesce((select list(platform order by review_count desc, platform) from platforms p where p.category_id = metrics.category_id), []) as channels,
 coalesce((select list(review_count order by review_count desc, platform) from platforms p where p.category_id = metrics.category_id), []) as channel_counts,
 cast((select sum(review_count) from platforms p where p.category_id = metrics.category_id) as double) as channel_total from metrics)""",
        "overview_texts": f"""select category_id, array_to_string(list_filter([{text_sql(OVERVIEW['premise_named'], 'category_name')}, {text_sql(OVERVIEW['conclusion'], LEADERS, MATURITY)},
 {text_sql(OVERVIEW['competition'], STRUCTURE)}, {RATING}, {DECISION}, {text_sql(OVERVIEW['action'], FIRST_STEP, SECOND_STEP)}], lambda x: x is not null), ' ') as market_overview from labelled""",
        "growth_texts": f"""select category_id, case when coalesce(n_points, 0) = 0 then {text_sql(GROWTH['no_data'])} else array_to_string(list_filter([{text_sql(GROWTH['premise'])},
 case when max_growth is not null then {text_sql(GROWTH['flow'], *(f"'{y}'" for y in (SETTINGS.start_year, SETTINGS.end_year)))} end, case when max_growth is not null then {text_sql(GROWTH['best_year'], 'cast(max_growth_year as varchar)')} end,
 case when min_growth < 0 then {text_sql(GROWTH['decline'])} end, case when max_growth is not null and recent_years >= 2 and recent_rates >= 1 then {text_sql(GROWTH['momentum'])} end,
 case when max_growth is not null then {text_sql(GROWTH['caveat'])} end], lambda x: x is not null), ' ') end as growth_summary from core left join extremes using (category_id)""",
    }
)


ORACLES["s7_report_json"] = base.with_steps(REPORT_ENTRIES)


@query("r1_market_overview", "select category_id, market_overview from overview_texts")
def r1(spark, d):
    return metrics_rows(spark, d).select("category_id", narrative.market_overview().alias("market_overview"))


@query("r2_growth_summary", "select category_id, growth_summary from growth_texts")
def r2(spark, d):
    groups = t.products(spark, d).select("category_id").distinct()
    extremes = gr.growth_extremes(growth(spark, d), recent_year=SETTINGS.recent_year)
    return groups.join(extremes, "category_id", "left").select("category_id", narrative.growth_summary(SETTINGS.start_year, SETTINGS.end_year).alias("growth_summary"))


def lines(*items: str) -> str:
    return "list_filter([" + ",\n ".join(items) + "], lambda x: x is not null)"


SEGMENT_VALUES = f"array_to_string(list_transform(segs[1:3], lambda s: {strip_sql('regexp_replace(s, chr(94) || chr(91) || chr(94) || chr(58) || chr(93) || chr(42) || chr(58), chr(32))')}), ', ')"
BRAND_LIST = "array_to_string(list_transform(brand_names[1:3], lambda b, i: b || '(' || " + pct_sql("brand_shares[i]") + " || ')'), ', ')"
SIZES = [int_sql(c) for c in ("product_count", "brand_count", "total_review_count")]
PRICES = [int_sql(c) for c in ("price_p50", "price_p25", "price_p75")]
CHANNEL = [["channels[1]", pct_sql("channel_counts[1] / channel_total")], ["channels[2]", pct_sql("channel_counts[2] / channel_total")]]
BULLET_LINES = lines(
    f"case when brand_count > 0 then {text_sql(BULLETS['size_brands'], 'category_name', *SIZES)} else {text_sql(BULLETS['size'], 'category_name', SIZES[0], SIZES[2])} end",
    text_sql(BULLETS["zero_reviews"], pct_sql("zero_review_ratio")),
    f"case when avg_rating is not null and total_review_count > 0 then (case when low_rating_ratio is not null then {text_sql(BULLETS['rating_low'], fixed_sql('avg_rating', 2), pct_sql('low_rating_ratio'))} else {text_sql(BULLETS['rating'], fixed_sql('avg_rating', 2))} end) end",
    f"case when price_p50 is not null then {text_sql(BULLETS['price'], *PRICES)} || (case when price_change_6m_median is not null then {text_sql(BULLETS['price_change'], pct_sql('price_change_6m_median'))} else '' end) end",
    f"case when channel_total > 0 then (case when len(channels) = 1 then {text_sql(BULLETS['channel_one'], *CHANNEL[0])} else {text_sql(BULLETS['channel_two'], *CHANNEL[0], *CHANNEL[1])} end) end",
    f"case when len(brand_names) > 0 then (case when top3_brand_share is not null then {text_sql(BULLETS['brands_share'], BRAND_LIST, pct_sql('top3_brand_share'))} else {text_sql(BULLETS['brands'], BRAND_LIST)} end) end",
    f"case when len(segs) > 0 then {text_sql(BULLETS['segments'], SEGMENT_VALUES)} end",
    f"case when len(tags) > 0 then {text_sql(BULLETS['keywords'], 'array_to_string(tags[1:6], chr(44) || chr(32))')} end",
    text_sql(BULLETS["period"], "strftime(period_from, '%Y-%m-%d')", "strftime(period_to, '%Y-%m-%d')"),
)


@query("r3_summary_bullets", f"select category_id, generate_subscripts(bullets, 1) as place, unnest(bullets) as line from (select category_id, ({BULLET_LINES})[1:8] as bullets from labelled)")
def r3(spark, d):
    bullets = F.posexplode(narrative.summary_bullets()).alias("place", "line")
    return metrics_rows(spark, d).select("category_id", bullets).withColumn("place", F.col("place") + 1)


AGES = f"list_transform(list_filter(segs, lambda s: contains(s, '연령') or contains(s, '개월') or contains(s, '세'))[1:2], lambda s: {strip_sql('string_split(s, chr(58))[-1]')})"
LOW = f"(case when low_rating_ratio > 0 then {pct_sql('low_rating_ratio')} else '{ENTRY['low_ratio_unknown']}' end)"
TIER = f"(case when price_p50 < 50000 then '{ENTRY['low']}' when price_p50 < 150000 then '{ENTRY['middle']}' else '{ENTRY['premium']}' end)"
ENTRY_LINES = lines(
    f"case when zero_review_ratio > 0.3 then {text_sql(ENTRY['open'], pct_sql('zero_review_ratio'), SIZES[1], SIZES[0])} when brand_count > 100 then {text_sql(ENTRY['hard'], SIZES[1], SIZES[0])} else {text_sql(ENTRY['medium'], SIZES[1], SIZES[0])} end",
    f"""case when len(segs) = 0 then (case when avg_rating is not null then {text_sql(ENTRY['no_segments'], SIZES[2], fixed_sql('avg_rating', 2))} else {text_sql(ENTRY['no_segments_no_rating'], SIZES[2])} end)
 when len(ages) > 0 then {text_sql(ENTRY['ages'], 'array_to_string(ages, chr(44) || chr(32))')} else {text_sql(ENTRY['no_ages'])} end""",
    f"case when price_p50 is not null then {text_sql(ENTRY['price'], TIER, *PRICES)} end",
    f"""case when len(tags) > 0 then {text_sql(ENTRY['keywords'], 'array_to_string(tags[1:4], chr(44) || chr(32))')}
 when avg_rating > 4.5 then {text_sql(ENTRY['high_rating'], fixed_sql('avg_rating', 2), LOW)} else {text_sql(ENTRY['no_keywords'])} end""",
    f"case when len(brand_names) > 0 and top3_brand_share is not null then {text_sql(ENTRY['share'], pct_sql('top3_brand_share'))} else {text_sql(ENTRY['no_share'])} end",
)


@query("r4_entry_insight", f"select category_id, array_to_string({ENTRY_LINES}, ' ') as entry_insight from (select *, {AGES} as ages from labelled)")
def r4(spark, d):
    return metrics_rows(spark, d).select("category_id", narrative.entry_insight().alias("entry_insight"))


@query("r5_donut_items", "select category_id, rn as place, brand as name, score as value, round(share, 6) as share from brand_top")
def r5(spark, d):
    lists = listed(brand_top(spark, d), ["category_id"], "top_brands", {"name": "brand", "reviewCount": "score", "share": "share"})
    from marketlens.plans.report import donut_items

    items = lists.select("category_id", F.posexplode(donut_items()).alias("place", "item"))
    return items.select("category_id", (F.col("place") + 1).alias("place"), "item.name", "item.value", "item.share")


@query(
    "r6_growth_points",
    "select category_id, year, review_count, estimated_units, round(estimated_revenue, 6) as estimated_revenue, round(growth_rate, 6) as growth_rate from growth",
)
def r6(spark, d):
    points = growth_points(growth(spark, d)).select("category_id", F.inline("points"))
    return points.toDF("category_id", "year", "review_count", "estimated_units", "estimated_revenue", "growth_rate")


REPORT_SQL = """select m.category_id, category_name, (select count(*) from brand_top b where b.category_id = m.category_id) as n_items,
 coalesce(round((select sum(share) from brand_top b where b.category_id = m.category_id), 6), 0) as shares, (select count(*) from growth g where g.category_id = m.category_id) as n_points,
 {texts} 'review_count' as proxy, 3.0e0 as units_per_review, round(price_ref, 6) as price_ref from metrics m {join}"""
REPORT_TEXTS = REPORT_SQL.format(texts="market_overview, growth_summary,", join="join overview_texts using (category_id) join growth_texts using (category_id)")


def report_columns(reports):
    return reports.select(
        F.col("categoryId").alias("category_id"),
        F.col("categoryName").alias("category_name"),
        F.size("charts.brandTop10Donut.items").alias("n_items"),
        F.aggregate("charts.brandTop10Donut.items", F.lit(0.0), lambda a, x: a + x["share"]).alias("shares"),
        F.size("charts.growthLine.points").alias("n_points"),
        F.col("summaries.marketOverviewSummary").alias("market_overview"),
        F.col("summaries.growthSummary").alias("growth_summary"),
        F.col("assumptions.proxy").alias("proxy"),
        F.col("assumptions.unitsPerReview").alias("units_per_review"),
        F.col("assumptions.priceRef").alias("price_ref"),
    )


@query("r7_category_report", REPORT_TEXTS)
def r7(spark, d):
    return report_columns(category_report(rows(spark, d), SETTINGS))


# Every entry of the ranked lists of a metrics row; segments under two products and channels after the second are not shown.
LISTS = """select category_id, 'brand' as kind, rn as place, brand as name, score as n, round(share, 6) as share from brand_top
 union all select category_id, 'tag', rn, word, n, null from word_top union all select category_id, 'segment', rn, segment, n, null from segment_top"""
CHANNEL_LIST = """ union all select category_id, 'channel', rn, platform, review_count, null from (select *, row_number() over (partition by category_id order by review_count desc, platform) as rn from platforms) where rn <= 2"""


def list_rows(found, lists: dict[str, str], fields: dict[str, tuple[str, str]]):
    out = None
    for kind, name in lists.items():
        share = F.col("x.share") if kind == "brand" else F.lit(None).cast("double")
        items = found.select("category_id", F.lit(kind).alias("kind"), F.posexplode(name).alias("place", "x"))
        label, n = fields[kind]
        part = items.select("category_id", "kind", (F.col("place") + 1).alias("place"), F.col(f"x.{label}").alias("name"), F.col(f"x.{n}").alias("n"), share.alias("share"))
        out = part if out is None else out.unionAll(part)
    return out


FIELDS = {"brand": ("name", "reviewCount"), "tag": ("tag", "count"), "segment": ("segment", "count"), "channel": ("platform", "count")}


@query("a30_lists", LISTS + CHANNEL_LIST)
def a30_lists(spark, d):
    found = materialise(metrics_rows(spark, d).select("category_id", "top_brands", "top_tags", "top_segments", "top_platforms"), "lists")
    return list_rows(found, {"brand": "top_brands", "tag": "top_tags", "segment": "top_segments", "channel": "top_platforms"}, FIELDS)


@query("r9_lists", LISTS)
def r9_lists(spark, d):
    found = materialise(records.model_input(rows(spark, d)).select("category_id", "input.metrics.*"), "lists")
    return list_rows(found, {"brand": "topBrands", "tag": "topTags", "segment": "topSegments"}, FIELDS)


@query("a30_platforms", "select category_id, platform, review_count from platforms")
def a30_platforms(spark, d):
    products = t.stored_products(spark, d)
    facts = materialise(group_facts(review_facts(t.reviews(spark, d)), products), "facts")
    return chosen_platforms(products, facts, facts.select("category_id").distinct())


@query(
    "r8_template_summary",
    "select category_id, category_name, market_overview, growth_summary from metrics join overview_texts using (category_id) join growth_texts using (category_id)",
)
def r8(spark, d):
    return template_summary(rows(spark, d)).toDF("category_id", "category_name", "market_overview", "growth_summary")


@query(
    "r9_model_input",
    """select category_id, 'market_report_summary' as report_type, category_name, product_count, brand_count, total_review_count, round(avg_rating, 6) as avg_rating, stars_1, stars_5,
 round(zero_review_ratio, 6) as zero_ratio, round(low_rating_ratio, 6) as low_ratio, round(top3_brand_share, 6) as top3, len(brand_names) as n_brands, len(tags) as n_tags, len(segs) as n_segments,
 (select count(*) from growth g where g.category_id = l.category_id) as n_years, round(coalesce((select sum(estimated_revenue) from growth g where g.category_id = l.category_id), 0), 6) as revenue from labelled l""",
)
def r9(spark, d):
    i = records.model_input(rows(spark, d)).select("category_id", "input.*").select("category_id", "reportType", "categoryName", "metrics.*", "growthData")
    return i.select(
        "category_id",
        F.col("reportType").alias("report_type"),
        F.col("categoryName").alias("category_name"),
        F.col("productCount").alias("product_count"),
        F.col("brandCount").alias("brand_count"),
        F.col("totalReviewCount").alias("total_review_count"),
        F.col("avgRatingWeighted").alias("avg_rating"),
        F.col("ratingHistogram")["1"].alias("stars_1"),
        F.col("ratingHistogram")["5"].alias("stars_5"),
        F.col("zeroReviewRatio").alias("zero_ratio"),
        F.col("lowRatingRatio").alias("low_ratio"),
        F.col("top3BrandShare").alias("top3"),
        F.size("topBrands").alias("n_brands"),
        F.size("topTags").alias("n_tags"),
        F.size("topSegments").alias("n_segments"),
        F.size("growthData").alias("n_years"),
        F.aggregate("growthData", F.lit(0.0), lambda a, p: a + p["estimatedRevenue"]).alias("revenue"),
    )


FLAT = base.squash_sql("review_text")
SHORT = f"case when length({FLAT}) > 180 then ({FLAT})[1:179] || '…' else {FLAT} end"
# Insight lists as rows: keywords with counts, then example texts.
INSIGHTS = """select {keys}, 'keyword' as kind, rn as place, word as text, n from (select *, row_number() over (partition by {keys} order by n desc, word) as rn
 from (select {keys}, lower(w) as word, count(*) as n from (select {keys}, unnest(regexp_extract_all({words}, '[가-힣]{{2,}}|[a-zA-Z]{{2,}}')) as w from shorts) group by all)) where rn <= 10
 union all select {keys}, sentiment, rn, short, text_count from (select *, row_number() over (partition by {keys}, sentiment order by {order}) as rn
 from (select *, count(*) over (partition by {keys}) as text_count from shorts) where sentiment is not null) where rn <= case sentiment when 'positive' then 3 else 2 end"""
SENTIMENT = "case when rating >= 4 then 'positive' when rating <= 2 then 'negative' end as sentiment"


def insight_rows(found, keys):
    words = found.select(*keys, F.posexplode("top_keywords").alias("place", "x")).select(*keys, F.lit("keyword").alias("kind"), "place", F.col("x.tag").alias("text"), F.col("x.count").alias("n"))
    out = words
    for kind in ("positive", "negative"):
        out = out.unionAll(found.select(*keys, F.lit(kind).alias("kind"), F.posexplode(f"{kind}_examples").alias("place", "text"), F.col("text_count").alias("n")))
    return out.withColumn("place", F.col("place") + 1)


base.STEPS["shorts"] = f"select category_id, review_id, review_text, {SENTIMENT}, {SHORT} as short from placed where review_text is not null and {FLAT} <> ''"


@query("r10_review_insights", INSIGHTS.format(keys="category_id", order="review_id", words="review_text"))
def r10(spark, d):
    found = records.insights_of_categories(t.stored_products(spark, d), t.reviews(spark, d, texts=True))
    return insight_rows(found, ["category_id"])


@query("r10_insights_of_cut_texts", INSIGHTS.format(keys="category_id", order="review_id", words="short"))
def r10_cut(spark, d):
    found = records.insights_of_categories(t.stored_products(spark, d), t.reviews(spark, d, texts=True), keyword_chars=180)
    return insight_rows(found, ["category_id"])


# Samples: the steps are reused with products replaced by sample members, under one number per category and sample.
MEMBERS = {
    "raw_products": base.STEPS["raw_products"],
    "base_products": base.STEPS["products"],
    "draws": re.sub(r"\bproducts\b", "base_products", DRAWS),
    "products": "select * replace (b.category_id * 1000 + draws.sample_idx as category_id) from base_products b join draws using (id, category_id)",
}
SAMPLE_SHORTS = f"select category_id, category_id // 1000 as real_id, category_id % 1000 as sample_idx, review_id, review_text, {SENTIMENT}, {SHORT} as short from placed where review_text is not null"


def sample_sql(body: str) -> str:
    kept = dict(base.STEPS)
    try:
        base.STEPS.clear()
        base.STEPS.update({**MEMBERS, **{k: v for k, v in kept.items() if k not in MEMBERS}, "shorts": SAMPLE_SHORTS})
        return base.with_steps(body)
    finally:
        base.STEPS.clear()
        base.STEPS.update(kept)


# The reviews that follow the sample's place on a ring of hashes.
RING_PLACE = f"cast(concat('0x', left(md5({{x}}), {RING_DIGITS})) as bigint)"
AFTER = f"(({RING_PLACE.format(x="concat(review_id, ':42')")} - {RING_PLACE.format(x="concat('sample ', sample_idx, ':42')")}) + {16**RING_DIGITS}) % {16**RING_DIGITS}"
SAMPLE_INSIGHTS = "select category_id // 1000 as category_id, category_id % 1000 as sample_idx, kind, place, text, n from (" + INSIGHTS.format(
    keys="category_id", order=f"{AFTER}, review_id", words="review_text"
) + ")"


@query("r10_sample_insights")
def r10_samples(spark, d):
    reviews = t.reviews(spark, d, texts=True)
    samples = records.Samples(t.stored_products(spark, d), SAMPLES, RATIO, 10, 42)
    return insight_rows(records.insights_of_samples(samples, reviews, samples.word_counts(reviews)), SAMPLE_KEYS)


ORACLES["r10_sample_insights"] = sample_sql(SAMPLE_INSIGHTS)

RECORD_MEASURES = ["avg_rating", "zero_review_ratio", "low_rating_ratio", "top3_brand_share"]


@query("r11_sft_records")
def r11(spark, d):
    found = records.sample_rows(t.stored_products(spark, d), t.reviews(spark, d, texts=True), samples=SAMPLES, ratio=RATIO, settings=SETTINGS)
    chat = records.chat_records(found, system="Summarise the market from the figures given; review counts stand for sales.")
    user = """reportType string, categoryName string, metrics struct<productCount:bigint,brandCount:bigint,totalReviewCount:bigint,avgRatingWeighted:double,zeroReviewRatio:double,
 lowRatingRatio:double,top3BrandShare:double,topBrands:array<struct<name:string,reviewCount:bigint>>,topTags:array<struct<tag:string>>,topSegments:array<struct<segment:string>>>,
 growthData array<struct<estimatedRevenue:double,priceRef:double>>, reviewInsights struct<reviewTextCount:bigint,positiveExamples:array<string>>"""
    parsed = chat.select(
        "category_id",
        "sample_idx",
        F.from_json(F.col("messages")[1]["content"], user).alias("u"),
        F.from_json(F.col("messages")[2]["content"], "marketOverviewSummary string, growthSummary string").alias("a"),
    )
    return parsed.select(
        "category_id",
        "sample_idx",
        F.col("u.metrics.productCount").alias("product_count"),
        F.col("u.metrics.brandCount").alias("brand_count"),
        F.col("u.metrics.totalReviewCount").alias("total_review_count"),
        F.col("u.metrics.avgRatingWeighted").alias("avg_rating"),
        F.col("u.metrics.zeroReviewRatio").alias("zero_review_ratio"),
        F.col("u.metrics.lowRatingRatio").alias("low_rating_ratio"),
        F.col("u.metrics.top3BrandShare").alias("top3_brand_share"),
        F.get(F.col("u.metrics.topBrands"), F.lit(0))["name"].alias("first_brand"),
        F.get(F.col("u.metrics.topTags"), F.lit(0))["tag"].alias("first_tag"),
        F.size("u.metrics.topSegments").alias("n_segments"),
        F.size("u.growthData").alias("n_years"),
        F.get(F.col("u.growthData"), F.lit(0))["priceRef"].alias("price_ref"),
        F.coalesce("u.reviewInsights.reviewTextCount", F.lit(0)).alias("n_texts"),
        F.col("a.marketOverviewSummary").alias("market_overview"),
        F.col("a.growthSummary").alias("growth_summary"),
    )


ORACLES["r11_sft_records"] = sample_sql(
    "select l.category_id // 1000 as category_id, l.category_id % 1000 as sample_idx, product_count, brand_count, total_review_count, "
    + ", ".join(f"round({c}, 6) as {c}" for c in RECORD_MEASURES)
    + """, brand_names[1] as first_brand, tags[1] as first_tag, len(segs) as n_segments, (select count(*) from growth g where g.category_id = l.category_id) as n_years,
 case when (select count(*) from growth g where g.category_id = l.category_id) > 0 then round(price_ref, 6) end as price_ref, (select count(*) from shorts s where s.category_id = l.category_id) as n_texts,
 market_overview, growth_summary from labelled l join overview_texts using (category_id) join growth_texts using (category_id)
 where l.category_id // 1000 in (select category_id from base_products group by 1 having count(*) >= 10)"""
)

LARGEST = "(select category_id from products where category is not null group by 1 having count(*) >= 10 order by count(*) desc, category_id limit 20)"


@query("r12_reports_of_largest", f"{REPORT_TEXTS} where m.category_id in {LARGEST}")
def r12(spark, d):
    return report_columns(reports_of_largest(t.stored_products(spark, d), t.reviews(spark, d, texts=True), 20, 10, SETTINGS))


@query("r7_report_by_id", f"{REPORT_TEXTS} where m.category_id = 104")
def r7_by_id(spark, d):
    return report_columns(report_of_category(t.stored_products(spark, d), t.reviews(spark, d, texts=True), category_id=104, settings=SETTINGS))


# Every product of a supplier category has its path, so the pattern takes whole categories.
MATCHING = "(select category_id from products where regexp_matches(category, 'Services > r') group by 1 order by count(*) desc, 1 limit 1)"


@query("r7_report_by_pattern", f"{REPORT_TEXTS} where m.category_id = {MATCHING}")
def r7_by_pattern(spark, d):
    return report_columns(report_of_category(t.stored_products(spark, d), t.reviews(spark, d, texts=True), needle="Services > r", settings=SETTINGS))


# Generated texts per category: several conversations fall on one category; the overlay takes the last.
GENERATION_CATEGORY = "100 * (1 + cast(floor(conv_id / 8) as bigint) % 6) + 1 + conv_id % 8"
base.STEPS["generations"] = f"select generation_id, {GENERATION_CATEGORY} as category_id, coalesce(question, '') as market_overview, coalesce(answer, '') as growth_summary from turn_texts"


def generations(spark, d):
    return t.turn_texts(spark, d).select(
        "generation_id",
        F.expr(GENERATION_CATEGORY).alias("category_id"),
        F.coalesce("question", F.lit("")).alias("market_overview"),
        F.coalesce("answer", F.lit("")).alias("growth_summary"),
    )


@query(
    "j4_overlay_summaries",
    """select m.category_id, category_name, coalesce(g.market_overview, '') as market_overview, coalesce(g.growth_summary, '') as growth_summary
 from metrics m left join (select category_id, arg_max(market_overview, generation_id) as market_overview, arg_max(growth_summary, generation_id) as growth_summary from generations group by 1) g using (category_id)""",
)
def j4(spark, d):
    last = generations(spark, d).groupBy("category_id").agg(*[F.max_by(c, "generation_id").alias(c) for c in ("market_overview", "growth_summary")])
    return report_columns(overlay_summaries(category_report(rows(spark, d), SETTINGS), last)).select("category_id", "category_name", "market_overview", "growth_summary")
