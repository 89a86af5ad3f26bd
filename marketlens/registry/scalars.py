"""Scalar functions and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import bands, numbers
from marketlens.functions.clean import parse_iso
from marketlens.functions.text import squash_truncate
from marketlens.operators import brands, products as prod, reviews as rev
from marketlens.operators.segments import top_segments
from marketlens.plans.metrics import listed
from marketlens.registry import tables as t
from marketlens.registry.base import int_sql, pct_sql, query, squash_sql
from marketlens.registry.measures import brand_top, grouped, growth, summary


@query("f1_category_display_name", "select id, case when coalesce(category, '') = '' then '카테고리' else trim(string_split(category, '>')[-1]) end as name from products")
def f1(spark, d):
    return t.products(spark, d).select("id", numbers.category_display_name(F.col("category")).alias("name"))


@query("f2_pct", f"select {pct_sql('l_discount + l_tax / 64')} as one, {pct_sql('l_discount * l_tax', 2)} as two, count(*) as n from lineitem group by all")
def f2(spark, d):
    one, two = numbers.pct(F.col("l_discount") + F.col("l_tax") / 64), numbers.pct(F.col("l_discount") * F.col("l_tax"), 2)
    return t.table(spark, d, "lineitem").groupBy(one.alias("one"), two.alias("two")).agg(F.count("*").alias("n"))


@query("f3_fmt_int", f"select o_orderkey, {int_sql('o_totalprice')} as whole, {int_sql('o_custkey / 2.0e0')} as half from orders")
def f3(spark, d):
    return t.table(spark, d, "orders").select("o_orderkey", numbers.fmt_int(F.col("o_totalprice")).alias("whole"), numbers.fmt_int(F.col("o_custkey") / 2.0).alias("half"))


STAMPS = "case l_partkey % 4 when 0 then 'none' when 1 then cast(cast(l_shipdate as date) as varchar(10)) when 2 then concat(cast(cast(l_shipdate as date) as varchar(10)), 'T08:15:00') else concat(cast(year(l_shipdate) as varchar(10)), '.01.05') end"


@query("f4_parse_iso", f"select strftime(case when regexp_matches(x, '^[0-9]{{4}}-') then cast(x as timestamp) end, '%Y-%m-%d %H:%M:%S') as stamp, count(*) as n from (select {STAMPS} as x from lineitem) group by 1")
def f4(spark, d):
    text = F.expr(STAMPS.replace("varchar(10)", "string"))
    return t.table(spark, d, "lineitem").select(parse_iso(text).alias("stamp")).groupBy("stamp").agg(F.count("*").alias("n"))


FLAT = squash_sql("text")


@query("f5_squash_truncate", f"select doc_id, case when length(x) > 180 then x[1:179] || '…' else x end as short from (select doc_id, {FLAT} as x from documents)")
def f5(spark, d):
    return t.table(spark, d, "documents").select("doc_id", squash_truncate(F.col("text"), 180).alias("short"))


@query("f6_estimate_units", "select category_id, year, cast(round_even(review_count * 2.5e0, 0) as bigint) as at_two_and_half, cast(round_even(review_count * 3.0e0, 0) as bigint) as at_default from yearly")
def f6(spark, d):
    counts = rev.yearly_review_counts(grouped(spark, d))
    n = F.col("review_count")
    return counts.select("category_id", "year", numbers.estimate_units(n, 2.5).alias("at_two_and_half"), numbers.estimate_units(n, 0.0).alias("at_default"))


@query("f7_estimate_revenue", "select id, round(cast(round_even(coalesce(review_count, 0) * 3.0e0, 0) as double) * case when min_price > 0 then min_price else 1.0 end, 6) as revenue from products")
def f7(spark, d):
    units = numbers.estimate_units(F.coalesce("review_count", F.lit(0.0)))
    return t.products(spark, d).select("id", numbers.estimate_revenue(units, F.col("min_price")).alias("revenue"))


@query("f8_concentration_band", "select category_id, case when coalesce(top3_brand_share, 0) >= 0.65 then 'strong' when coalesce(top3_brand_share, 0) >= 0.45 then 'mixed' else 'dispersed' end as band from concentration")
def f8(spark, d):
    return brands.brand_concentration(brand_top(spark, d)).select("category_id", bands.concentration_band(F.col("top3_brand_share")).alias("band"))


@query("f9_maturity_band", "select category_id, case when zero_review_ratio >= 0.35 then 'emerging' when zero_review_ratio <= 0.15 then 'mature' else 'transitional' end as band from core")
def f9(spark, d):
    return summary(spark, d, bands.maturity_band(F.col("zero_review_ratio")).alias("band"))


@query("f10_hhi_band", "select category_id, case when hhi_top10 is null then 'none' when hhi_top10 >= 5000 then 'monopoly' when hhi_top10 >= 2500 then 'concentrated' else 'competitive' end as band from core left join concentration using (category_id)")
def f10(spark, d):
    found = brands.brand_concentration(brand_top(spark, d))
    return t.products(spark, d).select("category_id").distinct().join(found, "category_id", "left").select("category_id", bands.hhi_band(F.col("hhi_top10")).alias("band"))


@query(
    "f11_rating_band",
    "select category_id, case when (stars_1 + stars_2) / nullif(cast(total_reviews_product as double), 0) > 0.1 then 'uneven' else 'stable' end as band from hist_product join core using (category_id)",
)
def f11(spark, d):
    sums = t.products(spark, d).groupBy("category_id").agg(*prod.summary_measures(), *prod.rating_hist_product_measures())
    low = (F.col("product_stars_1") + F.col("product_stars_2")) / F.nullif("total_reviews_product", F.lit(0))
    return sums.select("category_id", bands.rating_band(low).alias("band"))


@query("f12_entry_band", "select category_id, case when zero_review_ratio > 0.3 then 'open' when brand_count > 100 then 'hard' else 'medium' end as band from core")
def f12(spark, d):
    sums = t.products(spark, d).groupBy("category_id").agg(*prod.summary_measures(), F.countDistinct("brand").alias("brand_count"))
    return sums.select("category_id", bands.entry_band(F.col("zero_review_ratio"), F.col("brand_count")).alias("band"))


@query("f13_price_tier", "select category_id, case when price_p50 < 50000 then 'low' when price_p50 < 150000 then 'middle' else 'premium' end as tier from prices")
def f13(spark, d):
    return prod.price_quantiles(t.products(spark, d)).select("category_id", bands.price_tier(F.col("price_p50")).alias("tier"))


@query(
    "f14_age_segments",
    """select category_id, segment, place from (select category_id, segment, row_number() over (partition by category_id order by rn) as place from segment_top
 where contains(segment, '연령') or contains(segment, '개월') or contains(segment, '세')) where place <= 2""",
)
def f14(spark, d):
    lists = listed(top_segments(t.products(spark, d)), ["category_id"], "labels", {"segment": "segment"})
    ages = bands.age_segments(F.transform("labels", lambda x: x["segment"]))
    return lists.select("category_id", F.posexplode(ages).alias("place", "segment")).select("category_id", "segment", (F.col("place") + 1).alias("place"))


@query("f15_action_band", "select category_id, case when zero_review_ratio >= 0.3 then 'gather_reviews' else 'niche_position' end as band from core")
def f15(spark, d):
    return summary(spark, d, bands.action_band(F.col("zero_review_ratio")).alias("band"))
