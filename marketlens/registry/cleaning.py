"""Scans, sinks, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import cells
from marketlens.functions.catalog import canonical_reviews
from marketlens.functions.clean import brand_of, positive, sentiment, to_number, to_timestamp_lenient
from marketlens.operators import selection as sel
from marketlens.plans.export import export_largest
from marketlens.plans.metrics import price_reference
from marketlens.operators.products import price_quantiles
from marketlens.plans.records import split_prompt_answer, validate_chat_records
from marketlens.plans.report import category_report, category_rows
from marketlens.registry import tables as t
from marketlens.registry.base import SETTINGS, json_sql, query, strip_sql
from marketlens.session import scratch_path
from marketlens.sources.catalog import csv_by_headers, read_catalog_csv, write_catalog_csv
from marketlens.sources.documents import read_sft_jsonl, write_report_json, write_sft_jsonl

RAW_TEXT_COLUMNS = ["category", "manufacturer", "price_trend", "specifications", "unit_price", "review_tags", "review_rating_distribution", "review_platform_distribution", "updated_at"]


def catalog_through_csv(spark, d):
    """Both raw tables written as compressed CSV folders and read back. Whole texts come once a line item, so plain
    files would be several times the input."""
    root = scratch_path(spark, "catalog")
    write_catalog_csv(t.raw_products(spark, d), f"{root}/products", "gzip")
    for k, part in enumerate(t.raw_review_slices(spark, d)):
        write_catalog_csv(part, f"{root}/reviews", "gzip", "append" if k else "overwrite")
    return read_catalog_csv(spark, f"{root}/products", f"{root}/reviews")


@query(
    "s1_s4_catalog_csv",
    f"""select cast(id as varchar) as id, cast(category_id as varchar) as category_id, category, nullif(manufacturer, '') as manufacturer, specifications, review_tags, review_rating_distribution, updated_at from raw_products""",
)
def s1_s4(spark, d):
    products, _ = catalog_through_csv(spark, d)
    blank = F.nullif(F.col("manufacturer"), F.lit(""))
    return products.select("id", "category_id", "category", blank.alias("manufacturer"), "specifications", "review_tags", "review_rating_distribution", "updated_at")


@query(
    "s1_s4_reviews_csv",
    "select review_id, cast(product_id as varchar) as product_id, rating, nullif(trim(platform), '') as platform, nullif(review_text, '') as review_text from raw_reviews",
)
def s1_s4_reviews(spark, d):
    _, reviews = catalog_through_csv(spark, d)
    text = F.nullif(F.col("review_text"), F.lit(""))
    return reviews.select("review_id", "product_id", to_number(F.col("rating")).alias("rating"), F.nullif(F.trim("platform"), F.lit("")).alias("platform"), text.alias("review_text"))


@query("s3_parse_literal", "select id, k as star, n from product_stars")
def s3(spark, d):
    raw = t.raw_products(spark, d).filter(F.col("category_id").isNotNull())
    found = raw.select("id", F.explode(F.arrays_zip(F.lit(cells.STARS).alias("star"), cells.star_counts(cells.text_map(F.col("review_rating_distribution"))).alias("n"))).alias("x"))
    return found.select("id", "x.star", "x.n")


def conversation_records(spark, d):
    """Chat records out of the conversations: one per conversation, turns in order."""
    turns = t.table(spark, d, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    messages = F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return turns.groupBy("conv_id").agg(messages.alias("messages"))


@query(
    "s5_s6_sft_jsonl",
    "select count(*) as n_messages, arg_max(role, turn) as last_role, cast(sum(length(text)) as bigint) as n_chars, arg_min(text, turn) as first_text from conversations group by conv_id",
)
def s5_s6(spark, d):
    path = scratch_path(spark, "records")
    write_sft_jsonl(conversation_records(spark, d), path)
    back = read_sft_jsonl(spark, path)
    chars = F.aggregate("messages", F.lit(0).cast("bigint"), lambda a, m: a + F.length(m["content"]))
    return back.select(
        F.size("messages").alias("n_messages"), F.element_at("messages", -1)["role"].alias("last_role"), chars.alias("n_chars"), F.col("messages")[0]["content"].alias("first_text")
    )


# Every entry of the documents; its SQL needs the texts of the reports and is registered with them.
REPORT_ENTRIES = """select m.category_id, category_name, 'brand' as part, rn as place, brand as name, cast(score as double) as value, round(share, 6) as rate, round(price_ref, 6) as price_ref from metrics m join brand_top using (category_id)
 union all select m.category_id, category_name, 'year', year - 1995, cast(year as varchar), round(estimated_revenue, 6), round(growth_rate, 6), round(m.price_ref, 6) from metrics m join growth using (category_id)
 union all select m.category_id, category_name, 'overview', 1, market_overview, null, null, round(price_ref, 6) from metrics m join overview_texts using (category_id)
 union all select m.category_id, category_name, 'growth', 1, growth_summary, null, null, round(price_ref, 6) from metrics m join growth_texts using (category_id)"""


@query("s7_report_json")
def s7(spark, d):
    path = scratch_path(spark, "reports")
    rows = category_rows(t.stored_products(spark, d), t.reviews(spark, d, texts=True), SETTINGS)
    write_report_json(category_report(rows, SETTINGS), path)
    body = """categoryName string, charts struct<brandTop10Donut:struct<items:array<struct<name:string,value:bigint,share:double>>>,growthLine:struct<points:array<struct<year:int,estimatedRevenue:double,growthRate:double>>>>,
 summaries struct<marketOverviewSummary:string,growthSummary:string>, assumptions struct<priceRef:double>"""
    back = spark.read.text(path).select(F.col("category_id").cast("bigint").alias("category_id"), F.from_json("value", body).alias("r"))
    none = F.lit(None).cast("double")

    def entries(part, items, name, value, rate):
        fields = [F.lit(part).alias("part"), F.transform(items, lambda x: F.struct(name(x).alias("name"), value(x).alias("value"), rate(x).alias("rate"))).alias("items")]
        return F.struct(*fields)

    parts = F.array(
        entries("brand", F.col("r.charts.brandTop10Donut.items"), lambda x: x["name"], lambda x: x["value"].cast("double"), lambda x: x["share"]),
        entries("year", F.col("r.charts.growthLine.points"), lambda x: x["year"].cast("string"), lambda x: x["estimatedRevenue"], lambda x: x["growthRate"]),
        entries("overview", F.array("r.summaries.marketOverviewSummary"), lambda x: x, lambda x: none, lambda x: none),
        entries("growth", F.array("r.summaries.growthSummary"), lambda x: x, lambda x: none, lambda x: none),
    )
    each = back.select("category_id", "r", F.inline(parts))
    items = each.select("category_id", F.col("r.categoryName").alias("category_name"), "part", F.posexplode("items").alias("place", "x"), F.col("r.assumptions.priceRef").alias("price_ref"))
    return items.select("category_id", "category_name", "part", (F.col("place") + 1).alias("place"), "x.name", "x.value", "x.rate", "price_ref")


MIXED = ["id", "category_id", "category", "manufacturer", "review_count", "average_rating", "min_price"]


@query("s1_csv_mixed_headers", "select cast(id as varchar) as id, cast(category_id as varchar) as category_id, category, nullif(manufacturer, '') as manufacturer, case when (id % 3 + 3) % 3 < 2 then min_price end as min_price, case when (id % 3 + 3) % 3 = 2 then 'x' end as note from raw_products")
def s1_mixed(spark, d):
    root = scratch_path(spark, "mixed")
    products = t.raw_products(spark, d).select(*MIXED)
    # Three kinds of file in one folder: other orders, a missing column, a further one.
    kinds = [MIXED, MIXED[::-1], [*MIXED[2:6], "note", *MIXED[:2]]]
    for k, columns in enumerate(kinds):
        part = products.withColumn("note", F.lit("x")).filter(F.pmod(F.col("id"), F.lit(3)) == k)
        part.select(*columns).write.mode("append").options(header="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", emptyValue='""').csv(root)
    found = csv_by_headers(spark, root)
    return found.select("id", "category_id", "category", F.nullif("manufacturer", F.lit("")).alias("manufacturer"), to_number(F.col("min_price")).alias("min_price"), "note")


@query(
    "e1_export_largest",
    """select p.category_id, count(distinct p.id) as n_products, count(r.review_id) as n_reviews, sum(length(r.review_text)) as n_chars
 from raw_products p join (select category_id from raw_products where category is not null and category_id is not null group by 1 having count(*) >= 10 order by count(*) desc, category_id limit 5) using (category_id) left join raw_reviews r on r.product_id = p.id group by 1""",
)
def e1(spark, d):
    root = scratch_path(spark, "export")
    export_largest(t.raw_products(spark, d), t.raw_reviews(spark, d, texts=True), root, 5)
    products, reviews = read_catalog_csv(spark, f"{root}/products", f"{root}/reviews")
    sizes = reviews.groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("n"), F.sum(F.length("review_text")).alias("chars"))
    joined = products.join(sizes, "id", "left").groupBy(F.col("category_id").cast("bigint").alias("category_id"))
    return joined.agg(F.count("*").alias("n_products"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_reviews"), F.sum("chars").alias("n_chars"))


# Number text of three kinds: padded, with a unit, plain.
NUMBER_TEXT = "case p_partkey % 3 when 0 then concat(' ', p_size, '.5 ') when 1 then concat(p_size, '원') else concat('1e', p_size % 4) end"


@query("p1_to_number", f"select p_partkey as id, round(try_cast(trim({NUMBER_TEXT}) as double), 6) as number from part")
def p1(spark, d):
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), to_number(F.expr(NUMBER_TEXT)).alias("number"))


DATE_PARTS = "cast(year(l_shipdate) as varchar(10)), '{s}', lpad(cast(month(l_shipdate) as varchar(10)), 2, '0'), '{s}', lpad(cast(day(l_shipdate) as varchar(10)), 2, '0')"
DATE_TEXT = "case l_partkey %% 5 when 0 then concat(%s) when 1 then concat(%s) when 2 then concat(%s) when 3 then concat(%s, ' 10:30:00') else 'soon' end" % tuple(DATE_PARTS.replace("{s}", s) for s in "-./-")


@query(
    "p2_to_timestamp_lenient",
    f"""select strftime(coalesce(try_strptime(x, '%Y-%m-%d %H:%M:%S'), try_strptime(x, '%Y-%m-%d'), try_strptime(x, '%Y.%m.%d'), try_strptime(x, '%Y/%m/%d')), '%Y-%m-%d %H:%M:%S') as stamp, count(*) as n
 from (select {DATE_TEXT} as x from lineitem) group by 1""",
)
def p2(spark, d):
    text = F.expr(DATE_TEXT.replace("varchar(10)", "string"))
    return t.table(spark, d, "lineitem").select(to_timestamp_lenient(text).alias("stamp")).groupBy("stamp").agg(F.count("*").alias("n"))


@query("p3_filter_category_id", "select id, category_id, brand from products where category_id = 203")
def p3(spark, d):
    return sel.filter_category_id(t.products(spark, d), 203).select("id", "category_id", "brand")


@query(
    "p4_filter_category_contains",
    """select id, category_id, category from products where regexp_matches(category, 'gear|bolt') and category_id =
 (select category_id from products where regexp_matches(category, 'gear|bolt') group by 1 order by count(*) desc, category_id limit 1)""",
)
def p4(spark, d):
    return sel.filter_category_contains(t.products(spark, d), "gear|bolt").select("id", "category_id", "category")


@query(
    "p5_filter_category_like",
    "select id, category_id, (select arg_min(category_id, id) from products where category like '%gear%') as picked_category_id from products where category like '%gear%'",
)
def p5(spark, d):
    return sel.filter_category_like(t.products(spark, d), "gear").select("id", "category_id", "picked_category_id")


@query("p6_canonical_reviews", "select review_id, product_id, round(rating, 6) as rating, platform, strftime(review_date, '%Y-%m-%d %H:%M:%S') as review_date, review_text from reviews")
def p6(spark, d):
    # A table whose date and text columns carry the second names of their lists.
    raw = t.raw_reviews(spark, d, texts=True).withColumnsRenamed({"review_date": "first_seen_at", "review_text": "review_content"})
    return canonical_reviews(raw)


@query("p7_with_brand", "select id, brand from products where brand is not null")
def p7(spark, d):
    raw = t.raw_products(spark, d).filter(F.col("category_id").isNotNull())
    return raw.select("id", brand_of(F.col("manufacturer")).alias("brand")).filter(F.col("brand").isNotNull())


@query("p8_with_price", "select id, round(min_price, 6) as price from products where min_price > 0")
def p8(spark, d):
    return t.products(spark, d).select("id", positive(F.col("min_price")).alias("price")).filter(F.col("price").isNotNull())


@query("p9_with_sentiment", "select case when rating >= 4 then 'positive' when rating <= 2 then 'negative' end as sentiment, count(*) as n from reviews group by 1")
def p9(spark, d):
    return t.reviews(spark, d).select(sentiment(F.col("rating")).alias("sentiment")).groupBy("sentiment").agg(F.count("*").alias("n"))


@query("p10_price_reference", "select category_id, round(coalesce(price_p50, price_p25, price_p75), 6) as price_ref from prices")
def p10(spark, d):
    return price_quantiles(t.products(spark, d)).select("category_id", price_reference(F.col("price_p25"), F.col("price_p50"), F.col("price_p75")).alias("price_ref"))


@query("p11_category_path", "select category_id, category_path from core")
def p11(spark, d):
    return sel.category_path(t.products(spark, d))


@query("v1_validate_chat_records", "select conv_id, count(*) >= 2 and arg_max(role, turn) = 'assistant' as is_valid from conversations group by conv_id")
def v1(spark, d):
    return validate_chat_records(conversation_records(spark, d)).select("conv_id", "is_valid")


@query(
    "v2_split_prompt_answer",
    "select conv_id, count(*) - 1 as n_prompt, arg_max(text, turn) as answer from conversations group by conv_id",
)
def v2(spark, d):
    return split_prompt_answer(conversation_records(spark, d)).select("conv_id", F.size("prompt").alias("n_prompt"), "answer")
