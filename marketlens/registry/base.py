"""Registration of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.plans.report import Settings
from marketlens.registry import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The driver's ship dates run from 1995 to 2001.
SETTINGS = Settings(start_year=1996, end_year=2001, recent_year=1999)

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def plain(sql: str) -> str:
    return re.sub(r"@(\w+)", r"\1", sql)


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squash_sql(x: str) -> str:
    return strip_sql(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def json_sql(x: str) -> str:
    return f"cast(replace(replace(replace({x}, chr(39), '\"'), 'True', 'true'), 'False', 'false') as json)"


def text_sql(pattern: str, *args: str) -> str:
    """SQL text of a phrase with its ``%s`` places filled."""
    bits = pattern.replace("'", "''").split("%s")
    out = [f"'{bits[0]}'"]
    for bit, arg in zip(bits[1:], args):
        out += [arg, f"'{bit}'"]
    return "(" + " || ".join(out) + ")"


def pct_sql(x: str, digits: int = 1) -> str:
    return f"(printf('%.{digits}f', ({x}) * 100) || '%')"


def int_sql(x: str) -> str:
    return f"coalesce(format('{{:,}}', cast(round_even(cast({x} as double), 0) as bigint)), '0')"


# Shared steps of the oracle queries, in order of use.
STEPS: dict[str, str] = {
    "raw_products": plain(tables.RAW_PRODUCTS),
    "raw_reviews": plain(tables.REVIEWS_WITH_TEXT),
    "products": f"""select id, category_id, category, nullif({strip_sql("coalesce(manufacturer, '')")}, '') as brand, cast(review_count as double) as review_count,
 average_rating, min_price, price_trend, specifications, unit_price, review_tags, review_rating_distribution, review_platform_distribution, cast(updated_at as date) as updated_on
 from raw_products where category_id is not null""",
    "reviews": f"""select review_id, product_id, rating, nullif({strip_sql('platform')}, '') as platform, review_date, review_text from raw_reviews""",
    "lookup": "select category_id, id as product_id, max(brand) as brand from products group by all",
    "placed": "select * from reviews join lookup using (product_id)",
    "reviewed": "select distinct category_id from placed",
    "product_stars": f"""select category_id, id, k, cast(coalesce(try_cast({json_sql('review_rating_distribution')} ->> k as double), 0) as bigint) as n
 from products, (values ('1'), ('2'), ('3'), ('4'), ('5')) t(k) where review_rating_distribution is not null""",
    "hist_product": "select category_id, " + ", ".join(f"cast(coalesce(sum(n) filter (where k = '{k}'), 0) as bigint) as stars_{k}" for k in range(1, 6)) + " from products left join product_stars using (category_id, id) group by category_id",
    "hist_rows": "select category_id, " + ", ".join(f"count(*) filter (where rating is not null and greatest(1, least(5, cast(trunc(rating) as int))) = {k}) as stars_{k}" for k in range(1, 6)) + " from placed group by category_id",
    "platform_product": f"""select category_id, k as platform, cast(sum(coalesce(cast(try_cast(j ->> k as double) as bigint), 0)) as bigint) as review_count
 from (select category_id, j, unnest(json_keys(j)) as k from (select category_id, {json_sql('review_platform_distribution')} as j from products where review_platform_distribution is not null)) group by all""",
    "platform_rows": "select category_id, platform, count(*) as review_count from placed where platform is not null group by all",
    "platforms": "select * from platform_rows union all select * from platform_product where category_id not in (select category_id from reviewed)",
    "brand_product": "select category_id, brand, cast(sum(coalesce(review_count, 0)) as bigint) as score from products where brand is not null group by all",
    "brand_rows": "select category_id, brand, count(*) as score from placed where brand is not null group by all",
    "brand_scores": "select * from brand_rows union all select * from brand_product where category_id not in (select category_id from reviewed)",
    "brand_ranked": """select *, row_number() over (partition by category_id order by score desc, brand) as rn, sum(score) over (partition by category_id) as total from brand_scores""",
    "brand_top": "select category_id, brand, score, rn, total, case when total > 0 then score / cast(total as double) else 0.0 end as share from brand_ranked where rn <= 10",
    "concentration": "select category_id, sum(score) filter (where rn <= 3) / nullif(cast(max(total) as double), 0) as top3_brand_share, sum(pow(share * 100, 2)) as hhi_top10 from brand_top group by category_id",
    "tag_rows": f"""select category_id, {strip_sql('tag')} as word from (select category_id, unnest(cast({json_sql('review_tags')} as varchar[])) as tag from products where review_tags is not null) where {strip_sql('tag')} <> ''""",
    "tag_counts": "select category_id, word, count(*) as n from tag_rows group by all",
    "word_counts": "select category_id, lower(w) as word, count(*) as n from (select category_id, unnest(regexp_extract_all(review_text, '[가-힣]{2,}|[a-zA-Z]{2,}')) as w from placed where brand is not null) group by all",
    "words": "select * from word_counts union all select * from tag_counts where category_id not in (select category_id from reviewed)",
    "word_top": "select * from (select *, row_number() over (partition by category_id order by n desc, word) as rn from words) where rn <= 10",
    "prices": """select category_id, min(p) as price_min, max(p) as price_max, quantile_cont(p, 0.25) as price_p25, quantile_cont(p, 0.5) as price_p50, quantile_cont(p, 0.75) as price_p75
 from (select category_id, case when min_price > 0 then min_price end as p from products) where p is not null group by category_id""",
    "trend_items": f"""select category_id, id, cast(json_extract_string(x, '$.period') as varchar) as period, try_cast(json_extract_string(x, '$.price') as double) as price, pos
 from (select category_id, id, unnest(cast({json_sql('price_trend')} as json[])) as x, generate_subscripts(cast({json_sql('price_trend')} as json[]), 1) as pos from products where price_trend is not null)""",
    "trend_pairs": "select category_id, id, min_by(price, pos) filter (where period = '1개월' and price > 0) as p1, min_by(price, pos) filter (where period = '6개월' and price > 0) as p6 from trend_items group by category_id, id",
    "changes": "select category_id, median((p1 - p6) / p6) as price_change_6m_median from trend_pairs where p1 is not null and p6 is not null group by category_id",
    "spec_keys": f"select category_id, id, j, unnest(json_keys(j)) as key from (select category_id, id, {json_sql('specifications')} as j from products where specifications is not null)",
    "spec_values": "select category_id, id, key, json_extract(j, '$.\"' || key || '\"') as v from spec_keys",
    "spec_leaves": """select category_id, id, key, null as inner_key, v from spec_values where json_type(v) <> 'OBJECT'
 union all select category_id, id, key, inner_key, json_extract(v, '$."' || inner_key || '"') as v from (select *, unnest(json_keys(v)) as inner_key from spec_values where json_type(v) = 'OBJECT')""",
    "spec_texts": f"select *, case when json_type(v) = 'VARCHAR' then json_extract_string(v, '$') end as t, json_type(v) = 'BOOLEAN' and cast(v as varchar) = 'true' as flag from spec_leaves",
    "spec_segments": f"""select category_id, id, case
 when key in ('연령', '사용연령', '적용연령', '대상연령') and length({strip_sql('t')}) > 0 then '연령: ' || {strip_sql('t')}
 when key in ('용량', '규격', '크기', '사이즈') and regexp_matches(t, '\\p{{Nd}}+[mlkgL매개권조각세트팩]+') then '용량: ' || {strip_sql('t')}
 when key in ('구성', '포함내용', '구성품') and length({strip_sql('t')}) between 1 and 29 then '구성: ' || {strip_sql('t')}
 when inner_key in ('유기농', '무첨가', '무향', '프리미엄', '세트', '단품', '대용량', '소용량') and flag then '타입: ' || inner_key end as segment from spec_texts""",
    "unit_segments": "select category_id, id, '단위: ' || regexp_extract(unit_price, '원/([가-힣a-zA-Z]+)', 1) as segment from products where regexp_extract(unit_price, '원/([가-힣a-zA-Z]+)', 1) <> ''",
    "segment_bag": "select category_id, segment from spec_segments where segment is not null union all select category_id, segment from unit_segments",
    "segment_counts": "select category_id, segment, count(*) as n from segment_bag group by all",
    "segment_top": "select * from (select *, row_number() over (partition by category_id order by n desc, segment) as rn from segment_counts) where rn <= 10 and n >= 2",
    "core": """select category_id, count(*) as product_count, count(distinct brand) as brand_count, cast(sum(coalesce(review_count, 0)) as bigint) as total_reviews_product,
 sum(average_rating * review_count) filter (where average_rating is not null and review_count > 0) / sum(review_count) filter (where average_rating is not null and review_count > 0) as weighted_rating,
 avg(case when coalesce(review_count, 0) = 0 then 1.0 else 0.0 end) as zero_review_ratio, min(updated_on) as period_from, max(updated_on) as period_to,
 coalesce(arg_min(category, id) filter (where category is not null), '') as category_path from products group by category_id""",
    "review_sums": "select category_id, count(*) as total_reviews_rows, avg(rating) as mean_rating from placed group by category_id",
    "metrics": """select core.category_id, case when category_path = '' then '카테고리' else trim(string_split(category_path, '>')[-1]) end as category_name, category_path,
 total_reviews_rows is not null as has_reviews, product_count, brand_count, coalesce(total_reviews_rows, total_reviews_product) as total_review_count,
 case when total_reviews_rows is not null then mean_rating else weighted_rating end as avg_rating,
 """
    + ", ".join(f"case when total_reviews_rows is not null then hr.stars_{k} else hp.stars_{k} end as stars_{k}" for k in range(1, 6))
    + """, zero_review_ratio, period_from, period_to, top3_brand_share, hhi_top10, price_min, price_max, price_p25, price_p50, price_p75, price_change_6m_median,
 coalesce(price_p50, price_p25, price_p75) as price_ref,
 (case when total_reviews_rows is not null then hr.stars_1 + hr.stars_2 else hp.stars_1 + hp.stars_2 end) / nullif(cast(coalesce(total_reviews_rows, total_reviews_product) as double), 0) as low_rating_ratio
 from core left join review_sums using (category_id) left join hist_rows hr using (category_id) left join hist_product hp using (category_id)
 left join concentration using (category_id) left join prices using (category_id) left join changes using (category_id)""",
    "yearly": "select category_id, cast(year(review_date) as int) as year, count(*) as review_count from placed where review_date is not null group by all",
    "spine": """select c.category_id, y.year, coalesce(yearly.review_count, 0) as review_count from (select distinct category_id from yearly) c
 cross join (select cast(unnest(generate_series(1996, 2001)) as int) as year) y left join yearly on yearly.category_id = c.category_id and yearly.year = y.year""",
    "estimated": """select category_id, year, review_count, cast(round_even(review_count * 3.0e0, 0) as bigint) as estimated_units, price_ref,
 cast(round_even(review_count * 3.0e0, 0) as double) * (case when price_ref > 0 then price_ref else 1.0 end) as estimated_revenue from spine left join metrics using (category_id)""",
    "growth": """select *, case when before > 0 then (estimated_revenue - before) / before * 100 end as growth_rate
 from (select *, lag(estimated_revenue) over (partition by category_id order by year) as before from estimated)""",
    "extremes": """select category_id, count(*) as n_points, max(growth_rate) as max_growth, min(growth_rate) as min_growth,
 (select min(g2.year) from growth g2 where g2.category_id = g.category_id and g2.growth_rate = max(g.growth_rate)) as max_growth_year,
 count(*) filter (where year >= 1999) as recent_years, count(*) filter (where year >= 1999 and growth_rate is not null) as recent_rates,
 avg(growth_rate) filter (where year >= 1999) as recent_mean_growth from growth g group by category_id""",
    "turn_texts": plain(tables.TURN_TEXTS),
}


def with_steps(body: str) -> str:
    """The query text with the shared steps it needs in front."""
    needed, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name, sql in STEPS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(sql)
    if not needed:
        return body
    return "with " + ",\n".join(f"{n} as ({STEPS[n]})" for n in STEPS if n in needed) + "\n" + body


def tidy(df: DataFrame) -> DataFrame:
    """Column types both engines share: bigint, double rounded to six digits, text for dates."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def add(make):
        QUERIES[name] = lambda spark, sf_dir: tidy(make(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_steps(sql)
        return make

    return add
