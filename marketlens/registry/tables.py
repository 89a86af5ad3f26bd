"""The driver's tables seen as catalog tables.

The same portable SELECT text runs in Spark and in the SQL oracle, so both sides start from equal
rows. Whole tables and whole texts are used; see FIXTURES.md for the mapping in words.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.catalog import canonical_products, canonical_reviews
from marketlens.operators.turns import exchanges
from marketlens.session import configure, materialise

Q = "chr(39)"

#: Tables whose files hold as much together are joined in so many slices, where each is written by itself.
LARGE, SLICES = 256 << 20, 4


def pairs(*items: tuple[str, str]) -> str:
    """SQL text of a Python dict literal with quoted keys and bare values."""
    parts = []
    for i, (key, value) in enumerate(items):
        parts.append(f"{', ' if i else ''}{{q}}{key}{{q}}: |{value}")
    out = ["'{'"]
    for part in parts:
        text, value = part.split("|", 1)
        for j, bit in enumerate(text.split("{q}")):
            if j:
                out.append(Q)
            if bit:
                out.append(f"'{bit}'")
        out.append(value)
    return "concat(" + ", ".join(out + ["'}'"]) + ")"


CATEGORY_ID = """case when p_partkey % 101 = 0 then null else
 (case p_type when 'ECONOMY' then 100 when 'LARGE' then 200 when 'MEDIUM' then 300 when 'PROMO' then 400 when 'SMALL' then 500 else 600 end)
 + (case split_part(p_name, ' ', 2) when 'anvil' then 1 when 'bolt' then 2 when 'gear' then 3 when 'gizmo' then 4 when 'plate' then 5 when 'ring' then 6 when 'rod' then 7 else 8 end) end"""

MANUFACTURER = """case when p_partkey % 37 = 0 then '' when p_partkey % 41 = 0 then null
 when p_type = 'ECONOMY' and p_partkey % 5 <> 0 then 'Brand#1' when p_type = 'LARGE' and p_partkey % 3 <> 0 then ' Brand#1 '
 when p_type = 'MEDIUM' and p_partkey % 2 = 0 then 'Brand#1' when p_partkey % 5 = 0 then concat(' ', p_brand, ' ') else p_brand end"""

ZERO = "(p_type = 'PROMO' and p_partkey % 2 = 0) or (p_type not in ('PROMO', 'SMALL') and p_partkey % 4 = 0)"

SPECIFICATIONS = (
    "concat('{', "
    + f"{Q}, '연령', {Q}, ': {{', {Q}, '권장', {Q}, ': ', {Q}, p_size % 7, '세', {Q}, '}}, ', "
    + f"{Q}, '용량', {Q}, ': ', {Q}, p_size * 10, 'ml', {Q}, ', ', "
    + f"{Q}, '구성', {Q}, ': ', {Q}, p_name, {Q}, ', ', "
    + f"{Q}, '특징', {Q}, ': {{', {Q}, '세트', {Q}, ': ', case when p_size % 2 = 0 then 'True' else 'False' end, ', ', {Q}, '무향', {Q}, ': True}}}}')"
)
TREND = (
    f"concat('[{{', {Q}, 'period', {Q}, ': ', {Q}, '1개월', {Q}, ', ', {Q}, 'price', {Q}, ': ', 900 + p_partkey % 97, '}}, {{', "
    f"{Q}, 'period', {Q}, ': ', {Q}, '6개월', {Q}, ', ', {Q}, 'price', {Q}, ': ', p_partkey % 89, '}}]')"
)
STARS = pairs(*[(str(k), f"h{k}") for k in range(1, 6)])
CHANNELS = pairs(("alpha", "pa"), ("nova", "pn"), ("rho", "pr"))

COUNTS = """select {key} as item, count(*) as n,
 sum(case when cast(l_quantity as int) % 5 = 0 then 1 else 0 end) as h1, sum(case when cast(l_quantity as int) % 5 = 1 then 1 else 0 end) as h2,
 sum(case when cast(l_quantity as int) % 5 = 2 then 1 else 0 end) as h3, sum(case when cast(l_quantity as int) % 5 = 3 then 1 else 0 end) as h4,
 sum(case when cast(l_quantity as int) % 5 = 4 then 1 else 0 end) as h5,
 sum(case when l_returnflag = 'A' then 1 else 0 end) as pa, sum(case when l_returnflag = 'N' then 1 else 0 end) as pn, sum(case when l_returnflag = 'R' then 1 else 0 end) as pr
 from @lineitem group by {key}"""

PART_PRODUCTS = f"""select p_partkey as id, {CATEGORY_ID} as category_id,
 case when p_partkey % 97 = 0 then null else concat('All > ', p_type, ' > ', split_part(p_name, ' ', 2)) end as category,
 {MANUFACTURER} as manufacturer,
 case when {ZERO} then (case when p_partkey % 3 = 0 then null else 0 end) else n end as review_count,
 case when {ZERO} then null else cast(3 + p_partkey % 3 as double) end as average_rating,
 case when p_partkey % 29 = 0 then null when p_partkey % 31 = 0 then cast(0 as double) when p_type = 'LARGE' then p_retailprice * 200 when p_type = 'MEDIUM' then p_retailprice * 100 else p_retailprice end as min_price,
 {TREND} as price_trend,
 case when p_type = 'SMALL' then null else {SPECIFICATIONS} end as specifications,
 concat(p_size, '원/', case when p_size % 3 = 0 then '개' else 'ml' end) as unit_price,
 case when p_partkey % 10 = 0 then null else concat('[', {Q}, p_name, {Q}, ', ', {Q}, p_type, {Q}, ']') end as review_tags,
 case when {ZERO} then null else {STARS} end as review_rating_distribution,
 case when {ZERO} then null else {CHANNELS} end as review_platform_distribution,
 concat('2024-01-', lpad(cast(1 + p_partkey % 28 as varchar(10)), 2, '0')) as updated_at
 from @part left join ({COUNTS.format(key="l_partkey")}) r on item = p_partkey"""

# Suppliers are products without review rows, so their categories take every value from product columns.
SUPPLIER_PRODUCTS = f"""select -1 - s_suppkey as id, 701 + s_suppkey % 3 as category_id,
 concat('Services > ', case s_suppkey % 3 when 0 then 'repair' when 1 then 'rental' else 'care' end) as category,
 case when s_suppkey % 3 = 2 then '' else s_name end as manufacturer, n as review_count, 4.25 + (s_suppkey % 3) * 0.25 as average_rating, s_acctbal as min_price,
 cast(null as varchar(1)) as price_trend, cast(null as varchar(1)) as specifications, cast(null as varchar(1)) as unit_price,
 case when s_suppkey % 3 = 1 then concat('[', {Q}, ' quick ', {Q}, ', ', {Q}, 'fair', {Q}, ']') end as review_tags,
 case when s_suppkey % 3 = 0 then {STARS} else concat('{{', {Q}, '1', {Q}, ': 1, ', {Q}, '5', {Q}, ': ', n, '}}') end as review_rating_distribution,
 case when s_suppkey % 3 = 0 then {CHANNELS} when s_suppkey % 3 = 1 then concat('{{', {Q}, 'alpha', {Q}, ': ', n, '}}') end as review_platform_distribution,
 concat('2023-12-', lpad(cast(1 + s_suppkey % 28 as varchar(10)), 2, '0')) as updated_at
 from @supplier left join ({COUNTS.format(key="l_suppkey")}) r on item = s_suppkey"""

RAW_PRODUCTS = f"{PART_PRODUCTS} union all {SUPPLIER_PRODUCTS}"

RAW_REVIEWS = """select concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) as review_id, l_partkey as product_id,
 case when l_orderkey % 50 = 0 then null else cast(1 + cast(l_quantity as int) % 5 as double) end as rating,
 case when l_orderkey % 33 = 0 then ' ' when l_returnflag = 'A' then 'alpha' when l_returnflag = 'N' then concat(' ', 'nova') else 'rho' end as platform,
 l_shipdate as review_date, $text as review_text
 from @lineitem"""
REVIEWS_WITH_TEXT = RAW_REVIEWS.replace("$text", "text") + " left join @documents on doc_id = l_orderkey"
REVIEWS_WITHOUT_TEXT = RAW_REVIEWS.replace("$text", "cast(null as varchar(1))")

# Generated summaries, one per user message with the assistant message right after it: the first is the overview, the second
# the growth part. An assistant message after no user message has no overview. Conversation and turn make one number.
TURNS = 1000000
TURN_TEXTS = f"""select conv_id * {TURNS} + turn as generation_id, conv_id, turn, case when role = 'user' then text end as question,
 case when role = 'assistant' then text when next_role = 'assistant' then next_text end as answer
 from (select *, lead(role) over (partition by conv_id order by turn) as next_role, lead(text) over (partition by conv_id order by turn) as next_text,
 lag(role) over (partition by conv_id order by turn) as role_before from @conversations)
 where role = 'user' or (role = 'assistant' and coalesce(role_before, '') <> 'user')"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_bytes(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """What the tables' files hold together; the files are listed, not read."""
    files = spark.read.format("binaryFile").load([f"{sf_dir}/{name}.parquet" for name in names])
    return files.agg(F.sum("length")).first()[0] or 0


def run(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return run_over(spark, sql, {n: table(spark, sf_dir, n) for n in names})


def run_over(spark: SparkSession, sql: str, frames: dict[str, DataFrame]) -> DataFrame:
    text = re.sub(r"varchar\(\d+\)", "string", sql).replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(r"@(\w+)", r"{\1}", text), **frames)


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, RAW_PRODUCTS, "part", "supplier", "lineitem")


def raw_reviews(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    if texts:
        return run(spark, sf_dir, REVIEWS_WITH_TEXT, "lineitem", "documents")
    return run(spark, sf_dir, REVIEWS_WITHOUT_TEXT, "lineitem")


def raw_review_slices(spark: SparkSession, sf_dir: str, large: int = LARGE) -> list[DataFrame]:
    """Raw reviews with texts, from large files in slices by a hash of the order: written one after the other, only one
    slice's lines and texts are in shuffle files at a time. Lines without an order are in one of them."""
    keys = {"lineitem": "l_orderkey", "documents": "doc_id"}
    n = SLICES if file_bytes(spark, sf_dir, *keys) >= large else 1

    def sliced(name: str, k: int) -> DataFrame:
        rows = table(spark, sf_dir, name)
        return rows if n == 1 else rows.filter(F.pmod(F.xxhash64(F.col(keys[name]).cast("bigint")), F.lit(n)) == k)

    return [run_over(spark, REVIEWS_WITH_TEXT, {name: sliced(name, k) for name in keys}) for k in range(n)]


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_products(raw_products(spark, sf_dir))


def stored_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical products written out once: a catalog is a stored table, not a query repeated per branch."""
    return materialise(products(spark, sf_dir))


def reviews(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    return canonical_reviews(raw_reviews(spark, sf_dir, texts))


def turn_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = exchanges(table(spark, sf_dir, "conversations"))
    return pairs.select((F.col("conv_id") * TURNS + F.col("turn")).alias("generation_id"), "*")
