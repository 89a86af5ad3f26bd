"""Metrics rows, texts, reports and training records end to end on a small catalog."""

import json
import time
from collections import Counter
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marketlens.functions.catalog import canonical_products, canonical_reviews
from marketlens.plans import narrative, records, report
from marketlens.plans.export import export_largest
from marketlens.plans.phrases import BULLETS, ENTRY, GROWTH, OVERVIEW
from marketlens.registry import QUERIES, tables
from marketlens.registry.cleaning import conversation_records  # noqa: F401
from marketlens.session import shared_dir
from marketlens.sources.catalog import bounds_query, key_predicates, read_catalog_csv, write_catalog_csv
from marketlens.sources.documents import read_sft_jsonl, write_report_json, write_sft_jsonl

PRODUCT_TYPES = "id bigint, category_id bigint, category string, manufacturer string, review_count bigint, average_rating double, min_price double, price_trend string, specifications string, unit_price string, review_tags string, review_rating_distribution string, review_platform_distribution string, updated_at string"
TREND = "[{'period': '1개월', 'price': 90}, {'period': '6개월', 'price': 100}]"
SPEC = "{'연령': {'권장': '신생아~12개월'}, '특징': {'무향': True}}"


def product(i, number, **over):
    row = dict(
        id=i, category_id=number, category=f"All > 유모차 {number}", manufacturer=f"b{i % 3}", review_count=5, average_rating=4.0, min_price=1000.0 * i, price_trend=TREND,
        specifications=SPEC, unit_price="10원/개", review_tags="['안전', '가벼움']", review_rating_distribution="{'1': 1, '5': 4}", review_platform_distribution="{'alpha': 3, 'nova': 2}", updated_at=f"2024-01-{i % 28 + 1:02d}",
    )
    row.update(over)
    return tuple(row[n.split()[0]] for n in PRODUCT_TYPES.split(", "))


@pytest.fixture(scope="module")
def catalog(spark):
    # 1: review rows; 2: product columns only; 3: nothing but names
    rows = [product(i, 1) for i in range(1, 15)] + [product(20 + i, 2) for i in range(12)]
    empty = dict.fromkeys(["manufacturer", "review_count", "average_rating", "min_price", "price_trend", "specifications", "unit_price", "review_tags", "review_rating_distribution", "review_platform_distribution", "updated_at", "category"])
    rows += [product(40 + i, 3, **empty) for i in range(3)]
    reviews = [(f"r{p}-{k}", p, float(1 + (p + k) % 5), "alpha" if k else "nova", f"{2020 + (p + k) % 6}-03-01", f"좋아요 strong wheel {p}") for p in range(1, 15) for k in range(p % 4 + 1)]
    reviews += [("x", 1, None, None, None, None)]
    raw = spark.createDataFrame(rows, PRODUCT_TYPES), spark.createDataFrame(reviews, "review_id string, product_id bigint, rating double, platform string, review_date string, review_text string")
    return canonical_products(raw[0]), canonical_reviews(raw[1]), raw, reviews


@pytest.fixture(scope="module")
def rows(catalog):
    return report.category_rows(catalog[0], catalog[1]).persist()


def test_metrics_rows_by_mode(rows, catalog):
    got = {r.category_id: r for r in rows.collect()}
    reviews = catalog[3]
    assert set(got) == {1, 2, 3}
    one, two, three = got[1], got[2], got[3]
    assert one.has_reviews and one.total_review_count == len(reviews) and one.category_name == "유모차 1"
    assert sum(b.reviewCount for b in one.top_brands) == len(reviews) and one.top_tags[0].tag in ("strong", "wheel", "좋아요")
    rated = [r[2] for r in reviews if r[2]]
    assert one.avg_rating == pytest.approx(sum(rated) / len(rated)) and sum(one.rating_hist.asDict().values()) == len(rated)
    assert one.platform_total == len(reviews) - 1
    assert not two.has_reviews and two.total_review_count == 60 and two.rating_hist["5"] == 48 and two.avg_rating == 4.0
    assert [t.tag for t in two.top_tags] == ["가벼움", "안전"] and two.platform_total == 60
    assert two.price_change_6m_median == pytest.approx(-0.1) and [s.segment for s in two.top_segments] == ["단위: 개", "연령: 신생아~12개월", "타입: 무향"]
    assert three.brand_count == 0 and three.top_brands == [] and three.top3_brand_share is None and three.price_ref is None and three.category_name == "카테고리"
    assert three.zero_review_ratio == 1.0 and three.low_rating_ratio is None and three.period_from is None


def test_texts_follow_the_findings(rows):
    texts = rows.select("category_id", "market_overview", "growth_summary", narrative.summary_bullets().alias("bullets"), narrative.entry_insight().alias("entry")).collect()
    got = {r.category_id: r for r in texts}
    assert got[2].growth_summary == GROWTH["no_data"] and got[1].growth_summary.startswith(GROWTH["premise"])
    assert GROWTH["caveat"] in got[1].growth_summary
    assert OVERVIEW["none"] in got[3].market_overview and OVERVIEW["without_segments"] in got[3].market_overview and OVERVIEW["share_unknown"] in got[3].market_overview
    assert "연령: 신생아~12개월" in got[1].market_overview
    assert len(got[1].bullets) == 8 and got[1].bullets[-1].startswith("리뷰에서")
    assert got[3].bullets == [BULLETS["size"].replace("%s", "{}").format("카테고리", "3", "0"), BULLETS["zero_reviews"].replace("%s", "100.0%")]
    assert ENTRY["no_segments_no_rating"].replace("%s", "0") in got[3].entry and ENTRY["no_share"] in got[3].entry
    assert "신생아~12개월 연령대" in got[2].entry and "최근 6개월 기준 제품별 가격 변화 중앙값은 -10.0%입니다." in got[2].bullets[3]


def test_published_overview_numbers(spark):
    row = spark.createDataFrame(
        [("아기띠/외출용품", 0.455087, 0.444, 830.955, 4.7, 0.03, 17446, ["연령: 신생아~12개월", "연령: 신생아~36개월", "연령: 신생아~48개월"], ["좋아요"])],
        "category_name string, top3_brand_share double, zero_review_ratio double, hhi_top10 double, avg_rating double, low_rating_ratio double, total_review_count bigint, s array<string>, t array<string>",
    ).select("*", F.transform("s", lambda x: F.struct(x.alias("segment"))).alias("top_segments"), F.transform("t", lambda x: F.struct(x.alias("tag"))).alias("top_tags"))
    text = row.select(narrative.market_overview().alias("x")).first().x
    for part in ["45.5% 수준으로", "비중이 44.4% 수준으로", "약 831 수준으로", "평점은 4.7점 수준으로", "17,446건 내외", "연령: 신생아~12개월, 연령: 신생아~36개월, 연령: 신생아~48개월 등"]:
        assert part in text
    assert "좋아요" not in text and text.count("동시에") == 2


def test_report_documents(rows, spark, tmp_path):
    reports = report.category_report(rows)
    path = str(tmp_path / "reports")
    write_report_json(reports, path)
    docs = {r.category_id: json.loads(r.value) for r in spark.read.text(path).collect()}
    assert set(docs) == {1, 2, 3}
    assert set(docs[1]) == {"categoryId", "categoryName", "charts", "summaries", "assumptions"}
    assert docs[1]["assumptions"] == {"proxy": "review_count", "unitsPerReview": 3.0, "priceRef": 7500.0}
    points = docs[1]["charts"]["growthLine"]["points"]
    assert [p["year"] for p in points] == list(range(2020, 2026)) and points[0]["growthRate"] is None
    assert docs[3]["charts"]["brandTop10Donut"]["items"] == [] and docs[3]["assumptions"]["priceRef"] is None
    generated = spark.createDataFrame([(1, "new", None)], "category_id bigint, market_overview string, growth_summary string")
    laid = {r.categoryId: r.summaries for r in report.overlay_summaries(reports, generated).collect()}
    assert (laid[1].marketOverviewSummary, laid[1].growthSummary, laid[2].marketOverviewSummary) == ("new", "", "")
    assert report.template_summary(rows).filter("categoryId = 2").first().growthSummary == GROWTH["no_data"]


def test_reports_of_largest(catalog):
    got = report.reports_of_largest(catalog[0], catalog[1], n=1, min_products=10)
    assert [r.categoryId for r in got.select("categoryId").collect()] == [1]


def test_donut_fraction_of_zero_sum(spark):
    top = spark.createDataFrame([(1, "a", 0), (2, "a", 3), (2, "b", 1)], "category_id bigint, brand string, score bigint")
    got = {(r.category_id, r.brand): r.fraction for r in report.donut_fraction(top).collect()}
    assert got == {(1, "a"): 0.0, (2, "a"): 0.75, (2, "b"): 0.25}


def test_training_records(catalog, spark, tmp_path):
    products, reviews = catalog[0], catalog[1]
    found = records.sample_rows(products, reviews, samples=2, ratio=0.8)
    chat = records.chat_records(found, system="S")
    path = str(tmp_path / "records")
    write_sft_jsonl(chat, path)
    back = read_sft_jsonl(spark, path)
    assert back.count() == 4  # two categories with ten products or more, two samples each
    checked = records.validate_chat_records(back)
    assert checked.filter("not is_valid").count() == 0
    for r in records.split_prompt_answer(back).collect():
        assert [m.role for m in r.prompt] == ["system", "user"] and r.prompt[0].content == "S"
        user, answer = json.loads(r.prompt[1].content), json.loads(r.answer)
        assert set(answer) == {"marketOverviewSummary", "growthSummary"} and user["reportType"] == "market_report_summary"
        assert user["metrics"]["productCount"] == (11 if user["categoryId"] == 1 else 10)
        assert len(user["metrics"]) == 11
        if user["categoryId"] == 1:
            insight = user["reviewInsights"]
            assert len(insight["positiveExamples"]) == 3 and len(insight["negativeExamples"]) == 2
            assert insight["topKeywords"][0][0] in ("strong", "wheel", "좋아요") and isinstance(insight["topKeywords"][0][1], int)
            assert user["growthData"][0]["growthRate"] is None
        else:
            assert "reviewInsights" not in user and user["growthData"] == []


@pytest.mark.parametrize("first", [records.FIRST_WORDS, 1])
def test_words_of_samples(spark, monkeypatch, first):
    """Words come first in a sample as by plain counting; per product only a few words of left-out products are counted."""
    monkeypatch.setattr(records, "FIRST_WORDS", first)
    brand = lambda i: None if i % 4 == 0 else "b"
    products = canonical_products(spark.createDataFrame([(i, i % 2, "c", brand(i)) for i in range(60)], "id bigint, category_id bigint, category string, manufacturer string"))
    word = lambda n: "w" + "abcdefghijkl"[n]
    texts = [(i, " ".join(word(n) for n in range(12) if (i * 7 + n * 5 + j) % (n + 2) == 0)) for i in range(61) for j in range(2)]
    reviews = canonical_reviews(spark.createDataFrame([*texts, (1, None)], "product_id bigint, review_text string"))
    samples = records.Samples(products, 3, 0.7, 10, 42)
    words = samples.word_counts(reviews)
    gone = {(r.category_id, r.sample_idx, r.id) for r in samples.excluded.collect()}
    assert gone
    some = {(r.category_id, int(r.draw_key)) for r in words.of_first.collect()}
    assert some and some <= {(c, i) for c, _, i in gone}
    assert words.of_first.select("category_id", "word").distinct().count() <= 2 * 2 * first
    for branded in (True, False):
        got = {}
        for r in samples.words(words, 4, branded).collect():
            got.setdefault((r.category_id, r.sample_idx), []).append((-r.n, r.word))
        for c, s in [(c, s) for c in range(2) for s in range(3)]:
            want = Counter(w for i, t in texts if i < 60 and i % 2 == c and (c, s, i) not in gone and not (branded and brand(i) is None) for w in t.split())
            assert sorted(got[c, s])[:4] == sorted((-n, w) for w, n in want.items())[:4]


def test_insights_for_inference(catalog):
    row = records.insights_of_categories(catalog[0], catalog[1]).withColumn("i", records.insight_columns()).collect()
    assert [r.category_id for r in row] == [1]
    assert row[0].i.reviewTextCount == len(catalog[3]) - 1 and row[0].i.hasReviewText and len(row[0].i.positiveExamples) == 3


def test_records_without_an_answer_are_flagged(spark):
    rows = spark.createDataFrame([([("user", "q")],), ([("user", "q"), ("assistant", "a")],), ([],), ([("assistant", "a"), ("user", "q")],)], "messages array<struct<role:string,content:string>>")
    assert [r.is_valid for r in records.validate_chat_records(rows).collect()] == [False, True, False, False]


def test_csv_round_trip_keeps_quotes_and_line_breaks(spark, tmp_path, catalog):
    products, reviews = catalog[2]
    odd = reviews.limit(1).withColumn("review_text", F.lit('a "quoted", line\nbreak'))
    write_catalog_csv(products, str(tmp_path / "p"))
    write_catalog_csv(odd, str(tmp_path / "r"))
    back_products, back_reviews = read_catalog_csv(spark, str(tmp_path / "p"), str(tmp_path / "r"))
    assert back_reviews.first().review_text == 'a "quoted", line\nbreak'
    left, right = [{tuple(r) for r in canonical_products(x).select("id", "brand", "spec_segments", "price_change", "stars").selectExpr("*").toPandas().astype(str).values.tolist()} for x in (products, back_products)]
    assert left == right


def line_tables(spark, folder):
    """Tables of a few lines: orders with one text, two, none; lines and texts without a key; one repeated line."""
    text = 'said "so",\nthen left ' * 400
    lines = [(None if k == 7 else k % 40, k % 20, k % 3, k % 4, float(k), "ANR"[k % 3], datetime(1996, 1, 1 + k % 28)) for k in [*range(200), 3]]
    documents = [(k, f"{k} {text}") for k in range(30)] + [(5, "again"), (None, "of no order")]
    tables = {
        "lineitem": (lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz"),
        "documents": (documents, "doc_id bigint, text string"),
        "part": ([(k, "red bolt", "Brand#2", "LARGE", k, 9.5) for k in range(20)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(k, f"s{k}", 1.5) for k in range(3)], "s_suppkey bigint, s_name string, s_acctbal double"),
    }
    for name, (rows, columns) in tables.items():
        spark.createDataFrame(rows, columns).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_csv_of_the_catalog_is_smaller_than_its_texts(spark, tmp_path):
    d = line_tables(spark, tmp_path)
    held = lambda: {p: p.stat().st_size for p in Path(shared_dir(spark)).glob("catalog-*/reviews/part-*")}
    before = held()
    rows = QUERIES["s1_s4_reviews_csv"](spark, d)
    written = sum(size for p, size in held().items() if p not in before)
    want = tables.raw_reviews(spark, d, texts=True).selectExpr("review_id", "cast(product_id as string) product_id", "rating", "nullif(trim(platform), '') platform", "review_text").collect()
    assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, want)) and len(want) == 206
    assert 0 < written < sum(len(r.review_text or "") for r in want) / 4


def test_slices_hold_every_review_once(spark, tmp_path):
    d = line_tables(spark, tmp_path)
    whole = tables.raw_reviews(spark, d, texts=True).collect()
    slices = [x.collect() for x in tables.raw_review_slices(spark, d, large=0)]
    assert Counter(r for x in slices for r in x) == Counter(whole) and sum(bool(x) for x in slices) > 1
    assert len(tables.raw_review_slices(spark, d)) == 1


def test_csv_writes_leave_no_shuffle_files(spark, tmp_path):
    blocks = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString("\n").split("\n")
    held = {b for b in blocks() if b.startswith("shuffle_")}
    rows = spark.range(1000).repartition(4, "id")
    write_catalog_csv(rows, str(tmp_path / "rows"))
    until = time.time() + 30  # other executors are told, not waited for
    while (left := {b for b in blocks() if b.startswith("shuffle_")} - held) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert rows.count() == spark.read.csv(str(tmp_path / "rows"), header=True).count() == 1000


@pytest.mark.parametrize("keys", [list(range(100)), [5] * 60 + list(range(40)), ["b", "a'b", "c", "a"] * 5, [7], []])
def test_jdbc_parts_hold_every_row_once(spark, keys):
    """Bounds as the database would measure them deal all rows, also those without a key."""
    kind = "string" if keys and isinstance(keys[0], str) else "bigint"
    table = spark.createDataFrame([(k,) for k in [*keys, None, None]], f"k {kind}")
    table.createOrReplaceTempView("measured")
    query = bounds_query("measured", "k", 8)
    bounds = [row.lower_bound for row in spark.sql(f"select * from {query}").collect()]
    parts = [table.filter(p).count() for p in key_predicates("k", bounds)]
    assert sum(parts) == len(keys) + 2 and len(parts) == max(1, len(set(bounds)))
    if keys == list(range(100)):
        assert max(parts) <= 15


def test_report_of_a_picked_category(catalog):
    products, reviews = catalog[0], catalog[1]
    assert [r.categoryId for r in report.report_of_category(products, reviews, category_id=2).collect()] == [2]
    with pytest.raises(ValueError, match="no product"):
        report.report_of_category(products, reviews, needle="nowhere")


def test_growth_text_names_the_years_of_the_series(spark):
    row = spark.range(1).selectExpr("3 as n_points", "0.5 as max_growth", "1999 as max_growth_year", "-0.1 as min_growth", "2 as recent_years", "1 as recent_rates")
    assert row.select(narrative.growth_summary(1996, 2001)).first()[0].count("1996년부터 2001년까지") == 1


def test_export_of_the_largest(spark, catalog, tmp_path):
    export_largest(*catalog[2], str(tmp_path), n=1)
    products, reviews = read_catalog_csv(spark, f"{tmp_path}/products", f"{tmp_path}/reviews")
    assert {r.category_id for r in products.select("category_id").distinct().collect()} == {"1"}
    assert {r.product_id for r in reviews.select("product_id").collect()} <= {r.id for r in products.select("id").collect()}
