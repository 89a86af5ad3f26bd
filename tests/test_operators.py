"""Operators on small frames against brute force and published numbers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.functions.catalog import canonical_products, canonical_reviews
from marketlens.operators import brands, draws, examples, growth, products as prod, ranking, reviews as rev, selection as sel
from marketlens.operators import keywords
from marketlens.operators.keywords import keyword_counts
from marketlens.operators.quantiles import exact_quantiles, quantiles_of_counts, value_counts
from marketlens.operators.segments import top_segments


def test_quantiles_match_linear_interpolation(spark):
    rnd = random.Random(3)
    groups = {
        "even": [1.0, 2.0, 3.0, 4.0],
        "one": [7.0],
        "same": [5.0] * 9,
        "mixed": [-3.5, 0.0, 0.0, 1e-9, 2.5e8, -1e12, 4.0, 3.9999999999],
        "wide": [rnd.uniform(-1, 1) * 10 ** rnd.randint(-6, 9) for _ in range(2000)],
        "close": [1000 + i / 4096 for i in range(3000)],
        "money": [float(rnd.randint(1, 400) * 10) for _ in range(3000)],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("even", None)], "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.75, "z": 1.0}).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        want = np.quantile(np.array(vs), [0.25, 0.5, 0.75, 1.0])
        assert [got[k].a, got[k].b, got[k].c, got[k].z] == pytest.approx(list(want), rel=1e-12)


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def catalog_of(spark, rows):
    plain = [(i, c, "All", "b", None) for i, c in rows]
    return canonical_products(spark.createDataFrame(plain, "id bigint, category_id bigint, category string, manufacturer string, min_price double"))


def test_draws_are_the_smallest_hashes(spark):
    products = catalog_of(spark, [(i, 1) for i in range(500)] + [(1000 + i, 2) for i in range(7)] + [(2000 + i, 3) for i in range(40)])
    got = {(r.category_id, r.sample_idx, r.id) for r in draws.subsample_products(products, 3, 0.1, 20).collect()}
    ends = draws.draw_ends(products, 3, 0.1, 20)
    gone = {(r.category_id, r.sample_idx, r.id) for r in draws.left_out(products, ends).collect()}
    for c, first, n, take in [(1, 0, 500, 50), (2, 1000, 7, 7), (3, 2000, 40, 20)]:
        for s in range(3):
            order = sorted(range(first, first + n), key=lambda i: md5(f"{i}:{42 + s}"))
            assert {i for cc, ss, i in got if (cc, ss) == (c, s)} == set(order[:take])
            assert {i for cc, ss, i in gone if (cc, ss) == (c, s)} == set(order[take:])


def test_rows_of_one_id_are_drawn_together(spark):
    products = catalog_of(spark, [(i // 3, 1) for i in range(90)])
    for s, ids in Counter((r.sample_idx, r.id) for r in draws.subsample_products(products, 2, 0.5, 10).collect()).items():
        assert ids == 3
    assert Counter(r.sample_idx for r in draws.subsample_products(products, 2, 0.5, 10).collect()) == {0: 45, 1: 45}


def test_sums_and_tops_of_samples_by_what_they_leave_out(spark):
    rnd = random.Random(4)
    rows = [(1 if i % 3 else 2, str(i), "word", rnd.choice("abcdefghijklmnopqrst") * rnd.choice([1, 1, 2]), rnd.randint(1, 5)) for i in range(400)]
    per_product = spark.createDataFrame(rows, "category_id bigint, draw_key string, kind string, name string, n bigint")
    members = {(c, s): {k for cc, k, *_ in rows if cc == c and rnd.random() < 0.8} for c in (1, 2) for s in range(3)}
    members[1, 2] = set()
    gone = [(c, s, k) for (c, s), kept in members.items() for cc, k, *_ in rows if cc == c and k not in kept]
    excluded = spark.createDataFrame(gone, "category_id bigint, sample_idx int, draw_key string")
    samples = spark.createDataFrame(list(members), "category_id bigint, sample_idx int")
    totals = per_product.groupBy("category_id", "kind", "name").agg(F.sum("n").alias("n"))
    names = ["category_id", "kind", "name"]
    for k in (1, 3, 100):
        found = draws.top_candidates(totals, lambda some: per_product.join(some, names), excluded, samples, k).collect()
        for (c, s), kept in members.items():
            want = Counter()
            for cc, key, _, name, n in rows:
                if cc == c and key in kept:
                    want[name] += n
            got = {r.name: r.n for r in found if (r.category_id, r.sample_idx) == (c, s)}
            order = lambda counts: sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
            assert order(got) == order(want)


@pytest.mark.parametrize("many", [5, 4000])
def test_ring_examples(spark, many):
    """The first reviews after the sample's place, also where a sample leaves out nearly all of a group."""
    rated = spark.createDataFrame([(i % 10, str(i), "positive") for i in range(many)], "product_id bigint, review_id string, sentiment string")
    lookup = spark.createDataFrame([(1, p, str(p)) for p in range(10)], "category_id bigint, product_id bigint, draw_key string")
    out = {0: {"3"}, 1: {str(p) for p in range(9)}, 2: {str(p) for p in range(10)}}
    excluded = spark.createDataFrame([(1, s, p) for s, ps in out.items() for p in ps], "category_id bigint, sample_idx int, draw_key string")
    left = {s: [i for i in range(many) if str(i % 10) not in ps] for s, ps in out.items()}
    available = spark.createDataFrame([(1, s, "positive", len(ids)) for s, ids in left.items()], "category_id bigint, sample_idx int, sentiment string, _n bigint")
    totals = spark.createDataFrame([(1, "positive", many)], "category_id bigint, sentiment string, _n bigint")
    found = draws.ring_examples(rated, lookup, excluded, available, totals, 3).collect()
    place = lambda x: int(md5(f"{x}:42")[:13], 16)
    for s, ids in left.items():
        start = place(f"sample {s}")
        want = sorted(ids, key=lambda i: ((place(i) - start) % 16**13, str(i)))[:3]
        assert [int(r.review_id) for r in sorted(found, key=lambda r: r.rn) if r.sample_idx == s] == want


def test_quantiles_of_parts_by_what_they_leave_out(spark):
    rnd = random.Random(5)
    rows = [(g, float(rnd.choice([rnd.randint(1, 30), rnd.randint(1, 10**6)])), rnd.random() * 10 - 5) for g in (1, 2) for _ in range(700)]
    gone = {(g, s): [r for r in rows if r[0] == g and rnd.random() < (0.1, 0.9, 1.0)[s]] for g in (1, 2) for s in range(3)}
    measures = {"x": F.col("x"), "y": F.col("y")}
    counts = value_counts(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], measures)
    less = value_counts(spark.createDataFrame([(g, s, *r[1:]) for (g, s), rs in gone.items() for r in rs], "g int, s int, x double, y double"), ["g", "s"], measures)
    parts = spark.createDataFrame(list(gone), "g int, s int")
    got = {(r.g, r.s, r.measure): r for r in quantiles_of_counts(counts, ["g"], {"a": 0.0, "b": 0.25, "c": 0.5, "d": 1.0}, parts, less).collect()}
    assert {k[:2] for k in got} == {(g, s) for g in (1, 2) for s in (0, 1)}
    for (g, s, m), r in got.items():
        left = list((Counter(x for x in rows if x[0] == g) - Counter(gone[g, s])).elements())
        want = np.quantile([x["xy".index(m) + 1] for x in left], [0, 0.25, 0.5, 1])
        assert [r.a, r.b, r.c, r.d] == pytest.approx(list(want), rel=1e-12)


def test_top_k_cuts_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id", (F.col("id") % 7).alias("n"))
    top = ranking.top_k(df, ["k"], ranking.by_score("n", "id"), 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted((r.k, r.rn, r.id) for r in top.collect()) == [(0, 1, 6), (0, 2, 20), (1, 1, 13), (1, 2, 27)]


PRODUCTS = [
    # id, category, path, maker, reviews, rating, price
    (1, 10, "A > X", "b1", 4, 4.0, 100.0),
    (2, 10, None, " b2 ", 0, 5.0, 0.0),
    (3, 10, "A > X", "", None, None, 300.0),
    (4, 20, "A > Y", "b1", 6, 3.0, 50.0),
    (5, 30, None, None, None, None, None),
    (1, 10, "A > X", "b1", 4, 4.0, 100.0),  # listed twice
]
REVIEWS = [
    ("r1", 1, 5.0, "p", "2021-01-01", "좋아요 soft soft"),
    ("r2", 1, 1.0, " ", "2022-05-05", "나빠요"),
    ("r3", 2, 0.4, "q", "bad", "hard"),
    ("r4", 3, None, None, "2022-07-07", "unbranded word"),
    ("r5", 99, 3.0, "p", "2022-01-01", "nobody"),
]


@pytest.fixture(scope="module")
def catalog(spark):
    products = spark.createDataFrame(PRODUCTS, "id bigint, category_id bigint, category string, manufacturer string, review_count bigint, average_rating double, min_price double")
    reviews = spark.createDataFrame(REVIEWS, "review_id string, product_id bigint, rating double, platform string, review_date string, review_text string")
    return canonical_products(products), canonical_reviews(reviews)


def test_product_measures(catalog):
    products, _ = catalog
    got = {r.category_id: r for r in products.groupBy("category_id").agg(*prod.summary_measures()).collect()}
    assert (got[10].product_count, got[10].total_reviews_product, got[10].weighted_rating) == (4, 8, 4.0)
    assert got[10].zero_review_ratio == 0.5 and got[10].price_min == 100.0
    assert got[30].weighted_rating is None and got[30].price_min is None and got[30].zero_review_ratio == 1.0


def test_review_measures_ignore_strangers_and_repeated_ids(catalog):
    products, reviews = catalog
    grouped = rev.group_facts(rev.review_facts(reviews), products)
    rows = {r.category_id: r for r in rev.review_measures(grouped).collect()}
    assert set(rows) == {10}
    assert rows[10].total_reviews_rows == 4 and rows[10].mean_rating == pytest.approx(6.4 / 3)
    assert (rows[10].row_stars_1, rows[10].row_stars_5) == (2, 1)  # 0.4 truncates to 0 and is clamped to 1
    assert {(r.platform, r.review_count) for r in rev.platform_dist_rows(grouped).collect()} == {("p", 1), ("q", 1)}
    assert {(r.brand, r.score) for r in rev.brand_scores_rows(grouped).collect()} == {("b1", 2), ("b2", 1)}
    assert {(r.year, r.review_count) for r in rev.yearly_review_counts(grouped).collect()} == {(2021, 1), (2022, 2)}
    assert sel.reviews_of(reviews, products).count() == 4
    assert sel.reviews_with_brand(reviews, products).count() == 4


def test_keywords_leave_out_brandless_reviews(catalog):
    products, reviews = catalog
    got = {(r.word, r.n) for r in keyword_counts(reviews, products).collect()}
    assert got == {("좋아요", 1), ("soft", 2), ("나빠요", 1), ("hard", 1)}


@pytest.mark.parametrize("sent", [keywords.SENT_PRODUCTS, 0])
def test_keywords_are_added_up_per_group(spark, monkeypatch, sent):
    """Neither way counts words per product first, of which there are nearly as many as words in all texts."""
    monkeypatch.setattr(keywords, "SENT_PRODUCTS", sent)
    rows = [(1, 10, "c", "b"), (1, 20, "c", "b"), (1, 10, "c", "b"), (2, 10, "c", ""), (3, 20, "c", "x"), (None, 20, "c", "x")]
    products = canonical_products(spark.createDataFrame(rows, "id bigint, category_id bigint, category string, manufacturer string"))
    texts = [(1, "Ab ab 가나cd"), (1, "ab"), (2, "ab"), (3, "cd cd"), (3, None), (4, "ab"), (None, "ab")]
    reviews = canonical_reviews(spark.createDataFrame(texts, "product_id bigint, review_text string"))
    counts = keyword_counts(reviews, products)
    got = {(r.category_id, r.word): r.n for r in counts.collect()}
    assert got == {(10, "ab"): 3, (10, "가나"): 1, (10, "cd"): 1, (20, "ab"): 3, (20, "가나"): 1, (20, "cd"): 3}
    plan = counts._jdf.queryExecution().executedPlan().toString().splitlines()
    grouped = [line.split("functions=")[0] for line in plan if "Aggregate(" in line and "word" in line]
    assert grouped and all("category_id" in line and "product_id" not in line for line in grouped)


def test_selection(catalog):
    products, _ = catalog
    assert sel.filter_category_contains(products, "X|Y").select("category_id").distinct().first()[0] == 10
    assert sel.filter_category_like(products, "A > ").select("picked_category_id").distinct().first()[0] == 10
    assert {(r.category_id, r.category_path) for r in sel.category_path(products).collect()} == {(10, "A > X"), (20, "A > Y"), (30, "")}
    assert {(r.category_id, r.product_count) for r in sel.category_sizes(products, 1).collect()} == {(10, 3), (20, 1)}
    assert [r.category_id for r in sel.largest_categories(products, 2, 1, need_path=False).collect()] == [10, 20]
    with pytest.raises(ValueError, match="exactly one"):
        sel.pick_category(products)
    with pytest.raises(ValueError, match="no product"):
        sel.pick_category(products, category_id=77)
    assert sel.pick_category(products, needle="Y").count() == 1


def test_subsample_sizes(spark):
    rows = [(i, 1, None, None) for i in range(45)] + [(100 + i, 2, None, None) for i in range(8)]
    products = canonical_products(spark.createDataFrame(rows, "id bigint, category_id bigint, category string, manufacturer string"))
    drawn = draws.subsample_products(products, 3, 0.9)
    got = {(r.category_id, r.sample_idx): r["count"] for r in drawn.groupBy("category_id", "sample_idx").count().collect()}
    assert got == {**{(1, i): 40 for i in range(3)}, **{(2, i): 8 for i in range(3)}}
    assert drawn.filter("category_id = 1").select("sample_idx", "id").distinct().count() == 120
    assert draws.subsample_products(products, 1, 0.5).count() == 53


def test_published_brand_shares(spark):
    top = [3187, 2994, 1682, 930, 916, 583, 469, 456, 441, 436]
    scores = [(4, f"b{i:02d}", n) for i, n in enumerate(top)] + [(4, f"z{i:02d}", 432) for i in range(12)] + [(5, "only", 0)]
    assert sum(n for _, _, n in scores) == 17278
    shares = brands.brand_top_share(spark.createDataFrame(scores, "category_id bigint, brand string, score bigint"))
    rows = sorted(shares.filter("category_id = 4").collect(), key=lambda r: r.rn)
    assert [r.score for r in rows] == top and rows[0].share == pytest.approx(0.18445421923833777)
    found = {r.category_id: r for r in brands.brand_concentration(shares).collect()}
    assert found[4].top3_brand_share == pytest.approx(0.455087, abs=1e-6) and found[4].hhi_top10 == pytest.approx(830.955, abs=1e-3)
    assert found[5].top3_brand_share is None and found[5].hhi_top10 == 0.0


def test_published_growth_series(spark):
    counts = {2019: 50, 2020: 5594, 2021: 6698, 2022: 9174, 2023: 7667, 2024: 20618, 2025: 16433}
    yearly = spark.createDataFrame([(4, y, n) for y, n in counts.items()] + [(5, 1999, 3)], "category_id bigint, year int, review_count bigint")
    price = spark.createDataFrame([(4, 27615.0), (5, None)], "category_id bigint, price_ref double")
    rows = growth.yearly_growth(yearly, price)
    got = sorted(rows.filter("category_id = 4").collect(), key=lambda r: r.year)
    assert [r.estimated_units for r in got] == [16782, 20094, 27522, 23001, 61854, 49299]
    assert got[0].estimated_revenue == 463434930.0 and got[0].growth_rate is None
    assert [r.growth_rate for r in got[1:]] == pytest.approx([19.735430818734358, 36.96625858465213, -16.426858513189448, 168.91874266336245, -20.297798040547093])
    found = {r.category_id: r for r in growth.growth_extremes(rows).collect()}
    assert found[4].max_growth_year == 2024 and found[4].min_growth < 0 and found[4].recent_rates == 3
    # only a year outside the range: a series of zeros without growth
    assert found[5].n_points == 6 and found[5].max_growth is None and found[5].max_growth_year is None
    assert growth.recent_momentum(rows).count() == 1
    assert growth.latest_year(rows).filter("category_id = 4").first().revenue_rounded == 1361391885
    assert growth.axis_range(rows).filter("category_id = 5").first().axis_max == 1.0


def test_growth_extremes_take_the_first_year_on_ties(spark):
    rows = spark.createDataFrame([(1, 2020, None), (1, 2021, 5.0), (1, 2022, 5.0)], "category_id bigint, year int, growth_rate double")
    assert growth.growth_extremes(rows).first().max_growth_year == 2021


def test_top_segments_cut_first_then_filter(spark):
    cells = [(i, 1, None, None, "{'연령': '%d세'}" % i, "9원/개" if i < 2 else None) for i in range(12)]
    products = canonical_products(spark.createDataFrame(cells, "id bigint, category_id bigint, category string, manufacturer string, specifications string, unit_price string"))
    assert [(r.segment, r.n) for r in top_segments(products).collect()] == [("단위: 개", 2)]


def test_examples(catalog):
    _, reviews = catalog
    pool = examples.rated_texts(reviews).withColumn("category_id", F.lit(1))
    first = examples.first_examples(pool, ["category_id"], 1).collect()
    assert {(r.sentiment, r.review_id) for r in first} == {("positive", "r1"), ("negative", "r2")}
    drawn = examples.sample_examples(pool, ["category_id"], 1).collect()
    want = min(["r2", "r3"], key=lambda r: md5(f"{r}:42"))
    assert {(r.sentiment, r.review_id) for r in drawn} == {("positive", "r1"), ("negative", want)}


@pytest.mark.parametrize("sent", [keywords.SENT_PRODUCTS, 0])
def test_facts_are_grouped_where_reviews_are_read(spark, monkeypatch, sent):
    """A sent lookup leaves no grouping by product; both ways give the rows of the facts per product."""
    monkeypatch.setattr(keywords, "SENT_PRODUCTS", sent)
    rows = [(1, 10, "c", "b"), (1, 20, "c", "b"), (1, 10, "c", "b"), (2, 10, "c", ""), (3, 20, "c", "x"), (None, 20, "c", "x")]
    products = canonical_products(spark.createDataFrame(rows, "id bigint, category_id bigint, category string, manufacturer string"))
    texts = [(1, 5.0, "p", "2022-01-02"), (1, None, None, "2022-03-04"), (2, 7.0, "p", None), (3, 0.5, "q", "2021-01-01"), (3, 2.5, "q", "2021-05-01"), (4, 1.0, "p", "2021-05-01"), (None, 1.0, "p", "2021-05-01")]
    reviews = canonical_reviews(spark.createDataFrame(texts, "product_id bigint, rating double, platform string, review_date string"))
    found = rev.facts_of_groups(reviews, products)
    got = sorted(map(str, found.collect()))
    assert got == sorted(map(str, rev.group_facts(rev.review_facts(reviews), products).select(*found.columns).collect())) and len(got) == 6
    assert {r.brand: r.rating_sum for r in found.filter("category_id = 20").groupBy("brand").agg(F.sum("rating_sum").alias("rating_sum")).collect()} == {"b": 5.0, "x": 3.0}
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    by_product = [line for line in plan if "Aggregate(" in line and "product_id" in line.split("functions=")[0]]
    assert bool(by_product) == (sent == 0)
