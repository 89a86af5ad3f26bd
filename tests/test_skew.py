"""One product, category and word with a third of all rows: same numbers as plain counting."""

import os
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.functions.catalog import canonical_products, canonical_reviews
from marketlens.operators import examples, keywords, products as prod, reviews as rev
from marketlens.operators.keywords import keyword_counts
from marketlens.operators.ranking import by_score, top_k
from marketlens.operators.selection import reviews_with_brand
from marketlens.session import materialise, shared_dir

N = 30000


def product_of(i):
    return 1 if i % 3 == 0 else i % 400


def test_hot_product(spark):
    products = canonical_products(
        spark.range(400).select("id", F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 5 + 2).alias("category_id"), F.lit("c").alias("category"), F.concat(F.lit("b"), F.col("id") % 50).alias("manufacturer"))
    )
    raw = spark.range(N).select(
        F.col("id").cast("string").alias("review_id"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 400).alias("product_id"),
        (F.col("id") % 5 + 1).cast("double").alias("rating"),
        F.lit("p").alias("platform"),
        F.lit("2022-01-01").alias("review_date"),
        F.concat(F.lit("common "), F.when(F.col("id") % 2 == 0, "even").otherwise("odd")).alias("review_text"),
    )
    reviews = canonical_reviews(raw)
    grouped = rev.group_facts(rev.review_facts(reviews), products)
    category = {i: 1 if i < 200 else i % 5 + 2 for i in range(400)}
    want = Counter((category[product_of(i)], f"b{product_of(i) % 50}") for i in range(N))
    assert {(r.category_id, r.brand): r.score for r in rev.brand_scores_rows(grouped).collect()} == want
    assert want[(1, "b1")] > N / 3

    words = Counter((category[product_of(i)], w) for i in range(N) for w in ("common", "even" if i % 2 == 0 else "odd"))
    counts = keyword_counts(reviews, products)
    assert {(r.category_id, r.word): r.n for r in counts.collect()} == words
    first = {r.category_id: r.word for r in top_k(counts, ["category_id"], by_score("n", "word"), 1).collect()}
    assert set(first.values()) == {"common"}


def test_hot_category_quantiles(spark):
    rows = canonical_products(
        spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("category_id"), F.lit("c").alias("category"), F.lit("b").alias("manufacturer"), (F.col("id") + 1).cast("double").alias("min_price"))
    )
    got = prod.price_quantiles(rows).filter("category_id = 1").first()
    prices = sorted([float(i + 1) for i in range(9000) if i % 3 == 0] + [2.0])
    place = (len(prices) - 1) * 0.5
    low, high = prices[int(place)], prices[min(int(place) + 1, len(prices) - 1)]
    assert got.price_p50 == low + (high - low) * (place - int(place))


def test_stages_go_to_the_named_folder(spark):
    folder = shared_dir(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    assert materialise(spark.range(5), "probe").count() == 5
    assert any(n.startswith("probe-") for n in set(os.listdir(folder)) - before)


def test_texts_are_neither_shuffled_nor_sorted(spark, tmp_path):
    """One product with a third of all reviews: words are counted where texts are read, examples ranked without them."""
    raw = spark.range(3000).select(
        F.col("id").cast("string").alias("review_id"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("product_id"),
        F.lit(5.0).alias("rating"),
        F.lit("2022-01-01").alias("review_date"),
        F.concat(F.lit("word "), F.col("id").cast("string")).alias("review_text"),
    )
    raw.write.parquet(str(tmp_path / "reviews"))
    reviews = canonical_reviews(spark.read.parquet(str(tmp_path / "reviews")))
    products = canonical_products(spark.range(50).select("id", (F.col("id") % 3).alias("category_id"), F.lit("c").alias("category"), F.lit("b").alias("manufacturer")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pool = reviews_with_brand(examples.rated_texts(reviews), products)
        for df in (keyword_counts(reviews, products), examples.first_examples(pool, ["category_id"], 3), examples.sample_examples(pool, ["category_id"], 3)):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            joins = plan.split("Join")
            assert len(joins) > 1
            moved = [c for c in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in c or "Sort" in c or "Window" in c]
            assert moved and not any("review_text" in line for line in moved)
            assert "review_text" not in "".join(line for line in plan.splitlines() if line.lstrip(" +-:").startswith(("Join", "Window", "Aggregate [product_id")))
        found = examples.fetch_texts(examples.first_examples(pool, ["category_id"], 3), reviews)
        assert found.count() == 9 and found.filter(F.col("review_text") == F.concat(F.lit("word "), F.col("review_id"))).count() == 9
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


ODD = ["", " ", "a", "ab", "Ab cD", "가", "가나 ab가나cd", "x가y나z", "ñandú ésta", "K İİ ſs", "漢字ab漢字", "각곀힣힤ꯍ가가", "no_it-is 3rd\tone\n", "😀ok😀", "AB" * 40]


@pytest.mark.parametrize("piece", [1, 20, 1 << 24])
def test_words_added_up_in_pieces(monkeypatch, piece):
    """Sums of a task, however texts fall into batches and pieces, are those of the words searched one by one."""
    monkeypatch.setattr(keywords, "PIECE", piece)
    texts = ODD * 3
    groups = [None if i % 7 == 0 else i % 3 for i in range(len(texts))]
    rows = pa.record_batch({"category_id": pa.array(groups, pa.int64()), "text": pa.array([x.encode() for x in texts], pa.binary())})
    want = Counter((g, w.lower()) for g, x in zip(groups, texts) for w in re.findall("[가-힣]{2,}|[a-zA-Z]{2,}", x))
    for size in (1, 4, len(texts)):
        got = Counter()
        for batch in keywords.added_up(rows.slice(k, size) for k in range(0, len(texts), size)):
            for g, w, n in zip(*(c.to_pylist() for c in batch.columns)):
                got[g, w] += n
        assert got == want


def test_words_reach_spark_as_sums(spark):
    """A task passes on each word of a group once a piece, not once a place."""
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(ODD * 20)] + [(1, None)], "product_id bigint, review_text string").coalesce(1)
    lookup = spark.range(len(ODD) * 20).select(F.col("id").alias("product_id"), (F.col("id") % 2).alias("category_id"))
    found = keywords.words_of_groups(texts, lookup)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    want = Counter((i % 2, w.lower()) for i, x in enumerate(ODD * 20) for w in re.findall("[가-힣]{2,}|[a-zA-Z]{2,}", x))
    assert {(r.category_id, r.word): r.n for r in found.collect()} == want


@pytest.mark.parametrize("held, held_bytes, once", [(1 << 23, 1 << 26, True), (40, 1 << 26, False), (1, 1, False), (1 << 23, 60, False)])
def test_words_added_up_over_pieces(monkeypatch, held, held_bytes, once):
    """A task passes on a word of a group once for all its pieces, and earlier where it would hold too much; sums stay the same."""
    monkeypatch.setattr(keywords, "PIECE", 20)
    monkeypatch.setattr(keywords, "HELD", held)
    monkeypatch.setattr(keywords, "HELD_BYTES", held_bytes)
    monkeypatch.setattr(keywords, "BATCH", 7)
    # Groups that come late are numbered anew after each passing on.
    rows = [((i // 15, None if i % 4 == 0 else str(i % 4)), x) for i, x in enumerate([x for x in ODD if not re.search("[가-힣]", x)] * 3 + ODD * 3)]
    batch = pa.record_batch({"a": pa.array([g[0] for g, _ in rows], pa.int32()), "b": pa.array([g[1] for g, _ in rows]), "text": pa.array([x.encode() for _, x in rows], pa.binary())})
    got, seen = Counter(), Counter()
    for found in keywords.added_up(iter([batch])):
        assert found.num_rows <= 7 and found.schema.field("a").type == pa.int32()
        for a, b, w, n in zip(*(c.to_pylist() for c in found.columns)):
            got[(a, b), w] += n
            seen[(a, b), w] += 1
    assert got == Counter((g, w.lower()) for g, x in rows for w in re.findall("[가-힣]{2,}|[a-zA-Z]{2,}", x))
    # ASCII runs come once; a word that also stands in a longer run may come again.
    plain = {w for x in ODD for w in re.split("[^a-z]+", x.lower()) if x.isascii()}
    assert not once or max(n for (_, w), n in seen.items() if w in plain and not any(w in x.lower() for x in ODD if not x.isascii())) == 1
