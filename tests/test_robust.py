"""Odd numbers, files with other headers and rows without ids."""

import gzip

import pytest
from pyspark.sql import functions as F

from marketlens.functions import cells, clean
from marketlens.functions.catalog import canonical_products, canonical_reviews
from marketlens.operators import products as prod
from marketlens.operators.draws import subsample_products
from marketlens.operators.reviews import review_facts
from marketlens.sources.catalog import csv_by_headers, read_catalog_csv


def test_numbers_that_fit_no_whole_number(spark):
    df = spark.createDataFrame([("1e30", "7"), ("12", "1e12")], "product_id string, rating string").withColumn("review_date", F.lit("2020-01-01"))
    rows = canonical_reviews(df)
    assert [(r.product_id, r.rating) for r in rows.collect()] == [(12, 1e12)]
    assert review_facts(rows).first().stars_5 == 1
    assert spark.range(1).select(cells.whole_number(F.lit("1e30"))).first()[0] == 0


def test_years_have_four_digits(spark):
    row = spark.range(1).select(clean.to_timestamp_lenient(F.lit("202401")), clean.to_timestamp_lenient(F.lit("2024-01-05"))).first()
    assert row[0] is None and row[1].year == 2024


def test_draws_take_rows_without_an_id(spark):
    rows = [(None if k < 35 else k, 1, "All", "b", float(k)) for k in range(40)]
    products = canonical_products(spark.createDataFrame(rows, "id bigint, category_id bigint, category string, manufacturer string, min_price double"))
    sizes = subsample_products(products, 2, 0.5, 10).groupBy("sample_idx").count().collect()
    assert sorted(map(tuple, sizes)) == [(0, 20), (1, 20)]


def test_star_and_channel_sums_beyond_64_bits(spark):
    rows = [(1, 1, "{'5': 9000000000000000000}", "{'a': 9000000000000000000}"), (2, 1, "{'5': 9000000000000000000}", "{'a': 9000000000000000000}"), (3, 2, "{'5': 3}", "{'a': 4}")]
    raw = spark.createDataFrame(rows, "id bigint, category_id bigint, review_rating_distribution string, review_platform_distribution string")
    products = canonical_products(raw.withColumns({"category": F.lit("c"), "manufacturer": F.lit("m")}))
    largest = 2**63 - 1
    assert {r.category_id: (r.product_stars_5, r.product_stars_1) for r in prod.rating_hist_product(products).collect()} == {1: (largest, 0), 2: (3, 0)}
    assert {r.category_id: r.review_count for r in prod.platform_dist_product(products).collect()} == {1: largest, 2: 4}


def test_csv_columns_go_by_name(spark, tmp_path):
    products, reviews = tmp_path / "p", tmp_path / "r"
    products.mkdir(), reviews.mkdir()
    (products / "a.csv").write_text("category_id,id,extra,review_count,manufacturer,category,average_rating\n5,7,x,3,m,All > a,4.5\n")
    (reviews / "a.csv").write_text("rating,product_id,first_seen_at,review_text\n4,7,2021-03-04,good\n")
    p, r = read_catalog_csv(spark, str(products), str(reviews))
    assert (p.first().id, p.first().category_id, p.first().min_price) == ("7", "5", None) and "extra" not in p.columns
    row = canonical_reviews(r).first()
    assert (row.product_id, row.rating, row.review_date.year, row.review_text) == (7, 4.0, 2021, "good")
    (reviews / "a.csv").write_text("rating,product_id\n4,7\n")
    with pytest.raises(ValueError):
        read_catalog_csv(spark, str(products), str(reviews))


def test_csv_files_of_one_folder_go_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("category_id,id,note\n5,7,x\n")
    (tmp_path / "b.csv").write_text("id,category_id\n8,5\n")
    (tmp_path / "c d.csv").write_text('id,category_id\n9,"5\n6"\n')
    (tmp_path / "empty.csv").write_text("")
    got = {(r.id, r.category_id, r.note) for r in csv_by_headers(spark, str(tmp_path)).collect()}
    assert got == {("7", "5", "x"), ("8", "5", None), ("9", "5\n6", None)}


def test_csv_files_of_one_header_take_one_job(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"{k:02d}.csv").write_text(f"id,note\n{k},a\n")
        (tmp_path / f"{k:02d}.csv.gz").write_bytes(gzip.compress(f"note,id\nb,{k}\n".encode()))
        (tmp_path / f"{k:02d}-crlf.csv").write_bytes(f"id,note\r\n{k},e\r\n".encode())
    # Equal first lines, headers that differ after a line break.
    (tmp_path / "p.csv").write_text('id,"no\nte"\n1,c\n')
    (tmp_path / "q.csv").write_text('id,"no\nme"\n2,d\n')
    jobs = lambda: set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    found = csv_by_headers(spark, str(tmp_path))
    assert len(jobs() - before) <= 5
    rows = {(r["id"], r["note"], r["no\nte"], r["no\nme"]) for r in found.collect()}
    assert rows == {(str(k), x, None, None) for k in range(12) for x in "abe"} | {("1", None, "c", None), ("2", None, None, "d")}
