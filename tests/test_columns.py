"""Column functions on single values: nulls, bad text, rounding, odd white space."""

import datetime

import pytest
from pyspark.sql import functions as F

from marketlens.functions import bands, cells, clean, numbers, text
from marketlens.functions.catalog import canonical_products, canonical_reviews


@pytest.mark.parametrize("x,y", [("12", 12.0), (" 12.5 ", 12.5), ("1e3", 1000.0), ("1d", None), ("x", None), ("", None), (None, None), ("NaN", None), (".5", 0.5), ("-3", -3.0)])
def test_to_number(value, x, y):
    assert value(clean.to_number, x) == y


@pytest.mark.parametrize(
    "x,y",
    [
        ("2024-01-05", (2024, 1, 5)),
        ("2024.01.05", (2024, 1, 5)),
        ("2024/01/05 10:11", (2024, 1, 5)),
        ("20240105", (2024, 1, 5)),
        (" 2024-01-05T10:00:00 ", (2024, 1, 5)),
        ("12:30", None),
        ("soon", None),
        (None, None),
    ],
)
def test_to_timestamp_lenient(value, x, y):
    got = value(clean.to_timestamp_lenient, x)
    assert (got and (got.year, got.month, got.day)) == y


def test_parse_iso_takes_only_iso(value):
    assert value(clean.parse_iso, "2024-01-05 10:00:00") == datetime.datetime(2024, 1, 5, 10)
    assert value(clean.parse_iso, "2024.01.05") is None


def test_strip_and_squash_cover_unicode_space(value):
    assert value(clean.strip, "　 a b \n") == "a b"
    assert value(clean.squash, " a \t  b\r\n") == "a b"


@pytest.mark.parametrize("x,y", [(4.0, "positive"), (4.5, "positive"), (3.0, None), (2.0, "negative"), (None, None)])
def test_sentiment(value, x, y):
    assert value(clean.sentiment, x, "double") == y


@pytest.mark.parametrize(
    "x,y",
    [
        ("{'1': 3, '5': '7', '2': 3.9, '3': 'x'}", [3, 3, 0, 0, 7]),
        ("{1: 2, 'b': None}", [2, 0, 0, 0, 0]),
        ('{"4": 1}', [0, 0, 0, 1, 0]),
        ("nan", None),
        ("[1, 2", None),
        ("", None),
        (None, None),
    ],
)
def test_star_counts(value, x, y):
    assert value(lambda c: cells.star_counts(cells.text_map(c)), x) == y


def test_channel_counts(value):
    assert value(lambda c: cells.channel_counts(cells.text_map(c)), "{'쿠팡': 2, 'b': 'x'}") == {"쿠팡": 2, "b": 0}


def test_tags_keep_repeats_and_drop_blanks(value):
    assert value(lambda c: cells.tags(cells.tag_list(c)), "['a ', 'a', ' ', \"it's\"]") == ["a", "a", "it's"]


@pytest.mark.parametrize(
    "x,y",
    [
        ("[{'period': '1개월', 'price': 90}, {'period': ' 6개월 ', 'price': '100'}]", -0.1),
        ("[{'period': '1개월', 'price': 0}, {'period': '1개월', 'price': 50}, {'period': '6개월', 'price': 100}]", -0.5),
        ("[{'period': '1개월', 'price': 90}]", None),
        ("[]", None),
        ("bad", None),
    ],
)
def test_price_change(value, x, y):
    got = value(lambda c: cells.price_change(cells.price_points(c)), x)
    assert got == (None if y is None else pytest.approx(y))


@pytest.mark.parametrize(
    "x,y",
    [
        ("{'연령': ' 3세 ', '용량': '100ml', '규격': 'big', '구성': '2개입'}", ["구성: 2개입", "연령: 3세", "용량: 100ml"]),
        ("{'연령': {'a': '1세', 'b': 2, 'c': ' '}, '특징': {'무향': True, '세트': False, '기타': True}}", ["연령: 1세", "타입: 무향"]),
        ("{'무향': True, '연령': True}", []),
        ("{'구성': '" + "x" * 30 + "'}", []),
        ("['연령']", []),
        ("None", []),
        (None, []),
    ],
)
def test_spec_labels(value, x, y):
    assert sorted(value(lambda c: cells.spec_labels(cells.spec_object(c)), x)) == y


@pytest.mark.parametrize("x,y", [("123원/개", ["단위: 개"]), ("10원/ml당", ["단위: ml당"]), ("10원", []), (None, [])])
def test_unit_labels(value, x, y):
    assert value(cells.unit_labels, x) == y


def test_tokens_mix_hangul_and_latin(value):
    assert value(text.tokens, "유모차abc 가 A bB 좋아요!") == ["유모차", "abc", "bb", "좋아요"]


def test_squash_truncate(value):
    assert value(lambda c: text.squash_truncate(c, 5), "ab  cdef") == "ab c…"
    assert value(lambda c: text.squash_truncate(c, 5), " ab c ") == "ab c"


@pytest.mark.parametrize("x,y", [("", 0), (None, 0), ("a", 3), ("a. b! c?", 2 + 2 + 1), ("。", 0 + 1 + 1), ("...", 0 + 1 + 1)])
def test_sentence_count(value, x, y):
    assert value(text.sentence_count, x) == y


def test_key_number_count_overlaps(value):
    assert value(text.key_number_count, "45.5%") == 3
    assert value(text.key_number_count, "4.7점, 10%") == 3
    assert value(text.key_number_count, None) == 0


def test_jaccard(value):
    assert value(lambda c: text.token_jaccard(c, F.lit("b c")), "a b b") == pytest.approx(1 / 3)
    assert value(lambda c: text.token_jaccard(c, F.lit("b")), " ") == 0.0


@pytest.mark.parametrize("x,y", [(0.25 / 100, "0.2%"), (0.455, "45.5%"), (12.3456, "1234.6%"), (-0.1, "-10.0%")])
def test_pct_rounds_half_even(value, x, y):
    assert value(numbers.pct, x, "double") == y


@pytest.mark.parametrize("x,y", [(2.5, "2"), (3.5, "4"), (1234567.0, "1,234,567"), (None, "0")])
def test_fmt_int(value, x, y):
    assert value(numbers.fmt_int, x, "double") == y


@pytest.mark.parametrize("x,y", [("A > B > C ", "C"), (" solo ", "solo"), ("", "카테고리"), (None, "카테고리"), ("A >", "")])
def test_category_display_name(value, x, y):
    assert value(numbers.category_display_name, x) == y


def test_estimates(value):
    assert value(lambda c: numbers.estimate_units(c, 0.5), 5, "bigint") == 2
    assert value(lambda c: numbers.estimate_units(c, 0.0), 5, "bigint") == 15
    assert value(lambda c: numbers.estimate_units(c), -4, "bigint") == 0
    assert value(lambda c: numbers.estimate_revenue(F.lit(7), c), None, "double") == 7.0
    assert value(lambda c: numbers.estimate_revenue(F.lit(7), c), 2.0, "double") == 14.0


@pytest.mark.parametrize(
    "make,x,y",
    [
        (bands.concentration_band, 0.65, "strong"),
        (bands.concentration_band, 0.45, "mixed"),
        (bands.concentration_band, None, "dispersed"),
        (bands.maturity_band, 0.35, "emerging"),
        (bands.maturity_band, 0.15, "mature"),
        (bands.maturity_band, None, "mature"),
        (bands.maturity_band, 0.2, "transitional"),
        (bands.hhi_band, None, "none"),
        (bands.hhi_band, 5000.0, "monopoly"),
        (bands.hhi_band, 2500.0, "concentrated"),
        (bands.rating_band, 0.1, "stable"),
        (bands.rating_band, 0.11, "uneven"),
        (bands.price_tier, 49999.0, "low"),
        (bands.price_tier, 50000.0, "middle"),
        (bands.price_tier, 150000.0, "premium"),
        (bands.price_tier, None, None),
        (bands.action_band, 0.3, "gather_reviews"),
    ],
)
def test_bands(value, make, x, y):
    assert value(make, x, "double") == y


def test_entry_band(value):
    assert value(lambda z: bands.entry_band(z, F.lit(500)), 0.31, "double") == "open"
    assert value(lambda z: bands.entry_band(z, F.lit(101)), 0.3, "double") == "hard"
    assert value(lambda z: bands.entry_band(z, F.lit(100)), None, "double") == "medium"


def test_canonical_tables_pick_columns_and_drop_unusable_rows(spark):
    raw = spark.createDataFrame([("12.0", "3", "A > B", " X "), ("7", "x", None, None), (None, "4", None, " ")], "id string, category_id string, category string, manufacturer string")
    rows = canonical_products(raw).select("id", "category_id", "brand", "min_price").collect()
    assert [tuple(r) for r in rows] == [(12, 3, "X", None), (None, 4, None, None)]
    reviews = spark.createDataFrame([(1, "2024-02-01", "t"), (None, "2024-02-01", "t")], "product_id bigint, created_at string, body string")
    got = canonical_reviews(reviews).collect()
    assert len(got) == 1 and got[0].review_text == "t" and got[0].review_date == datetime.datetime(2024, 2, 1) and got[0].rating is None
    bare = canonical_reviews(spark.createDataFrame([(1,)], "product_id bigint")).first()
    assert bare.review_date is None and bare.review_text is None


def test_missing_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="manufacturer"):
        canonical_products(spark.createDataFrame([(1, 2, "a")], "id bigint, category_id bigint, category string"))
