"""Repair of generated summaries on the cases that real output shows."""

import json

import pytest
from pyspark.sql import functions as F

from marketlens.functions import generated as g
from marketlens.operators import turns
from marketlens.plans import quality
from marketlens.plans.phrases import NO_GROWTH_TEXT

LONG = "본 시장은 상위 브랜드의 비중이 낮아 신규 진입 여지가 비교적 넓은 편이라고 볼 수 있습니다"


@pytest.mark.parametrize(
    "x,y",
    [
        ('a {"k": {"n": 1}} b } {"z": 2}', '{"k": {"n": 1}}'),
        ('{"k": "}"}', None),  # a brace inside a string closes the object too early
        ("no object", None),
        ('{"k": 1', None),
        ("{}", None),
        ('{"k": 1}<|im_end|>', '{"k": 1}'),
        (None, None),
    ],
)
def test_first_json_object(value, x, y):
    assert value(g.first_json_object, x) == y


def unwrap(spark, overview, growth):
    row = spark.createDataFrame([(overview, growth)], "o string, w string").select(g.unwrap_nested(F.col("o"), F.col("w")).alias("p")).first().p
    return row.overview, row.growth


def test_unwrap_nested_levels(spark):
    inner = json.dumps({"marketOverviewSummary": "deep", "growthSummary": "g"})
    twice = json.dumps({"marketOverviewSummary": inner})
    assert unwrap(spark, twice, "old") == ("deep", "g")
    assert unwrap(spark, inner + '"<|im_end|>', None) == ("deep", "g")
    assert unwrap(spark, "plain", "old") == ("plain", "old")
    assert unwrap(spark, "{broken", inner) == ("deep", "g")


def test_trim_foreign_tail(value):
    assert value(g.trim_foreign_tail, "가" * 60 + " 对应的 끝") == "가" * 60
    assert value(g.trim_foreign_tail, "앞 对应的 그리고 전체 시장") == "전체 시장"
    assert value(g.trim_foreign_tail, "앞 对应的 rest") == "rest"
    assert value(g.trim_foreign_tail, " a <|im_end|> b") == "a"


def test_recover_value(value):
    assert value(g.recover_value, '{"marketOverviewSummary" x": "' + LONG + '群 tail') == LONG
    assert value(g.recover_value, json.dumps({"growthSummary": "grown"})) == "grown"
    assert value(g.recover_value, "plain text") == "plain text"
    assert value(g.recover_value, "{not json") == "{not json"


def test_dedupe_sentences(value):
    text = "첫 문장은 이렇게 충분히 깁니다. 짧다. 첫 문장은 이렇게 충분히 깁니다. 값은 4.7점이며 이어집니다"
    assert value(g.dedupe_sentences, text) == "첫 문장은 이렇게 충분히 깁니다. 값은 4.7점이며 이어집니다."
    many = ". ".join(f"sentence number {chr(97 + i)} goes on" for i in range(20))
    assert value(g.dedupe_sentences, many).count("sentence") == 12
    assert value(g.dedupe_sentences, "") == ""


def test_coerce_markdown(value):
    got = value(g.coerce_markdown, "# T\n## Market Overview\n- **bold** `x`\n\ny\n## Growth\nup\nand on")
    assert (got.overview, got.growth) == ("bold x y", "and on") or got.growth.endswith("up and on")
    alone = value(g.coerce_markdown, "just text\n# heading")
    assert (alone.overview, alone.growth) == ("just text", NO_GROWTH_TEXT)


def test_split_500(value):
    got = value(g.split_500, "a" * 500 + "b")
    assert (len(got.overview), got.growth) == (500, "b")


def test_repair_and_scores(spark):
    raw = spark.createDataFrame(
        [
            (1, 'x {"marketOverviewSummary":"' + LONG + '. ' + LONG + '.","growthSummary":"대리 지표로 본 성장률은 12.5% 수준입니다."}'),
            (2, "no json at all"),
            (3, '{"marketOverviewSummary": 5}'),
        ],
        "category_id bigint, raw string",
    )
    fixed = {r.category_id: r for r in quality.repaired(raw).collect()}
    assert fixed[1].market_overview == LONG + "."
    assert fixed[2].growth_summary == NO_GROWTH_TEXT
    assert (fixed[3].market_overview, fixed[3].growth_summary) == ("", "")

    templates = spark.createDataFrame([(1, LONG, "성장률은"), (2, "other", "words"), (9, "unused", "x")], "category_id bigint, market_overview string, growth_summary string")
    scores = quality.quality_rows(quality.pair_template_generated(templates, quality.scored_texts(raw)))
    got = {r.category_id: r for r in scores.collect()}
    assert set(got) == {1, 2}
    assert got[1].json_valid and got[1].contains_proxy_disclaimer and got[1].contains_key_numbers == 3
    assert got[2].template_similarity is None and got[2].has_market_overview and not got[2].has_growth_summary
    total = quality.evaluation_summary(scores).first()
    assert total.total_categories == 2 and total.json_valid_rate == 1.0 and total.avg_template_similarity == pytest.approx(got[1].template_similarity)
    empty = quality.evaluation_summary(scores.filter("false")).first()
    assert empty.total_categories == 0 and empty.avg_template_similarity == 0.0


@pytest.mark.parametrize(
    "text, value",
    [
        ('{"a": "x", "a": "y"}', "y"),
        ('{"a": "x", "a": 3}', None),
        ('{"a": 3, "b": {"c": 1, "c": 2}, "a": "z"}', "z"),
        ('{"b": "x"}', None),
        ('{"a": "x", }', None),
        ("{'a': 'x'}", None),
        ('{"a": NaN}', None),
    ],
)
def test_repeated_keys_take_the_last_value(value_of_key, text, value):
    assert value_of_key(text) == value


@pytest.fixture
def value_of_key(spark):
    return lambda text: spark.createDataFrame([(text,)], "x string").select(g.json_text(g.first_json_object(F.col("x")), "a").alias("y")).first().y


def test_exchanges_pair_neighbours_across_spans(spark, monkeypatch):
    rows = [(1, k, role, f"{role}{k}") for k, role in enumerate(["system", "assistant", "user", "assistant", "user", "user", "assistant", "assistant", "user"])]
    rows += [(2, 5 * k, role, f"{role}{k}") for k, role in enumerate(["user", "assistant"] * 4)] + [(3, 1, "assistant", "only")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    for span in (1000, 2):
        monkeypatch.setattr(turns, "SPAN", span)
        got = {(r.conv_id, r.turn): (r.question, r.answer) for r in turns.exchanges(df).collect()}
        assert {k: v for k, v in got.items() if k[0] == 1} == {
            (1, 1): (None, "assistant1"),
            (1, 2): ("user2", "assistant3"),
            (1, 4): ("user4", None),
            (1, 5): ("user5", "assistant6"),
            (1, 7): (None, "assistant7"),
            (1, 8): ("user8", None),
        }
        assert [got[2, 10 * k] for k in range(4)] == [(f"user{2 * k}", f"assistant{2 * k + 1}") for k in range(4)] and got[3, 1] == (None, "only")
