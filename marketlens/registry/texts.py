"""Repair and scoring of generated texts, over the whole conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import generated as g
from marketlens.functions.text import key_number_count, mentions_proxy, sentence_count, token_jaccard
from marketlens.plans import quality
from marketlens.plans.phrases import NO_GROWTH_TEXT
from marketlens.plans.report import category_rows
from marketlens.registry import base, tables as t
from marketlens.registry.base import SETTINGS, SPACE, query, squash_sql, strip_sql
from marketlens.registry.measures import words_sql
from marketlens.registry.reports import GENERATION_CATEGORY, generations

QUOTE, SLASH, LINE = "chr(34)", "chr(92)", "chr(10)"


def escaped(x: str) -> str:
    """Portable SQL for a text as the inside of a JSON string."""
    flat = f"replace(replace({x}, chr(13), ' '), chr(9), ' ')"
    return f"replace(replace(replace({flat}, {SLASH}, concat({SLASH}, {SLASH})), {QUOTE}, concat({SLASH}, {QUOTE})), {LINE}, concat({SLASH}, 'n'))"


def object_text(overview: str, growth: str) -> str:
    parts = [f"'{{'", QUOTE, f"'{g.OVERVIEW_KEY}'", QUOTE, "':'", QUOTE, overview, QUOTE, "','", QUOTE, f"'{g.GROWTH_KEY}'", QUOTE, "':'", QUOTE, growth, QUOTE, "'}'"]
    return "concat(" + ", ".join(parts) + ")"


USER, ANSWER = "coalesce(question, '')", "coalesce(answer, '')"
INNER = object_text(escaped(USER), escaped(ANSWER))
REPEATED = object_text(escaped(USER), escaped(ANSWER)).replace(f"'{{'", f"'{{', {QUOTE}, '{g.OVERVIEW_KEY}', {QUOTE}, ': ', {QUOTE}, 'an earlier value', {QUOTE}, ', '", 1)
# Model output in seven shapes: an object in noise, an object inside a value, markdown, plain text with a foreign tail,
# an object cut off, an object with a repeated key, an object without the second key.
RAW = f"""case generation_id % 7 when 0 then concat('noise ', {object_text(escaped(USER), escaped(ANSWER))}, ' tail }} {g.END_TOKEN}')
 when 1 then {object_text(escaped(f"concat({INNER}, '{g.END_TOKEN}')"), "'short'")}
 when 2 then concat('## Market Overview', {LINE}, '- ', {USER}, {LINE}, '**Growth**', {LINE}, '# head', {LINE}, {ANSWER})
 when 3 then concat({USER}, ' 对应的 ', {ANSWER}, ' {g.END_TOKEN} rest')
 when 4 then {REPEATED}
 when 5 then concat('{{', {QUOTE}, '{g.OVERVIEW_KEY}', {QUOTE}, ':', {QUOTE}, {escaped(ANSWER)}, {QUOTE}, '}}')
 else concat('x ', {object_text(escaped(USER), "'broken'")}, '{{') end"""
base.STEPS["raw_generations"] = f"select generation_id, {GENERATION_CATEGORY} as category_id, {RAW} as raw from turn_texts"


def raw_generations(spark, d):
    # Spark reads a backslash in a literal as an escape; the portable text has none.
    return t.turn_texts(spark, d).select("generation_id", F.expr(GENERATION_CATEGORY).alias("category_id"), F.expr(RAW).alias("raw"))


def token_free(x: str) -> str:
    return strip_sql(f"replace({strip_sql(x)}, '{g.END_TOKEN}', '')")


def object_steps(prefix: str, source: str, text: str) -> dict[str, str]:
    """SQL steps that find the first balanced object of a text by running brace depth."""
    return {
        f"{prefix}_pieces": f"""select generation_id, unnest(regexp_extract_all(tail, '[{{}}]|[^{{}}]+')) as piece, generate_subscripts(regexp_extract_all(tail, '[{{}}]|[^{{}}]+'), 1) as i
 from (select generation_id, substr(x, strpos(x, '{{')) as tail from (select generation_id, {text} as x from {source}) where strpos(x, '{{') > 0)""",
        f"{prefix}_depths": f"select *, sum(case piece when '{{' then 1 when '}}' then -1 else 0 end) over (partition by generation_id order by i) as depth from {prefix}_pieces",
        f"{prefix}_ends": f"select generation_id, min(i) as last_i from {prefix}_depths where piece = '}}' and depth = 0 group by 1",
        f"{prefix}_objects": f"""select generation_id, obj from (select generation_id, string_agg(piece, '' order by i) as obj from {prefix}_depths join {prefix}_ends using (generation_id) where i <= last_i group by 1)
 where json_valid(obj) and not regexp_matches(obj, '^[{{]{SPACE}*[}}]$')""",
    }


def value_sql(obj: str, key: str) -> str:
    """The last value of a key where it is a string."""
    keys = f"json_keys(cast({obj} as json))"
    last = f"json_extract(cast({obj} as json), '$.*')[len({keys}) + 1 - list_position(list_reverse({keys}), '{key}')]"
    return f"case when json_type({last}) = 'VARCHAR' then json_extract_string({last}, '$') end"


def nested_sql(x: str) -> str:
    bare = f"regexp_replace({token_free(x)}, '{SPACE}*([\"' || chr(92) || chr(92) || ']{SPACE}*)+$', '')"
    return f"case when starts_with({bare}, '{{') and json_valid({bare}) then {bare} end"


base.STEPS.update(object_steps("first", "raw_generations", token_free("raw")))
base.STEPS["level_0"] = f"select generation_id, {value_sql('obj', g.OVERVIEW_KEY)} as o, {value_sql('obj', g.GROWTH_KEY)} as w from first_objects"
for _k in (1, 2, 3):
    base.STEPS[f"level_{_k}"] = (
        f"select generation_id, coalesce({value_sql('n', g.OVERVIEW_KEY)}, o) as o, coalesce({value_sql('n', g.GROWTH_KEY)}, w) as w from (select *, coalesce({nested_sql('o')}, {nested_sql('w')}) as n from level_{_k - 1})"
    )


@query("g1_first_json_object", "select generation_id, obj from raw_generations left join first_objects using (generation_id)")
def g1(spark, d):
    return raw_generations(spark, d).select("generation_id", g.first_json_object(F.col("raw")).alias("obj"))


@query("g2_unwrap_nested", "select generation_id, o as overview, w as growth from level_3")
def g2(spark, d):
    found = raw_generations(spark, d).select("generation_id", g.first_json_object(F.col("raw")).alias("obj")).filter(F.col("obj").isNotNull())
    pair = g.unwrap_nested(g.json_text(F.col("obj"), g.OVERVIEW_KEY), g.json_text(F.col("obj"), g.GROWTH_KEY))
    return found.select("generation_id", pair.alias("p")).select("generation_id", "p.overview", "p.growth")


def trim_sql(x: str) -> str:
    """Cases over the foreign markers, then over the openers of the rest."""
    head = strip_sql(f"string_split({strip_sql(x)}, '{g.END_TOKEN}')[1]")
    cases = []
    for mark in g.FOREIGN_MARKERS:
        after = strip_sql(f"substr(h, strpos(h, '{mark}') + {len(mark)})")
        openers = " ".join(f"when contains({after}, '{o}') then substr({after}, strpos({after}, '{o}'))" for o in g.OPENERS)
        cases.append(f"when contains(h, '{mark}') then (case when strpos(h, '{mark}') - 1 > {g.PREFIX_PAST} then {strip_sql(f'left(h, strpos(h, {chr(39)}{mark}{chr(39)}) - 1)')} else (case {openers} else {after} end) end)")
    return f"select category_id, turn, case {' '.join(cases)} else h end as text from (select category_id, turn, {head} as h from {{source}})"


# Every message, some of them with a foreign marker, an opener or an end token put in.
FOREIGN = "case turn % 4 when 0 then concat(text, ' 对应的 ', '本文') when 1 then concat('짧은 市场概况 그 뒤 전체 ', text) when 2 then concat(text, '<|im_end|>', text) else text end"
base.STEPS["foreign_texts"] = f"select conv_id as category_id, turn, {FOREIGN} as text from conversations"
base.STEPS["trimmed_texts"] = trim_sql("text").replace("{source}", "foreign_texts")


def foreign_texts(spark, d):
    return t.table(spark, d, "conversations").select(F.col("conv_id").alias("category_id"), "turn", F.expr(FOREIGN).alias("text"))


@query("g3_trim_foreign_tail", "select category_id, turn, text from trimmed_texts")
def g3(spark, d):
    return foreign_texts(spark, d).select("category_id", "turn", g.trim_foreign_tail(F.col("text")).alias("text"))


def dedupe_sql(x: str) -> str:
    parts = f"list_filter(list_transform(string_split(regexp_replace({x}, '([가-힣a-zA-Z]){SPACE}*[.。]{SPACE}+', chr(92) || '1' || chr(1), 'g'), chr(1)), lambda s: {strip_sql('s')}), lambda s: length(s) >= 10)"
    return f"(select array_to_string(list_filter(p, lambda s, i: list_position(list_transform(p, lambda z: left(z, 50)), left(s, 50)) = i)[1:12], '. ') from (select {parts} as p))"


@query(
    "g5_dedupe_sentences",
    f"select conv_id, turn, {squash_sql('case when t <> chr(0) and not ends_with(t, chr(46)) and length(t) > 0 then t || chr(46) else t end')} as text from (select conv_id, turn, {dedupe_sql('c.text')} as t from conversations c)",
)
def g5(spark, d):
    return t.table(spark, d, "conversations").select("conv_id", "turn", g.dedupe_sentences(F.col("text")).alias("text"))


LINE_BREAK = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def markdown_sql(x: str) -> str:
    lines = f"list_filter(list_transform(string_split_regex({x}, '{LINE_BREAK}'), lambda s: {strip_sql('s')}), lambda s: s <> '' and not starts_with(s, '#'))"
    bare = f"list_transform({lines}, lambda s: replace(replace(case when starts_with(s, '- ') then {strip_sql('substr(s, 3)')} else s end, '**', ''), chr(96), ''))"
    return squash_sql(f"array_to_string({bare}, ' ')")


BOTH = "strpos(lower(x), 'market overview') > 0 and strpos(lower(x), 'growth') > 0"
base.STEPS["markdown"] = f"""select generation_id, {markdown_sql(f"case when {BOTH} then substr(x, strpos(lower(x), 'market overview'), greatest(strpos(lower(x), 'growth') - strpos(lower(x), 'market overview'), 0)) else x end")} as overview,
 {markdown_sql(f"case when {BOTH} then substr(x, strpos(lower(x), 'growth')) else '' end")} as growth from (select generation_id, {strip_sql('raw')} as x from raw_generations)"""


@query("g6_coerce_markdown", f"select generation_id, overview, case when growth = '' then '{NO_GROWTH_TEXT}' else growth end as growth from markdown")
def g6(spark, d):
    return raw_generations(spark, d).select("generation_id", g.coerce_markdown(F.col("raw")).alias("p")).select("generation_id", "p.overview", "p.growth")


@query("g7_split_500", f"select conv_id, turn, left({strip_sql('text')}, 500) as overview, substr({strip_sql('text')}, 501) as growth from conversations")
def g7(spark, d):
    parts = t.table(spark, d, "conversations").select("conv_id", "turn", g.split_500(F.col("text")).alias("p"))
    return parts.select("conv_id", "turn", "p.overview", "p.growth")


@query("g8_ensure_keys", "select generation_id, coalesce(o, '') as overview, coalesce(w, '') as growth from raw_generations left join level_0 using (generation_id)")
def g8(spark, d):
    obj = raw_generations(spark, d).select("generation_id", g.first_json_object(F.col("raw")).alias("obj"))
    return obj.select("generation_id", *[g.ensure_text(g.json_text(F.col("obj"), k)).alias(n) for k, n in [(g.OVERVIEW_KEY, "overview"), (g.GROWTH_KEY, "growth")]])


def pieces_sql(x: str, mark: str) -> str:
    return f"len(list_filter(string_split({x}, '{mark}'), lambda s: {strip_sql('s')} <> ''))"


def sentences_sql(x: str) -> str:
    dots = pieces_sql(f"replace({x}, '。', '.')", ".")
    return f"(case when {x} = '' then 0 else greatest(1, {dots} + {pieces_sql(x, '!')} + {pieces_sql(x, '?')}) end)"


NUMBERS = [r"\p{Nd}+\.\p{Nd}+%", r"\p{Nd}+%", r"\p{Nd}+\.\p{Nd}+점", r"\p{Nd}+\.\p{Nd}+"]


def numbers_sql(x: str) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({x}, '{p}'))" for p in NUMBERS) + ")"


def proxy_sql(*texts: str) -> str:
    return "(" + " or ".join(f"contains({x}, '대리 지표') or contains(lower({x}), 'proxy')" for x in texts) + ")"


def jaccard_sql(a: str, b: str) -> str:
    both = f"len(list_distinct(list_concat({words_sql(a)}, {words_sql(b)})))"
    return f"(case when len({words_sql(a)}) > 0 and len({words_sql(b)}) > 0 then len(list_intersect({words_sql(a)}, {words_sql(b)})) / cast({both} as double) else 0.0 end)"


@query("q1_sentence_count", f"select doc_id, {sentences_sql('text')} as n from documents")
def q1(spark, d):
    return t.table(spark, d, "documents").select("doc_id", sentence_count(F.col("text")).alias("n"))


# Documents with their quality share put in as the kinds of number the count looks for.
NUMBERED = "concat(text, ' ', n_chars, '.5% ', doc_id, '% 4.7점')"


@query("q2_key_number_count", f"select doc_id, {numbers_sql('x')} as n from (select doc_id, {NUMBERED} as x from documents)")
def q2(spark, d):
    return t.table(spark, d, "documents").select("doc_id", key_number_count(F.expr(NUMBERED)).alias("n"))


MENTION = "case doc_id % 3 when 0 then concat('a Proxy ', text) when 1 then concat(text, ' 대리 지표') else text end"


@query("q3_mentions_proxy", f"select doc_id, {proxy_sql('x', 'source')} as found from (select doc_id, {MENTION} as x, source from documents)")
def q3(spark, d):
    return t.table(spark, d, "documents").select("doc_id", mentions_proxy(F.expr(MENTION), F.col("source")).alias("found"))


@query("q4_token_jaccard", f"select conv_id, turn, round({jaccard_sql('text', 'next_text')}, 6) as jaccard from (select a.conv_id, a.turn, a.text, b.text as next_text from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1)")
def q4(spark, d):
    turns = t.table(spark, d, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return turns.join(following, ["conv_id", "turn"]).select("conv_id", "turn", token_jaccard(F.col("text"), F.col("next_text")).alias("jaccard"))


base.STEPS["pairs"] = """select g.*, t.market_overview as template_overview, t.growth_summary as template_growth from generations g
 join (select category_id, market_overview, growth_summary from overview_texts join growth_texts using (category_id)) t using (category_id)"""


def templates(spark, d):
    return category_rows(t.stored_products(spark, d), t.reviews(spark, d, texts=True), SETTINGS).select("category_id", "market_overview", "growth_summary")


@query("j5_pair_template_generated", "select generation_id, category_id, market_overview, growth_summary, template_overview, template_growth from pairs")
def j5(spark, d):
    paired = quality.pair_template_generated(templates(spark, d), generations(spark, d), extra=["generation_id"])
    return paired.select("generation_id", "category_id", "market_overview", "growth_summary", "template_overview", "template_growth")


def score_steps(prefix: str, pairs: str) -> dict[str, str]:
    """SQL steps of the quality rows of pairs; a null text means that its key was missing."""
    overview, growth = "coalesce(market_overview, '')", "coalesce(growth_summary, '')"
    shares = f"{jaccard_sql(overview, 'template_overview')} as sim_a, {jaccard_sql(growth, 'template_growth')} as sim_b"
    return {
        f"{prefix}word_shares": f"select *, {shares} from {pairs}",
        f"{prefix}scores": f"""select generation_id, category_id, market_overview is not null and growth_summary is not null as json_valid, {overview} <> '' as has_market_overview, {growth} <> '' as has_growth_summary,
 length({overview}) as market_overview_length, length({growth}) as growth_summary_length, {sentences_sql(overview)} as market_overview_sentences, {sentences_sql(growth)} as growth_summary_sentences,
 {proxy_sql(overview, growth)} as contains_proxy_disclaimer, {numbers_sql(overview)} + {numbers_sql(growth)} as contains_key_numbers,
 case when sim_a > 0 or sim_b > 0 then (sim_a + sim_b) / 2 end as template_similarity from {prefix}word_shares""",
    }


base.STEPS.update(score_steps("", "pairs"))


def scored(spark, d):
    return quality.quality_rows(quality.pair_template_generated(templates(spark, d), generations(spark, d), extra=["generation_id"]), ["generation_id", "category_id"])


@query("q5_template_similarity", "select generation_id, round(template_similarity, 6) as template_similarity from scores")
def q5(spark, d):
    return scored(spark, d).select("generation_id", "template_similarity")


@query("q6_quality_row", "select * exclude (template_similarity), round(template_similarity, 6) as template_similarity from scores")
def q6(spark, d):
    return scored(spark, d)


SUMMARY = """select count(*) as total_categories, round(avg(cast(json_valid as int)), 6) as json_valid_rate, round(avg(cast(contains_proxy_disclaimer as int)), 6) as proxy_disclaimer_rate,
 round(avg(market_overview_length), 6) as avg_market_overview_length, round(avg(growth_summary_length), 6) as avg_growth_summary_length, round(avg(contains_key_numbers), 6) as avg_key_numbers,
 round(coalesce(avg(template_similarity), 0), 6) as avg_template_similarity from {scores}"""


@query("a31_evaluation_summary", SUMMARY.format(scores="scores"))
def a31(spark, d):
    return quality.evaluation_summary(scored(spark, d))


def literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def recover_steps(prefix: str, source: str) -> dict[str, str]:
    """SQL steps of the value recovery over (category_id, turn, text)."""
    keys = [f'"{g.OVERVIEW_KEY}"', f'\\"{g.OVERVIEW_KEY}\\"']
    rest = " ".join(f"when contains(text, {literal(k)}) then substr(text, strpos(text, {literal(k)}) + {len(k)})" for k in keys)
    value = " ".join(f"when contains(rest, {literal(o)}) then substr(rest, strpos(rest, {literal(o)}) + {len(o)})" for o in g.VALUE_OPENERS)
    ends = ", ".join(f"nullif(strpos(value, {literal(m)}), 0)" for m in g.VALUE_ENDS)
    chunk = strip_sql(f"case when least({ends}) is not null then left(value, least({ends}) - 1) else value end")
    broken = f"starts_with({strip_sql('text')}, '{{') and (contains(text, '{g.OVERVIEW_KEY}') or contains(text, '{g.GROWTH_KEY}'))"
    return {
        f"{prefix}_rest": f"select *, case {rest} end as rest from {source}",
        f"{prefix}_value": f"select *, case {value} end as value from {prefix}_rest",
        f"{prefix}_best": f"select category_id, turn, case when {broken} and length({chunk}) > 30 and regexp_matches({chunk}, '[가-힣]') then {chunk} else text end as text from {prefix}_value",
    }


base.STEPS["unwrapped_texts"] = "select generation_id as category_id, 0 as turn, o as text from level_3 where o is not null union all select generation_id as category_id, 1 as turn, w as text from level_3 where w is not null"
base.STEPS["unwrapped_trimmed"] = trim_sql("text").replace("{source}", "unwrapped_texts")
base.STEPS.update(recover_steps("unwrapped", "unwrapped_trimmed"))
base.STEPS["cleaned_texts"] = f"select category_id, turn, {squash_sql('case when not ends_with(t, chr(46)) and length(t) > 0 then t || chr(46) else t end')} as text from (select category_id, turn, {dedupe_sql('b.text')} as t from unwrapped_best b)"


@query(
    "g_repaired_summaries",
    f"""select m.generation_id, case when f.obj is null then overview else coalesce(a.text, '') end as market_overview,
 case when f.obj is null then (case when growth = '' then '{NO_GROWTH_TEXT}' else growth end) else coalesce(b.text, '') end as growth_summary
 from markdown m left join first_objects f using (generation_id) left join cleaned_texts a on a.category_id = m.generation_id and a.turn = 0 left join cleaned_texts b on b.category_id = m.generation_id and b.turn = 1""",
)
def repaired(spark, d):
    return quality.repaired(raw_generations(spark, d)).select("generation_id", "market_overview", "growth_summary")


base.STEPS.update(object_steps("whole", "raw_generations", strip_sql("raw")))


@query(
    "g_scored_texts",
    f"""select r.generation_id, r.category_id, case when obj is null then left({strip_sql('raw')}, 500) else {value_sql('obj', g.OVERVIEW_KEY)} end as market_overview,
 case when obj is null then substr({strip_sql('raw')}, 501) else {value_sql('obj', g.GROWTH_KEY)} end as growth_summary from raw_generations r left join whole_objects using (generation_id)""",
)
def scored_texts(spark, d):
    return quality.scored_texts(raw_generations(spark, d)).select("generation_id", "category_id", "market_overview", "growth_summary")


base.STEPS["scored_texts"] = f"""select r.generation_id, r.category_id, case when obj is null then left({strip_sql('raw')}, 500) else {value_sql('obj', g.OVERVIEW_KEY)} end as market_overview,
 case when obj is null then substr({strip_sql('raw')}, 501) else {value_sql('obj', g.GROWTH_KEY)} end as growth_summary from raw_generations r left join whole_objects using (generation_id)"""
base.STEPS["raw_pairs"] = base.STEPS["pairs"].replace("from generations g", "from scored_texts g")
base.STEPS.update(score_steps("raw_", "raw_pairs"))


def evaluated(spark, d):
    return quality.evaluation(raw_generations(spark, d), templates(spark, d), ["generation_id", "category_id"])


@query("q6_quality_of_raw_texts", "select * exclude (template_similarity), round(template_similarity, 6) as template_similarity from raw_scores")
def q6_raw(spark, d):
    return evaluated(spark, d)[0]


@query("a31_evaluation_of_raw_texts", SUMMARY.format(scores="raw_scores"))
def a31_raw(spark, d):
    return evaluated(spark, d)[1]


# A value cut off in the middle, behind each kind of opening; some with an end marker, some whole objects.
OPENER = f"case turn % 4 when 0 then concat({QUOTE}, ': ', {QUOTE}) when 1 then concat({QUOTE}, ':', {QUOTE}) when 2 then concat({SLASH}, {QUOTE}, ':', {SLASH}, {QUOTE}) else concat(':', {SLASH}, {QUOTE}) end"
BROKEN = f"concat('{{', {QUOTE}, '{g.OVERVIEW_KEY}', {QUOTE}, ':', {QUOTE}, 'x', {OPENER}, case when conv_id % 2 = 0 then '시장 구조 ' else 'note ' end, {escaped('text')}, case when conv_id % 3 = 0 then '群 tail' else '' end, {QUOTE}, '}}')"
base.STEPS["broken_texts"] = f"select conv_id as category_id, turn, {BROKEN} as text from conversations"
base.STEPS.update(recover_steps("broken", "broken_texts"))


@query(
    "g4_recover_value",
    f"select category_id, turn, case when starts_with(text, '{{') and json_valid(text) then coalesce({value_sql('text', g.OVERVIEW_KEY)}, {value_sql('text', g.GROWTH_KEY)}, text) else text end as text from broken_best",
)
def g4(spark, d):
    broken = t.table(spark, d, "conversations").select(F.col("conv_id").alias("category_id"), "turn", F.expr(BROKEN).alias("text"))
    return broken.select("category_id", "turn", g.recover_value(F.col("text")).alias("text"))
