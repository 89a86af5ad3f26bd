"""Quality rules: text statistics in SQL, and a decision list learned by sequential covering.

The statistics are Spark expressions over the words and lines of whole texts. The list is learned from
all labelled rows. Each statistic is cut into bins once, at quantiles of all rows, of the rows above
zero and of the rows to be rejected; a rule grows by the condition (a statistic at most, or above, an
edge) with the largest information gain over the rows it covers, whose edge is then moved by counts
between ever closer values. It is pruned from its end on rows it has not grown on, and is kept if it
is precise enough on those. Covered rows leave, and the next rule follows until none is precise. Each
step is a grouped count, of which only those few counts reach the driver. The list is written as an
ordered CASE expression.

Empty cases: null and empty texts have zero statistics and fail the base rule; an empty table gives an
empty result; without labels the list is empty and keeps what passes the base rule; null ids are
carried along; equal rows get equal verdicts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import stage

#: Steps of a 64th, and halves of the rest towards both ends.
QUANTILES = sorted({k / 64 for k in range(1, 64)} | {x for k in range(7, 14) for x in (2.0**-k, 1 - 2.0**-k)})
MOST_CONDITIONS = 3
PRECISE, LEAST = 0.95, 5
_BLANKS = " \t\n\x0b\f\r"
WINDOW = 8
#: Statistics that rules may use, as expressions of the counted columns.
RATIOS = {
    "n_words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "line_share": "n_lines / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_word = lambda line: F.length(F.btrim(line, F.lit(_BLANKS))) > 0
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split(text, "\n"), has_word).alias("lines"),
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).alias("n_symbols"),
        F.regexp_count(text, F.lit("[0-9]")).alias("n_digits"),
    )
    rows = rows.withColumn("n_words", F.size("words"))
    # Hashes of every two, four and eight words, each from two of the hashes before it.
    shifted = lambda c, k, less: F.slice(c, F.lit(1 + k), F.size(c) - less)
    hashed, width = "words", 1
    while width < WINDOW:
        both = F.zip_with(shifted(hashed, 0, width), shifted(hashed, width, width), lambda a, b: F.xxhash64(a, b))
        hashed, width = f"of_{2 * width}", 2 * width
        rows = rows.withColumn(hashed, F.when(F.col("n_words") >= WINDOW, both))
    # Where a window recurs, hashes with places in order, so that equal ones are neighbours.
    rows = rows.withColumnRenamed(hashed, "windows")
    rows = rows.withColumn(
        "sorted",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i")))),
        ),
    )
    near = lambda k: F.get(F.col("sorted"), k)["h"]
    rows = rows.withColumn(
        "places",
        F.sort_array(
            F.transform(
                F.filter("sorted", lambda s, k: F.coalesce(near(k - 1) == s["h"], F.lit(False)) | F.coalesce(near(k + 1) == s["h"], F.lit(False))),
                lambda s: s["i"],
            )
        ),
    )
    # Words under the union of those windows: each adds what lies beyond the end of those before it.
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["total"] + i + WINDOW - F.greatest(i, a["end"])).alias("total")),
        lambda a: a["total"],
    )
    long = lambda column, name: column.cast("bigint").alias(name)
    return rows.select(
        "doc_id",
        long(F.col("n_words"), "n_words"),
        *[long(F.col(c), c) for c in ("word_chars", "n_symbols", "n_digits")],
        long(F.size("lines"), "n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        long(F.size(F.array_distinct("words")), "n_distinct"),
        long(F.coalesce(covered, F.lit(0)), "n_repeat_words"),
    )


BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def learned_rules(found: DataFrame) -> list[list[tuple[str, str, float]]]:
    """Conjunctions that reject, in order, from rows with a label (0 is to be rejected) and the ratios."""
    names = list(RATIOS)
    # Quantiles of all rows, of those above zero and of those to be rejected, finer towards both ends.
    of = {"": lambda n: F.col(n), "_above": lambda n: F.when(F.col(n) > 0, F.col(n)), "_bad": lambda n: F.when(F.col("label") == 0, F.col(n))}
    cuts = found.agg(*[F.percentile_approx(pick(n), QUANTILES, 10_000).alias(n + kind) for n in names for kind, pick in of.items()]).first()
    edges = {n: sorted({x for kind in of for x in cuts[n + kind] or []}) for n in names}
    if not any(edges.values()):
        return []
    above = lambda n, values: F.size(F.filter(F.array(*map(F.lit, values)), lambda e: F.col(n) > e)) if values else F.lit(0)
    # Bin k holds what is above k edges.
    binned = found.select(
        (F.col("label") == 0).cast("int").alias("bad"),
        (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("for_pruning"),
        *names,
        *[above(n, edges[n]).alias(f"bin_{n}") for n in names],
    )
    rows = stage(binned, "bins")

    def meets(rule) -> Column:
        out = F.lit(True)
        for name, side, edge in rule:
            out = out & (F.col(name) <= edge if side == "<=" else F.col(name) > edge)
        return out

    def totals(df: DataFrame) -> tuple[int, int]:
        row = df.agg(F.sum("bad").alias("p"), F.count("*").alias("a")).first()
        return row.p or 0, (row.a or 0) - (row.p or 0)

    def counted(df: DataFrame, bins: dict[str, Column]) -> list:
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("bin")) for n, c in bins.items()]))
        return df.select("bad", pairs.alias("x")).groupBy("x.name", "x.bin").agg(F.sum("bad").alias("p"), F.count("*").alias("a")).collect()

    def best_of(counts: list, values: dict[str, list[float]], p0: int, n0: int, sure: bool, sides: str | None = None):
        """(gain, condition, p, n) of the best condition; sure asks it to be precise by itself."""
        best = None
        for name, at in values.items():
            p = a = 0
            for row in sorted((r for r in counts if r["name"] == name), key=lambda r: r.bin):
                p, a = p + row.p, a + row.a
                for side, x, y in (("<=", p, a - p), (">", p0 - p, n0 - (a - p))):
                    if x >= LEAST and x + y < p0 + n0 and row.bin < len(at) and sides in (None, side) and not (sure and x < PRECISE * (x + y)):
                        gain = x * (math.log2(x / (x + y)) - math.log2(p0 / (p0 + n0)))
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, (name, side, at[row.bin]), x, y)
        return best

    def refined(df: DataFrame, best, p0: int, n0: int, sure: bool):
        """The same condition with a cut anywhere between the edges beside its own, by counts between ever closer values."""
        (name, side, edge), at = best[1], edges[best[1][0]]
        k = at.index(edge)
        low, high = at[k - 1] if k else -math.inf, at[k + 1] if k + 1 < len(at) else math.inf
        while True:
            inside = df.filter((F.col(name) > low) & (F.col(name) <= high))
            values = sorted({*(inside.agg(F.percentile_approx(name, [j / 64 for j in range(1, 65)], 10_000)).first()[0] or []), best[1][2]})
            found = best_of(counted(df, {name: above(name, values)}), {name: values}, p0, n0, sure, side)
            if found is None or found[0] <= best[0] + 1e-9:
                return best
            best, k = found, values.index(found[1][2])
            low, high = values[k - 1] if k else low, values[k + 1] if k + 1 < len(values) else high

    def grown(growing: DataFrame, sure: bool) -> list[tuple[str, str, float]]:
        rule: list[tuple[str, str, float]] = []
        p0, n0 = totals(growing)
        while len(rule) < MOST_CONDITIONS and p0 and n0:
            rest = growing.filter(meets(rule))
            best = best_of(counted(rest, {n: F.col(f"bin_{n}") for n in names}), edges, p0, n0, sure)
            if best is None or best[0] <= 0:
                break
            best = refined(rest, best, p0, n0, sure)
            rule.append(best[1])
            p0, n0 = best[2], best[3]
        return rule

    def pruned(rule, pruning: DataFrame):
        worth = []
        for k in range(1, len(rule) + 1):
            p, n = totals(pruning.filter(meets(rule[:k])))
            worth.append(((p - n) / max(p + n, 1), k, p, n))
        best = max(worth, key=lambda x: (x[0], -x[1]), default=None)
        return rule[: best[1]] if best and best[2] >= LEAST and best[2] >= PRECISE * (best[2] + best[3]) else None

    rules: list = []
    left = rows
    while True:
        # Where the largest gain leads to no precise rule, a condition that is precise by itself may.
        for sure in (False, True):
            rule = pruned(grown(left.filter("not for_pruning"), sure), left.filter("for_pruning"))
            if rule:
                break
        if not rule:
            return rules
        rules.append(rule)
        left = left.filter(~meets(rule))


def expression(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The ordered list as one conditional expression: false for what a rule rejects."""
    out = None
    for rule in rules:
        met = F.lit(True)
        for name, side, edge in rule:
            met = met & (F.expr(RATIOS[name]) <= edge if side == "<=" else F.expr(RATIOS[name]) > edge)
        out = F.when(met, False) if out is None else out.when(met, False)
    return F.lit(True) if out is None else out.otherwise(True)


def quality_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row."""
    found = stage(statistics(docs, id_col, text_col), "statistics")
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    learn = found.filter(f"not ({BASE_FAILED})").join(known, "doc_id")
    learn = stage(learn.select("doc_id", "label", *[F.expr(e).alias(n) for n, e in RATIOS.items()]), "labelled")
    verdict = expression(learned_rules(learn))
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.expr(BASE_FAILED).alias("base_failed"),
        (~F.expr(BASE_FAILED) & verdict).alias("kept"),
    )
