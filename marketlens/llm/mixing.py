"""Mixing sources to target weights with soft membership.

A softmax classifier fitted on labelled rows gives every document a probability for each domain. The
expected tokens of a domain are the sum over documents of rate * tokens * probability. Rates are at
least 0, or lie between bounds that a document's likeliest domain sets, and minimise the squared,
share-weighted distance of those totals from the targets, plus a small pull towards rate 1, by projected
gradient steps with momentum. Probabilities are multiples of a thousandth, so the steps run on a table of
distinct ones with their tokens, which hardly grows with the documents. A step needs two numbers per domain
from it; a rate follows from those numbers and the probabilities, so no table of rates is kept or collected.
Steps end where the optimality conditions hold: a projected step would move no rate any more, in the
token-weighted mean. What then is left between totals and targets is returned as the residual.

Defined cases: null and empty texts have no tokens and get the rate their probabilities give; an empty
table gives an empty result; without labels all domains are alike likely; a domain without labelled rows has
probability 0; null ids are carried along; equal rows get equal rates (in ties of probability the first domain
counts as the likeliest); further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import Remembered, sliced, stage, texts, words_of
from marketlens.llm.labelled import one_row_an_id
from marketlens.llm.quality import statistics

BUCKETS, ROUNDS, BATCH, STEP, DECAY = 1 << 15, 12, 128, 0.02, 1e-3
PULL, SETTLED = 2e-3, 2e-4
#: Probabilities are whole multiples of 1 / PARTS, so documents fall into classes of equal ones, however many there are.
PARTS = 1000


class Classifier:
    """Domain probabilities from hashed words, present or not, and standardised text statistics."""

    def __init__(self, weights: np.ndarray, mean: np.ndarray, spread: np.ndarray, known: np.ndarray):
        self.weights, self.mean, self.spread, self.known = weights, mean, spread, known
        self.bucket = Remembered(lambda word: xxhash.xxh32_intdigest(word) % BUCKETS)

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        words = words_of(text)
        some = set(words)
        return np.fromiter(map(self.bucket.__getitem__, some), np.int64, len(some)), np.array(statistics(text, words, len(text))), len(words)

    def probabilities(self, columns: np.ndarray, found: np.ndarray) -> np.ndarray:
        z = self.weights[columns].sum(axis=0) + np.clip((found - self.mean) / self.spread, -4, 4) @ self.weights[BUCKETS:-1] + self.weights[-1]
        p = np.where(self.known, np.exp(z - z[self.known].max(initial=-50)), 0)
        return p / max(p.sum(), 1e-300)


def fit(rows: list[tuple[int, str]], domains: int) -> tuple:
    """Weights of the classifier from (domain, text)."""
    y = np.array([domain for domain, _ in rows], np.int64)
    known = np.bincount(y, minlength=domains) > 0
    if not known.any():
        known[:] = True
    blank = Classifier(np.zeros((0, domains)), np.zeros(0), np.ones(0), known)
    coded = [blank.encode((text or "").encode()) for _, text in rows]
    found = np.array([c[1] for c in coded] or [blank.encode(b"")[1]])
    mean, spread = found.mean(axis=0), found.std(axis=0) + 1e-6
    weights = np.zeros((BUCKETS + found.shape[1] + 1, domains))
    if len(rows):
        size = len(weights)
        random = np.random.default_rng(7)
        x = np.clip((found - mean) / spread, -4, 4)
        wanted = np.eye(domains)[y]
        first, second, t = np.zeros_like(weights), np.zeros_like(weights), 0
        for _ in range(ROUNDS):
            order = random.permutation(len(rows))
            for start in range(0, len(rows), BATCH):
                some = order[start : start + BATCH]
                columns = np.concatenate([coded[k][0] for k in some])
                owner = np.repeat(np.arange(len(some)), [len(coded[k][0]) for k in some])
                z = np.stack([np.bincount(owner, weights[columns, k], len(some)) for k in range(domains)], axis=1)
                z += x[some] @ weights[BUCKETS:-1] + weights[-1]
                z[:, ~known] = -np.inf
                p = np.exp(z - z.max(axis=1, keepdims=True))
                error = (p / p.sum(axis=1, keepdims=True) - wanted[some]) / len(some)
                slope = np.stack([np.bincount(columns, error[owner, k], size) for k in range(domains)], axis=1)
                slope[BUCKETS:-1] += x[some].T @ error
                slope[-1] += error.sum(axis=0)
                slope[:-1] += DECAY * weights[:-1]
                t += 1
                first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
                weights -= STEP * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return weights, mean, spread, known


def labelled_domains(docs: DataFrame, labels: DataFrame, domain, usable, per_domain: int, domains: int) -> list[tuple[int, str]]:
    """(domain, text) of at most per_domain rows of each domain, in the order of a hash of the id."""
    known = labels.withColumn("domain", domain.cast("int")).filter(F.col("doc_id").isNotNull() & F.col("domain").isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    picked = None
    for k in range(domains):
        some = known.filter(F.col("domain") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain)
        picked = some if picked is None else picked.unionByName(some)
    found = one_row_an_id(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), ["doc_id", "domain"], ["text"]).collect()
    rows = sorted((row.doc_id, row.domain, row.text or "") for row in found)
    return [(domain, text) for _, domain, text in rows]


def bounds_of(keep: int | None):
    """Lowest and highest rate of a row, as columns. With a domain to keep, rows of which it is the likeliest are
    never dropped and all others never copied."""
    if keep is None:
        return F.lit(0.0), F.lit(float("inf"))
    mine = F.array_position("p", F.array_max("p")) == keep + 1
    return F.when(mine, 1.0).otherwise(0.0), F.when(mine, float("inf")).otherwise(1.0)


def state_of(steps: list[np.ndarray], size: float, keep: int | None = None):
    """A column with a document's state after all steps: its rate r, the one before q, and the point y the last step left from."""
    low, high = bounds_of(keep)
    root = float(np.sqrt(PULL * size))
    momentum = (1 - root) / (1 + root)
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("q"), F.lit(1.0).alias("y"))
    if not steps:
        return start

    def step(a, e):
        y = next_point(a, momentum)
        along = sum((F.col("p")[k] * e[k] for k in range(len(steps[0]))), F.lit(0.0))
        r = F.greatest(low, F.least(high, y - F.lit(size) * (along + PULL * (y - 1))))
        return F.struct(r.alias("r"), a["r"].alias("q"), y.alias("y"))

    return F.aggregate(F.array(*[F.array(*[F.lit(float(x)) for x in e]) for e in steps]), start, step)


def next_point(state, momentum: float):
    return state["r"] + momentum * (state["r"] - state["q"])


def fitted_steps(found: DataFrame, targets: list[float], keep: int | None = None) -> tuple[list[np.ndarray], float, np.ndarray]:
    """The gradients of all steps, the step size, and targets less totals as shares of all tokens, from (n_tokens, p)."""
    classes = stage(found.groupBy("p").agg(F.sum("n_tokens").alias("n_tokens")).filter("n_tokens > 0").coalesce(8), "posterior-classes")
    domains = range(len(targets))
    at = lambda k: F.col("p")[k]
    sums = classes.agg(
        F.sum("n_tokens").alias("n"),
        *[F.sum(F.col("n_tokens") * at(k)).alias(f"s{k}") for k in domains],
        *[F.sum(F.col("n_tokens") * at(j) * at(k)).alias(f"g{j}_{k}") for j in domains for k in domains],
    ).first()
    if not sums.n:
        return [], 1.0, np.zeros(len(targets))
    share = np.maximum(np.array([sums[f"s{k}"] for k in domains]) / sums.n, 1e-6)
    gram = np.array([[sums[f"g{j}_{k}"] for k in domains] for j in domains]) / sums.n
    root = np.sqrt(share)
    size = 1 / (float(np.linalg.eigvalsh(gram / np.outer(root, root))[-1]) + PULL)
    wanted = np.array(targets, float)
    wanted = wanted / wanted.sum()
    momentum = (1 - np.sqrt(PULL * size)) / (1 + np.sqrt(PULL * size))
    steps: list[np.ndarray] = []
    totals = share
    while True:
        steps.append((totals - wanted) / share)
        state = F.col("state")
        n = F.col("n_tokens")
        row = classes.withColumn("state", state_of(steps, size, keep)).agg(
            F.sum(n * F.pow(state["r"] - state["y"], F.lit(2.0))).alias("moved"),
            *[F.sum(n * state["r"] * at(k)).alias(f"r{k}") for k in domains],
            *[F.sum(n * next_point(state, momentum) * at(k)).alias(f"y{k}") for k in domains],
        ).first()
        if row.moved / sums.n <= (SETTLED * size) ** 2:
            return steps, size, wanted - np.array([row[f"r{k}"] for k in domains]) / sums.n
        totals = np.array([row[f"y{k}"] for k in domains]) / sums.n


def in_parts(p: np.ndarray) -> list[float]:
    """Probabilities as multiples of 1 / PARTS; what rounding leaves goes to the largest."""
    parts = np.rint(p * PARTS)
    parts[parts.argmax()] += PARTS - parts.sum()
    return (parts / PARTS).tolist()


def _posteriors(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(*model.value)
        for batch in sliced(batches):
            coded = [classifier.encode(x) for x in texts(batch.column(1))]
            sizes = pa.array([c[2] for c in coded], pa.int64())
            found = pa.array([in_parts(classifier.probabilities(c[0], c[1])) for c in coded], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sizes, found], names=["row", "chance", "n_tokens", "p"])

    return run


def _copies(rate, chance):
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")


def _chance():
    """A number from 0 to 1 that depends only on a row's id and text."""
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _with_rates(docs: DataFrame, kept: list[str], labels: DataFrame, domain, targets: list[float], usable, per_domain: int, keep: int | None) -> DataFrame:
    """(row, n_tokens, p, rate, copies, residual): each row's kept columns as one struct, so that no name can clash."""
    rows = labelled_domains(docs, labels, domain, usable, per_domain, len(targets))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, len(targets)))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "text", _chance().alias("chance"))
    schema = T.StructType([packed.schema["row"], packed.schema["chance"], T.StructField("n_tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))])
    found = stage(packed.mapInArrow(_posteriors(model), schema), "posteriors")
    model.destroy()
    steps, step, left = fitted_steps(found.select("n_tokens", "p"), targets, keep)
    rated = found.withColumn("rate", state_of(steps, step, keep)["r"])
    return rated.withColumn("copies", _copies(F.col("rate"), F.col("chance"))).withColumn("residual", F.lit(float(np.abs(left).max())))


def mixing_rates(docs: DataFrame, labels: DataFrame, domain, targets: list[float], usable, per_domain: int = 1500, keep: int | None = None) -> DataFrame:
    """doc_id, n_tokens, p (probability of each domain), rate and copies (a whole number with the rate as its mean) of
    every row, and the residual: the largest share of all tokens by which a domain's total misses its target.

    domain: a column over labels with the domain's number, 0 and up; targets: a weight for each domain, the
    expected tokens of all domains together stay what they are; usable: whose labels may be learned; keep: a domain
    whose rows have rates of at least 1, while those of all others have at most 1.
    """
    rated = _with_rates(docs, ["doc_id"], labels, domain, targets, usable, per_domain, keep)
    return rated.select("row.doc_id", "n_tokens", "p", "rate", "copies", "residual")


def mixed_rows(docs: DataFrame, labels: DataFrame, domain, targets: list[float], usable, per_domain: int = 1500, keep: int | None = None) -> DataFrame:
    """docs with each row as often as it is to be copied."""
    rated = _with_rates(docs, docs.columns, labels, domain, targets, usable, per_domain, keep)
    return rated.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def label_domain():
    """Domains of the labels table: 0 good and clean, 1 good and toxic, 2 poor and clean, 3 poor and toxic."""
    return (1 - F.col("quality")) * 2 + F.col("toxic")
