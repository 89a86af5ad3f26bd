"""Quality by a factorisation machine over hashed words, structure statistics and the stated length.

Pairwise interactions have rank RANK and are scored in linear time: half the sum over factors of the
square of the sum less the sum of the squares. Statistics are one-hot over bins whose edges are
quantiles of the fitted sample. The machine is fitted by Adam on at most `per_class` rows of each
label; labels, language, source and id are never inputs.

Empty cases: null and empty texts have no words and zero statistics; a null stated length is 0; an
empty table gives an empty result; with labels of one kind only, every score is the smoothed share of
label 1; null ids are carried along; equal rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import Remembered, sliced, texts, words_of
from marketlens.llm.labelled import labelled_sample

BUCKETS, RANK, BINS = 1 << 15, 8, 10
ROUNDS, BATCH, STEP, WORD_DECAY = 12, 128, 0.02, 2e-3
#: Classes of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 symbol, 7 punctuation, 8 not ASCII.
_KIND = np.zeros(256, np.uint8)
for _kind, _bytes in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, (32, 9)), (5, (10,)), (6, b"#*$%&|<>{}[]=_\\/^~@+"), (7, b".,;:!?'\"()-"), (8, range(128, 256))):
    _KIND[list(_bytes)] = _kind


def statistics(text: bytes, words: list[bytes], stated: int) -> list[float]:
    n = max(len(text), 1)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=9)
    lines = [line for line in text.split(b"\n") if line.strip()]
    unique = len(set(words))
    n_words = max(len(words), 1)
    return [
        *(kinds / n).tolist(),
        float(np.log1p(len(words))),
        unique / n_words,
        len(b"".join(words)) / n_words,
        len(set(lines)) / max(len(lines), 1),
        len(lines) / n_words,
        sum(line.rstrip()[-1:] in b".!?" for line in lines) / max(len(lines), 1),
        float(np.log1p(max(map(len, words), default=0))),
        float(np.log1p(max(stated, 0))),
    ]


N_STATISTICS = 17


class Machine:
    """Weights of a fitted machine: edges of the bins, intercept, linear weights and factors."""

    def __init__(self, edges: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.edges, self.bias, self.linear, self.factors = edges, bias, linear, factors
        self.bucket = Remembered(lambda word: xxhash.xxh32_intdigest(word) % BUCKETS)

    def encode(self, text: bytes, stated: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and values: words by the root of their number at unit length, then one bin of each statistic."""
        words = words_of(text)
        here = np.fromiter(map(self.bucket.__getitem__, words), np.int64, len(words))
        columns, counts = np.unique(here, return_counts=True)
        values = np.sqrt(counts / max(len(words), 1))
        found = statistics(text, words, stated)
        bins = [BUCKETS + k * BINS + int(np.searchsorted(self.edges[k], x, "right")) for k, x in enumerate(found)]
        return np.concatenate([columns, bins]).astype(np.int64), np.concatenate([values, np.full(len(bins), 0.5)])

    def raw(self, columns: np.ndarray, values: np.ndarray) -> float:
        scaled = self.factors[columns] * values[:, None]
        total = scaled.sum(axis=0)
        return self.bias + self.linear[columns] @ values + 0.5 * float((total * total - (scaled * scaled).sum(axis=0)).sum())


def fit(rows: list[tuple]) -> tuple:
    """Weights from (doc_id, label, text, stated length)."""
    size = BUCKETS + N_STATISTICS * BINS
    y = np.array([row[1] for row in rows], float)
    raw = [((row[2] or "").encode(), row[3] or 0) for row in rows]
    random = np.random.default_rng(7)
    edges = np.zeros((N_STATISTICS, BINS - 1))
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return edges, bias, np.zeros(size), np.zeros((size, RANK))
    found = np.array([statistics(text, words_of(text), stated) for text, stated in raw])
    edges = np.quantile(found, np.arange(1, BINS) / BINS, axis=0).T.copy()
    encoded = [Machine(edges, 0, np.zeros(0), np.zeros(0)).encode(text, stated) for text, stated in raw]
    weights = np.column_stack([np.zeros(size), random.normal(0, 0.05, (size, RANK))])
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    decay = np.full((size, 1), 1e-4)
    decay[:BUCKETS] = WORD_DECAY
    t = 0
    for _ in range(ROUNDS):
        order = random.permutation(len(y))
        for start in range(0, len(y), BATCH):
            some = order[start : start + BATCH]
            lengths = np.array([len(encoded[k][0]) for k in some])
            columns = np.concatenate([encoded[k][0] for k in some])
            values = np.concatenate([encoded[k][1] for k in some])[:, None]
            edge = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            scaled = weights[columns] * values
            sums = np.add.reduceat(scaled, edge, axis=0)
            squares = np.add.reduceat(scaled[:, 1:] ** 2, edge, axis=0)
            z = bias + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(axis=1)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]
            by_row = np.repeat(error, lengths)[:, None]
            slope = np.column_stack([values * by_row, by_row * values * (np.repeat(sums[:, 1:], lengths, axis=0) - scaled[:, 1:])])
            whole = np.stack([np.bincount(columns, slope[:, f], size) for f in range(RANK + 1)], axis=1) / len(some) + decay * weights
            t += 1
            first = 0.9 * first + 0.1 * whole
            second = 0.999 * second + 0.001 * whole**2
            weights -= STEP * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
            bias -= STEP * error.mean()
    return edges, float(bias), weights[:, 0].copy(), weights[:, 1:].copy()


def quality(
    docs: DataFrame, labels: DataFrame, held_out, per_class: int = 2500, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars"
) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; held_out is a condition on doc_id of rows no label is learned from."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(length_col).cast("bigint").alias("stated"))
    rows = labelled_sample(docs, labels, "quality", ~held_out, per_class, columns=("text", "stated"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*model.value)
        for batch in sliced(batches):
            stated = [x or 0 for x in batch.column(2).to_pylist()]
            z = np.array([machine.raw(*machine.encode(text, n)) for text, n in zip(texts(batch.column(1)), stated)], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "held_out", "score"]
            )

    scored = docs.withColumn("held_out", held_out).mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def good_rows(docs: DataFrame, labels: DataFrame, held_out, least: float = 0.3, per_class: int = 2500, length_col: str = "n_chars") -> DataFrame:
    """The rows of docs whose text scores at least `least`, with all their columns; held_out as above."""
    rows = labelled_sample(docs, labels, "quality", ~held_out, per_class, columns=("text", length_col))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows))
    text_at, length_at = docs.columns.index("text"), docs.columns.index(length_col)
    limit = float(np.log(least / (1 - least)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*model.value)
        for batch in sliced(batches):
            stated = [x or 0 for x in batch.column(length_at).to_pylist()]
            keep = [machine.raw(*machine.encode(text, n)) >= limit for text, n in zip(texts(batch.column(text_at)), stated)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
