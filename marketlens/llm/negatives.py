"""Hard negatives by rotated one-bit codes whose error intervals are certain.

Vectors are rotated by one fixed random rotation. A row keeps the signs of its rotated components (one
bit each), its length, and the alignment of the rotated vector with its code vector. An anchor is
rotated too and rounded to PLANES bits a component, so its inner product with a row's code vector is a
few popcounts of bit planes. Row = alignment * code + rest, with the rest at right angles to the code; by
Cauchy and Schwarz the rest contributes at most (length of the row's rest) * (length of the anchor's
rest), and the rounding of the anchor at most (its length) * (the row's length). So every inner product
lies in an interval around its estimate without any chance of error, and only rows whose interval
reaches what is asked for are scored, in integers.

Rows are packed map-side into blocks and written once. Anchors go through in waves of at most WAVE, each
one row that is sent to all tasks; every task scans its blocks for the whole wave, keeping only the best few
of each anchor, so no row is shuffled and a task returns a bounded number of rows an anchor. The first scan
finds positives (rows of an anchor's label only), the second the negatives of their score windows. The exact
scores found so far bound what later rows must reach; no candidate is capped.

Defined cases: a row takes part if it has an id, a label and a vector of the most common length (ties: the
shorter) whose components are neither null nor non-finite nor so large that a product leaves 64 bits
(|scale * x| below 2**26). Every row is a row of its own: rows that share an id are each other's candidates,
only a row itself is not; ties beyond the id give equal results. Fewer positives or negatives than asked for: all there
are; an anchor without a positive or a window without a negative gives nothing; an empty table gives an empty
result. Only the three named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.centroids import usable
from marketlens.llm.common import stage

BLOCK, WAVE, PLANES = 16384, 32768, 6
_CHUNK, _PROBE = 32, 32
_BLOCK = "block bigint, ids binary, labels binary, x binary"
_ANCHOR = "row_key bigint, anchor_id bigint, label bigint, x binary"
_WAVE = "wave string, row_keys binary, own binary, vectors binary, limits binary"
_NONE = np.iinfo(np.int64).min


def rotation(dimension: int) -> np.ndarray:
    """An orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(dimension).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def _bits(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words, unused bits zero."""
    words = -(-signs.shape[1] // 64)
    padded = np.zeros((len(signs), words * 64), bool)
    padded[:, : signs.shape[1]] = signs
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


class Rows:
    """A block of rows, ordered by label, with codes and alignments."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, first_key: int, turn: np.ndarray):
        order = np.argsort(labels, kind="stable")
        self.keys, self.ids, self.labels = first_key + order, ids[order], labels[order]
        self.x = x[order].astype(np.int64)
        y = self.x @ turn.T
        signs = y >= 0
        self.codes, self.ones = _bits(signs), signs.sum(axis=1).astype(np.float32)
        self.length = np.sqrt((y**2).sum(axis=1))
        self.aligned = np.abs(y).sum(axis=1) / math.sqrt(x.shape[1])
        self.rest = np.sqrt(np.maximum(self.length**2 - self.aligned**2, 0))
        self.largest = int(np.abs(self.x).max(initial=0))
        self.exact_float = self.x.astype(np.float64)

    def scores(self, some: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Integer inner products; floats hold them exactly where no partial sum can reach 2**53."""
        if self.largest * int(np.abs(q).max(initial=0)) * len(q) < 2**53:
            return (self.exact_float[some] @ q.astype(np.float64)).astype(np.int64)
        return self.x[some] @ q


class Anchors:
    """A wave of anchors: bit planes of the rotated vectors."""

    def __init__(self, keys: np.ndarray, labels: np.ndarray, x: np.ndarray, limits: np.ndarray | None, turn: np.ndarray):
        self.keys, self.labels, self.x, self.limits = keys, labels, x.astype(np.int64), limits
        y = self.x @ turn.T
        self.low = y.min(axis=1, initial=0)
        self.step = np.maximum((y.max(axis=1, initial=0) - self.low) / (2**PLANES - 1), 1e-12)
        u = np.rint((y - self.low[:, None]) / self.step[:, None])
        rounded = self.low[:, None] + self.step[:, None] * u
        self.sum, self.square = rounded.sum(axis=1), (rounded**2).sum(axis=1)
        self.off = np.sqrt(((y - rounded) ** 2).sum(axis=1))
        u = u.astype(np.int64)
        self.planes = np.stack([_bits((u >> p) & 1 == 1) for p in range(PLANES)], axis=1)
        self.length = np.sqrt((y**2).sum(axis=1))

    def intervals(self, some: np.ndarray, rows: Rows, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Estimates and half widths of the inner products of some anchors with a part of the rows."""
        counts = np.zeros((len(some), len(rows.ones[part])), np.float32)
        for p in range(PLANES):
            for w in range(rows.codes.shape[1]):
                counts += np.bitwise_count(rows.codes[None, part, w] & self.planes[some, p, w][:, None]) * np.float32(2**p)
        low, step = (a[some, None].astype(np.float32) for a in (self.low, self.step))
        t = (2 * (low * rows.ones[None, part] + step * counts) - self.sum[some, None].astype(np.float32)) / math.sqrt(self.x.shape[1])
        # Float32 sums are off by far less than this share of the lengths.
        slack = 1e-4 * self.length[some, None] * rows.length[None, part] + 1e-3
        half = rows.rest[None, part] * np.sqrt(np.maximum(self.square[some, None] - t**2, 0)) + self.off[some, None] * rows.length[None, part]
        return rows.aligned[None, part] * t, half + slack


class Best:
    """The best (score, id, key) found so far for each place of a table of lists."""

    def __init__(self, count: int, k: int):
        self.k, self.found = k, [None] * count
        self.least = np.full(count, _NONE)

    def add(self, place: int, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        if not len(score):
            return
        if self.found[place] is not None:
            score, ids, keys = (np.concatenate(pair) for pair in zip(self.found[place], (score, ids, keys)))
        order = np.lexsort((keys, ids, -score))[: self.k]
        self.found[place] = score[order], ids[order], keys[order]
        if len(order) == self.k:
            self.least[place] = score[order[-1]]


def _positives(anchors: Anchors, rows: Rows, best: Best) -> None:
    for label in np.unique(rows.labels):
        part = slice(np.searchsorted(rows.labels, label), np.searchsorted(rows.labels, label, "right"))
        own = np.flatnonzero(anchors.labels == label)
        for start in range(0, len(own), _CHUNK):
            some = own[start : start + _CHUNK]
            about, half = anchors.intervals(some, rows, part)
            about[anchors.keys[some, None] == rows.keys[None, part]] = -np.inf
            upper = about + half
            probe = min(best.k, about.shape[1])
            top = np.argpartition(-about, probe - 1, axis=1)[:, :probe]
            for line, anchor in enumerate(some):
                least = best.least[anchor]
                if upper[line].max() < least:
                    continue
                some_top = top[line][np.isfinite(about[line, top[line]])]
                if len(some_top) == best.k:
                    least = max(least, rows.scores(part.start + some_top, anchors.x[anchor]).min())
                at = part.start + np.flatnonzero((upper[line] >= least) & np.isfinite(about[line]))
                score = rows.scores(at, anchors.x[anchor])
                good = score >= least
                best.add(anchor, score[good], rows.ids[at][good], rows.keys[at][good])


def _negatives(anchors: Anchors, rows: Rows, best: Best, slots: int, low: int, high: int) -> None:
    every = slice(0, len(rows.ids))
    for start in range(0, len(anchors.keys), _CHUNK):
        some = np.arange(start, min(start + _CHUNK, len(anchors.keys)))
        about, half = anchors.intervals(some, rows, every)
        for line, anchor in enumerate(some):
            asked = [(s, int(v)) for s, v in enumerate(anchors.limits[anchor]) if v > _NONE and low * int(v) <= high * int(v)]
            if not asked:
                continue
            # Integers: low * p <= 100 * n <= high * p.
            windows = [(anchor * slots + s, -(-low * p // 100), high * p // 100) for s, p in asked]
            other = rows.labels != anchors.labels[anchor]
            upper, lower = about[line] + half[line], about[line] - half[line]

            def reach(windows=windows) -> float:
                return min(max(a, best.least[place]) for place, a, _ in windows)

            most = max(b for _, _, b in windows)
            open_ = np.flatnonzero(other & (upper >= reach()) & (lower <= most))
            if len(open_) > 4 * _PROBE:
                # Some rows of the largest estimates first: what they reach narrows the rest.
                near = about[line, open_]
                near = np.where(near <= min(b for _, _, b in windows), near, -np.inf)
                first = open_[np.argpartition(-near, _PROBE - 1)[:_PROBE]]
                _keep(anchors, rows, best, anchor, windows, first)
                open_ = open_[(upper[open_] >= reach()) & ~np.isin(open_, first)]
            _keep(anchors, rows, best, anchor, windows, open_)


def _keep(anchors: Anchors, rows: Rows, best: Best, anchor: int, windows: list[tuple[int, int, int]], at: np.ndarray) -> None:
    score = rows.scores(at, anchors.x[anchor])
    for place, a, b in windows:
        good = (score >= max(a, best.least[place])) & (score <= b)
        best.add(place, score[good], rows.ids[at][good], rows.keys[at][good])


def _scan(dimension: int, k: int, slots: int, low: int, high: int):
    """A scan of blocks for one wave: the k best rows of every anchor (slots 0), or of every window of its positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dimension)
        anchors = best = None
        for batch in batches:
            for row in range(batch.num_rows):
                block, names, labels, x, keys, own, vectors, limits = (batch.column(c)[row].as_py() for c in range(8))
                if anchors is None:
                    count = len(keys) // 8
                    anchors = Anchors(
                        np.frombuffer(keys, "<i8"),
                        np.frombuffer(own, "<i8"),
                        np.frombuffer(vectors, "<i4").reshape(count, dimension),
                        np.frombuffer(limits, "<i8").reshape(count, -1) if slots else None,
                        turn,
                    )
                    best = Best(count * max(slots, 1), k)
                found = np.frombuffer(names, "<i8")
                rows = Rows(found, np.frombuffer(labels, "<i8"), np.frombuffer(x, "<i4").reshape(-1, dimension), block, turn)
                if slots:
                    _negatives(anchors, rows, best, slots, low, high)
                else:
                    _positives(anchors, rows, best)
        if best is not None:
            kept = [(place, *found) for place, found in enumerate(best.found) if found is not None]
            for start in range(0, len(kept), 4096):
                some = kept[start : start + 4096]
                places = np.repeat([place for place, *_ in some], [len(score) for _, score, *_ in some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors.keys[places // max(slots, 1)]), pa.array((places % max(slots, 1)).astype(np.int32))]
                    + [pa.array(np.concatenate([entry[c] for entry in some])) for c in (1, 2, 3)],
                    names=["row_key", "slot", "score", "vec_id", "found_key"],
                )

    return run


_FOUND = "row_key bigint, slot int, score bigint, vec_id bigint, found_key bigint"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = 0
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            some = batch.slice(start, BLOCK)
            first = (some.column(0)[0].as_py() << 40) + at
            at += some.num_rows
            numbers = [some.column(c).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for c in (1, 2)]
            x = some.column(3).flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
            yield pa.RecordBatch.from_pydict({"block": [first], "ids": [numbers[0]], "labels": [numbers[1]], "x": [x]})


def _anchors_of(every: int):
    """The anchors of blocks as rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, names, labels, x in zip(*(column.to_pylist() for column in batch.columns)):
                ids = np.frombuffer(names, "<i8")
                at = np.flatnonzero(ids % every == 0)
                width = len(x) // max(len(ids), 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block + at),
                        pa.array(ids[at]),
                        pa.array(np.frombuffer(labels, "<i8")[at]),
                        pa.array([x[i * width : (i + 1) * width] for i in at], pa.binary()),
                    ],
                    names=["row_key", "anchor_id", "label", "x"],
                )

    return run


def _wave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, row_key, label, x, limits) of a partition as waves of at most WAVE."""
    held: list[tuple] = []
    name, number = 0, 0

    def out() -> pa.RecordBatch:
        nonlocal number
        keys, labels, x, limits = zip(*held)
        number += 1
        numbers = [np.array(v, "<i8").tobytes() for v in (keys, labels)]
        return pa.RecordBatch.from_pydict(
            {
                "wave": [f"{name}.{number}"],
                "row_keys": [numbers[0]],
                "own": [numbers[1]],
                "vectors": [b"".join(x)],
                "limits": [b"" if limits[0] is None else np.array(limits, "<i8").tobytes()],
            }
        )

    for batch in batches:
        for part, *row in zip(*(column.to_pylist() for column in batch.columns)):
            name = part
            held.append(tuple(row))
            if len(held) == WAVE:
                yield out()
                held.clear()
    if held:
        yield out()


def _scanned(blocks: DataFrame, anchors: DataFrame, count: int, run, what: str) -> DataFrame:
    """What the scans of all waves found; a wave is one row of bounded size that every task receives."""
    dealt = anchors.repartition(max(1, -(-count // WAVE))).select(F.spark_partition_id().alias("part"), "row_key", "label", "x", "limits")
    waves = stage(dealt.mapInArrow(_wave, _WAVE), f"{what}-waves")
    found = blocks.sparkSession.createDataFrame([], _FOUND)
    for row in waves.select("wave").collect():
        one = waves.filter(F.col("wave") == row.wave)
        tiles = blocks.withColumn("wave", F.lit(row.wave)).join(F.broadcast(one), "wave").drop("wave")
        found = found.unionByName(stage(tiles.mapInArrow(run, _FOUND), what))
    return found


def hard_negatives(
    vectors: DataFrame,
    relabel=None,
    anchor_every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows whose id is divisible by anchor_every; relabel is a function from (id, label)
    columns to the label that counts. A negative's score lies between the two percentages of the positive's.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("x")
    )
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0))
    rows = rows.filter(usable("x", F.size("x"), scale))
    if relabel is not None:
        rows = rows.withColumn("label", relabel(F.col("vec_id"), F.col("label")))
    size = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame(
        [], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    )
    if not size:
        return empty
    dimension = size.n
    whole = F.transform("x", lambda x: F.floor(x * float(scale)).cast("int")).alias("x")
    rows = rows.filter(F.size("x") == dimension).select(F.spark_partition_id().alias("part"), "vec_id", "label", whole)
    blocks = stage(rows.mapInArrow(_packed, _BLOCK), "vector-blocks")
    anchors = stage(blocks.mapInArrow(_anchors_of(anchor_every), _ANCHOR), "anchors")
    count = anchors.count()

    no_limits = anchors.withColumn("limits", F.lit(None).cast("array<bigint>"))
    found = _scanned(blocks, no_limits, count, _scan(dimension, positives, 0, *window), "positives")
    order = Window.partitionBy("row_key").orderBy(F.desc("score"), "vec_id", "found_key")
    best = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    # At most `positives` entries each, in order.
    lists = stage(best.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found")), "positive-lists")
    scores = F.transform("found", lambda x: x["score"])
    limits = F.concat(scores, F.array_repeat(F.lit(_NONE), F.lit(positives) - F.size("found"))).alias("limits")
    asked = anchors.join(lists, "row_key").select("row_key", "label", "x", limits)
    found = _scanned(blocks, asked, count, _scan(dimension, negatives, positives, *window), "negatives")
    order = Window.partitionBy("row_key", "slot").orderBy(F.desc("score"), "vec_id", "found_key")
    best = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= negatives)
    names = anchors.select("row_key", "anchor_id").join(lists, "row_key").select("row_key", "anchor_id", F.posexplode("found").alias("slot", "p"))
    return best.join(names, ["row_key", "slot"]).select(
        "anchor_id",
        F.col("p.vec_id").alias("positive_id"),
        "rank",
        F.col("vec_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
