"""Exact k-means rounds that skip most distances by bounds on total displacement.

For every vector an upper bound of the distance to its own centroid and a lower bound to each other
one are kept, each with the round it was computed in. All centroids of all rounds are kept too (rounds
times k, bounded). A bound is loosened by the norm of the one displacement between the centroid of that
round and today's, not by the sum of the drifts in between, so it stays tight when centroids wander
back. A vector whose upper bound lies below all its lower bounds keeps its centroid unread; otherwise its
own distance is computed exactly, then those to the centroids whose bounds still fail, and integers decide.

Vectors are packed once into blocks and written bucketed by block; the bounds, about a sixth of the
vectors' size, are a table bucketed likewise, rewritten each round, so a round joins the two without
a shuffle. What leaves the tasks of a round is, per block, the change of each centroid's sum and count,
added up by Spark; after the first round only vectors that moved contribute. Each round is a written table.

Defined cases: a vector takes part if it has an id and exactly `dimension` components, none null, non-finite
or so large that a squared distance could leave 64 bits (|scale * x| below 2**26). Rows are vectors: equal ones
and repeated ids each count. Equal hashes (repeated ids) start in order of their components; with fewer
vectors than k there are as many centroids as vectors; an empty table gives an empty result. Ties go to the
smaller centroid; empty centroids stay where they are. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import shared_dir, stage

#: Vectors of a block, and blocks of a bucket.
BLOCK, BLOCKS = 4096, 256
#: Largest integer component: squared distances of up to 1,024 components stay below 2**63.
LARGEST = 2**26
_BLOCKS = "block bigint, ids binary, x binary"
_STATE = "block bigint, state binary, moved array<bigint>, scans bigint"


def usable(column, dimension: int, scale: int):
    """A condition: exactly `dimension` components, all finite and small enough when scaled."""
    return (F.size(column) == dimension) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < LARGEST))


def integers(vectors: DataFrame, dimension: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).filter(usable("x", dimension, scale))
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * float(scale)).cast("int")).alias("x"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = 0
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            some = batch.slice(start, BLOCK)
            block = (some.column(0)[0].as_py() << 32) + count
            count += 1
            ids = some.column(1).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
            x = some.column(2).flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
            yield pa.RecordBatch.from_pydict({"block": [block], "ids": [ids], "x": [x]})


class Bounds:
    """Centroids of all rounds so far, and the bounds of a block against them."""

    def __init__(self, history: np.ndarray):
        self.history, self.now = history, len(history) - 1
        k = history.shape[1]
        self.kind = np.dtype([("own", "i1"), ("upper", "<f4"), ("at", "i1"), ("lower", "<f4", (k,)), ("seen", "i1", (k,))])
        gap = (history - history[-1]).astype(np.float64)
        #: Norm of the total displacement of each centroid from each round to now, never too small.
        self.moved = np.sqrt((gap**2).sum(axis=2)) * (1 + 1e-9)

    def distances(self, x: np.ndarray, k: int) -> np.ndarray:
        return ((x - self.history[-1, k]) ** 2).sum(axis=1)

    def first(self, x: np.ndarray) -> np.ndarray:
        all_ = np.stack([self.distances(x, k) for k in range(self.history.shape[1])], axis=1)
        state = np.zeros(len(x), self.kind)
        state["own"] = all_.argmin(axis=1)
        state["upper"] = _above(all_[np.arange(len(x)), state["own"]])
        state["lower"] = _below(all_)
        return state

    def next(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, int]:
        """The state of this round and the number of distances computed for it."""
        state = state.copy()
        lines = np.arange(len(x))
        own = state["own"].astype(int)
        upper = state["upper"] + self.moved[state["at"], own]
        lower = state["lower"] - self.moved[state["seen"], np.arange(self.history.shape[1])]
        lower[lines, own] = np.inf
        # Rounding of the sums above is far below this slack.
        fails = lines[upper * (1 + 1e-9) + 1e-9 >= lower.min(axis=1)]
        if not len(fails):
            return state, 0
        before, scans = own[fails], len(fails)
        exact = np.full((len(fails), self.history.shape[1]), np.iinfo(np.int64).max)
        for k in np.unique(before):
            some = np.flatnonzero(before == k)
            exact[some, k] = self.distances(x[fails[some]], k)
        tight = _above(exact[np.arange(len(fails)), before]).astype(np.float64)
        for k in range(self.history.shape[1]):
            some = np.flatnonzero((before != k) & (lower[fails, k] <= tight * (1 + 1e-9) + 1e-9))
            scans += len(some)
            exact[some, k] = self.distances(x[fails[some]], k)
        who, where = np.nonzero(exact < np.iinfo(np.int64).max)
        state["lower"][fails[who], where] = _below(exact[who, where])
        state["seen"][fails[who], where] = self.now
        best = exact.argmin(axis=1)
        state["own"][fails] = best
        state["upper"][fails] = _above(exact[np.arange(len(fails)), best])
        state["at"][fails] = self.now
        return state, scans


def _above(square: np.ndarray) -> np.ndarray:
    return np.nextafter((np.sqrt(square) * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))


def _below(square: np.ndarray) -> np.ndarray:
    return np.nextafter((np.sqrt(square) * (1 - 1e-9)).astype(np.float32), np.float32(-np.inf))


def _changes(x: np.ndarray, before: np.ndarray | None, after: np.ndarray, k: int) -> list[int]:
    """Per centroid, by how much its component sums and its count change, as one flat list."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    some = slice(None) if before is None else before != after
    for sign, own in ((1, after), (-1, before)):
        if own is not None:
            for c in np.unique(own[some]):
                rows = x[some][own[some] == c]
                out[c, :-1] += sign * rows.sum(axis=0)
                out[c, -1] += sign * len(rows)
    return out.ravel().tolist()


def _round(history: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(history)
        k, dimension = history.shape[1:]
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["x"], "<i4").reshape(-1, dimension).astype(np.int64)
                if row["state"] is None:
                    before, state, scans = None, bounds.first(x), len(x) * k
                else:
                    old = np.frombuffer(row["state"], bounds.kind)
                    before, (state, scans) = old["own"], bounds.next(x, old)
                moved = _changes(x, before, state["own"], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]]), pa.array([state.tobytes()]), pa.array([moved], pa.list_(pa.int64())), pa.array([scans])],
                    names=["block", "state", "moved", "scans"],
                )

    return run


def _assigned(history: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = Bounds(history).kind
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["x"], "<i4").reshape(-1, history.shape[2]).astype(np.int64)
                own = np.frombuffer(row["state"], kind)["own"].astype(np.int32)
                far = ((x - history[-1][own]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(row["ids"], "<i8")), pa.array(own), pa.array(far)], names=["vec_id", "cluster", "distance"]
                )

    return run


class Bucketed:
    """Tables of the shared folder that are bucketed by block, known to the session's catalog until dropped."""

    def __init__(self, df: DataFrame, buckets: int):
        self.spark, self.buckets = df.sparkSession, buckets
        self.folder, self.names = shared_dir(self.spark), []

    def write(self, df: DataFrame, what: str) -> DataFrame:
        name = f"llm_{what}_{uuid.uuid4().hex}"
        df.write.option("path", f"{self.folder}/{name}").bucketBy(self.buckets, "block").format("parquet").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def cluster_rounds(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    scale: int = 1024,
    dimension: int = 64,
    seed: int = 3,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray, list[int]]:
    """vec_id, cluster and squared distance of every vector after `rounds` rounds and a last assignment; the
    centroids of all rounds; the number of distances computed in each round."""
    spark = vectors.sparkSession
    rows = integers(vectors, dimension, scale, id_col, vector_col)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = rows.select(order.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    if not start:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), np.zeros((1, 0, dimension), np.int64), []
    centroids = np.array([row.x for row in start], np.int64)
    count = rows.count()
    buckets = max(-(-count // (BLOCK * BLOCKS)), min(-(-count // BLOCK), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    tables = Bucketed(rows, min(buckets, 100_000))
    packed = rows.select(F.spark_partition_id().alias("part"), "vec_id", "x").mapInArrow(_pack, _BLOCKS)
    blocks = tables.write(packed.repartition(tables.buckets, "block"), "blocks")

    history, sums, scans, state = [centroids], [[0] * (dimension + 1) for _ in centroids], [], None
    for number in range(rounds + 1):
        if state is None:
            joined = blocks.withColumn("state", F.lit(None).cast("binary"))
        else:
            joined = blocks.join(state.select("block", "state").hint("shuffle_hash"), "block")
        state = tables.write(joined.select("block", "x", "state").mapInArrow(_round(np.stack(history)), _STATE), "bounds")
        total = state.select("scans", F.posexplode("moved").alias("place", "by")).groupBy("place")
        changes = total.agg(F.sum(F.col("by").cast("decimal(38,0)")).alias("by"), F.sum("scans").alias("scans")).collect()
        scans.append(int(changes[0].scans))
        for row in changes:
            sums[row.place // (dimension + 1)][row.place % (dimension + 1)] += int(row.by)
        if number < rounds:
            # Exact integers of any size: floor of the mean; a centroid without vectors stays.
            means = [[s // c[-1] for s in c[:-1]] if c[-1] else old.tolist() for c, old in zip(sums, history[-1])]
            history.append(np.array(means, np.int64))
    done = np.stack(history)
    joined = blocks.join(state.select("block", "state").hint("shuffle_hash"), "block").select("ids", "x", "state")
    found = stage(joined.mapInArrow(_assigned(done), "vec_id bigint, cluster int, distance bigint"), "clusters")
    tables.drop()
    return found, done, scans


def clustered(vectors: DataFrame, **settings) -> DataFrame:
    """Per vector: vec_id, cluster, distance, the sum of distances in its cluster and over all, and the
    sha256 of its final centroid's components as decimal integers joined by commas."""
    found, history, _ = cluster_rounds(vectors, **settings)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    of = {row.cluster: int(row.s) for row in sums}
    rows = [
        (k, of.get(k, 0), sum(of.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for k, c in enumerate(history[-1].tolist())
    ]
    # One row per centroid.
    small = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(small), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
