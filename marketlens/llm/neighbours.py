"""Nearest neighbours by one hierarchical navigable small-world graph per shard, with shard results merged.

Equal vectors are one node that keeps its smallest ids. Nodes are dealt to shards of about SHARD by a
hash. A shard's graph is one row: ids, vectors and flat neighbour arrays of every level. Candidate
links of a level are the nearest nodes of that level, pruned by the usual rule (a candidate stays if
it is nearer to the node than to any link kept before), with links back and a few random ones, so that
every part can be reached. Inner product becomes a distance by one more coordinate that gives all
vectors one length; for queries it is zero. A search descends from the top level to a beam on the
lowest one, many queries at a time. Every node is indexed and every shard is searched.

Empty cases: vectors that are null, zero, hold a null or non-finite component, or differ in length
from most take no part, nor do rows with a null id; an empty table gives an empty result; a repeated
id counts once for each different vector.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import stage

SHARD, LINKS, BEAM, WIDE = 8192, 16, 128, 6
BLOCK = 4096
_AT_ONCE = 256


def _lifted(x: np.ndarray) -> np.ndarray:
    """Vectors with one more coordinate, so that all have the length of the longest."""
    square = (x.astype(np.float64) ** 2).sum(axis=1)
    return np.column_stack([x, np.sqrt(np.maximum(square.max() - square, 0))]).astype(np.float32)


def _level_links(x: np.ndarray, links: int, random: np.random.Generator) -> np.ndarray:
    """A flat row of at most 2 * links neighbours for each vector, -1 where there are fewer."""
    n, most = len(x), 2 * links
    out = np.full((n, most), -1, np.int32)
    if n < 2:
        return out
    pool = min(n - 1, 4 * links)
    kept = np.full((n, links), -1, np.int32)
    for start in range(0, n, 512):
        rows = np.arange(start, min(start + 512, n))
        near = x[rows] @ x.T
        near[np.arange(len(rows)), rows] = -np.inf
        some = np.argpartition(-near, pool - 1, axis=1)[:, :pool]
        value = np.take_along_axis(near, some, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        some, value = np.take_along_axis(some, order, axis=1), np.take_along_axis(value, order, axis=1)
        between = np.einsum("rid,rjd->rij", x[some], x[some])
        chosen = np.zeros(some.shape, bool)
        for k in range(pool):
            hidden = (chosen[:, :k] & (between[:, k, :k] > value[:, k : k + 1])).any(axis=1)
            chosen[:, k] = ~hidden & (chosen.sum(axis=1) < links)
        # Room that pruning leaves goes to the nearest pruned ones.
        first = np.argsort(~chosen, axis=1, kind="stable")[:, :links]
        kept[rows, : first.shape[1]] = np.take_along_axis(some, first, axis=1)
    far = random.integers(0, n, (n, 2)).astype(np.int32)
    source = np.concatenate([np.repeat(np.arange(n), links), kept.ravel(), np.repeat(np.arange(n), 2), far.ravel()])
    target = np.concatenate([kept.ravel(), np.repeat(np.arange(n), links), far.ravel(), np.repeat(np.arange(n), 2)])
    # Own links first, then random ones, then links back, up to the room of a row.
    rank = np.concatenate([np.zeros(kept.size), np.full(kept.size, 2), np.ones(far.size), np.full(far.size, 3)])
    good = (source >= 0) & (target >= 0) & (source != target)
    pairs = pd.DataFrame({"s": source[good], "t": target[good], "r": rank[good]}).sort_values(["s", "r"], kind="stable").drop_duplicates(["s", "t"])
    place = pairs.groupby("s").cumcount().to_numpy()
    fits = place < most
    out[pairs.s.to_numpy()[fits], place[fits]] = pairs.t.to_numpy()[fits]
    return out


class Graph:
    """Levels of one shard, lowest first: the nodes of each and their links, as positions in the shard."""

    def __init__(self, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.levels = vectors, levels

    @classmethod
    def built(cls, vectors: np.ndarray, seed: int) -> Graph:
        random = np.random.default_rng(seed)
        x = _lifted(vectors)
        height = np.floor(-np.log(1 - random.random(len(x))) / math.log(LINKS)).astype(int)
        levels = []
        for level in range(int(height.max()) + 1):
            nodes = np.flatnonzero(height >= level).astype(np.int32)
            links = _level_links(x[nodes], LINKS, random)
            levels.append((nodes, np.where(links >= 0, nodes[links], -1).astype(np.int32)))
        return cls(vectors, levels)

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and inner products of the k best found for each query, best first; -1 where there are fewer."""
        n, count = len(self.vectors), len(queries)
        enter = np.repeat(self.levels[-1][0][:1], count)[:, None]
        for level in range(len(self.levels) - 1, -1, -1):
            enter, value = self._beam(queries, enter, level, max(BEAM, k) if level == 0 else 8)
        order = np.argsort(-value, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(enter, order, axis=1)
        return found, np.take_along_axis(value, order, axis=1)

    def _beam(self, queries: np.ndarray, enter: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        nodes, links = self.levels[level]
        row_of = np.full(len(self.vectors), -1, np.int64)
        row_of[nodes] = np.arange(len(nodes))
        count = len(queries)
        lines = np.arange(count)[:, None]
        ids = np.full((count, size), -1, np.int64)
        value = np.full((count, size), -np.inf, np.float32)
        done = np.ones((count, size), bool)
        width = min(size, enter.shape[1])
        ids[:, :width] = enter[:, :width]
        known = ids >= 0
        value[known] = np.einsum("qd,qd->q", np.repeat(queries, known.sum(axis=1), axis=0), self.vectors[ids[known]])
        done[known] = False
        seen = np.zeros((count, len(self.vectors) + 1), bool)
        seen[np.broadcast_to(lines, ids.shape)[known], ids[known]] = True
        seen[:, -1] = True
        while not done.all():
            open_ = np.where(done, -np.inf, value)
            pick = np.argpartition(-open_, min(WIDE, size) - 1, axis=1)[:, :WIDE]
            live = ~np.take_along_axis(done, pick, axis=1)
            done[np.broadcast_to(lines, pick.shape), pick] = True
            at = np.where(live, row_of[np.take_along_axis(ids, pick, axis=1)], -1)
            near = np.where(at[:, :, None] >= 0, links[at], -1).reshape(count, -1)
            near = np.sort(near, axis=1)
            new = ~seen[lines, near]
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[lines, near] = True
            more = np.full(near.shape, -np.inf, np.float32)
            who, where = np.nonzero(new)
            if not len(who):
                continue
            more[who, where] = np.einsum("nd,nd->n", queries[who], self.vectors[near[who, where]])
            all_value = np.concatenate([value, more], axis=1)
            best = np.argpartition(-all_value, size - 1, axis=1)[:, :size]
            value = np.take_along_axis(all_value, best, axis=1)
            ids = np.take_along_axis(np.concatenate([ids, np.where(new, near, -1)], axis=1), best, axis=1)
            done = np.take_along_axis(np.concatenate([done, ~new], axis=1), best, axis=1) | (value == -np.inf)
        return ids, value


_INDEX = "shard int, nodes binary, vectors binary, sizes array<int>, members array<binary>, links array<binary>"


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("node")
    vectors = np.stack(frame["vector"].to_numpy()).astype(np.float32)
    shard = int(frame["shard"].iloc[0])
    graph = Graph.built(vectors, shard)
    return pd.DataFrame(
        {
            "shard": [shard],
            "nodes": [frame["node"].to_numpy(np.int64).tobytes()],
            "vectors": [vectors.tobytes()],
            "sizes": [[len(nodes) for nodes, _ in graph.levels]],
            "members": [[nodes.tobytes() for nodes, _ in graph.levels]],
            "links": [[links.tobytes() for _, links in graph.levels]],
        }
    )


def index(nodes: DataFrame, count: int) -> DataFrame:
    """One row per shard from (node, vector)."""
    shards = max(1, -(-count // SHARD))
    return nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(_build, _INDEX)


def _searcher(k: int, dimension: int):
    def run(graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(graphs) and len(queries):
            row = graphs.iloc[0]
            nodes = np.frombuffer(row["nodes"], np.int64)
            vectors = np.frombuffer(row["vectors"], np.float32).reshape(-1, dimension)
            levels = [
                (np.frombuffer(m, np.int32), np.frombuffer(x, np.int32).reshape(n, -1)) for n, m, x in zip(row["sizes"], row["members"], row["links"])
            ]
            graph = Graph(vectors, levels)
            q = np.stack(queries["vector"].to_numpy()).astype(np.float32)
            names = queries["query"].to_numpy(np.int64)
            for start in range(0, len(q), _AT_ONCE):
                some = q[start : start + _AT_ONCE]
                found, _ = graph.search(some, k)
                who, where = np.nonzero(found >= 0)
                at = found[who, where]
                exact = np.einsum("nd,nd->n", some[who].astype(np.float64), vectors[at].astype(np.float64))
                out.append(pd.DataFrame({"query": names[start + who], "node": nodes[at], "score": exact}))
        return pd.concat(out) if out else pd.DataFrame({"query": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "score": np.zeros(0)})

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found, for the rows for which is_query (a condition on vec_id) holds."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.forall("vector", good) & F.exists("vector", lambda x: x != 0))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dimension = size.n if size else 1
    rows = rows.filter(F.size("vector") == dimension).distinct()
    # The smallest ids of equal vectors: one more than are asked for, as a query's own does not count.
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    nodes = stage(
        rows.withColumn("place", F.row_number().over(smallest))
        .filter(F.col("place") <= k + 1)
        .groupBy("vector")
        .agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")),
        "nodes",
    )
    # A repeated id with several vectors may name several nodes: number them apart.
    nodes = nodes.withColumn("node", F.when(F.count("*").over(Window.partitionBy("node")) == 1, F.col("node")).otherwise(F.xxhash64("node", "vector")))
    nodes = stage(nodes, "nodes")
    queries = stage(rows.filter(is_query).join(nodes.select("vector", F.col("node").alias("query")), "vector").select("vec_id", "query"), "queries")
    asked = stage(nodes.join(queries.select(F.col("query").alias("node")).distinct(), "node").select(F.col("node").alias("query"), "vector"), "asked")
    count, n_asked = nodes.count(), asked.count()
    graphs = stage(index(nodes.select("node", "vector"), count), "index")
    shards, blocks = max(1, -(-count // SHARD)), max(1, -(-n_asked // BLOCK))
    spread = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    copies = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = (
        copies.groupBy("shard", "block")
        .cogroup(spread.groupBy("shard", "block"))
        .applyInPandas(_searcher(k + 1, dimension), "query bigint, node bigint, score double")
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    top = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    # The best ids of each asked vector, then those of each query row less its own.
    listed = top.join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    by_vector = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = (
        listed.withColumn("place", F.row_number().over(by_vector))
        .filter(F.col("place") <= k + 1)
        .groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    )
    lists = stage(lists, "lists")
    answers = queries.join(lists, "query").select(
        F.col("vec_id").alias("query_id"),
        F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("found"),
    )
    return answers.select("query_id", F.posexplode("found").alias("place", "x")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )
