"""Near duplicates by b-bit minwise signatures and a multi-index Hamming join.

A document's signature has `CHUNKS * LANES` minwise hashes of 16 bits each. Two signatures that
differ in fewer than `2 * CHUNKS` lanes have, by the pigeonhole principle, a chunk with at most one
differing lane. Every chunk is therefore indexed once for each lane that may differ, under its other
lanes: pairs within that distance always meet. Pairs that meet are confirmed on their full sets.

At a similarity of exactly 0.75 a chunk has at most one differing lane with probability 0.74, so a
pair misses all ten with 1.5e-6; the chance falls quickly above 0.75.

Groups of copies never turn into all their pairs. Equal sets are one class. In each bucket the
smallest class is held against the others; links found make components. What then is left to look at
are classes whose buckets hold several components. A link needs 3/7 of both sizes together in common,
so by the prefix filter two linked sets share one of their rarest shingles, of which each has few
enough to lie before the last three quarters of its set. Sets are dealt by those shingles; in the list
of one, only sets outside its commonest component meet the others, and only pairs whose places in both
sets leave room for a link come out and are confirmed.

Empty cases: documents without words have no shingles and no links; an empty table gives an empty
result. A null id is its own component (null) and kept. Rows that share an id count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import U64, components, hashed, mixed, sliced, stage, texts, word_hashes, words_of

WIDTH = 5
CHUNKS, LANES = 10, 4
_RANDOM = np.random.default_rng(20240229)
_PLACE = _RANDOM.integers(0, 2**63, WIDTH, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_FACTORS = _RANDOM.integers(0, 2**63, CHUNKS * LANES, dtype=np.int64).astype(U64) * U64(2) + U64(1)
#: Shingles hashed by all factors at a time.
_BLOCK = 1024


def shingle_set(text: bytes, memory) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a text."""
    words = hashed(words_of(text), memory)
    n = len(words)
    if n == 0:
        return words
    width = min(n, WIDTH)
    total = words[: n - width + 1] * _PLACE[0]
    for k in range(1, width):
        total = total + words[k : n - width + 1 + k] * _PLACE[k]
    return np.unique(mixed(total + U64(width)))


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(len(_FACTORS), ~U64(0))
    for start in range(0, len(shingles), _BLOCK):
        block = shingles[start : start + _BLOCK]
        least = np.minimum(least, (_FACTORS[:, None] * block[None, :]).min(axis=1))
    return (mixed(least) & U64(0xFFFF)).astype(np.uint16)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory = word_hashes()
    for batch in sliced(batches):
        sizes, digests, signatures = [], [], []
        for text in texts(batch.column(1)):
            shingles = shingle_set(text, memory)
            sizes.append(len(shingles))
            digests.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            signatures.append(signature(shingles).tobytes() if len(shingles) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
            names=["doc_id", "n_shingles", "digest", "signature"],
        )


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk and lane that may differ: chunk, that lane and the other three lanes in one number."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lanes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, CHUNKS, LANES).astype(np.int64)
        keys = np.empty(lanes.shape, np.int64)
        for free in range(LANES):
            value = np.arange(CHUNKS, dtype=np.int64)[None, :] * LANES + free
            for k in range(LANES):
                if k != free:
                    value = (value << 16) | lanes[:, :, k]
            keys[:, :, free] = value
        per = CHUNKS * LANES
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys.reshape(-1)),
                pa.array(np.repeat(batch.column(0).to_numpy(), per)),
                pa.array(np.repeat(batch.column(1).to_numpy(), per)),
            ],
            names=["key", "node", "n"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory = word_hashes()
    for batch in sliced(batches):
        found = [shingle_set(text, memory).tobytes() for text in texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "shingles"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shingle of a set, some sets at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            batch = whole.slice(at, 64)
            found = batch.column(2).to_pylist()
            sizes = [len(x) // 8 for x in found]
            repeated = [pa.array(np.repeat(batch.column(k).to_numpy(), sizes)) for k in range(2)]
            shingles = pa.array(np.frombuffer(b"".join(found), np.int64))
            yield pa.RecordBatch.from_arrays([*repeated, shingles], names=["set", "component", "shingle"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for left, right in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(left.as_buffer(), U64), np.frombuffer(right.as_buffer(), U64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= 75 * (len(both) - shared))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stage(
        docs.mapInArrow(_sign, "doc_id bigint, n_shingles bigint, digest binary, signature binary"), "signatures"
    )
    known = signed.filter("doc_id is not null and digest is not null")
    classes = stage(
        known.groupBy("digest").agg(
            F.min("doc_id").alias("node"), F.min("n_shingles").alias("n"), F.min("signature").alias("signature")
        ),
        "classes",
    )
    keys = classes.select("node", "n", "signature").mapInArrow(_index, "key bigint, node bigint, n bigint")
    # Only what shares a key goes on, with the bucket's first class beside it.
    buckets = stage(
        keys.groupBy("key")
        .agg(F.min(F.struct("node", "n")).alias("first"), F.max("node").alias("last"))
        .filter("first.node < last")
        .select("key", F.col("first.node").alias("first"), F.col("first.n").alias("first_n")),
        "buckets",
    )
    met = stage(keys.join(buckets, "key"), "met")
    sets = sets_of(docs, stage(met.select("node").distinct(), "members"))
    close = lambda x, y: (100 * F.least(x, y) >= 75 * F.greatest(x, y))
    tried = stage(
        met.filter((F.col("node") != F.col("first")) & close(F.col("n"), F.col("first_n")))
        .select(F.col("first").alias("a"), F.col("node").alias("b"))
        .distinct(),
        "pairs",
    )
    links = confirmed(sets, tried)
    found = stage(components(links), "components")
    # Classes of one bucket that are in different components and were not held against each other.
    labelled = met.select("key", "node", "n").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
    rest = stage(labelled.join(split, "key", "left_semi").select("node", "component").distinct(), "rest")
    extra = links_between(sets, rest)
    if extra.limit(1).count():
        found = stage(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(extra)), "components")
    of_class = classes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return (
        signed.join(of_class, "digest", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce(F.least("component", "doc_id"), "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def sets_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The shingle sets of the classes that share a bucket with another one, written once for all steps that hold sets against each other.

    Members are a written table of ids: while it is small Spark sends it to all tasks and no text is shuffled, else the texts are, once.
    """
    found = docs.join(members.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_sets, "node bigint, shingles binary")
    return stage(found.filter("length(shingles) > 0"), "sets")


def links_between(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """All links (a, b) between sets of different components, from (node, component)."""
    sets = sets.withColumn("set", F.xxhash64("node", "shingles"))
    size = (F.length("shingles") / 8).cast("bigint").alias("n")
    known = stage(sets.select("set", "node", size).join(nodes, "node").distinct(), "nodes")
    listed = _listed_sets(sets, known)
    # Three quarters of a linked set occur in some other component; without sets that fall short others may fall short too.
    abroad = stage(_abroad(listed), "abroad")
    able = listed.join(abroad.select("shingle"), "shingle").groupBy("set").agg(F.count("*").alias("m"))
    known = stage(able.join(known, "set").filter("100 * m >= 75 * n").drop("m"), "able")
    held = stage(postings(sets, known), "postings")
    return confirmed(sets, stage(candidates(held), "candidates"))


def _listed_sets(sets: DataFrame, known: DataFrame) -> DataFrame:
    found = sets.join(known.select("set", "component"), "set").select("set", "component", "shingles")
    return found.mapInArrow(_listed, "set bigint, component bigint, shingle bigint")


def _abroad(listed: DataFrame) -> DataFrame:
    """Shingles that occur in several components, and in how many sets."""
    found = listed.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("uses"))
    return found.filter("x < y").select("shingle", "uses")


def postings(sets: DataFrame, known: DataFrame) -> DataFrame:
    """(shingle, at, node, n, component): the shingles of each set that come before the last three quarters of it, rarest first.

    Shingles of one component only are the rarest of all and need no row. `at` is a shingle's place in its whole set, from 1.
    """
    listed = _listed_sets(sets, known)
    shared = listed.join(stage(_abroad(listed), "uses"), "shingle")
    ranked = shared.groupBy("set").agg(F.sort_array(F.collect_list(F.struct("uses", "shingle"))).alias("rare")).join(known, "set")
    ranked = ranked.withColumn("m", F.size("rare")).withColumn("most", F.expr("cast(m - (3 * n + 3) div 4 + 1 as int)")).filter("most > 0")
    return ranked.select("node", "n", "m", "component", F.posexplode(F.slice("rare", 1, F.col("most"))).alias("place", "x")).select(
        "x.shingle", (F.col("n") - F.col("m") + F.col("place") + 1).alias("at"), "node", "n", "component"
    )


def candidates(held: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, from postings."""
    counted = held.groupBy("shingle", "component").agg(F.count("*").alias("c"))
    main = counted.groupBy("shingle").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("several"))
    outside = held.join(main.filter("several > 1").drop("several"), "shingle").filter("component <> main")
    met = outside.alias("x").join(held.alias("y"), "shingle").filter(
        "x.component <> y.component and (y.component = main or x.node < y.node) "
        "and 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n) "
        "and 7 * (1 + least(x.n - x.at, y.n - y.at)) >= 3 * (x.n + y.n)"
    )
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def confirmed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= 75 * union."""
    held = (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
        .select("a", "b", "left", "right")
    )
    return stage(held.mapInArrow(_confirm, "a bigint, b bigint").distinct(), "links")


def unrepeated_rows(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, with all columns of docs: its smallest id; rows without an id all stay."""
    kept = near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    rest = docs.filter(F.col("doc_id").isNull())
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]).unionByName(rest)
