"""What several operators share: words and hashes inside tasks, tables in the shared folder, components of a graph."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII capitals to small letters, byte by byte; other characters stay.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share; an error where a cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table several jobs read to the shared folder: its lineage ends there and outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about `most` bytes, one row at least: what a task holds besides its batch stays small."""
    for batch in batches:
        rows = max(1, int(most * batch.num_rows / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    # A worker goes on to tasks of other stages: what Arrow keeps for later goes back.
    pa.default_memory_pool().release_unused()


def words_of(text: bytes) -> list[bytes]:
    """Words between the six ASCII white-space bytes, A-Z lowered."""
    return text.translate(LOWER).split()


class Remembered(dict):
    """Values of a function of words, kept until `limit` words are held, then started anew: bounded and exact."""

    def __init__(self, of, limit: int = 200_000):
        super().__init__()
        self.of, self.limit = of, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.of(word)
        return value


def word_hashes(limit: int = 200_000) -> Remembered:
    return Remembered(xxhash.xxh64_intdigest, limit)


def hashed(words: list[bytes], memory: Remembered) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, words), U64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def crc_mod(column: str, modulus: int):
    """crc32 of an id written as text, modulo a number; null ids count as remainder 1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(1))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node; the component is its smallest node.

    Rounds of large and small stars: each node's larger neighbours, then its smaller ones, are hung
    on its smallest neighbour, until every node hangs on one that hangs on none. Minima are written
    before they are joined, so that a hub's edges can be split between tasks.
    """
    edges = stage(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges"
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        # At most one smaller neighbour each, and that one has none: every tree is a star.
        rough = least.filter("m < u").join(edges, "u").filter("v <> m").limit(1).count() or (
            edges.join(least.filter("m < u").select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        )
        if not rough:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        large = stage(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(),
            "large",
        )
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = stage(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
