"""Registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.centroids import clustered
from marketlens.llm.common import crc_mod, read_table
from marketlens.llm.lattice import score_documents
from marketlens.llm.licenses import license_notices
from marketlens.llm.mixing import label_domain, mixing_rates
from marketlens.llm.near_dup import near_duplicates
from marketlens.llm.negatives import hard_negatives
from marketlens.llm.neighbours import nearest
from marketlens.llm.packing import pack
from marketlens.llm.pii import personal_data
from marketlens.llm.quality import quality
from marketlens.llm.repeats import remove_repeats
from marketlens.llm.rules import quality_rules
from marketlens.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op2_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op5_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), crc_mod("doc_id", 7) == 2, class_col="lang")


@query
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


@query
def op3_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, name) for name in ("documents", "labels"))
    return toxicity(docs, labels, crc_mod("doc_id", 5) == 0)


@query
def op6_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, name) for name in ("documents", "labels"))
    return quality(docs, labels, crc_mod("doc_id", 5) == 0)


@query
def op9_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read_table(spark, sf_dir, "documents"))


@query
def op10_decision_list_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, name) for name in ("documents", "labels"))
    return quality_rules(docs, labels)


@query
def op8_hnsw_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, name) for name in ("documents", "labels"))
    found = mixing_rates(docs, labels, label_domain(), [0.7, 0.1, 0.15, 0.05], crc_mod("doc_id", 5) != 0)
    return found.select("doc_id", "n_tokens", F.col("p").alias("domain_probabilities"), "rate", "copies", "residual")


@query
def op11_displacement_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(read_table(spark, sf_dir, "embeddings"))


@query
def op12_fuzzy_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_notices(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").alias("n_spans"))


@query
def op13_one_bit_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(
        read_table(spark, sf_dir, "embeddings"), lambda vec_id, label: F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    )


def _rounds_sql(rounds: int = 10) -> str:
    """The rounds of op11 as one chain of common tables."""
    vector = "list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)::BIGINT)"
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS line, vec_id, {vector} AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
        """c0 AS MATERIALIZED (SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept) WHERE c < 8)""",
    ]
    for r in range(rounds + 1):
        far = "list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT"
        steps.append(f"a{r} AS MATERIALIZED (SELECT line, min({far} * 8 + c) AS best FROM kept k, c{r} c GROUP BY line)")
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN (
                SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
                    SELECT best % 8 AS c, i, sum(v[i]) AS s, count(*) AS n FROM kept JOIN a{r} USING (line), range(1, 65) t(i) GROUP BY ALL
                ) GROUP BY c) m ON o.c = m.c)"""
            )
    return f"""WITH {", ".join(steps)}, digests AS (
        SELECT c, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM c{rounds}
    ) SELECT vec_id, (best % 8)::INTEGER AS cluster, best // 8 AS distance,
        (sum(best // 8) OVER (PARTITION BY best % 8))::BIGINT AS cluster_inertia, (sum(best // 8) OVER ())::BIGINT AS inertia, centroid_sha256
    FROM kept JOIN a{rounds} USING (line) JOIN digests ON c = best % 8"""


ORACLES["op11_displacement_bounds"] = _rounds_sql()

ORACLES["op13_one_bit_hard_negatives"] = """
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS line, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), scores AS MATERIALIZED (
    SELECT a.line AS anchor, a.vec_id AS anchor_id, b.vec_id, b.line, a.label = b.label AS same,
        list_dot_product(a.v, b.v)::BIGINT AS score
    FROM kept a JOIN kept b ON a.line <> b.line WHERE a.vec_id % 50 = 0
), positives AS (
    SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, line AS positive FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
) SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, vec_id))::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON s.anchor = p.anchor AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
