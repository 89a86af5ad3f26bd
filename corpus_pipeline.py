"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all rows the one before it kept and writes a table the next one reads. Null and empty texts are
empty texts: they pass or fall by their quality score, are nobody's near copy, hold no personal data and pack as
their end token. Rows without an id stay where no label names them. Equal texts: the smallest id stays. Columns beyond those
of documents are carried along under their own names. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marketlens.llm.common import crc_mod, read_table, stage
from marketlens.llm.mixing import label_domain, mixed_rows
from marketlens.llm.near_dup import unrepeated_rows
from marketlens.llm.packing import pack
from marketlens.llm.pii import redacted_rows
from marketlens.llm.quality import good_rows

#: Target token weights: good and clean, good and toxic, poor and clean, poor and toxic texts. Good and clean texts are
#: never dropped and no others copied, so where fewer than these shares are toxic the rest goes to clean ones.
TARGETS = [0.96, 0.04, 0.0, 0.0]
CLEAN = 0
#: Rows of an Arrow batch. Rows hold whole texts, and a task holds its batch several times over, on both sides of Arrow.
BATCH_ROWS = "500"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return good_rows(docs, read_table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) == 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return unrepeated_rows(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return redacted_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixed_rows(docs, read_table(spark, sf_dir, "labels"), label_domain(), TARGETS, crc_mod("doc_id", 5) != 0, keep=CLEAN)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)


STAGES = [
    ("quality", keep_good),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact),
    ("mixing", mix),
    ("packing", pack_sequences),
]
#: Fitted models and a tokenizer are beyond SQL: what the stages decide is tested in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
