"""JSON sinks and sources: training records as lines, one report document per category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import schema


def write_sft_jsonl(records: DataFrame, path: str) -> None:
    """One JSON object per line; non-ASCII characters are kept."""
    records.select("messages").write.mode("overwrite").json(path)


def read_sft_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.RECORDS).json(path)


def write_report_json(reports: DataFrame, path: str) -> None:
    """Report documents as JSON lines in one folder per category; nulls are written."""
    text = F.to_json(F.struct(*[F.col(c) for c in reports.columns]), {"ignoreNullFields": "false"})
    reports.select(F.col("categoryId").alias("category_id"), text.alias("value")).repartition("category_id").write.mode("overwrite").partitionBy("category_id").text(path)
