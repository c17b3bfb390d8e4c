"""p2: personal information in history_messages and memory_records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.pii import pii_items, redacted
from mnemospark.runtime import table

TABLES = ("history_messages", "memory_records")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(t).alias("source_table"), F.col("id").alias("source_id"), "text") for t in TABLES]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii_items(_texts(spark, d)).select("source_table", "source_id", "pii_type", "start_pos")


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Resent rows are one record; every other text comes out, with placeholders where items were."""
    return redacted(_texts(spark, d).dropDuplicates(["source_table", "source_id"]))


def queries() -> dict:
    return {"p2_found": p2_found, "p2_redacted": p2_redacted}


def oracle_sql() -> dict[str, str]:
    return {}
