"""p8: reading levels of the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.mixing import source_name
from mnemospark.llm.reading import level_profile, reading_levels
from mnemospark.runtime import checkpointed, table


def language(column: str) -> Column:
    """The primary subtag, lower case: ' en ', 'EN' and 'en-XX' are en."""
    return F.lower(F.regexp_extract(column, r"([A-Za-z]+)", 1))


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text", language("lang").alias("group_name"))
    return reading_levels(documents, table(spark, d, "level_labels"))


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text", "scope", source_name("source").alias("source"), language("lang").alias("lang")).withColumn("group_name", F.col("lang"))
    return level_profile(checkpointed(reading_levels(documents, table(spark, d, "level_labels"))))


def queries() -> dict:
    return {"p8_levels": p8_levels, "p8_profile": p8_profile}


def oracle_sql() -> dict[str, str]:
    return {}
