"""p7: the documents' sources mixed to the shares of mix_targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemospark.llm.mixing import mix_sources, mixing_plan, mixture_shares, prepared
from mnemospark.runtime import checkpointed, table


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return prepared(table(spark, d, "documents").select("doc_id", "text", "source"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(_sized(spark, d), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    sized, targets = _sized(spark, d), table(spark, d, "mix_targets")
    return mixture_shares(checkpointed(mix_sources(sized, targets)), mixing_plan(sized, targets))


def queries() -> dict:
    return {"p7_mixture": p7_mixture, "p7_shares": p7_shares}


def oracle_sql() -> dict[str, str]:
    return {}
