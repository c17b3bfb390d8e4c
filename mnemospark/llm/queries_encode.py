"""p6: token ids of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.encode import encode_texts
from mnemospark.runtime import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents").select("doc_id", "text"))


def p6_token_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of every token id in the corpus, and the documents that hold it."""
    mark = lambda ids, first: F.transform(ids, lambda t: F.struct(t.alias("token_id"), F.lit(first).alias("first")))
    # one pass: each id once per occurrence and once per document; sums are combined before the shuffle
    marked = p6_ids(spark, d).select(F.explode(F.concat(mark("ids", 0), mark(F.array_distinct("ids"), 1))).alias("m")).select("m.*")
    return marked.groupBy("token_id").agg(F.sum(1 - F.col("first")).alias("occurrences"), F.sum("first").alias("documents"))


def queries() -> dict:
    return {"p6_ids": p6_ids, "p6_token_frequencies": p6_token_frequencies}


def oracle_sql() -> dict[str, str]:
    return {}
