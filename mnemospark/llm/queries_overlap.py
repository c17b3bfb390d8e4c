"""p1: overlaps between the held-out and training cases of the experience banks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.overlap import cross_split_overlaps, overlap_report
from mnemospark.llm.words import words_sql
from mnemospark.runtime import checkpointed, table


def _banks(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "experience_banks")
    return b.select(F.col("training_dataset_fingerprint").alias("training"), F.col("held_out_dataset_fingerprint").alias("held_out"))


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Resent rows of a case are equal, so they fall together with its text."""
    cases = table(spark, d, "evaluation_cases")
    records = cases.select("id", F.col("dataset_fingerprint").alias("dataset"), F.concat_ws(" ", "question", "reference").alias("text"))
    return cross_split_overlaps(records, _banks(spark, d), 0.7)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pair = _overlaps(spark, d).select(F.least("training_id", "held_out_id").alias("id_a"), F.greatest("training_id", "held_out_id").alias("id_b"))
    return pair.distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(checkpointed(_overlaps(spark, d)), table(spark, d, "evaluation_cases").select("id", "source").dropDuplicates(["id"]))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_report": p1_report}


#: All pairs of two datasets.
_SQL = f"""WITH c AS MATERIALIZED (SELECT id, any_value(dataset_fingerprint) AS ds, any_value(source) AS source, {words_sql("any_value(concat_ws(' ', question, reference))")} AS w FROM evaluation_cases GROUP BY id),
b AS (SELECT DISTINCT training_dataset_fingerprint AS training, held_out_dataset_fingerprint AS held_out FROM experience_banks WHERE training_dataset_fingerprint IS NOT NULL AND held_out_dataset_fingerprint IS NOT NULL),
p AS MATERIALIZED (SELECT training, held_out, x.id AS t, y.id AS h, x.source AS ts, y.source AS hs, len(list_intersect(x.w, y.w)) AS s, len(x.w) AS n, len(y.w) AS m FROM b JOIN c x ON x.ds = training JOIN c y ON y.ds = held_out AND x.id <> y.id WHERE len(x.w) > 0 AND len(y.w) > 0),
f AS MATERIALIZED (SELECT *, s = n AND s = m AS exact FROM p WHERE s >= 0.7 * (n + m - s))
"""


def oracle_sql() -> dict[str, str]:
    ends = "SELECT training, held_out, 'training' AS split, t AS id, ts AS source, exact FROM f UNION ALL SELECT training, held_out, 'held_out', h, hs, exact FROM f"
    return {
        "p1_found": _SQL + "SELECT DISTINCT least(t, h) AS id_a, greatest(t, h) AS id_b FROM f",
        "p1_report": _SQL + f"SELECT training, held_out, split, source, count(*) AS cases, count(*) FILTER (e) AS exact_cases, sum(k) AS links FROM (SELECT training, held_out, split, id, source, bool_or(exact) AS e, count(*) AS k FROM ({ends}) GROUP BY ALL) GROUP BY ALL",
    }
