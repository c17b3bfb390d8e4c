"""Mining behaviour and stated claims from records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.numeric import POLICY, frequency_confidence
from mnemospark.functions.text import stated_claims


def skill_actions(records: DataFrame) -> DataFrame:
    """id, scope, session_id, turn, ord, action: the skill each recallable invocation used, by provenance or first line."""
    first_line = F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))
    name = F.coalesce("provenance.skill", first_line)
    used = records.where("record_use = 'recallable' AND kind = 'skill-invocation'").withColumn("name", name).where("name <> ''")
    return used.select("id", "scope", F.col("provenance.session_id").alias("session_id"), F.coalesce("provenance.turn", F.lit(-1)).alias("turn"), "ord", F.concat(F.lit("skill:"), F.col("name")).alias("action"))


def affinities(actions: DataFrame, by: list[str], least: int = POLICY["min_observations"]) -> DataFrame:
    """by, action, uses, sessions, confidence, first_id of actions seen at least ``least`` times."""
    t = actions.groupBy(*by, "action").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("session_id").alias("sessions"), F.min_by("id", "ord").alias("first_id"))
    return t.where(F.col("uses") >= least).withColumn("confidence", frequency_confidence("uses"))


def ngrams(actions: DataFrame, by: list[str], least: int = POLICY["min_repeats"], shortest: int = POLICY["min_sequence"], longest: int = POLICY["max_sequence"]) -> DataFrame:
    """by, length, label ('a > b'), occurrences, evidence (distinct records), confidence of sequences within a turn.

    Sequences never span turns. A turn's actions are windowed by lead(), so a long turn is never gathered into an array.
    """
    order = Window.partitionBy(*by, "session_id", "turn").orderBy("ord")
    ahead = actions.select(*by, "id", "action", *[F.lead(F.struct("action", "id"), k).over(order).alias(f"n{k}") for k in range(1, longest)])
    grams = None
    for length in range(shortest, longest + 1):
        steps = [F.col("action"), *[F.col(f"n{k}.action") for k in range(1, length)]]
        ids = [F.col("id"), *[F.col(f"n{k}.id") for k in range(1, length)]]
        g = ahead.where(F.col(f"n{length - 1}").isNotNull()).select(*by, F.lit(length).alias("length"), F.concat_ws(" > ", *steps).alias("label"), F.array(*ids).alias("ids"))
        grams = g if grams is None else grams.unionByName(g)
    counted = grams.groupBy(*by, "length", "label").agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") >= least)
    cited = grams.join(counted.select(*by, "length", "label"), [*by, "length", "label"], "left_semi").select(*by, "length", "label", F.explode("ids").alias("id")).distinct()
    evidence = cited.groupBy(*by, "length", "label").agg(F.count(F.lit(1)).alias("evidence"))
    return counted.join(evidence, [*by, "length", "label"]).withColumn("confidence", frequency_confidence("occurrences"))


def sequence_edges(procedures: DataFrame, by: list[str], known: DataFrame) -> DataFrame:
    """Edges that procedures (by, label, confidence) imply: 'part-of' for each step that is a known action, 'co-occurs' for
    consecutive known steps. by, from_label, to_label, relation, confidence (the greatest of the procedures').
    """
    steps = procedures.select(*by, "label", "confidence", F.posexplode(F.split("label", " > ")).alias("pos", "step"))
    held = steps.join(known.select(*by, F.col("action").alias("step")).distinct(), [*by, "step"], "left_semi")
    part = held.select(*by, F.col("step").alias("from_label"), F.col("label").alias("to_label"), F.lit("part-of").alias("relation"), "confidence")
    before = held.select(*by, "label", (F.col("pos") + 1).alias("pos"), F.col("step").alias("before"))
    pairs = held.join(before, [*by, "label", "pos"]).select(*by, F.col("before").alias("from_label"), F.col("step").alias("to_label"), F.lit("co-occurs").alias("relation"), "confidence")
    return part.unionByName(pairs).groupBy(*by, "from_label", "to_label", "relation").agg(F.max("confidence").alias("confidence"))


def claims(records: DataFrame, text: str = "text") -> DataFrame:
    """One row per stated claim: the records' columns and type, subject, sentence, no."""
    return records.select("*", F.posexplode(stated_claims(text)).alias("no", "c")).select("*", "c.type", "c.subject", "c.sentence").drop("c")


def stated_beliefs(found: DataFrame, by: list[str], order: list[Column], session: str, least: int = 1) -> DataFrame:
    """by, type, subject, statements, sessions, summary (first sentence), confidence of claims stated at least ``least`` times."""
    t = found.groupBy(*by, "type", "subject").agg(F.count(F.lit(1)).alias("statements"), F.count_distinct(session).alias("sessions"), F.min_by("sentence", F.struct(*order)).alias("summary"))
    return t.where(F.col("statements") >= least).withColumn("confidence", frequency_confidence("statements"))
