"""p5: orphan references of memory_edges, experience_training_sources and evidence_quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.orphans import normal_key, orphan_references, orphan_report
from mnemospark.runtime import checkpointed, table


def _field(df: DataFrame, name: str, field: str, kind: str) -> DataFrame:
    """Resent rows are one record: the earliest arrival of an id counts."""
    one = df.groupBy("id").agg(F.min_by(field, "stored_at").alias("key"), F.min("stored_at").alias("seen_at"), F.min(field).alias("any_key"))
    return one.select(F.lit(name).alias("source_table"), F.col("id").alias("source_id"), F.lit(field).alias("field_name"), F.lit(kind).alias("kind"), F.coalesce("key", "any_key").alias("key"), F.col("seen_at").cast("timestamp").alias("seen_at"))


def references(spark: SparkSession, d: str) -> DataFrame:
    """All references in one shape; both ends of an edge come from one pass over the edges."""
    edges = table(spark, d, "memory_edges").groupBy("id").agg(F.min_by(F.struct("src", "dst"), "stored_at").alias("k"), F.min("stored_at").alias("seen_at"))
    ends = edges.select(
        F.lit("memory_edges").alias("source_table"),
        F.col("id").alias("source_id"),
        F.explode(F.array(F.struct(F.lit("src").alias("field_name"), F.col("k.src").alias("key")), F.struct(F.lit("dst").alias("field_name"), F.col("k.dst").alias("key")))).alias("f"),
        F.col("seen_at").cast("timestamp").alias("seen_at"),
    ).select("source_table", "source_id", "f.field_name", F.lit("node").alias("kind"), "f.key", "seen_at")
    sources = _field(table(spark, d, "experience_training_sources"), "experience_training_sources", "episode_id", "episode")
    quotes = _field(table(spark, d, "evidence_quotes"), "evidence_quotes", "event_id", "event")
    return ends.unionByName(sources).unionByName(quotes)


def parents(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, episodes and the events in the episodes' steps, with first arrival and whether the latest version holds them."""

    def versioned(df: DataFrame, kind: str) -> DataFrame:
        alive = F.max_by(F.col("op") == "put", F.struct("version", "stored_at"))
        first = F.min(F.when(F.col("op") == "put", F.col("stored_at")))
        return df.groupBy(normal_key("id").alias("key")).agg(first.alias("first_at"), alive.alias("alive")).select(F.lit(kind).alias("kind"), "key", F.col("first_at").cast("timestamp").alias("first_at"), "alive")

    nodes = table(spark, d, "memory_nodes").select("id", "version", "op", "stored_at")
    episodes = table(spark, d, "experience_episodes").select("id", "version", "op", "stored_at", F.col("steps.evidence.id").alias("events"))
    latest = episodes.groupBy(normal_key("id").alias("episode")).agg(F.max("version").alias("top"))
    listed = episodes.where("op = 'put'").select(normal_key("id").alias("episode"), "version", "stored_at", F.explode("events").alias("event")).select("episode", "version", "stored_at", normal_key("event").alias("key")).where("key IS NOT NULL")
    # an event is alive when the highest version of an episode that holds it still lists it
    events = (
        listed.join(latest, "episode")
        .groupBy("key")
        .agg(F.min("stored_at").alias("first_at"), F.max(F.col("version") == F.col("top")).alias("alive"))
        .select(F.lit("event").alias("kind"), "key", F.col("first_at").cast("timestamp").alias("first_at"), "alive")
    )
    return versioned(nodes, "node").unionByName(versioned(episodes, "episode")).unionByName(events)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(references(spark, d), parents(spark, d)).select("source_table", "source_id", "field_name")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    refs = references(spark, d)
    return orphan_report(checkpointed(orphan_references(refs, parents(spark, d))), refs)


def queries() -> dict:
    return {"p5_found": p5_found, "p5_report": p5_report}


_FOUND = """
WITH key_of AS (
  SELECT 'memory_edges' AS source_table, id AS source_id, 'src' AS field_name, 'node' AS kind, arg_min(src, stored_at) AS k, min(stored_at) AS seen_at FROM memory_edges GROUP BY id
  UNION ALL SELECT 'memory_edges', id, 'dst', 'node', arg_min(dst, stored_at), min(stored_at) FROM memory_edges GROUP BY id
  UNION ALL SELECT 'experience_training_sources', id, 'episode_id', 'episode', arg_min(episode_id, stored_at), min(stored_at) FROM experience_training_sources GROUP BY id
  UNION ALL SELECT 'evidence_quotes', id, 'event_id', 'event', arg_min(event_id, stored_at), min(stored_at) FROM evidence_quotes GROUP BY id),
refs AS (SELECT * EXCLUDE (k), lower(regexp_replace(k, '^\\s+|\\s+$', '', 'g')) AS key FROM key_of WHERE k IS NOT NULL AND trim(regexp_replace(k, '\\s', '', 'g')) <> ''),
ev AS (SELECT id AS episode, version, stored_at, lower(trim(s.evidence.id)) AS key FROM (SELECT id, version, stored_at, unnest(steps) AS s FROM experience_episodes WHERE op = 'put') WHERE s.evidence.id IS NOT NULL),
top AS (SELECT id AS episode, max(version) AS v FROM experience_episodes GROUP BY id),
parents AS (
  SELECT 'node' AS kind, lower(trim(id)) AS key, min(CASE WHEN op = 'put' THEN stored_at END) AS first_at, arg_max(op, version) = 'put' AS alive FROM memory_nodes GROUP BY ALL
  UNION ALL SELECT 'episode', lower(trim(id)), min(CASE WHEN op = 'put' THEN stored_at END), arg_max(op, version) = 'put' FROM experience_episodes GROUP BY ALL
  UNION ALL SELECT 'event', key, min(stored_at), max(CAST(version = v AS INT)) = 1 FROM ev JOIN top USING (episode) GROUP BY key),
orphans AS (
  SELECT r.*, CASE WHEN p.key IS NULL THEN 'missing' WHEN NOT alive THEN 'erased' ELSE 'later' END AS reason
  FROM refs r LEFT JOIN parents p ON r.kind = p.kind AND r.key = p.key WHERE p.key IS NULL OR NOT alive OR first_at > seen_at)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _FOUND + "SELECT source_table, source_id, field_name FROM orphans",
        "p5_report": _FOUND
        + """, n AS (SELECT source_table, field_name, strftime(seen_at, '%Y-%m') AS period, count(*) AS refs FROM refs GROUP BY ALL),
o AS (SELECT source_table, field_name, strftime(seen_at, '%Y-%m') AS period, count(*) FILTER (reason = 'missing') AS missing,
  count(*) FILTER (reason = 'erased') AS erased, count(*) FILTER (reason = 'later') AS later, count(*) AS orphans FROM orphans GROUP BY ALL)
SELECT n.source_table, n.field_name, n.period, coalesce(missing, 0) AS missing, coalesce(erased, 0) AS erased, coalesce(later, 0) AS later, coalesce(orphans, 0) AS orphans, refs
FROM n LEFT JOIN o USING (source_table, field_name, period)""",
    }
