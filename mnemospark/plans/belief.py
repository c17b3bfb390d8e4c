"""Queries of beliefs: decay, profiles, folds, upserts, sweeps, invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import numeric as N
from mnemospark.functions.text import tokenize
from mnemospark.operators import belief as B
from mnemospark.operators import invariants as V
from mnemospark.operators.context import similar_nodes
from mnemospark.operators.views import current_versions, first_arrivals, latest
from mnemospark.plans import sqltext as S
from mnemospark.runtime import table

#: The clock of all queries.
NOW = 1_760_000_000_000
WORK = ("project", "routine", "procedure")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return current_versions(table(spark, d, "memory_nodes"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return first_arrivals(table(spark, d, "memory_edges"))


def records(spark: SparkSession, d: str) -> DataFrame:
    return first_arrivals(table(spark, d, "memory_records"))


def current_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("id", "version", "scope", "node_type", "label", "status")


def decayed_beliefs(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose confidence, decayed to now, is at least 0.2."""
    return B.believed(nodes(spark, d), NOW, 0.2).select("id", F.round("confidence", 6).alias("confidence"))


def decayed_edges(spark: SparkSession, d: str) -> DataFrame:
    return B.believed(edges(spark, d), NOW).select("id", F.round("confidence", 6).alias("confidence"))


def profile_topn(spark: SparkSession, d: str) -> DataFrame:
    return B.profile(nodes(spark, d), NOW).select("scope", "id", F.round("standing", 6).alias("standing"), "rk", "total")


def suggest_topn(spark: SparkSession, d: str) -> DataFrame:
    p = B.profile(nodes(spark, d), NOW, 5, WORK, N.POLICY["retirement_floor"])
    return p.select("scope", F.col("node_type").alias("kind"), F.col("label").alias("subject"), F.round("confidence", 6).alias("confidence"), "rk")


def support_fold(spark: SparkSession, d: str) -> DataFrame:
    """Support of (scope, kind) from the records that witness it, as if each were observed in turn."""
    r = records(spark, d).select("scope", "kind", F.col("created_at").alias("at"), "ord", F.col("provenance.session_id").alias("session_id"), F.array("id").alias("evidence"))
    s = B.folded_support(r, ["scope", "kind"])
    return s.select("scope", "kind", "observations", "reinforcements", "sessions", "first_seen_at", "last_seen_at", "first_evidence")


def reinforce_signals(spark: SparkSession, d: str) -> DataFrame:
    """Every edge signals its target: 'contradicts' and 'avoids' against it, other relations for it."""
    verdict = F.when(F.col("relation").isin("contradicts", "avoids"), "contradict").otherwise("reinforce")
    signals = edges(spark, d).select(F.lower(F.trim("dst")).alias("id"), verdict.alias("verdict"), F.col("updated_at").alias("at"))
    n = B.reinforce(nodes(spark, d), signals)
    return n.select("id", F.round("confidence", 6).alias("confidence"), "support.reinforcements", "support.contradictions", "support.last_seen_at")


def contradicted_confidence(spark: SparkSession, d: str) -> DataFrame:
    n = B.contradicted(nodes(spark, d))
    return n.select("id", F.round("confidence", 6).alias("confidence"), F.round(N.clamped(F.col("confidence") * 3 - 0.5), 6).alias("stretched"))


def support_boosts(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).where("support IS NOT NULL")
    return n.select("id", F.round(N.support_boost("support.observations", "support.reinforcements", 0.15), 6).alias("boost"), F.round(N.frequency_confidence("support.observations"), 6).alias("frequency"))


def _first_versions(spark: SparkSession, d: str) -> DataFrame:
    """The least version of each node that is put, as versions may start above 1; of resent rows the first."""
    return latest(table(spark, d, "memory_nodes").where("op = 'put'"), ["id"], [F.col("version"), F.col("ord")])


def assert_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The first versions of all nodes, labels lower-cased, asserted again over the current ones."""
    first = _first_versions(spark, d)
    a = first.select("scope", "node_type", F.lower("label").alias("label"), "summary", "evidence", F.col("created_at").alias("at"), F.col("created_at").alias("ord"))
    u = B.upsert_nodes(nodes(spark, d), a)
    return u.select("scope", "node_type", "label", "created", F.round("confidence", 6).alias("confidence"), "new_evidence", F.size("evidence").alias("evidence"))


def merge_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of a node over all its versions, distinct, by first citation."""
    v = table(spark, d, "memory_nodes").where("op = 'put'").dropDuplicates(["id", "version"])
    lists = v.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("version", "evidence"))), lambda x: x["evidence"]).alias("lists"))
    return lists.select("id", F.array_join(F.array_distinct(F.flatten("lists")), ",").alias("evidence"))


def sweep_retire(spark: SparkSession, d: str) -> DataFrame:
    n = B.retired(nodes(spark, d), NOW).select(F.lit("node").alias("kind"), "id", F.round("confidence", 6).alias("confidence"))
    return n.unionByName(B.retired(edges(spark, d), NOW).select(F.lit("edge").alias("kind"), "id", F.round("confidence", 6).alias("confidence")))


def evict_overflow(spark: SparkSession, d: str) -> DataFrame:
    """Budget of 3 records a scope."""
    return B.evicted(records(spark, d), [nodes(spark, d), edges(spark, d)], 3).select("scope", "id")


def stats_breakdown(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).where("status = 'active'").groupBy(F.lit("node").alias("what"), F.col("node_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    e = edges(spark, d).where("status = 'active'").groupBy(F.lit("edge").alias("what"), F.col("relation").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    r = records(spark, d).where("status = 'active'").groupBy(F.lit("record").alias("what"), F.coalesce("record_use", F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(e).unionByName(r)


def record_filters(spark: SparkSession, d: str) -> DataFrame:
    """Active records at fidelity 'summary' or better with their effective use; pending ones aren't promoted yet."""
    kept = records(spark, d).where("status = 'active'").where(V.meets_fidelity("fidelity", "summary"))
    return kept.select("id", V.effective_use().alias("use"), (F.size("promoted_to") == 0).alias("pending"), F.get("attachments", F.lit(0))["uri"].alias("first_uri"))


def similar_node_merge(spark: SparkSession, d: str) -> DataFrame:
    """Every node's first version as a candidate against the current nodes."""
    first = _first_versions(spark, d).select("id", "scope", "node_type", "label")
    return similar_nodes(first, nodes(spark, d), 0.6).select("candidate", "node", F.round("score", 6).alias("score"))


def invariant_violations(spark: SparkSession, d: str) -> DataFrame:
    return V.violations(records(spark, d), nodes(spark, d), edges(spark, d))


def node_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms by which a node is found: its label and summary."""
    t = tokenize(F.concat_ws(" ", "label", "summary"))
    return nodes(spark, d).select("id", F.array_join(t, " ").alias("terms"))


def queries() -> dict:
    fs = [current_nodes, decayed_beliefs, decayed_edges, profile_topn, suggest_topn, support_fold, reinforce_signals, contradicted_confidence, support_boosts, assert_upsert, merge_evidence, sweep_retire, evict_overflow, stats_breakdown, record_filters, similar_node_merge, invariant_violations, node_terms]
    return {f.__name__: f for f in fs}


def decay_sql(seen: str, c: str = "confidence") -> str:
    return f"CASE WHEN half_life_ms IS NULL OR half_life_ms <= 0 OR {NOW} <= {seen} THEN {c} ELSE {c} * pow(2.0, -({NOW} - {seen}) / half_life_ms) END"


def oracle_sql() -> dict[str, str]:
    nodes_, edges_, records_ = S.current("memory_nodes"), S.first_arrivals("memory_edges"), S.first_arrivals("memory_records")
    nd = decay_sql("support.last_seen_at")
    ed = decay_sql("updated_at")
    held = f"SELECT *, {nd} AS c FROM {nodes_} WHERE status = 'active'"
    standing = "round(c * ln(1 + support.observations + support.reinforcements), 9)"
    first = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version, ord) AS k_ FROM memory_nodes WHERE op = 'put') WHERE k_ = 1)"
    label_terms = f"list_distinct({S.tokenize('label')})"
    return {
        "current_nodes": f"SELECT id, version, scope, node_type, label, status FROM {nodes_}",
        "decayed_beliefs": f"SELECT id, round(c, 6) AS confidence FROM ({held}) WHERE c >= 0.2",
        "decayed_edges": f"SELECT id, round({ed}, 6) AS confidence FROM {edges_} WHERE status = 'active'",
        "profile_topn": f"SELECT scope, id, round(s, 6) AS standing, rk, total FROM (SELECT scope, id, s, row_number() OVER (PARTITION BY scope ORDER BY s DESC NULLS LAST, ord, id) AS rk, count(*) OVER (PARTITION BY scope) AS total FROM (SELECT *, {standing} AS s FROM ({held}))) WHERE rk <= 12",
        "suggest_topn": f"SELECT scope, node_type AS kind, label AS subject, round(c, 6) AS confidence, rk FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY s DESC NULLS LAST, ord, id) AS rk FROM (SELECT *, {standing} AS s FROM ({held}) WHERE c >= 0.05 AND node_type IN {WORK})) WHERE rk <= 5",
        "support_fold": f"SELECT scope, kind, count(*) AS observations, count(*) - 1 AS reinforcements, count(DISTINCT provenance.session_id) AS sessions, min(created_at) AS first_seen_at, max(created_at) AS last_seen_at, arg_min(id, created_at * 100000 + ord) AS first_evidence FROM {records_} GROUP BY scope, kind",
        "reinforce_signals": f"""WITH s AS (SELECT lower(trim(dst)) AS id, count(*) FILTER (relation NOT IN ('contradicts', 'avoids')) AS ups, count(*) FILTER (relation IN ('contradicts', 'avoids')) AS downs, max(updated_at) FILTER (relation NOT IN ('contradicts', 'avoids')) AS up_at FROM {edges_} GROUP BY 1),
t AS (SELECT n.*, CASE WHEN status <> 'retracted' THEN ups END AS u, CASE WHEN status <> 'retracted' THEN downs END AS dn, CASE WHEN status <> 'retracted' THEN up_at END AS ua FROM {nodes_} n LEFT JOIN s USING (id))
SELECT id, round(CASE WHEN u IS NULL THEN confidence ELSE (1 - (1 - confidence) * pow(0.75, u)) * pow(0.5, dn) END, 6) AS confidence, support.reinforcements + coalesce(u, 0) AS reinforcements, support.contradictions + coalesce(dn, 0) AS contradictions, greatest(support.last_seen_at, ua) AS last_seen_at FROM t""",
        "contradicted_confidence": f"SELECT id, round(confidence * 0.5, 6) AS confidence, round(least(greatest(confidence * 1.5 - 0.5, 0), 1), 6) AS stretched FROM {nodes_}",
        "support_boosts": f"SELECT id, round(1 + 0.15 * ln(1 + support.observations + support.reinforcements), 6) AS boost, round(0.85 * (1 - exp(-support.observations / 6.0)), 6) AS frequency FROM {nodes_} WHERE support IS NOT NULL",
        "assert_upsert": f"""WITH a AS (SELECT scope, node_type, lower(label) AS label, evidence, created_at FROM {first}),
g AS (SELECT scope, node_type, label, count(*) AS times, list_distinct(flatten(list(evidence))) AS added FROM a GROUP BY ALL),
o AS (SELECT * FROM (SELECT scope, node_type, label, confidence, evidence, row_number() OVER (PARTITION BY scope, node_type, label ORDER BY ord) AS k FROM {nodes_} WHERE status = 'active') WHERE k = 1)
SELECT g.scope, g.node_type, g.label, o.k IS NULL AS created, round(CASE WHEN o.k IS NULL THEN 1 - 0.1 * pow(0.75, times - 1) ELSE 1 - (1 - o.confidence) * pow(0.75, times) END, 6) AS confidence,
  len(list_filter(added, lambda x: NOT list_contains(coalesce(o.evidence, []), x))) AS new_evidence, len(list_distinct(list_concat(coalesce(o.evidence, []), added))) AS evidence
FROM g LEFT JOIN o ON g.scope = o.scope AND g.node_type = o.node_type AND g.label = o.label""",
        "merge_evidence": "WITH v AS (SELECT id, version, any_value(evidence) AS evidence FROM memory_nodes WHERE op = 'put' GROUP BY id, version), e AS (SELECT id, version, unnest(evidence) AS x, generate_subscripts(evidence, 1) AS pos FROM v), f AS (SELECT id, x, min(version * 100000 + pos) AS k FROM e GROUP BY 1, 2), s AS (SELECT id, string_agg(x, ',' ORDER BY k) AS evidence FROM f GROUP BY 1) SELECT DISTINCT v.id, coalesce(s.evidence, '') AS evidence FROM v LEFT JOIN s USING (id)",
        "sweep_retire": f"SELECT 'node' AS kind, id, round(c, 6) AS confidence FROM ({held}) WHERE origin = 'inferred' AND c < 0.05 UNION ALL SELECT 'edge', id, round(c, 6) FROM (SELECT id, {ed} AS c FROM {edges_} WHERE status = 'active' AND origin = 'inferred') WHERE c < 0.05",
        "evict_overflow": f"""WITH r AS (SELECT scope, id, created_at, ord FROM {records_}), o AS (SELECT scope, count(*) - 3 AS overflow FROM r GROUP BY 1 HAVING count(*) > 3),
c AS (SELECT scope, unnest(evidence) AS id FROM {nodes_} UNION SELECT scope, unnest(evidence) FROM {edges_})
SELECT scope, id FROM (SELECT scope, id, overflow, row_number() OVER (PARTITION BY scope ORDER BY created_at, ord) AS k FROM r JOIN o USING (scope) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.scope = r.scope AND c.id = r.id)) WHERE k <= overflow""",
        "stats_breakdown": f"SELECT 'node' AS what, node_type AS kind, count(*) AS n FROM {nodes_} WHERE status = 'active' GROUP BY 2 UNION ALL SELECT 'edge', relation, count(*) FROM {edges_} WHERE status = 'active' GROUP BY 2 UNION ALL SELECT 'record', coalesce(record_use, 'none'), count(*) FROM {records_} WHERE status = 'active' GROUP BY 2",
        "record_filters": f"SELECT id, coalesce(record_use, CASE WHEN kind IN ('user-message', 'skill-invocation', 'artifact', 'note') THEN 'recallable' ELSE 'evidence' END) AS use, len(promoted_to) = 0 AS pending, attachments[1].uri AS first_uri FROM {records_} WHERE status = 'active' AND fidelity IN ('verbatim', 'summary')",
        "similar_node_merge": f"""WITH l AS (SELECT id AS candidate, scope, node_type, {label_terms} AS t FROM {first}), r AS (SELECT id AS node, ord, scope, node_type, {label_terms} AS t FROM {nodes_} WHERE status = 'active'),
p AS (SELECT candidate, node, ord, {S.jaccard('l.t', 'r.t')} AS score FROM l JOIN r ON l.scope = r.scope AND l.node_type = r.node_type)
SELECT candidate, node, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY round(score, 9) DESC, ord DESC) AS k FROM p WHERE score >= 0.6) WHERE k = 1""",
        "invariant_violations": V.violations_sql(records_, nodes_, edges_),
        "node_terms": f"SELECT id, array_to_string({S.tokenize(chr(39) + chr(39) + ' || concat_ws(' + chr(39) + ' ' + chr(39) + ', label, summary)')}, ' ') AS terms FROM {nodes_}",
    }
