"""Queries of the belief graph, conversation context and mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators import context as C
from mnemospark.operators import graph as G
from mnemospark.operators import mining as M
from mnemospark.operators.belief import believed
from mnemospark.operators.orphans import normal_key
from mnemospark.operators.views import current_versions
from mnemospark.plans import sqltext as S
from mnemospark.plans.belief import NOW, decay_sql, edges, nodes, records
from mnemospark.runtime import table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with normal endpoint keys."""
    return edges(spark, d).withColumn("src", normal_key("src")).withColumn("dst", normal_key("dst"))


def live_edges(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).where("status = 'active'")
    return G.live_edges(_edges(spark, d).where("status = 'active'"), n).select("id", "src", "dst")


def edge_endpoints(spark: SparkSession, d: str) -> DataFrame:
    e = G.with_endpoints(_edges(spark, d), nodes(spark, d), ["label", "node_type"])
    return e.select("id", "relation", "src_label", "src_node_type", "dst_label", "dst_node_type")


def spread_activation(spark: SparkSession, d: str) -> DataFrame:
    """Seeds: the nodes of the stated query set (ord divisible by 100), each a query of its own; two hops."""
    n = nodes(spark, d).where("status = 'active'")
    live = G.live_edges(believed(_edges(spark, d), NOW), n).select("src", "dst", "confidence")
    seeds = n.where("ord % 100 = 0").select(F.col("id").alias("query_id"), F.col("id").alias("node"), F.lit(1 / 61).alias("weight"))
    return G.spread_activation(seeds, live, ["query_id"]).select("query_id", "node", F.round("activation", 9).alias("activation"))


def erase_closure(spark: SparkSession, d: str) -> DataFrame:
    """All that goes with the records of the stated query set (ord divisible by 100)."""
    r = records(spark, d)
    return G.erase_closure(r, nodes(spark, d), _edges(spark, d), r.where("ord % 100 = 0"))


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    return current_versions(table(spark, d, "experience_episodes"))


def family_roots(spark: SparkSession, d: str) -> DataFrame:
    return G.chain_roots(_episodes(spark, d).select("id", "derived_from"), "derived_from")


def successor_chains(spark: SparkSession, d: str) -> DataFrame:
    """Where supersession leads: the last node of each chain of 'supersedes' edges; none for nodes on a cycle."""
    by = _edges(spark, d).where("relation = 'supersedes' AND src IS NOT NULL").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("successor"))
    chains = G.chain_roots(nodes(spark, d).select("id").join(by, "id", "left"), "successor")
    return chains.where("depth > 0 OR root IS NULL")


def episode_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return G.ancestors(_episodes(spark, d).select("id", "derived_from"), "derived_from", 4)


def companions(spark: SparkSession, d: str) -> DataFrame:
    return C.companions(records(spark, d))


def correction_links(spark: SparkSession, d: str) -> DataFrame:
    return C.correction_links(records(spark, d))


def label_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose ends are named by label are resolved to the first active node of the scope."""
    n = nodes(spark, d)
    named = G.with_endpoints(_edges(spark, d), n, ["label"]).select("id", "scope", F.col("src_label").alias("from_label"), F.col("dst_label").alias("to_label"))
    fresh = n.where("version = 1 AND status = 'active'").select("scope", "label", "id")
    return C.resolved_labels(named, fresh, n).select("id", "scope", F.col("from").alias("from_id"), F.col("to").alias("to_id"))


def affinity_tally(spark: SparkSession, d: str) -> DataFrame:
    a = M.affinities(M.skill_actions(records(spark, d)), ["scope"], 1)
    return a.select("scope", "action", "uses", "sessions", F.round("confidence", 6).alias("confidence"), "first_id")


def _event_actions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    ms = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.lit("user").alias("scope"), F.col("event_id").cast("string").alias("id"), F.col("user_id").alias("session_id"), F.date_format("ts", "yyyyMMdd").alias("turn"), F.struct(ms.alias("us"), "event_id").alias("ord"), F.col("event_type").alias("action"))


def ngram_procedures(spark: SparkSession, d: str) -> DataFrame:
    g = M.ngrams(_event_actions(spark, d), ["scope"])
    return g.select("length", "label", "occurrences", "evidence", F.round("confidence", 6).alias("confidence"))


def cooccur_edges(spark: SparkSession, d: str) -> DataFrame:
    a = _event_actions(spark, d)
    known = M.affinities(a, ["scope"]).select("scope", "action")
    e = M.sequence_edges(M.ngrams(a, ["scope"]), ["scope"], known)
    return e.select("from_label", "to_label", "relation", F.round("confidence", 6).alias("confidence"))


def stated_claims(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).where("record_use = 'recallable' AND kind IN ('user-message', 'note')").select("id", "ord", "text")
    return M.claims(r).select("id", "type", "subject", "sentence")


def stated_beliefs(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).where("record_use = 'recallable' AND kind IN ('user-message', 'note')").select("ord", "text", F.col("provenance.session_id").alias("session_id"))
    b = M.stated_beliefs(M.claims(r), [], [F.col("ord"), F.col("no")], "session_id")
    return b.select("type", "subject", "statements", "sessions", "summary", F.round("confidence", 6).alias("confidence"))


def queries() -> dict:
    fs = [live_edges, edge_endpoints, spread_activation, erase_closure, family_roots, successor_chains, episode_ancestors, companions, correction_links, label_resolution, affinity_tally, ngram_procedures, cooccur_edges, stated_claims, stated_beliefs]
    return {f.__name__: f for f in fs}


def _roots_sql(rows: str, parent: str) -> str:
    return f"""WITH RECURSIVE r AS MATERIALIZED (SELECT id, {parent} AS p FROM {rows}), l AS (SELECT r.id, x.id AS p FROM r LEFT JOIN r x ON r.p = x.id),
walk AS (SELECT id, id AS root, 0 AS depth FROM l WHERE p IS NULL UNION ALL SELECT l.id, w.root, w.depth + 1 FROM walk w JOIN l ON l.p = w.id)
SELECT r.id, root, CAST(depth AS BIGINT) AS depth FROM r LEFT JOIN walk USING (id)"""


def oracle_sql() -> dict[str, str]:
    n, r = S.current("memory_nodes"), S.first_arrivals("memory_records")
    e = f"(SELECT * REPLACE ({S.key('src')} AS src, {S.key('dst')} AS dst) FROM {S.first_arrivals('memory_edges')})"
    ep = S.current("experience_episodes")
    act = f"(SELECT id FROM {n} WHERE status = 'active')"
    actions = "a AS MATERIALIZED (SELECT CAST(event_id AS VARCHAR) AS id, user_id, strftime(ts, '%Y%m%d') AS turn, ts, event_id, event_type AS action FROM events)"
    lead = ", ".join(f"lead(action, {k}) OVER w AS a{k}, lead(id, {k}) OVER w AS i{k}" for k in (1, 2, 3))
    grams = " UNION ALL ".join(f"SELECT {m} AS length, concat_ws(' > ', action, {', '.join(f'a{k}' for k in range(1, m))}) AS label, [id, {', '.join(f'i{k}' for k in range(1, m))}] AS ids FROM w_ WHERE a{m - 1} IS NOT NULL" for m in (2, 3, 4))
    ngram = f"WITH {actions}, w_ AS MATERIALIZED (SELECT id, action, {lead} FROM a WINDOW w AS (PARTITION BY user_id, turn ORDER BY ts, event_id)), g AS MATERIALIZED ({grams}), c AS (SELECT length, label, count(*) AS occurrences FROM g GROUP BY ALL HAVING count(*) >= 3)"
    conf = lambda x: f"round(0.85 * (1 - exp(-{x} / 6.0)), 6)"
    said = f"(SELECT id, ord, text, provenance.session_id AS session_id FROM {r} WHERE record_use = 'recallable' AND kind IN ('user-message', 'note') AND text IS NOT NULL)"
    terms = S.topic(S.tokenize("text"))
    return {
        "live_edges": f"SELECT id, src, dst FROM {e} WHERE status = 'active' AND src IN {act} AND dst IN {act}",
        "edge_endpoints": f"SELECT e.id, relation, s.label AS src_label, s.node_type AS src_node_type, t.label AS dst_label, t.node_type AS dst_node_type FROM {e} e JOIN {n} s ON e.src = s.id JOIN {n} t ON e.dst = t.id",
        "spread_activation": f"""WITH n AS MATERIALIZED (SELECT id, ord FROM {n} WHERE status = 'active'), e AS MATERIALIZED (SELECT src, dst, {decay_sql('updated_at')} AS c FROM {e} WHERE status = 'active' AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)),
b AS MATERIALIZED (SELECT src AS node, dst AS target, c FROM e UNION ALL SELECT dst, src, c FROM e), s AS (SELECT id AS query_id, id AS node, 1 / 61.0 AS w FROM n WHERE ord % 100 = 0),
h1 AS MATERIALIZED (SELECT query_id, target AS node, sum(w * 0.45 * c) AS w FROM s JOIN b USING (node) GROUP BY ALL), h2 AS (SELECT query_id, target AS node, sum(w * 0.45 * c) AS w FROM h1 JOIN b USING (node) GROUP BY ALL)
SELECT query_id, node, round(sum(w), 9) AS activation FROM (SELECT query_id, node, CAST(w AS DOUBLE) AS w FROM s UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL""",
        "erase_closure": f"""WITH RECURSIVE r AS MATERIALIZED (SELECT id, scope, ord, (kind = 'note' AND record_use = 'evidence' AND provenance.author IN ('agent', 'api')) AS ledger FROM {r}), n AS MATERIALIZED (SELECT id, scope, evidence FROM {n}), e AS MATERIALIZED (SELECT id, scope, src, dst, evidence FROM {e}),
cn AS MATERIALIZED (SELECT n.id, n.scope, r.id AS rid, r.scope AS rs, ledger FROM (SELECT id, scope, unnest(evidence) AS rid FROM n) n JOIN r ON r.id = n.rid), ce AS MATERIALIZED (SELECT e.id, e.scope, r.id AS rid, r.scope AS rs, ledger FROM (SELECT id, scope, unnest(evidence) AS rid FROM e) e JOIN r ON r.id = e.rid),
ends AS (SELECT e.id, e.scope, n.id AS nid, n.scope AS ns FROM (SELECT id, scope, unnest([src, dst]) AS x FROM e) e JOIN n ON n.id = e.x),
l AS MATERIALIZED (SELECT 'record' AS k1, rid AS a, 'node' AS k2, id AS b FROM cn WHERE scope = rs UNION SELECT 'node', id, 'record', rid FROM cn WHERE ledger UNION SELECT 'record', rid, 'edge', id FROM ce WHERE scope = rs OR scope = 'user'
  UNION SELECT 'edge', id, 'record', rid FROM ce WHERE ledger UNION SELECT 'node', nid, 'edge', id FROM ends WHERE scope = ns OR scope = 'user'),
w AS (SELECT 'record' AS kind, id FROM r WHERE ord % 100 = 0 UNION SELECT k2, b FROM w JOIN l ON l.k1 = w.kind AND l.a = w.id) SELECT DISTINCT kind, id FROM w""",
        "family_roots": _roots_sql(ep, "derived_from"),
        "successor_chains": f"SELECT * FROM ({_roots_sql(f'(SELECT id, successor FROM {n} LEFT JOIN (SELECT dst, min(src) AS successor FROM {e} WHERE relation = ' + chr(39) + 'supersedes' + chr(39) + ' AND src IS NOT NULL GROUP BY dst) ON dst = id)', 'successor')}) WHERE depth > 0 OR root IS NULL",
        "episode_ancestors": f"WITH RECURSIVE r AS MATERIALIZED (SELECT id, derived_from AS p FROM {ep}), l AS MATERIALIZED (SELECT r.id, x.id AS p FROM r JOIN r x ON r.p = x.id), w AS (SELECT id, p AS ancestor, 1 AS distance FROM l UNION ALL SELECT w.id, l.p, w.distance + 1 FROM w JOIN l ON l.id = w.ancestor WHERE distance < 4 AND l.p <> w.id) SELECT * FROM w",
        "companions": f"""WITH p AS MATERIALIZED (SELECT id, ord, record_use, text, terms, provenance.session_id AS s, provenance.turn AS t FROM {r} WHERE provenance.session_id IS NOT NULL AND provenance.turn IS NOT NULL),
f AS MATERIALIZED (SELECT s, t, id, coalesce(record_use = 'evidence', false) AS ev, coalesce(rtrim(text, ' ') LIKE '%?', false) AS asks, len(terms) AS n, coalesce({S.correction('text')}, false) AS cor FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY ord DESC) AS k FROM p) WHERE k = 1)
SELECT * FROM (SELECT p.id, CASE WHEN a.ev AND (a.asks OR a.n < 12) THEN a.id END AS anchor, CASE WHEN c.ev AND c.n <= 30 AND NOT c.asks AND NOT coalesce(d.cor, false) THEN c.id END AS confirmation
FROM p LEFT JOIN f a ON a.s = p.s AND a.t = p.t - 1 LEFT JOIN f c ON c.s = p.s AND c.t = p.t + 1 LEFT JOIN f d ON d.s = p.s AND d.t = p.t + 2 WHERE p.record_use = 'recallable') WHERE anchor IS NOT NULL OR confirmation IS NOT NULL""",
        "correction_links": f"""WITH u AS MATERIALIZED (SELECT id, scope, created_at, ord, text, status, superseded_by, {terms} AS t FROM {r} WHERE record_use = 'recallable' AND text IS NOT NULL),
q AS (SELECT id AS correction, scope, created_at AS at_, unnest(t) AS term FROM u WHERE {S.correction('text')}), h AS (SELECT id, scope, created_at, ord, unnest(t) AS term FROM u WHERE status = 'active' AND superseded_by IS NULL),
s AS (SELECT correction, id, created_at, ord, count(*) AS shared FROM q JOIN h USING (scope, term) WHERE created_at <= at_ AND id <> correction GROUP BY ALL HAVING count(*) >= 2)
SELECT correction, id AS corrected, shared FROM (SELECT *, row_number() OVER (PARTITION BY correction ORDER BY shared DESC, created_at DESC, ord) AS k FROM s) WHERE k = 1""",
        "label_resolution": f"""WITH n AS MATERIALIZED (SELECT * FROM {n}), named AS (SELECT e.id, e.scope, s.label AS fl, t.label AS tl FROM {e} e JOIN n s ON e.src = s.id JOIN n t ON e.dst = t.id),
f AS (SELECT scope, label, min(id) AS id FROM n WHERE version = 1 AND status = 'active' GROUP BY ALL), h AS (SELECT scope, label, arg_min(id, ord) AS id FROM n WHERE status = 'active' GROUP BY ALL),
k AS (SELECT coalesce(f.scope, h.scope) AS scope, coalesce(f.label, h.label) AS label, coalesce(f.id, h.id) AS id FROM f FULL JOIN h ON f.scope = h.scope AND f.label = h.label)
SELECT named.id, named.scope, a.id AS from_id, b.id AS to_id FROM named JOIN k a ON a.scope = named.scope AND a.label = fl JOIN k b ON b.scope = named.scope AND b.label = tl""",
        "affinity_tally": f"SELECT scope, 'skill:' || name AS action, count(*) AS uses, count(DISTINCT session_id) AS sessions, {conf('count(*)')} AS confidence, arg_min(id, ord) AS first_id FROM (SELECT id, scope, ord, provenance.session_id AS session_id, coalesce(provenance.skill, trim(split_part(text, chr(10), 1), ' ')) AS name FROM {r} WHERE record_use = 'recallable' AND kind = 'skill-invocation') WHERE name <> '' GROUP BY scope, name",
        "ngram_procedures": f"{ngram}, ev AS (SELECT length, label, count(DISTINCT x) AS evidence FROM (SELECT length, label, unnest(ids) AS x FROM g) GROUP BY ALL) SELECT c.length, c.label, occurrences, evidence, {conf('occurrences')} AS confidence FROM c JOIN ev USING (length, label)",
        "cooccur_edges": f"""{ngram}, p AS (SELECT label, {conf('occurrences')} AS confidence, string_split(label, ' > ') AS st FROM c), k AS (SELECT action FROM a GROUP BY 1 HAVING count(*) >= 3),
s AS MATERIALIZED (SELECT label, confidence, unnest(st) AS step, generate_subscripts(st, 1) AS pos FROM p), h AS MATERIALIZED (SELECT * FROM s WHERE step IN (SELECT action FROM k))
SELECT step AS from_label, label AS to_label, 'part-of' AS relation, max(confidence) AS confidence FROM h GROUP BY 1, 2 UNION ALL SELECT b.step, h.step, 'co-occurs', max(h.confidence) FROM h JOIN h b ON b.label = h.label AND b.pos + 1 = h.pos GROUP BY 1, 2""",
        "stated_claims": f"SELECT id, type, subject, sentence FROM ({S.claims(said, 'text', 'id')})",
        "stated_beliefs": f"SELECT type, subject, count(*) AS statements, count(DISTINCT session_id) AS sessions, arg_min(sentence, ord * 1000 + no) AS summary, {conf('count(*)')} AS confidence FROM ({S.claims(said, 'text', 'ord, session_id')}) GROUP BY type, subject",
    }
