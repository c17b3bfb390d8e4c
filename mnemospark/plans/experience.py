"""Queries of recall, episodes and skills, evaluation and event capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.text import tokenize
from mnemospark.operators import capture as K
from mnemospark.operators import context as C
from mnemospark.operators import evaluation as E
from mnemospark.operators import experience as X
from mnemospark.operators import ranking as R
from mnemospark.operators import recall as Q
from mnemospark.operators.orphans import normal_key
from mnemospark.operators.views import current_versions, latest
from mnemospark.plans import sqltext as S
from mnemospark.plans.belief import NOW, decay_sql, edges, nodes, records
from mnemospark.plans.graph import _edges
from mnemospark.plans.text import _asked, _vectors, asked_and_documents, bm25_sql
from mnemospark.runtime import table


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: records with ord divisible by 100 ask their own text in their scope."""
    return records(spark, d).where("ord % 100 = 0 AND text IS NOT NULL").select("scope", F.col("id").alias("query_id"), "text")


def recall_cues(spark: SparkSession, d: str) -> DataFrame:
    c = Q.recalled_cues(_requests(spark, d), records(spark, d), nodes(spark, d), _edges(spark, d), NOW, terms=False, signals=False)
    return c.select("query_id", "kind", "id", F.round("score", 6).alias("score"), "rk")


def recall_diverse(spark: SparkSession, d: str) -> DataFrame:
    c = Q.recall(_requests(spark, d), records(spark, d), nodes(spark, d), _edges(spark, d), NOW)
    return c.select("query_id", "kind", "id", F.round("score", 6).alias("score"), "rk", "pick", "truncated")


def _chained(spark: SparkSession, d: str) -> DataFrame:
    """The same requests, each asking its own scope and the user's together."""
    return _requests(spark, d).select("query_id", F.array("scope", F.lit("user")).alias("scopes"), "text")


def recall_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Statistics, ranks and edges over the union of a request's scopes."""
    c = Q.recalled_cues(_chained(spark, d), records(spark, d), nodes(spark, d), _edges(spark, d), NOW, terms=False, signals=False)
    return c.select("query_id", "kind", "id", F.round("score", 6).alias("score"), "rk")


#: Options of ``recall_filtered``.
_ONLY = {"node_types": ["preference", "project", "routine"], "kinds": ["user-message", "note"], "fidelity": "summary", "least": 0.2}


def recall_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Some node types and record kinds, a fidelity floor, a least confidence, evidence included, beliefs boosted by support."""
    c = Q.recalled_cues(_chained(spark, d), records(spark, d), nodes(spark, d), _edges(spark, d), NOW, include_evidence=True, support_weight=0.15, terms=False, signals=False, **_ONLY)
    return c.select("query_id", "kind", "id", F.round("score", 6).alias("score"), "rk")


def recall_signals(spark: SparkSession, d: str) -> DataFrame:
    """What each cue's score is made of."""
    c = Q.recalled_cues(_chained(spark, d), records(spark, d), nodes(spark, d), _edges(spark, d), NOW, terms=False)
    s = c.select("query_id", "kind", "id", F.explode("signals").alias("s"))
    return s.select("query_id", "kind", "id", F.col("s.kind").alias("signal"), F.col("s.rank").alias("rank"), F.round("s.value", 6).alias("value"))


def episodes(spark: SparkSession, d: str) -> DataFrame:
    return current_versions(table(spark, d, "experience_episodes"))


def skills(spark: SparkSession, d: str) -> DataFrame:
    """The highest version of each skill; of resent rows the first by arrival."""
    return latest(table(spark, d, "experience_skills"), ["id"], [F.col("version").desc(), F.col("stored_at")])


def episode_steps(spark: SparkSession, d: str) -> DataFrame:
    s = X.steps(episodes(spark, d))
    return s.groupBy("tool", "role", "execution").agg(F.count(F.lit(1)).alias("steps"), F.count_if("complete").alias("complete"), F.count_distinct("id").alias("episodes"))


def quote_checks(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "evidence_quotes").dropDuplicates(["id"]).select("id", normal_key("episode_id").alias("episode_id"), normal_key("event_id").alias("event_id"), "quote")
    return X.quote_checks(q, episodes(spark, d))


def latest_per_family(spark: SparkSession, d: str) -> DataFrame:
    return X.latest_in_family(episodes(spark, d)).select("family", "id", "completed_at")


def environment_match(spark: SparkSession, d: str) -> DataFrame:
    e = episodes(spark, d).where("environment IS NOT NULL")
    linux = F.create_map(F.lit("os"), F.lit("linux"))
    return e.select("id", X.environment_matches(linux, F.col("environment")).alias("linux"), F.size("environment").alias("facts"), X.outcome_weight().alias("weight"))


def required_tools(spark: SparkSession, d: str) -> DataFrame:
    """Skills whose required tools were all used in the episodes they cite."""
    s = skills(spark, d)
    used = s.select("id", F.explode("episode_ids").alias("episode")).join(X.steps(episodes(spark, d)).select(F.col("id").alias("episode"), "tool").distinct(), "episode").select("id", "tool").distinct()
    wanted = s.select("id", F.explode(F.array_distinct("required_tools")).alias("tool"))
    have = wanted.join(used.withColumn("used", F.lit(1)), ["id", "tool"], "left").groupBy("id").agg(F.count(F.lit(1)).alias("required"), F.count("used").alias("used"))
    return have.select("id", "required", "used", (F.col("required") == F.col("used")).alias("covered"))


def skill_support(spark: SparkSession, d: str) -> DataFrame:
    s = X.skill_support(skills(spark, d), episodes(spark, d))
    return s.select("id", "families", "supporting", F.round("mean_weight", 6).alias("mean_weight"), "sessions", "last_completed")


def conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    return X.conflicting_skills(skills(spark, d))


def source_manifest(spark: SparkSession, d: str) -> DataFrame:
    return X.source_manifest(skills(spark, d), episodes(spark, d))


def checkpoint_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last episode of each session that no other one derives from."""
    e = episodes(spark, d)
    replaced = e.where("derived_from IS NOT NULL").select(F.col("derived_from").alias("id"))
    open_ = e.join(replaced, "id", "left_anti").where("session_id IS NOT NULL")
    return latest(open_, ["session_id"], [F.col("completed_at").desc_nulls_last(), F.col("id").desc()]).select("session_id", "id", "completed_at")


def skill_search(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth document asks the active skills."""
    active = skills(spark, d).where("status = 'active'")
    hits = X.skill_search(_asked(spark, d), active, 4)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rk")


def skill_markdown(spark: SparkSession, d: str) -> DataFrame:
    return X.skill_markdown(skills(spark, d))


def step_sampling(spark: SparkSession, d: str) -> DataFrame:
    return X.sampled_steps(episodes(spark, d), 3).select("id", F.col("n_steps").alias("steps"), F.array_join(F.col("picks").cast("array<string>"), ",").alias("picks"))


def overlapping_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Episodes that begin less than three days after an earlier one of their scope has ended."""
    e = episodes(spark, d).where("scope IS NOT NULL AND started_at IS NOT NULL").withColumn("completed_at", F.col("completed_at") + 3 * 86_400_000)
    return X.overlapping(e, ["scope"], "started_at", "completed_at").select("id", "scope", "busy_until")


#: What ``node_revisions`` watches.
WATCHED = ("status", "label", "summary", "confidence", "evidence")


def node_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Every version of each node and what it changed."""
    r = X.revisions(table(spark, d, "memory_nodes").where("op = 'put'"), list(WATCHED))
    return r.select("id", "version", "previous", F.array_join("changed", ",").alias("changed"))


def case_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Content fingerprint of each case and how many cases share it."""
    c = table(spark, d, "evaluation_cases").dropDuplicates(["id"])
    part = lambda x: F.coalesce(x, F.lit("~"))
    f = F.sha2(F.concat_ws("|", part("source"), part("question"), part("reference"), F.array_join(F.array_sort("evidence_session_ids"), ",")), 256)
    return c.groupBy(f.alias("fingerprint")).agg(F.count(F.lit(1)).alias("cases"), F.min("id").alias("first_id"))


def shared_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Evidence sessions that a bank's training and held-out datasets share."""
    c = table(spark, d, "evaluation_cases").dropDuplicates(["id"]).select(F.col("dataset_fingerprint").alias("name"), F.explode("evidence_session_ids").alias("member"))
    b = table(spark, d, "experience_banks").where("held_out_dataset_fingerprint IS NOT NULL").select(F.col("training_dataset_fingerprint").alias("training"), F.col("held_out_dataset_fingerprint").alias("held_out"))
    return E.shared_members(c, b)


def banks_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Current nodes per type at the moment each experience bank was frozen (a fixed table of about 14 rows)."""
    cutoffs = [r[0] for r in table(spark, d, "experience_banks").where("frozen_at IS NOT NULL").select(F.col("frozen_at").cast("timestamp")).collect()]
    held = E.as_of(table(spark, d, "memory_nodes"), cutoffs)
    return held.groupBy("cutoff", "node_type").agg(F.count(F.lit(1)).alias("nodes")).select(F.unix_millis("cutoff").alias("cutoff_ms"), "node_type", "nodes")


def _retrieved(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "v")
    ranked = R.cosine_neighbours(asked, v, 10).select("query_id", F.col("vec_id").alias("item"), "rk")
    return E.labelled_metrics(ranked, v.select(F.col("vec_id").alias("item"), "label"))


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of the query set against the vectors of the same label."""
    m = _retrieved(spark, d)
    return m.select("query_id", "gold", *[F.round(c, 6).alias(c) for c in m.columns[2:]])


def retrieval_summary(spark: SparkSession, d: str) -> DataFrame:
    """R@k, hit@k, nDCG@k, MRR and the unattributed share, averaged over the query set."""
    m = E.metric_averages(_retrieved(spark, d))
    return m.select("queries", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


def session_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Document hits of each query kept once per scope and ranked again."""
    hits = R.bm25(*asked_and_documents(spark, d, "scope"), best=10, group="scope")
    best = hits.groupBy("query_id", "scope").agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("doc_id")).alias("d"))).alias("b"))
    return R.ranked(best, ["query_id"], [F.col("b.s").desc(), F.col("b.d").desc()]).where("rk <= 10").select("query_id", "scope", "rk")


def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    """Ratings summarised overall and per rater; a rating of null is a failure."""
    r = table(spark, d, "level_labels").select("rater", F.col("reading_level").cast("double").alias("level"))
    s = E.summaries(r, "rater", "level", F.col("level").isNotNull())
    return s.select("overall", F.col("group").alias("rater"), "n", "completed", F.round("mean", 6).alias("mean"), F.round("mean_with_failures", 6).alias("mean_with_failures"), "p50", "p95")


def pass_rate_groups(spark: SparkSession, d: str) -> DataFrame:
    """Answerable cases overall, per source and per group, as grouping sets."""
    c = table(spark, d, "evaluation_cases").select("id", F.coalesce("source", F.lit("?")).alias("source"), F.coalesce("case_group", F.lit("?")).alias("case_group"), "abstention").distinct()
    g = c.groupingSets([[], ["source"], ["case_group"]], "source", "case_group")
    return g.agg(F.count(F.lit(1)).alias("cases"), F.count_if(~F.col("abstention")).alias("answerable"))


def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "evaluation_cases").dropDuplicates(["id"]).select("id", F.coalesce("source", F.lit("?")).alias("source"))
    return E.round_robin(c, "source", [F.col("id")], 40).select("id", "source", "seat")


def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Profile lines of each scope that fit 150 characters, stopping at the first that doesn't."""
    n = latest_lines(spark, d)
    return C.running_budget(n, ["scope"], 150).select("scope", "rk", "used")


def budget_greedy(spark: SparkSession, d: str) -> DataFrame:
    """The same lines, skipping those that don't fit and going on."""
    return C.greedy_budget(latest_lines(spark, d), ["scope"], 150)


def latest_lines(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).where("status = 'active' AND summary IS NOT NULL")
    return R.ranked(n, ["scope"], [F.col("ord")]).select("scope", "rk", F.length(F.concat(F.lit("- "), "summary")).alias("length"))


def recency_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The ten newest records of each scope, whatever is asked."""
    r = R.ranked(records(spark, d), ["scope"], [F.col("created_at").desc(), F.col("ord")]).where("rk <= 10")
    return r.select("scope", "id", "rk")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages as events: one per id, normal session and speaker, times in ms."""
    h = table(spark, d, "history_messages").groupBy("id").agg(F.first("session_id").alias("session_id"), F.first("role").alias("role"), F.first("at_ms").alias("at"))
    speaker = F.when(F.lower(F.trim("role")).isin("user", "human"), "user").when(F.lower(F.trim("role")).isin("assistant", "ai", "bot", "model"), "assistant").otherwise("other")
    at = F.when(F.col("at") < 100_000_000_000, F.col("at") * 1000).otherwise(F.col("at"))
    return h.select(normal_key("session_id").alias("session_id"), at.alias("at"), F.col("id").alias("ord"), speaker.alias("speaker")).where("session_id IS NOT NULL AND at IS NOT NULL")


def turn_capture(spark: SparkSession, d: str) -> DataFrame:
    return K.turns(_messages(spark, d), F.col("speaker") == "user")


def every_fifth_turn(spark: SparkSession, d: str) -> DataFrame:
    return K.every_nth(K.turns(_messages(spark, d), F.col("speaker") == "user"), 5).select("session_id", "turn", "nth")


def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = K.gap_sessions(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 1800)
    return s.select("user_id", "session", F.unix_micros(F.col("started").cast("timestamp")).alias("started_us"), F.unix_micros(F.col("ended").cast("timestamp")).alias("ended_us"), "events")


def queries() -> dict:
    fs = [recall_cues, recall_diverse, recall_scopes, recall_filtered, recall_signals, episode_steps, quote_checks, latest_per_family, environment_match, required_tools, skill_support, conflict_pairs, source_manifest, checkpoint_latest, skill_search, skill_markdown, step_sampling, overlapping_episodes, node_revisions, case_fingerprints, shared_sessions, banks_as_of, retrieval_metrics, retrieval_summary, session_metrics, metric_summary, pass_rate_groups, round_robin_sample, budget_prefix, budget_greedy, recency_baseline, turn_capture, every_fifth_turn, gap_sessions]
    return {f.__name__: f for f in fs}


def _recall_sql(more: str = "", only: dict | None = None, boost: str = "1") -> str:
    """CTEs that end in cues(query_id, kind, id, score, rk, terms). more: a scope that each request asks beside its own; the
    rows of a request's scopes are then copied under its chain's name.
    """
    only = only or {}
    inside = lambda c, k: f"AND {c} IN ({', '.join(repr(x) for x in only[k])})" if k in only else ""
    least = f"AND c >= {only['least']}" if only else ""
    sound = "AND fidelity IN ('verbatim', 'summary')" if only else ""
    hidden = "" if only else "WHERE record_use IS DISTINCT FROM 'evidence'"
    chains = f"ch AS MATERIALIZED (SELECT DISTINCT r.scope || '+' AS chain, m.scope AS member FROM rec r, (SELECT DISTINCT scope FROM rec UNION SELECT '{more}') m WHERE ord % 100 = 0 AND text IS NOT NULL AND (m.scope = r.scope OR m.scope = '{more}'))" if more else "ch AS MATERIALIZED (SELECT DISTINCT scope AS chain, scope AS member FROM rec WHERE ord % 100 = 0 AND text IS NOT NULL)"
    asker = "scope || '+'" if more else "scope"
    n, r = S.current("memory_nodes"), S.first_arrivals("memory_records")
    e = f"(SELECT * REPLACE ({S.key('src')} AS src, {S.key('dst')} AS dst) FROM {S.first_arrivals('memory_edges')})"
    concat = "concat_ws(' ', label, summary)"

    def ranked(name: str, docs: str, asked: str = "asked") -> str:
        inner = bm25_sql(asked, docs, "scope")
        for t in ("tf_", "df_", "qf_", "st_"):
            inner = inner.replace(t, f"{name}_{t}")
        inner = inner.replace("sc AS (", f"{name}_sc AS (")
        return f"{inner}, {name}_rk AS (SELECT scope, query_id, doc_id AS id, row_number() OVER (PARTITION BY scope, query_id ORDER BY round(score, 9) DESC, ord) AS rk FROM {name}_sc JOIN {docs} USING (scope, doc_id))"

    recency = f"0.5 + 0.5 * CASE WHEN {NOW} <= created_at THEN 1 ELSE pow(2.0, -({NOW} - created_at) / 5184000000.0) END"
    return f"""WITH RECURSIVE rec AS MATERIALIZED (SELECT * FROM {r}), {chains}, asked AS MATERIALIZED (SELECT {asker} AS scope, id AS query_id, {S.tokenize('text')} AS terms FROM rec WHERE ord % 100 = 0 AND text IS NOT NULL),
nd AS MATERIALIZED (SELECT * FROM (SELECT chain AS scope, id AS doc_id, ord, {decay_sql('support.last_seen_at')} AS c, {boost} AS boost, evidence, {S.tokenize(concat)} AS terms FROM {n} n_ JOIN ch ON member = n_.scope WHERE status = 'active' {inside('node_type', 'node_types')}) WHERE true {least}),
ed AS MATERIALIZED (SELECT * FROM (SELECT chain AS scope, e.id AS doc_id, e.ord, src, dst, {decay_sql('e.updated_at', 'e.confidence').replace('half_life_ms', 'e.half_life_ms')} AS c, {S.tokenize('claim')} AS terms FROM {e} e JOIN ch ON member = e.scope JOIN nd a ON a.doc_id = e.src AND a.scope = chain JOIN nd b ON b.doc_id = e.dst AND b.scope = chain WHERE e.status = 'active') WHERE true {least}),
rc AS MATERIALIZED (SELECT chain AS scope, id AS doc_id, ord, record_use, created_at, terms FROM rec JOIN ch ON member = rec.scope WHERE status = 'active' AND terms IS NOT NULL {inside('kind', 'kinds')} {sound}),
{ranked('n', 'nd')}, {ranked('e', 'ed')}, {ranked('r', 'rc')}, fused AS MATERIALIZED (SELECT scope, query_id, id, rk, 1.0 / (60 + rk) AS score FROM r_rk),
seeds AS (SELECT scope, query_id, id AS node, 1.0 / (60 + rk) AS w FROM n_rk UNION ALL SELECT DISTINCT x.scope, f.query_id, x.doc_id, 0.45 / 61 FROM (SELECT scope, doc_id, unnest(evidence) AS cited FROM nd) x JOIN fused f ON f.scope = x.scope AND f.id = x.cited AND f.rk <= 10),
h0 AS MATERIALIZED (SELECT scope, query_id, node, sum(w) AS w FROM seeds GROUP BY ALL), b AS MATERIALIZED (SELECT scope, src AS node, dst AS target, c FROM ed UNION ALL SELECT scope, dst, src, c FROM ed),
h1 AS MATERIALIZED (SELECT h0.scope, query_id, target AS node, sum(w * 0.45 * c) AS w FROM h0 JOIN b USING (scope, node) GROUP BY ALL), h2 AS (SELECT h1.scope, query_id, target AS node, sum(w * 0.45 * c) AS w FROM h1 JOIN b USING (scope, node) GROUP BY ALL),
act AS MATERIALIZED (SELECT scope, query_id, node, sum(w) AS a FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL),
ncue AS (SELECT act.scope, act.query_id, 'node' AS kind, node AS id, (coalesce(1.0 / (60 + rk), 0) + a) * (0.5 + 0.5 * c) * boost AS score, 0 AS part, nd.ord AS inn, terms FROM act JOIN nd ON nd.doc_id = node AND nd.scope = act.scope LEFT JOIN n_rk ON n_rk.scope = act.scope AND n_rk.query_id = act.query_id AND n_rk.id = node),
around AS (SELECT x.scope, act.query_id, x.doc_id AS id, sum(a) AS a FROM (SELECT scope, doc_id, unnest([src, dst]) AS node FROM ed) x JOIN act ON act.scope = x.scope AND act.node = x.node GROUP BY ALL),
ekeys AS (SELECT scope, query_id, id FROM around UNION SELECT scope, query_id, id FROM e_rk),
ecue AS (SELECT k.scope, k.query_id, 'edge' AS kind, k.id, (coalesce(1.0 / (60 + rk), 0) + coalesce(a, 0) * 0.45) * (0.5 + 0.5 * c) AS score, 1 AS part, ed.ord AS inn, terms FROM ekeys k JOIN ed ON ed.doc_id = k.id AND ed.scope = k.scope LEFT JOIN around ON around.scope = k.scope AND around.query_id = k.query_id AND around.id = k.id LEFT JOIN e_rk ON e_rk.scope = k.scope AND e_rk.query_id = k.query_id AND e_rk.id = k.id),
rcue AS (SELECT f.scope, f.query_id, 'record' AS kind, f.id, score * ({recency}) AS score, 2 AS part, rk AS inn, terms FROM fused f JOIN rc ON rc.doc_id = f.id AND rc.scope = f.scope {hidden}),
cues AS MATERIALIZED (SELECT query_id, kind, id, score, terms, row_number() OVER (PARTITION BY scope, query_id ORDER BY round(score, 9) DESC, part, inn) AS rk FROM (SELECT * FROM ncue UNION ALL SELECT * FROM ecue UNION ALL SELECT * FROM rcue))"""


def oracle_sql() -> dict[str, str]:
    ep, r, n = S.current("experience_episodes"), S.first_arrivals("memory_records"), S.current("memory_nodes")
    sk = "(SELECT * EXCLUDE (rn_) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, stored_at) AS rn_ FROM experience_skills) WHERE rn_ = 1)"
    step = f"(SELECT id, s.tool AS tool, s.observation AS observation, s.evidence.id AS event_id, s.evidence.role AS role, s.evidence.execution AS execution, s.evidence.complete AS complete FROM (SELECT id, unnest(steps) AS s FROM {ep}))"
    fam = f"""e AS MATERIALIZED (SELECT * FROM {ep}), l AS (SELECT e.id, x.id AS p FROM e LEFT JOIN e x ON e.derived_from = x.id), fam AS (SELECT id, id AS family FROM l WHERE p IS NULL UNION ALL SELECT l.id, f.family FROM fam f JOIN l ON l.p = f.id)"""
    last = "lat AS (SELECT * FROM (SELECT e.*, family, row_number() OVER (PARTITION BY family ORDER BY completed_at DESC NULLS LAST, ord DESC) AS k FROM e JOIN fam USING (id)) WHERE k = 1)"
    weight = "CASE outcome.source WHEN 'verified' THEN 1.0 WHEN 'tool-evidence' THEN 0.85 WHEN 'user' THEN 0.9 WHEN 'model' THEN 0.35 ELSE 0.0 END"
    docs = f"docs AS MATERIALIZED (SELECT doc_id, {S.tokenize('text')} AS terms FROM documents WHERE text IS NOT NULL), asked AS (SELECT doc_id AS query_id, terms FROM docs WHERE doc_id % 100 = 0)"
    case = "(SELECT id, any_value(dataset_fingerprint) AS dataset_fingerprint, any_value(source) AS source, any_value(case_group) AS case_group, any_value(question) AS question, any_value(reference) AS reference, any_value(abstention) AS abstention, any_value(evidence_session_ids) AS evidence_session_ids FROM evaluation_cases GROUP BY id)"
    text = "concat_ws(chr(10), title, description, array_to_string(applicability, chr(10)), array_to_string(tags, chr(10)), array_to_string(procedure_steps, chr(10)))"
    lines = f"(SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY ord) AS rk, length('- ' || summary) AS len FROM {n} WHERE status = 'active' AND summary IS NOT NULL)"
    msg = """m AS MATERIALIZED (SELECT lower(trim(any_value(session_id))) AS s, any_value(CASE WHEN at_ms < 100000000000 THEN at_ms * 1000 ELSE at_ms END) AS at_, id AS ord,
  any_value(CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot', 'model') THEN 'assistant' ELSE 'other' END) AS sp FROM history_messages GROUP BY id),
t AS MATERIALIZED (SELECT s AS session_id, turn, min(at_) AS opened_at, count(*) AS events, max(at_) FILTER (sp = 'assistant') IS NOT NULL AS closed, max(at_) FILTER (sp = 'assistant') AS closed_at
  FROM (SELECT *, sum(CASE WHEN sp = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY at_, ord ROWS UNBOUNDED PRECEDING) AS turn FROM m WHERE s <> '' AND at_ IS NOT NULL) WHERE turn > 0 GROUP BY s, turn)"""

    def section(title: str, c: str) -> str:
        return f"CASE WHEN len({c}) > 0 THEN chr(10) || '## {title}' || chr(10) || chr(10) || array_to_string(list_transform({c}, lambda x: '- ' || x), chr(10)) || chr(10) ELSE '' END"

    cut = ", ".join(f"sum(CASE WHEN rk <= {k} THEN 1 ELSE 0 END) AS n{k}, coalesce(sum(CASE WHEN rk <= {k} THEN 1 / log2(rk + 1) END), 0) AS d{k}" for k in (1, 5, 10))
    out = ", ".join(f"round(n{k} / gold, 6) AS recall_{k}, CASE WHEN n{k} > 0 THEN 1 ELSE 0 END AS hit_{k}, round(d{k} / list_sum(list_transform(range(1, least(gold, {k}) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_{k}" for k in (1, 5, 10))
    walk = f"""walk AS (SELECT query_id, CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS kept, CAST([] AS VARCHAR[][]) AS kept_terms FROM (SELECT DISTINCT query_id FROM cues)
  UNION ALL SELECT query_id, rk, CASE WHEN ok THEN list_append(kept, rk) ELSE kept END, CASE WHEN ok THEN list_append(kept_terms, t) ELSE kept_terms END
  FROM (SELECT w.query_id, c.rk, list_distinct(c.terms) AS t, kept, kept_terms, len(kept) < 12 AND len(list_filter(kept_terms, lambda k: {S.jaccard('k', 'list_distinct(c.terms)')} >= 0.7)) = 0 AS ok FROM walk w JOIN cues c ON c.query_id = w.query_id AND c.rk = w.rk + 1)),
fin AS (SELECT query_id, arg_max(kept, rk) AS kept, max(rk) AS n FROM walk GROUP BY 1)"""
    greedy = f"""WITH RECURSIVE x AS MATERIALIZED (SELECT * FROM {lines}), w AS (SELECT scope, CAST(0 AS BIGINT) AS rk, CAST(150 AS BIGINT) AS room, false AS took FROM (SELECT DISTINCT scope FROM x)
UNION ALL SELECT w.scope, x.rk, CASE WHEN len <= room THEN room - len ELSE room END, len <= room FROM w JOIN x ON x.scope = w.scope AND x.rk = w.rk + 1) SELECT scope, rk FROM w WHERE took"""
    metrics = f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS item, round(list_cosine_similarity(q.v, v.v), 9) AS s FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, item, rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item) AS rk FROM s WHERE s > 0) WHERE rk <= 10), g AS (SELECT q.vec_id AS query_id, x.vec_id AS item FROM v q JOIN v x ON q.label = x.label AND q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0),
m AS (SELECT g.query_id, count(*) AS gold, coalesce(max(1.0 / rk), 0) AS rr, {cut} FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.item = g.item GROUP BY 1) SELECT query_id, gold, round(CAST(rr AS DOUBLE), 6) AS rr, {out} FROM m"""
    return {
        "recall_cues": f"{_recall_sql()} SELECT query_id, kind, id, round(score, 6) AS score, rk FROM cues",
        "recall_diverse": f"{_recall_sql()}, {walk} SELECT c.query_id, kind, id, round(score, 6) AS score, c.rk, p.pick, n > len(kept) AS truncated FROM (SELECT query_id, kept, n, unnest(kept) AS rk, generate_subscripts(kept, 1) AS pick FROM fin) p JOIN cues c ON c.query_id = p.query_id AND c.rk = p.rk",
        "recall_scopes": f"{_recall_sql('user')} SELECT query_id, kind, id, round(score, 6) AS score, rk FROM cues",
        "recall_filtered": f"{_recall_sql('user', _ONLY, '1 + 0.15 * ln(1 + support.observations + support.reinforcements)')} SELECT query_id, kind, id, round(score, 6) AS score, rk FROM cues",
        "recall_signals": f"""{_recall_sql('user')}, sg AS (SELECT act.query_id, 'node' AS kind, node AS id, 'lexical' AS signal, rk AS rank, score AS value FROM act JOIN nd ON nd.scope = act.scope AND nd.doc_id = node JOIN n_rk ON n_rk.scope = act.scope AND n_rk.query_id = act.query_id AND n_rk.id = node JOIN n_sc ON n_sc.scope = act.scope AND n_sc.query_id = act.query_id AND n_sc.doc_id = node
UNION ALL SELECT act.query_id, 'node', node, 'graph', NULL, a FROM act JOIN nd ON nd.scope = act.scope AND nd.doc_id = node WHERE a > 0 UNION ALL SELECT act.query_id, 'node', node, 'confidence', NULL, c FROM act JOIN nd ON nd.scope = act.scope AND nd.doc_id = node
UNION ALL SELECT e_rk.query_id, 'edge', e_rk.id, 'lexical', rk, score FROM e_rk JOIN e_sc ON e_sc.scope = e_rk.scope AND e_sc.query_id = e_rk.query_id AND e_sc.doc_id = e_rk.id UNION ALL SELECT query_id, 'edge', id, 'graph', NULL, a FROM around WHERE a > 0 UNION ALL SELECT query_id, 'edge', k.id, 'confidence', NULL, c FROM ekeys k JOIN ed ON ed.scope = k.scope AND ed.doc_id = k.id
UNION ALL SELECT f.query_id, 'record', f.id, 'lexical', f.rk, r_sc.score FROM fused f JOIN r_sc ON r_sc.scope = f.scope AND r_sc.query_id = f.query_id AND r_sc.doc_id = f.id JOIN rc ON rc.scope = f.scope AND rc.doc_id = f.id WHERE record_use IS DISTINCT FROM 'evidence'
UNION ALL SELECT f.query_id, 'record', f.id, 'recency', NULL, CASE WHEN {NOW} <= created_at THEN 1 ELSE pow(2.0, -({NOW} - created_at) / 5184000000.0) END FROM fused f JOIN rc ON rc.scope = f.scope AND rc.doc_id = f.id WHERE record_use IS DISTINCT FROM 'evidence')
SELECT query_id, kind, id, signal, rank, round(value, 6) AS value FROM sg""",
        "episode_steps": f"SELECT tool, role, execution, count(*) AS steps, count(*) FILTER (complete) AS complete, count(DISTINCT id) AS episodes FROM {step} GROUP BY ALL",
        "quote_checks": f"""WITH q AS (SELECT id, any_value({S.key('episode_id')}) AS episode_id, any_value({S.key('event_id')}) AS event_id, any_value(quote) AS quote FROM evidence_quotes GROUP BY id), s AS (SELECT id AS episode_id, lower(trim(event_id)) AS event_id, any_value(observation) AS o FROM {step} WHERE event_id IS NOT NULL GROUP BY ALL)
SELECT q.id, q.episode_id, q.event_id, CASE WHEN o IS NULL THEN NULL WHEN instr(o, quote) > 0 THEN 'exact' WHEN instr(regexp_replace(o, '\\s+', '', 'g'), regexp_replace(quote, '\\s+', '', 'g')) > 0 THEN 'white_space' ELSE 'absent' END AS match, CASE WHEN instr(o, quote) > 0 THEN instr(o, quote) END AS start FROM q LEFT JOIN s ON q.episode_id = s.episode_id AND q.event_id = s.event_id""",
        "latest_per_family": f"WITH RECURSIVE {fam}, {last} SELECT family, id, completed_at FROM lat",
        "environment_match": f"SELECT id, coalesce(environment['os'] = 'linux', false) AS linux, cardinality(environment) AS facts, CAST({weight} AS DOUBLE) AS weight FROM {ep} WHERE environment IS NOT NULL",
        "required_tools": f"WITH s AS MATERIALIZED (SELECT * FROM {sk}), u AS (SELECT DISTINCT c.id, t.tool FROM (SELECT id, unnest(episode_ids) AS ep FROM s) c JOIN {step} t ON t.id = c.ep), w AS (SELECT id, unnest(list_distinct(required_tools)) AS tool FROM s) SELECT w.id, count(*) AS required, count(u.tool) AS used, count(*) = count(u.tool) AS covered FROM w LEFT JOIN u ON u.id = w.id AND u.tool = w.tool GROUP BY w.id",
        "skill_support": f"""WITH RECURSIVE {fam}, {last}, c AS (SELECT DISTINCT k.id, kind, family FROM (SELECT id, kind, unnest(episode_ids) AS ep FROM {sk}) k JOIN fam ON fam.id = k.ep),
j AS (SELECT c.id, c.family, coalesce(CASE WHEN c.kind = 'procedure' THEN outcome.status = 'success' ELSE outcome.status IN ('failure', 'partial') END, false) AS ok, CAST({weight} AS DOUBLE) AS w, session_id, completed_at FROM c JOIN lat USING (family))
SELECT id, count(*) AS families, count(*) FILTER (ok) AS supporting, round(avg(w) FILTER (ok), 6) AS mean_weight, count(DISTINCT CASE WHEN ok THEN coalesce(session_id, family) END) AS sessions, max(completed_at) FILTER (ok) AS last_completed FROM j GROUP BY id""",
        "conflict_pairs": f"WITH k AS MATERIALIZED (SELECT id, scope, lower(title) AS t, array_to_string(list_sort(list_distinct(coalesce(required_tools, []))), ',') AS tools, kind, coalesce(array_to_string(procedure_steps, chr(10)), '') AS p FROM {sk}) SELECT a.id AS id_a, b.id AS id_b, a.kind <> b.kind AS other_kind FROM k a JOIN k b ON a.scope = b.scope AND a.t = b.t AND a.tools = b.tools AND a.id < b.id WHERE a.kind <> b.kind OR a.p <> b.p",
        "source_manifest": f"WITH RECURSIVE {fam}, c AS (SELECT DISTINCT k.id, family FROM (SELECT id, unnest(episode_ids) AS ep FROM {sk}) k JOIN fam ON fam.id = k.ep), m AS (SELECT c.id, e.session_id, e.id AS ep, e.evidence FROM c JOIN fam USING (family) JOIN e ON e.id = fam.id), x AS (SELECT id, session_id, ep, unnest(CASE WHEN len(evidence) > 0 THEN evidence ELSE [NULL] END) AS v FROM m) SELECT id, session_id, count(DISTINCT ep) AS episodes, count(DISTINCT v) AS evidence FROM x GROUP BY ALL",
        "checkpoint_latest": f"WITH e AS MATERIALIZED (SELECT * FROM {ep}) SELECT session_id, id, completed_at FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY completed_at DESC NULLS LAST, id DESC) AS k FROM e WHERE session_id IS NOT NULL AND id NOT IN (SELECT derived_from FROM e WHERE derived_from IS NOT NULL)) WHERE k = 1",
        "skill_search": f"""WITH RECURSIVE {docs}, sd AS MATERIALIZED (SELECT id AS doc_id, confidence, kind, array_to_string(list_sort(list_distinct(coalesce(required_tools, []))), ',') AS context, {S.tokenize(text)} AS terms FROM {sk} WHERE status = 'active'), {bm25_sql('asked', 'sd')},
p AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS pos FROM sc), h AS (SELECT query_id, doc_id AS id, confidence / (60 + pos) AS score, kind, context, list_distinct(terms) AS t FROM p JOIN sd USING (doc_id)),
c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rk FROM h),
walk AS (SELECT query_id, CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT query_id FROM c)
  UNION ALL SELECT query_id, rk, CASE WHEN ok THEN list_append(kept, rk) ELSE kept END FROM (SELECT w.query_id, c.rk, kept, NOT EXISTS (SELECT 1 FROM c k WHERE k.query_id = w.query_id AND list_contains(w.kept, k.rk) AND k.kind IS NOT DISTINCT FROM c.kind AND k.context = c.context AND {S.jaccard('k.t', 'c.t')} >= 0.85) AS ok FROM walk w JOIN c ON c.query_id = w.query_id AND c.rk = w.rk + 1 WHERE len(kept) < 4)),
fin AS (SELECT query_id, arg_max(kept, rk) AS kept FROM walk GROUP BY 1), pk AS (SELECT query_id, unnest(kept) AS at_, generate_subscripts(kept, 1) AS seat FROM fin)
SELECT c.query_id, c.id, round(c.score, 6) AS score, pk.seat AS rk FROM pk JOIN c ON c.query_id = pk.query_id AND c.rk = pk.at_""",
        "skill_markdown": f"""SELECT id, '---' || chr(10) || 'name: experience-' || left(sha256(id), 32) || chr(10) || 'description: "' || regexp_replace(coalesce(description, ''), '(["\\\\])', '\\\\\\1', 'g') || '"' || chr(10) || '---' || chr(10) || chr(10) || '# ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(description, '') || chr(10) || chr(10) || 'Status: ' || status || '; version: ' || version || '; kind: ' || kind || '.' || chr(10) || chr(10) || 'Scope: ' || scope || chr(10) || {section('Applicability', 'applicability')} || {section('Required tools', 'required_tools')} || {section('Procedure', 'procedure_steps')} || {section('Cautions', 'cautions')} || {section('Verification', 'verification')} || {section('Source episodes', 'episode_ids')} AS markdown FROM {sk}""",
        "step_sampling": f"SELECT id, len(steps) AS steps, array_to_string(CASE WHEN len(steps) <= 3 THEN range(0, len(steps)) ELSE [0, (len(steps) - 1) // 2, len(steps) - 1] END, ',') AS picks FROM {ep} WHERE steps IS NOT NULL",
        "overlapping_episodes": f"SELECT id, scope, busy_until FROM (SELECT *, max(completed_at + 259200000) OVER (PARTITION BY scope ORDER BY started_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy_until FROM {ep} WHERE scope IS NOT NULL AND started_at IS NOT NULL) WHERE busy_until > started_at",
        "node_revisions": "WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, version ORDER BY stored_at) AS k FROM memory_nodes WHERE op = 'put') WHERE k = 1), l AS (SELECT id, version, lag(version) OVER w AS previous, "
        + ", ".join(f"{c} IS DISTINCT FROM lag({c}) OVER w AS d_{c}" for c in WATCHED)
        + " FROM o WINDOW w AS (PARTITION BY id ORDER BY version)) SELECT id, version, previous, CASE WHEN previous IS NULL THEN '' ELSE concat_ws(',', "
        + ", ".join(f"CASE WHEN d_{c} THEN '{c}' END" for c in WATCHED)
        + ") END AS changed FROM l",
        "case_fingerprints": f"SELECT sha256(concat_ws('|', coalesce(source, '~'), coalesce(question, '~'), coalesce(reference, '~'), array_to_string(list_sort(evidence_session_ids), ','))) AS fingerprint, count(*) AS cases, min(id) AS first_id FROM {case} GROUP BY 1",
        "shared_sessions": f"WITH s AS MATERIALIZED (SELECT DISTINCT dataset_fingerprint AS name, unnest(evidence_session_ids) AS member FROM {case}), b AS (SELECT DISTINCT training_dataset_fingerprint AS training, held_out_dataset_fingerprint AS held_out FROM experience_banks WHERE held_out_dataset_fingerprint IS NOT NULL) SELECT training, held_out, count(*) AS shared FROM b JOIN s x ON x.name = training JOIN s y ON y.name = held_out AND y.member = x.member WHERE x.member IS NOT NULL GROUP BY 1, 2",
        "banks_as_of": "WITH c AS (SELECT DISTINCT frozen_at AS cutoff FROM experience_banks WHERE frozen_at IS NOT NULL), v AS (SELECT c.cutoff, n.*, row_number() OVER (PARTITION BY cutoff, id ORDER BY version DESC, ord) AS k FROM c JOIN memory_nodes n ON n.stored_at <= c.cutoff) SELECT epoch_ms(cutoff) AS cutoff_ms, node_type, count(*) AS nodes FROM v WHERE k = 1 AND op = 'put' GROUP BY ALL",
        "retrieval_metrics": metrics,
        "retrieval_summary": f"WITH q_ AS ({metrics.replace(', 6)', ', 15)')}) SELECT count(*) AS queries, round(avg(rr), 6) AS mrr, round(avg(CASE WHEN rr = 0 THEN 1.0 ELSE 0.0 END), 6) AS unattributed, " + ", ".join(f"round(avg({m}_{k}), 6) AS {m}_{k}" for k in (1, 5, 10) for m in ("recall", "hit", "ndcg")) + " FROM q_",
        "session_metrics": f"WITH {docs}, {bm25_sql('asked', 'docs')}, t AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rk FROM sc), k AS (SELECT query_id, d.scope, min(rk) AS best FROM t JOIN documents d USING (doc_id) GROUP BY ALL) SELECT query_id, scope, rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best) AS rk FROM k) WHERE rk <= 10",
        "metric_summary": "SELECT grouping(rater) AS overall, rater, count(*) AS n, count(reading_level) AS completed, round(avg(reading_level), 6) AS mean, round(sum(coalesce(reading_level, 0)) / count(*), 6) AS mean_with_failures, CAST(quantile_disc(reading_level, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(reading_level, 0.95) AS DOUBLE) AS p95 FROM level_labels GROUP BY GROUPING SETS ((), (rater))",
        "pass_rate_groups": "WITH c AS (SELECT DISTINCT id, coalesce(source, '?') AS source, coalesce(case_group, '?') AS case_group, abstention FROM evaluation_cases) SELECT source, case_group, count(*) AS cases, count(*) FILTER (NOT abstention) AS answerable FROM c GROUP BY GROUPING SETS ((), (source), (case_group))",
        "round_robin_sample": f"SELECT id, source, seat FROM (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY id) AS seat FROM (SELECT id, coalesce(source, '?') AS source FROM {case})) ORDER BY seat, source LIMIT 40",
        "budget_prefix": f"SELECT scope, rk, used FROM (SELECT scope, rk, sum(len + 1) OVER (PARTITION BY scope ORDER BY rk) - 1 AS used FROM {lines}) WHERE used <= 150",
        "budget_greedy": greedy,
        "recency_baseline": f"SELECT scope, id, rk FROM (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, ord) AS rk FROM {r}) WHERE rk <= 10",
        "turn_capture": f"WITH {msg} SELECT * FROM t",
        "every_fifth_turn": f"WITH {msg} SELECT session_id, turn, nth FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS nth FROM t WHERE closed) WHERE nth % 5 = 0",
        "gap_sessions": "WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f) SELECT user_id, session, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS ended_us, count(*) AS events FROM s GROUP BY ALL",
    }
