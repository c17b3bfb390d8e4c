"""Queries of rendered lines, tool calls, judgements, floors and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import render as X
from mnemospark.operators import evaluation as E
from mnemospark.plans import sqltext as S
from mnemospark.plans.belief import edges, nodes, records
from mnemospark.plans.experience import episodes
from mnemospark.runtime import table


def cue_lines(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, edges and records as the lines a reader sees."""
    n = nodes(spark, d).select("id", X.belief_line("node_type", "summary").alias("line"))
    e = edges(spark, d).select("id", X.belief_line("relation", "claim").alias("line"))
    return n.unionByName(e).unionByName(records(spark, d).select("id", X.record_line().alias("line")))


#: Forms that node labels are read as commands in; {} is the label.
FORMS = ("", "suggest", " STATS ", "search  {}", "Forget {}", "search ", "{}", "help")


def memory_commands(spark: SparkSession, d: str) -> DataFrame:
    """Node labels in every form of a typed command, by turns."""
    forms = F.array(*[F.lit(f) for f in FORMS])
    n = nodes(spark, d).select("id", F.replace(F.get(forms, (F.col("ord") % len(FORMS)).cast("int")), F.lit("{}"), F.col("label")).alias("raw"))
    return n.select("id", X.memory_command("raw").alias("c")).select("id", "c.kind", "c.argument")


#: Shell commands of every role, and closing lines of every execution, given to the steps by turns.
COMMANDS = ("pytest -q", "rm -rf build", "echo 'rm x'", "git commit -m done", "cargo test", "npm run check", "ls > out.txt", "python -m unittest", "sudo mv a b", "cat notes", "ls # rm x", "pnpm install", "cd app && vitest", "npm exec jest")
ENDINGS = ("[exit code: 0]", "[exit code: 2]", "[timed out after 5 s]", "[killed by signal: 9]", "done", "[command finished with exit code -1]", "[status: running]")


def call_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles of the steps' tools and commands, and the execution that a result's closing line tells."""
    turn = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), ((F.col("ord") + F.col("no")) % len(xs)).cast("int"))
    s = episodes(spark, d).select("id", "ord", F.posexplode("steps").alias("no", "s")).select("id", "ord", "no", F.when(F.col("s.tool").isin("shell_run", "test_run"), "bash").otherwise(F.regexp_replace("s.tool", "^file_", "")).alias("tool"), F.col("s.observation").alias("observation"))
    given = s.withColumns({"command": turn(COMMANDS), "result": F.concat(F.coalesce("observation", F.lit("")), F.lit("\n"), turn(ENDINGS))})
    return given.select("id", "no", X.call_role("tool", "command").alias("role"), X.call_execution("result").alias("execution"))


def keyword_judge(spark: SparkSession, d: str) -> DataFrame:
    """The first half of each reference, as an answer, judged by the reference's long words: those the question doesn't
    already hold count.
    """
    c = table(spark, d, "evaluation_cases").dropDuplicates(["id"]).where("reference IS NOT NULL")
    words = F.array_distinct(F.regexp_extract_all("reference", F.lit(r"[A-Za-z]{7,}"), F.lit(0)))
    half = F.left("reference", F.floor(F.length("reference") / 2).cast("int"))
    j = E.keyword_judgement(c.select("id", "question", half.alias("answer"), words.alias("keywords")))
    return j.select("id", F.size("keywords").alias("keywords"), "countable", "hits", "passed")


def random_floor(spark: SparkSession, d: str) -> DataFrame:
    """Ten documents at random for every hundredth document, and whether they are of its source."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    picks = E.random_floor(docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id")), docs.select(F.col("doc_id").alias("item")), 10)
    source = lambda c: docs.select(F.col("doc_id").alias(c), F.col("source").alias(f"{c}_source"))
    both = picks.join(source("query_id"), "query_id").join(source("item"), "item")
    return both.select("query_id", "item", F.col("rk").cast("int").alias("rk"), F.col("query_id_source").eqNullSafe(F.col("item_source")).alias("same_source"))


def replay_visible(spark: SparkSession, d: str) -> DataFrame:
    """Node versions as events of their scope, erasures as forget requests: what was visible when every hundredth row came."""
    v = table(spark, d, "memory_nodes").select("id", "scope", "op", "ord", F.unix_micros(F.col("stored_at").cast("timestamp")).alias("seq"))
    erased = v.where("op = 'erase'").select("id", F.col("seq").alias("gone"))
    forgets = v.where("op = 'put'").join(erased, "id").select(F.col("scope").alias("episode"), F.col("gone").alias("seq"), F.col("ord").alias("target"))
    events = v.where("op = 'put'").select(F.col("scope").alias("episode"), "seq", F.col("ord").alias("id"))
    tasks = v.where("ord % 100 = 0").select(F.col("scope").alias("episode"), F.col("seq").alias("cutoff"), F.col("ord").alias("task_id"))
    return E.visible_counts(events, forgets, tasks, 86_400_000_000)


def queries() -> dict:
    return {f.__name__: f for f in [cue_lines, memory_commands, call_roles, keyword_judge, random_floor, replay_visible]}


def oracle_sql() -> dict[str, str]:
    n, e, r, ep = S.current("memory_nodes"), S.first_arrivals("memory_edges"), S.first_arrivals("memory_records"), S.current("experience_episodes")
    line = lambda kind, text, source: f"SELECT id, '- [' || {kind} || ' · ' || printf('%.2f', round(confidence + 1e-9, 2)) || ' · ' || origin || '] ' || coalesce({text}, '') AS line FROM {source}"
    tool = "CASE WHEN s.tool IN ('shell_run', 'test_run') THEN 'bash' ELSE regexp_replace(s.tool, '^file_', '') END"
    # what the commands and endings mean, by hand
    roles = "check action unknown action check check action check action unknown unknown action check check".split()
    ends = "completed failed incomplete failed completed failed incomplete".split()
    editing = ", ".join(f"'{t}'" for t in X.EDITING_TOOLS)
    return {
        "cue_lines": f"{line('node_type', 'summary', n)} UNION ALL {line('relation', 'claim', e)} UNION ALL SELECT id, '- [episode · ' || strftime(epoch_ms(created_at), '%Y-%m-%d') || ' · ' || fidelity || '] ' || coalesce(text, '') FROM {r}",
        "memory_commands": f"""WITH r AS (SELECT id, trim(regexp_replace(replace([{', '.join(repr(f) for f in FORMS)}][ord % {len(FORMS)} + 1], '{{}}', label), '\\s+', ' ', 'g')) AS flat FROM {n}),
c AS (SELECT id, flat, lower(split_part(flat, ' ', 1)) AS head, CASE WHEN instr(flat, ' ') > 0 THEN substr(flat, instr(flat, ' ') + 1) ELSE '' END AS rest FROM r),
k AS (SELECT id, rest, CASE WHEN flat = '' THEN 'show' WHEN head IN ('suggest', 'stats') THEN head WHEN head IN ('search', 'forget') AND rest <> '' THEN head ELSE 'usage' END AS kind FROM c) SELECT id, kind, CASE WHEN kind IN ('search', 'forget') THEN rest END AS argument FROM k""",
        "call_roles": f"""WITH st AS (SELECT id, ord, generate_subscripts(steps, 1) - 1 AS no, unnest(steps) AS s FROM {ep}), t AS (SELECT id, ord, no, {tool} AS tool FROM st)
SELECT id, no, CASE WHEN tool = 'bash' THEN {roles}[(ord + no) % {len(COMMANDS)} + 1] WHEN tool IN ({editing}) THEN 'action' ELSE 'unknown' END AS role, {ends}[(ord + no) % {len(ENDINGS)} + 1] AS execution FROM t""",
        "keyword_judge": "WITH c AS (SELECT id, any_value(question) AS q, any_value(reference) AS r FROM evaluation_cases GROUP BY id), k AS (SELECT id, coalesce(q, '') AS q, left(r, length(r) // 2) AS a, list_distinct(regexp_extract_all(r, '[A-Za-z]{7,}')) AS ks FROM c WHERE r IS NOT NULL), f AS (SELECT *, list_filter(ks, lambda x: NOT contains(q, x)) AS cs FROM k) SELECT id, len(ks) AS keywords, len(cs) AS countable, len(list_filter(cs, lambda x: contains(a, x))) AS hits, len(list_filter(cs, lambda x: contains(a, x))) > 0 AS passed FROM f",
        "random_floor": """WITH h AS (SELECT doc_id, source, CAST('0x' || left(md5('item' || doc_id), 8) AS BIGINT) % 1048576 AS slot, CAST('0x' || left(md5('query' || doc_id), 8) AS BIGINT) % 1048576 AS start FROM documents),
p AS (SELECT q.doc_id AS query_id, i.doc_id AS item, q.source IS NOT DISTINCT FROM i.source AS same_source, row_number() OVER (PARTITION BY q.doc_id ORDER BY (i.slot - q.start + 1048576) % 1048576, i.doc_id) AS rk FROM h q, h i WHERE q.doc_id % 100 = 0) SELECT query_id, item, rk, same_source FROM p WHERE rk <= 10""",
        "replay_visible": """WITH v AS (SELECT id, scope, op, ord, epoch_us(stored_at) AS seq FROM memory_nodes), g AS (SELECT id, min(seq) AS gone FROM v WHERE op = 'erase' GROUP BY id), p AS (SELECT v.scope, v.ord, v.seq, g.gone FROM v LEFT JOIN g USING (id) WHERE op = 'put')
SELECT t.ord AS task_id, count(p.ord) AS visible FROM (SELECT * FROM v WHERE ord % 100 = 0) t LEFT JOIN p ON p.scope = t.scope AND p.seq <= t.seq AND (p.gone IS NULL OR greatest(p.gone, p.seq) > t.seq) GROUP BY t.ord""",
    }
