"""Episodes and skills: evidence quotes, families, support, conflicts, manifests, search, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.numeric import POLICY
from mnemospark.functions.text import similarity, tokenize
from mnemospark.operators import ranking as R
from mnemospark.operators.capture import running_max
from mnemospark.operators.graph import chain_roots
from mnemospark.operators.views import folded_in_blocks, latest
from mnemospark.runtime import checkpointed, stored

#: How much an outcome weighs, by its source.
OUTCOME_WEIGHT = {"verified": 1.0, "tool-evidence": 0.85, "user": 0.9, "model": 0.35, "unknown": 0.0}


def outcome_weight(source: str = "outcome.source") -> Column:
    out = F.lit(0.0)
    for name, w in OUTCOME_WEIGHT.items():
        out = F.when(F.col(source) == name, w).otherwise(out)
    return out


def environment_matches(constraints: Column, environment: Column) -> Column:
    """Every key of the constraints has the same value in the environment; no constraints match anything."""
    return F.coalesce(F.forall(F.map_entries(constraints), lambda e: F.coalesce(F.element_at(environment, e["key"]) == e["value"], F.lit(False))), F.lit(True))


def context_key(tools: Column) -> Column:
    """Equal for equal sets of required tools, whatever their order."""
    return F.array_join(F.array_sort(F.array_distinct(F.coalesce(tools, F.array().cast("array<string>")))), ",")


def steps(episodes: DataFrame) -> DataFrame:
    """One row per step: id, no, action, observation, tool, event_id, seq, role, execution, complete."""
    s = episodes.select("id", F.posexplode("steps").alias("no", "s"))
    return s.select("id", "no", "s.action", "s.observation", "s.tool", F.col("s.evidence.id").alias("event_id"), "s.evidence.seq", "s.evidence.role", "s.evidence.execution", "s.evidence.complete")


def quote_checks(quotes: DataFrame, episodes: DataFrame) -> DataFrame:
    """Each quote against the observation of the step it cites: id, found BOOLEAN (null without such a step), match:
    'exact', 'white_space' (equal but for white space), 'absent'; start (1-based, exact matches).

    quotes: id, episode_id, event_id, quote (normal keys).
    """
    s = steps(episodes).where("event_id IS NOT NULL").select(F.col("id").alias("episode_id"), F.lower(F.trim("event_id")).alias("event_id"), "observation").dropDuplicates(["episode_id", "event_id"])
    joined = quotes.join(s, ["episode_id", "event_id"], "left")
    at = F.expr("instr(observation, quote)")
    match = F.when(F.col("observation").isNull(), F.lit(None).cast("string")).when(at > 0, "exact").when(F.expr("instr(regexp_replace(observation, '\\\\s+', ''), regexp_replace(quote, '\\\\s+', ''))") > 0, "white_space").otherwise("absent")
    return joined.select("id", "episode_id", "event_id", match.alias("match"), F.when(at > 0, at).alias("start"))


def families(episodes: DataFrame) -> DataFrame:
    """id, family: the root of each episode's derived_from chain; episodes on a cycle have none and are left out."""
    return chain_roots(episodes.select("id", "derived_from"), "derived_from").where("root IS NOT NULL").select("id", F.col("root").alias("family"))


def latest_in_family(episodes: DataFrame) -> DataFrame:
    """The latest episode of each family by completed_at, ties to the last by ord."""
    return latest(episodes.join(families(episodes), "id"), ["family"], [F.col("completed_at").desc_nulls_last(), F.col("ord").desc()])


def skill_support(skills: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per skill: cited families, those whose latest episode supports the skill's kind, mean outcome weight of the
    supporting ones, independent sessions, last completion.

    A procedure is supported by success, a pitfall by failure or partial success.
    """
    ends = latest_in_family(episodes).select("family", "session_id", "completed_at", F.col("outcome.status").alias("outcome_status"), outcome_weight().alias("weight"))
    cited = skills.select("id", "kind", F.explode("episode_ids").alias("episode")).join(families(episodes).withColumnRenamed("id", "episode"), "episode").select("id", "kind", "family").distinct()
    joined = cited.join(ends, "family")
    supports = F.when(F.col("kind") == "procedure", F.col("outcome_status") == "success").otherwise(F.col("outcome_status").isin("failure", "partial"))
    ok = F.coalesce(supports, F.lit(False))
    return joined.groupBy("id").agg(
        F.count(F.lit(1)).alias("families"),
        F.count_if(ok).alias("supporting"),
        F.avg(F.when(ok, F.col("weight"))).alias("mean_weight"),
        F.count_distinct(F.when(ok, F.coalesce("session_id", "family"))).alias("sessions"),
        F.max(F.when(ok, F.col("completed_at"))).alias("last_completed"),
    )


def conflicting_skills(skills: DataFrame) -> DataFrame:
    """id_a < id_b of skills with one scope, title (in lower case) and tool context but another kind or procedure.

    Groups of equal title are joined by key; of rows equal in all compared respects each keeps its own id.
    """
    keyed = skills.select("id", "scope", F.lower("title").alias("title"), context_key(F.col("required_tools")).alias("tools"), "kind", F.coalesce(F.array_join("procedure_steps", "\n"), F.lit("")).alias("procedure"))
    a, b = (keyed.select("scope", "title", "tools", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "kind", "procedure")]) for x in "ab")
    pairs = a.join(b, ["scope", "title", "tools"]).where("id_a < id_b AND (kind_a <> kind_b OR procedure_a <> procedure_b)")
    return pairs.select("id_a", "id_b", (F.col("kind_a") != F.col("kind_b")).alias("other_kind"))


def search_text() -> Column:
    return F.concat_ws("\n", "title", "description", "applicability", "tags", "procedure_steps")


def skill_search(queries: DataFrame, skills: DataFrame, limit: int, some: int = 64) -> DataFrame:
    """query_id, id, score, rk: BM25 over the skills given, each hit weighed by rank score times confidence, best ``limit``.

    queries: query_id, terms. Filter skills (status, expiry, tools) before: statistics are those of the rows given. A hit
    of the kind and tool context of a selected one whose search text is as similar as duplicates are is skipped; the walk
    over all hits is exact and goes block by block. rk counts the selected ones.

    A hit behind position n has at most the greatest confidence / (61 + n). So the walk goes over those of the first ``some``
    hits that have more; requests for which it doesn't end there take eight times as many hits, at last all.
    """
    docs = stored(skills.select(F.col("id").alias("doc_id"), "confidence", "kind", context_key(F.col("required_tools")).alias("context"), tokenize(search_text()).alias("terms")))
    met = R.Meeting(queries, None, docs)
    met.requests = requests = checkpointed(met.requests)
    most_confident = docs.agg(F.max("confidence")).first()[0]
    texts = docs.select(F.col("doc_id").alias("id"), F.array_distinct("terms").alias("terms"))

    def step(kept: Column, x: Column) -> Column:
        close = F.exists(kept, lambda y: y["kind"].eqNullSafe(x["kind"]) & (y["context"] == x["context"]) & (similarity(y["terms"], x["terms"], True) >= POLICY["duplicate_similarity"]))
        return F.when((F.size(kept) >= limit) | close, kept).otherwise(F.concat(kept, F.array(x)))

    out = None
    while True:
        whole = some >= met.n
        hits = R.ranked(met.found(None if whole else some, requests=requests), ["query_id"], [F.round("score", 9).desc(), F.col("doc_id")], "pos")
        hits = hits if whole else hits.where(F.col("pos") <= some)
        scored = hits.join(docs.drop("terms"), "doc_id").select("query_id", F.col("doc_id").alias("id"), "kind", "context", (F.col("confidence") / (60 + F.col("pos"))).alias("score"))
        if not whole:
            scored = checkpointed(scored)
            full = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= some).select("query_id", F.lit(True).alias("full"))
            least = max(most_confident or 0.0, 0.0) / (61 + some) + 2 * R.NEAR
            scored = scored.join(full, "query_id", "left").where(F.col("full").isNull() | (F.round("score", 9) > least)).drop("full")
        walked = R.ranked(scored, ["query_id"], [F.round("score", 9).desc(), F.col("id")])
        kinds = dict(walked.dtypes) | {"terms": "array<string>"}
        fields = ["rk", "id", "score", "kind", "context", "terms"]
        start = F.array().cast(f"array<struct<{','.join(f'{c}:{kinds[c]}' for c in fields)}>>")
        kept = folded_in_blocks(walked.select("query_id", *fields[:-1]), ["query_id"], "rk", F.struct(*fields), start, step, F.size("state") < limit, attach=lambda part: part.join(texts, "id"), size=4 * limit)
        if not whole:
            left = checkpointed(full.select("query_id").join(kept.where(F.size("state") >= limit), "query_id", "left_anti"))
            kept = kept.join(left, "query_id", "left_anti")
        out = kept if out is None else out.unionByName(kept)
        if whole or left.isEmpty():
            return out.select("query_id", F.posexplode("state").alias("at", "x")).select("query_id", "x.id", "x.score", (F.col("at") + 1).alias("rk"))
        requests, some = requests.join(left, "query_id", "left_semi"), 8 * some


def source_manifest(skills: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per skill and session: episodes and distinct evidence of the families it cites; session null where unknown."""
    fam = families(episodes)
    cited = skills.select("id", F.explode("episode_ids").alias("episode")).join(fam.withColumnRenamed("id", "episode"), "episode").select("id", "family").distinct()
    members = fam.withColumnRenamed("id", "episode").join(episodes.select(F.col("id").alias("episode"), "session_id", "evidence"), "episode")
    rows = cited.join(members, "family").select("id", "session_id", "episode", F.explode_outer("evidence").alias("e"))
    return rows.groupBy("id", "session_id").agg(F.count_distinct("episode").alias("episodes"), F.count_distinct("e").alias("evidence"))


def sampled_steps(episodes: DataFrame, most: int) -> DataFrame:
    """At most ``most`` steps of each episode, evenly spaced with both ends: id, n_steps, picks ARRAY<INT> (0-based)."""
    n = F.size("steps")
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (n - 1) / (most - 1)).cast("int"))
    return episodes.where("steps IS NOT NULL").select("id", n.alias("n_steps"), F.when(n == 0, F.array().cast("array<int>")).when(n <= most, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(spread).alias("picks"))


def skill_markdown(skills: DataFrame) -> DataFrame:
    """id, markdown: a skill as a document with front matter; sections without items are left out."""

    def section(name: str, items: str) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"\n## {name}\n\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"))).otherwise("")

    name = F.concat(F.lit("experience-"), F.left(F.sha2("id", 256), F.lit(32)))
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.coalesce("description", F.lit("")), r'(["\\])', r"\\$1"), F.lit('"'))
    head = F.concat(F.lit("---\nname: "), name, F.lit("\ndescription: "), quoted, F.lit("\n---\n\n# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("description", F.lit("")))
    state = F.concat(F.lit("\n\nStatus: "), "status", F.lit("; version: "), F.col("version").cast("string"), F.lit("; kind: "), "kind", F.lit(".\n\nScope: "), "scope", F.lit("\n"))
    parts = [section("Applicability", "applicability"), section("Required tools", "required_tools"), section("Procedure", "procedure_steps"), section("Cautions", "cautions"), section("Verification", "verification"), section("Source episodes", "episode_ids")]
    return skills.select("id", F.concat(head, state, *parts).alias("markdown"))


def overlapping(rows: DataFrame, by: list[str], start: str, end: str, bucket_ms: int = 86_400_000) -> DataFrame:
    """Rows that begin before an earlier one of their group has ended: a running maximum of ends by day, no pairs."""
    daily = rows.withColumn("__day", F.floor(F.col(start) / bucket_ms))
    return running_max(daily, by, "__day", [start, "id"], end, "busy_until").drop("__day").where(F.col("busy_until") > F.col(start))


def revisions(versions: DataFrame, watched: list[str]) -> DataFrame:
    """id, version, previous (version), changed ARRAY<STRING> (watched columns that differ from the previous version's) of all
    versions of every id; of resent rows of a version the first by stored_at. The first version has no previous one.
    """
    one = latest(versions, ["id", "version"], [F.col("stored_at")]).select("id", "version", F.struct(*watched).alias("now"))
    order = Window.partitionBy("id").orderBy("version")
    lined = one.withColumns({"before": F.lag("now").over(order), "previous": F.lag("version").over(order)})
    changed = F.filter(F.array(*[F.when(F.col("previous").isNotNull() & ~F.col(f"now.{c}").eqNullSafe(F.col(f"before.{c}")), F.lit(c)) for c in watched]), lambda c: c.isNotNull())
    return lined.select("id", "version", "previous", changed.alias("changed"))
