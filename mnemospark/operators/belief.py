"""Belief state: decayed views, profiles, suggestions, support folds, upserts, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.numeric import POLICY, decayed, reinforced, weakened
from mnemospark.operators.capture import running_count
from mnemospark.operators.views import latest


def believed(beliefs: DataFrame, now: int, least: float = 0.0) -> DataFrame:
    """Active beliefs with ``confidence`` decayed to ``now``, those below ``least`` dropped after decay.

    Nodes and edges alike; edges carry no support, so their last sighting is updated_at.
    """
    seen = F.col("support.last_seen_at") if "support" in beliefs.columns else F.col("updated_at")
    return beliefs.where("status = 'active'").withColumn("confidence", decayed("confidence", "half_life_ms", seen, now)).where(F.col("confidence") >= least)


def standing(confidence: str = "confidence") -> Column:
    """How much a belief weighs in a digest: confidence times the logarithm of its sightings."""
    return F.col(confidence) * F.log1p(F.col("support.observations") + F.col("support.reinforcements"))


def profile(nodes: DataFrame, now: int, limit: int = POLICY["profile_limit"], types: tuple[str, ...] | None = None, least: float = 0.0) -> DataFrame:
    """Best ``limit`` active nodes of each scope by ``standing``, with their rank and the scope's total.

    types restricts the node types (suggestions: project, routine, procedure).
    """
    held = believed(nodes, now, least)
    if types:
        held = held.where(F.col("node_type").isin(*types))
    held = held.withColumn("standing", F.round(standing(), 9))
    total = held.groupBy("scope").agg(F.count(F.lit(1)).alias("total"))
    order = Window.partitionBy("scope").orderBy(F.col("standing").desc_nulls_last(), "ord", "id")
    return held.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= limit).join(total, "scope")


def folded_support(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Support of each key from its observations (evidence ARRAY, session_id, at, ord): the sequential fold as aggregates.

    The first observation creates the belief, every later one reinforces it; an observation adds the evidence not seen
    before. keys, observations (distinct evidence), reinforcements, sessions, first_seen_at, last_seen_at, first_evidence.
    Evidence is counted per (key, id) first, so a key with any number of observations is never gathered.
    """
    rows = observations.select(*keys, "at", "ord", F.posexplode_outer("evidence").alias("pos", "id"))
    firsts = rows.where("id IS NOT NULL").groupBy(*keys, "id").agg(F.min(F.struct("at", "ord", "pos")).alias("first"))
    cited = firsts.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.min_by("id", "first").alias("first_evidence"))
    whole = observations.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("reinforcements"), F.count_distinct("session_id").alias("sessions"), F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"))
    return whole.join(cited, keys, "left").na.fill(0, ["observations"])


def reinforce(nodes: DataFrame, signals: DataFrame, reinforcement: float = POLICY["reinforcement_rate"], contradiction: float = POLICY["contradiction_rate"]) -> DataFrame:
    """Applies signals (id, verdict 'reinforce' or 'contradict', at) to nodes: confidence, counters, last sighting.

    Reinforcements come first, then contradictions, each as often as it is signalled; only reinforcements move the last
    sighting. Retracted nodes refuse both and stay as they are; nodes without a signal stay as they are.
    """
    n = signals.groupBy("id").agg(F.count_if(F.col("verdict") == "reinforce").alias("ups"), F.count_if(F.col("verdict") == "contradict").alias("downs"), F.max(F.when(F.col("verdict") == "reinforce", F.col("at"))).alias("last_up"))
    joined = nodes.join(n, "id", "left")
    takes = F.col("ups").isNotNull() & (F.col("status") != "retracted")
    up = reinforced("confidence", reinforcement, F.col("ups"))
    both = up * F.pow(F.lit(1.0 - contradiction), F.col("downs"))
    counters = F.col("support")
    for name, add in (("reinforcements", F.col("ups")), ("contradictions", F.col("downs"))):
        counters = counters.withField(name, (F.col(f"support.{name}") + add).cast("int"))
    counters = counters.withField("last_seen_at", F.greatest("support.last_seen_at", "last_up"))
    return joined.withColumn("support", F.when(takes, counters).otherwise(F.col("support"))).withColumn("confidence", F.when(takes, F.greatest(both, F.lit(0.0))).otherwise(F.col("confidence"))).drop("ups", "downs", "last_up")


def contradicted(nodes: DataFrame, rate: float = POLICY["contradiction_rate"]) -> DataFrame:
    return nodes.withColumn("confidence", weakened("confidence", rate))


def upsert_nodes(nodes: DataFrame, assertions: DataFrame, rate: float = POLICY["reinforcement_rate"], asserted: float = POLICY["asserted_confidence"]) -> DataFrame:
    """Asserted nodes merged by (scope, node_type, label): one row per asserted key, ``created`` or reinforced.

    nodes: active rows; of several with the key the one of least ord counts. assertions: scope, node_type, label, summary,
    evidence ARRAY, at, ord; of several with one key the last summary stays and evidence is united by first citation.
    An existing belief's given confidence stays and is reinforced once per assertion.
    """
    keys = ["scope", "node_type", "label"]
    found = latest(nodes.where("status = 'active'"), keys, [F.col("ord")])
    asked = assertions.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"), F.max_by("summary", F.struct("at", "ord")).alias("summary"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ord", "evidence"))), lambda x: x["evidence"]))).alias("added"), F.max("at").alias("at"))
    old = found.select(*keys, F.col("id").alias("old_id"), F.col("confidence").alias("old"), F.col("evidence").alias("old_evidence"))
    joined = asked.join(old, keys, "left")
    created = F.col("old_id").isNull()
    evidence = F.when(created, F.col("added")).otherwise(F.array_union("old_evidence", "added"))
    start = F.when(created, F.lit(asserted)).otherwise(F.col("old"))
    steps = F.col("times") - F.when(created, 1).otherwise(0)
    return joined.select(
        *keys,
        F.coalesce("old_id", F.concat(F.lit("node-"), F.left(F.sha2(F.concat_ws("\u0000", *keys), 256), F.lit(12)))).alias("id"),
        created.alias("created"),
        "summary",
        reinforced(start, rate, steps).alias("confidence"),
        evidence.alias("evidence"),
        F.size(F.array_except("added", F.coalesce("old_evidence", F.array().cast("array<string>")))).alias("new_evidence"),
    )


def retired(beliefs: DataFrame, now: int, floor: float = POLICY["retirement_floor"]) -> DataFrame:
    """Active inferred beliefs whose decayed confidence lies below the floor; asserted ones never retire."""
    return believed(beliefs.where("origin = 'inferred'"), now).where(F.col("confidence") < floor)


def evicted(records: DataFrame, beliefs: list[DataFrame], budget: int) -> DataFrame:
    """Records over each scope's budget: the oldest ones that no belief's evidence cites.

    The order within a scope is counted over day buckets, so a scope of any size is spread over tasks.
    """
    over = records.groupBy("scope").agg((F.count(F.lit(1)) - budget).alias("overflow")).where("overflow > 0")
    cited = beliefs[0].select("scope", F.explode("evidence").alias("id"))
    for more in beliefs[1:]:
        cited = cited.unionByName(more.select("scope", F.explode("evidence").alias("id")))
    free = records.join(over, "scope").join(cited.distinct(), ["scope", "id"], "left_anti")
    marked = free.withColumn("__one", F.lit(1)).withColumn("__day", F.floor(F.col("created_at") / 86_400_000))
    placed = running_count(marked, ["scope"], "__day", ["created_at", "ord"], "__one", "rk")
    return placed.where("rk <= overflow").drop("rk", "overflow", "__one", "__day")
