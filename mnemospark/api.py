"""What a memory tool offers, over versioned tables: remember, assert, relate, search, profile, suggest, stats, retract,
supersede, consolidate, sweep, forget. All calls take and return DataFrames and serve any number of scopes at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.numeric import POLICY
from mnemospark.functions.text import tokenize
from mnemospark.operators import belief as B
from mnemospark.operators import graph as G
from mnemospark.operators import mining as M
from mnemospark.operators import recall as R
from mnemospark.operators.context import similar_nodes
from mnemospark.operators.invariants import effective_use
from mnemospark.runtime import checkpointed
from mnemospark.sources.store import StoreError, VersionedTable

_SUPPORT = "struct<observations:int,reinforcements:int,contradictions:int,sessions:int,first_seen_at:bigint,last_seen_at:bigint>"
RECORD = "id string, scope string, kind string, text string, fidelity string, record_use string, terms array<string>, provenance struct<author:string,session_id:string,turn:int,skill:string>, created_at bigint, promoted_to array<string>, status string, superseded_by string, ord bigint"
NODE = f"id string, scope string, node_type string, label string, summary string, confidence double, half_life_ms bigint, support {_SUPPORT}, evidence array<string>, origin string, status string, superseded_by string, created_at bigint, updated_at bigint, ord bigint"
EDGE = "id string, scope string, src string, dst string, relation string, claim string, confidence double, half_life_ms bigint, evidence array<string>, origin string, status string, superseded_by string, created_at bigint, updated_at bigint, ord bigint"


def content_id(prefix: str, *columns: str):
    """A deterministic id from the values of columns."""
    return F.concat(F.lit(f"{prefix}-"), F.left(F.sha2(F.to_json(F.struct(*columns)), 256), F.lit(16)))


class Memory:
    """Records, nodes and edges in three versioned tables under one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.tables = {n: VersionedTable(spark, f"{path}/{n}") for n in ("records", "nodes", "edges")}
        self.schemas = {"records": RECORD, "nodes": NODE, "edges": EDGE}

    def current(self, name: str, scopes: list[str] | None = None) -> DataFrame:
        """Current rows of a table; empty with the table's schema before the first write."""
        t = self.tables[name]
        return t.current(scopes) if t.exists() else self.spark.createDataFrame([], self.schemas[name])

    def _put(self, name: str, rows: DataFrame) -> int:
        fields = self.spark.createDataFrame([], self.schemas[name]).schema
        shaped = checkpointed(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]))
        n = shaped.count()
        if n:
            self.tables[name].put(shaped)
        return n

    # -- writing

    def remember(self, observations: DataFrame) -> int:
        """scope, kind, text, created_at and perhaps session_id, turn, author, skill, record_use, fidelity -> records.

        Blank texts are refused. Ids come from the content, so the same observation twice is one record.
        """
        if not observations.where("text IS NULL OR trim(text) = ''").isEmpty():
            raise StoreError("invalid-input", "an observation without text")
        have = set(observations.columns)
        pick = lambda c, kind="string": F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
        rows = observations.select(
            "scope", "kind", "text", "created_at",
            F.coalesce(pick("fidelity"), F.lit("verbatim")).alias("fidelity"),
            pick("record_use").alias("record_use"),
            F.struct(pick("author").alias("author"), pick("session_id").alias("session_id"), pick("turn", "int").alias("turn"), pick("skill").alias("skill")).alias("provenance"),
        )
        rows = rows.withColumn("record_use", effective_use()).withColumn("id", content_id("rec", "scope", "kind", "text", "created_at", "provenance"))
        rows = rows.dropDuplicates(["id"]).join(self.current("records").select("id"), "id", "left_anti")
        none = F.lit(None).cast("string")
        return self._put("records", rows.select("*", tokenize("text").alias("terms"), F.array().alias("promoted_to"), F.lit("active").alias("status"), none.alias("superseded_by"), F.col("created_at").alias("ord")))

    def assert_beliefs(self, assertions: DataFrame, origin: str = "asserted") -> int:
        """scope, node_type, label, summary, evidence, at -> nodes created or reinforced (see ``belief.upsert_nodes``).

        With another origin than 'asserted', a label that restates one already held reinforces that one.
        """
        held = checkpointed(self.current("nodes"))
        asked = assertions.withColumn("label", F.trim("label")).withColumn("ord", F.col("at"))
        start, half = (POLICY["asserted_confidence"], None) if origin == "asserted" else (POLICY["inferred_confidence"], POLICY["inferred_half_life_ms"])
        if origin != "asserted":
            named = asked.withColumn("id", content_id("c", "scope", "node_type", "label"))
            like = similar_nodes(named.dropDuplicates(["id"]), held, POLICY["duplicate_threshold"]).join(held.select(F.col("id").alias("node"), F.col("label").alias("old_label")), "node")
            asked = named.join(like.select(F.col("candidate").alias("id"), "old_label"), "id", "left").withColumn("label", F.coalesce("old_label", "label")).drop("old_label", "id")
        at = asked.groupBy("scope", "node_type", "label").agg(F.max("at").alias("at"))
        merged = B.upsert_nodes(held, asked, asserted=start).join(at, ["scope", "node_type", "label"])
        old = held.select("id", F.col("support").alias("s"), F.col("created_at").alias("since"), F.col("ord").alias("o"), F.col("origin").alias("g"), F.col("half_life_ms").alias("h"), F.col("summary").alias("old_summary"))
        joined = merged.join(old, "id", "left")
        count = lambda name: F.coalesce(F.col(f"s.{name}"), F.lit(0))
        support = F.struct((count("observations") + F.col("new_evidence")).alias("observations"), (count("reinforcements") + F.when(F.col("created"), 0).otherwise(1)).alias("reinforcements"), count("contradictions").alias("contradictions"), (count("sessions") + (F.col("new_evidence") > 0).cast("int")).alias("sessions"), F.coalesce("s.first_seen_at", "at").alias("first_seen_at"), F.greatest("s.last_seen_at", "at").alias("last_seen_at")).cast(_SUPPORT)
        strongest = F.when((F.col("g") == "asserted") | F.lit(origin == "asserted"), "asserted").otherwise(F.lit(origin))
        life = F.when(strongest == "asserted", F.lit(None).cast("bigint")).otherwise(F.coalesce("h", F.lit(half).cast("bigint")))
        return self._put("nodes", joined.select("id", "scope", "node_type", "label", F.coalesce("summary", "old_summary").alias("summary"), "confidence", life.alias("half_life_ms"), support.alias("support"), "evidence", strongest.alias("origin"), F.lit("active").alias("status"), F.lit(None).alias("superseded_by"), F.coalesce("since", "at").alias("created_at"), F.col("at").alias("updated_at"), F.coalesce("o", "at").alias("ord")))

    def relate(self, relations: DataFrame, origin: str = "asserted") -> int:
        """scope, src, dst, relation, claim, evidence, at -> edges; both ends must be nodes of the scope."""
        ends = self.current("nodes").select("scope", F.col("id").alias("end"))
        wanted = relations.select("scope", F.explode(F.array("src", "dst")).alias("end"))
        if not wanted.join(ends, ["scope", "end"], "left_anti").isEmpty():
            raise StoreError("not-found", "an edge's end isn't a node of its scope")
        keyed = relations.withColumn("id", content_id("edge", "scope", "src", "dst", "relation"))
        one = keyed.groupBy("id", "scope", "src", "dst", "relation").agg(F.max_by("claim", "at").alias("claim"), F.array_distinct(F.flatten(F.collect_list("evidence"))).alias("added"), F.max("at").alias("at"))
        old = self.current("edges").select("id", F.col("confidence").alias("c"), F.col("evidence").alias("e"), F.col("created_at").alias("since"), F.col("ord").alias("o"))
        joined = one.join(old, "id", "left")
        start = POLICY["asserted_confidence"] if origin == "asserted" else POLICY["inferred_confidence"]
        rate = POLICY["reinforcement_rate"]
        confidence = F.when(F.col("c").isNull(), F.lit(start)).otherwise(F.col("c") + rate * (1 - F.col("c")))
        half = F.lit(None if origin == "asserted" else POLICY["inferred_half_life_ms"]).cast("bigint")
        return self._put("edges", joined.select("id", "scope", "src", "dst", "relation", "claim", confidence.alias("confidence"), half.alias("half_life_ms"), F.array_union(F.coalesce("e", F.array().cast("array<string>")), "added").alias("evidence"), F.lit(origin).alias("origin"), F.lit("active").alias("status"), F.lit(None).alias("superseded_by"), F.coalesce("since", "at").alias("created_at"), F.col("at").alias("updated_at"), F.coalesce("o", "at").alias("ord")))

    def signal(self, signals: DataFrame) -> int:
        """id, verdict ('reinforce' or 'contradict'), at: moves the nodes' confidence; retracted nodes refuse."""
        hit = self.current("nodes").where("status <> 'retracted'").join(signals.select("id").distinct(), "id", "left_semi")
        return self._put("nodes", B.reinforce(hit, signals))

    def retract(self, ids: DataFrame, at: int) -> int:
        """Nodes kept, but no longer held; their edges fall out of searches with them."""
        hit = self.current("nodes").join(ids.select("id").distinct(), "id", "left_semi")
        return self._put("nodes", hit.withColumn("status", F.lit("retracted")).withColumn("updated_at", F.lit(at)))

    def supersede(self, pairs: DataFrame, at: int) -> int:
        """outdated, replacement (node ids of one scope): a pointer on the outdated node and an edge between them."""
        n = checkpointed(self.current("nodes"))
        side = lambda c: n.select(F.col("id").alias(c), F.col("scope").alias(f"{c}_scope"), F.col("label").alias(f"{c}_label"), F.col("evidence").alias(f"{c}_evidence"))
        known = checkpointed(pairs.select("outdated", "replacement").distinct().join(side("outdated"), "outdated").join(side("replacement"), "replacement").where("outdated_scope = replacement_scope"))
        if known.count() != pairs.select("outdated", "replacement").distinct().count():
            raise StoreError("not-found", "both nodes must exist in one scope")
        pointed = n.drop("superseded_by").join(known.groupBy(F.col("outdated").alias("id")).agg(F.min("replacement").alias("superseded_by")), "id")
        self._put("nodes", pointed.withColumn("status", F.lit("superseded")).withColumn("updated_at", F.lit(at)))
        return self.relate(known.select(F.col("outdated_scope").alias("scope"), F.col("replacement").alias("src"), F.col("outdated").alias("dst"), F.lit("supersedes").alias("relation"), F.concat("replacement_label", F.lit(" supersedes "), "outdated_label").alias("claim"), F.array_union("replacement_evidence", "outdated_evidence").alias("evidence"), F.lit(at).alias("at")))

    # -- upkeep

    def consolidate(self, now: int) -> int:
        """Mines records not yet promoted for stated claims and repeated skills, merges them into nodes and marks the
        records cited; returns the nodes written.
        """
        pending = checkpointed(self.current("records").where("status = 'active' AND size(promoted_to) = 0"))
        said = M.claims(pending.where("record_use = 'recallable' AND kind IN ('user-message', 'note')").select("id", "scope", "ord", "text"))
        stated = said.groupBy("scope", F.col("type").alias("node_type"), F.col("subject").alias("label")).agg(F.min_by("sentence", F.struct("ord", "no")).alias("summary"), F.collect_set("id").alias("evidence"))
        actions = M.skill_actions(pending)
        often = M.affinities(actions, ["scope"])
        used = actions.join(often.select("scope", "action", "uses", "sessions"), ["scope", "action"])
        habit = used.groupBy("scope", F.lit("skill-affinity").alias("node_type"), F.substring("action", 7, 1000).alias("label")).agg(F.concat(F.lit("Reaches for the skill; used "), F.max("uses").cast("string"), F.lit(" times across "), F.max("sessions").cast("string"), F.lit(" sessions.")).alias("summary"), F.collect_set("id").alias("evidence"))
        found = checkpointed(stated.unionByName(habit).withColumn("at", F.lit(now)))
        n = self.assert_beliefs(found, "inferred") if not found.isEmpty() else 0
        cited = found.select(F.explode("evidence").alias("id")).distinct()
        self._put("records", pending.join(cited, "id", "left_semi").withColumn("promoted_to", F.array(F.lit("consolidated"))))
        return n

    def sweep(self, now: int, budget: int = POLICY["record_budget"]) -> tuple[int, int]:
        """(retired beliefs, evicted records): faded inferred beliefs are superseded, uncited records over budget erased."""
        retired = 0
        for name in ("nodes", "edges"):
            gone = B.retired(self.current(name), now).select("id")
            retired += self._put(name, self.current(name).join(gone, "id", "left_semi").withColumn("status", F.lit("superseded")).withColumn("updated_at", F.lit(now)))
        over = B.evicted(self.current("records"), [self.current("nodes"), self.current("edges")], budget).select("id", "scope")
        return retired, self.tables["records"].erase(over) if self.tables["records"].exists() else 0

    def forget(self, records: DataFrame) -> DataFrame:
        """Erases the records (id) with every version and all that was drawn from them; kind, id of what went."""
        r = self.current("records")
        start = r.join(records.select("id").distinct(), "id", "left_semi")
        gone = checkpointed(G.erase_closure(r, self.current("nodes"), self.current("edges"), start))
        for name in ("edges", "nodes", "records"):
            if self.tables[name].exists():
                ids = gone.where(F.col("kind") == name[:-1]).select("id")
                self.tables[name].erase(checkpointed(self.tables[name].rows().join(ids, "id", "left_semi").select("id", "scope").distinct()))
        return gone

    # -- reading

    def search(self, queries: DataFrame, now: int, **options) -> DataFrame:
        """query_id, scope, text -> the best cues of each request (see ``recall.recall``)."""
        return R.recall(queries, self.current("records"), self.current("nodes"), self.current("edges"), now, **options)

    def profile(self, now: int, limit: int = POLICY["profile_limit"]) -> DataFrame:
        return B.profile(self.current("nodes"), now, limit)

    def suggest(self, now: int, limit: int = POLICY["profile_limit"]) -> DataFrame:
        return B.profile(self.current("nodes"), now, limit, ("project", "routine", "procedure"), POLICY["retirement_floor"])

    def stats(self) -> DataFrame:
        """Active nodes, edges and records per scope, and how many records may be quoted."""
        count = lambda name, **more: self.current(name).where("status = 'active'").groupBy("scope").agg(F.count(F.lit(1)).alias(name), *[c.alias(k) for k, c in more.items()])
        quotable = F.count_if(F.col("record_use") == "recallable")
        return count("records", quotable=quotable).join(count("nodes"), "scope", "full").join(count("edges"), "scope", "full").na.fill(0)
