"""Conversation context of records: companions of a turn, corrections and what they correct, label and similarity lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import is_correction, similarity, tokenize, topic_terms
from mnemospark.operators.views import folded_in_blocks, latest


def companions(records: DataFrame) -> DataFrame:
    """id, anchor, confirmation of recallable records with a session and turn; rows with neither are left out.

    anchor: the evidence record of the turn before, if it asks a question or has fewer than 12 terms. confirmation: the
    evidence record of the next turn, if short, no question and not corrected two turns on. Of several records of a
    turn the last one (by ord) counts.
    """
    placed = records.select("id", "ord", "record_use", "text", "terms", F.col("provenance.session_id").alias("session"), F.col("provenance.turn").alias("turn")).where("session IS NOT NULL AND turn IS NOT NULL")
    turns = latest(placed, ["session", "turn"], [F.col("ord").desc()])
    asks = F.rtrim("text").endswith("?")
    facts = turns.select("session", "turn", F.col("id").alias("other"), F.col("record_use").eqNullSafe("evidence").alias("evidence"), F.coalesce(asks, F.lit(False)).alias("asks"), F.size("terms").alias("n"), F.coalesce(is_correction("text"), F.lit(False)).alias("corrects"))
    at = lambda k, p: facts.select("session", (F.col("turn") - k).alias("turn"), *[F.col(c).alias(f"{p}_{c}") for c in ("other", "evidence", "asks", "n", "corrects")])
    own = placed.where("record_use = 'recallable'").select("id", "session", "turn")
    joined = own.join(at(-1, "a"), ["session", "turn"], "left").join(at(1, "c"), ["session", "turn"], "left").join(at(2, "d"), ["session", "turn"], "left")
    anchor = F.when(F.col("a_evidence") & (F.col("a_asks") | (F.col("a_n") < 12)), F.col("a_other"))
    confirmed = F.col("c_evidence") & (F.col("c_n") <= 30) & ~F.col("c_asks") & ~F.coalesce("d_corrects", F.lit(False))
    return joined.select("id", anchor.alias("anchor"), F.when(confirmed, F.col("c_other")).alias("confirmation")).where("anchor IS NOT NULL OR confirmation IS NOT NULL")


def correction_links(records: DataFrame, least: int = 2) -> DataFrame:
    """correction, corrected, shared: for each recallable correction the earlier active recallable record of its scope that
    shares most topic terms (at least ``least``); ties go to the later one, then to the first by ord.
    """
    usable = records.where("record_use = 'recallable' AND text IS NOT NULL").select("id", "scope", "created_at", "ord", "text", "status", "superseded_by", topic_terms(tokenize("text")).alias("topics"))
    asked = usable.where(is_correction("text")).select(F.col("id").alias("correction"), "scope", F.col("created_at").alias("asked_at"), F.explode("topics").alias("term"))
    held = usable.where("status = 'active' AND superseded_by IS NULL").select("id", "scope", "created_at", "ord", F.explode("topics").alias("term"))
    pairs = asked.join(held, ["scope", "term"]).where("created_at <= asked_at AND id <> correction")
    shared = pairs.groupBy("correction", "id", "created_at", "ord").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    best = latest(shared, ["correction"], [F.col("shared").desc(), F.col("created_at").desc(), F.col("ord")])
    return best.select("correction", F.col("id").alias("corrected"), "shared")


def similar_nodes(candidates: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """candidate, node, score: the active node of the same scope and type whose label is most like the candidate's
    (Jaccard of terms at least ``threshold``; ties go to the last by ord).

    candidates: id, scope, node_type, label. Blocked on shared terms under the prefix filter: two term sets that overlap
    by t share one of the first n - ceil(t n) + 1 terms of either in a common order, so no pair is lost.
    """
    terms = F.array_sort(F.array_distinct(tokenize("label")))
    prefix = F.slice("terms", 1, F.size("terms") - F.ceil(F.size("terms") * threshold - 1e-9).cast("int") + 1)
    base = ["scope", "node_type"]
    left = candidates.select(*base, F.col("id").alias("candidate"), terms.alias("terms")).where("size(terms) > 0")
    right = nodes.where("status = 'active'").select(*base, F.col("id").alias("node"), "ord", terms.alias("terms")).where("size(terms) > 0")
    l = left.select(*base, "candidate", F.col("terms").alias("left_terms"), F.explode(prefix).alias("term"))  # noqa: E741
    r = right.select(*base, "node", "ord", F.col("terms").alias("right_terms"), F.explode(prefix).alias("term"))
    pairs = l.join(r.hint("merge"), [*base, "term"]).dropDuplicates(["candidate", "node"])
    scored = pairs.withColumn("score", similarity(F.col("left_terms"), F.col("right_terms"))).where(F.col("score") >= threshold)
    return latest(scored, ["candidate"], [F.round("score", 9).desc(), F.col("ord").desc()]).select("candidate", "node", "score")


def resolved_labels(edges: DataFrame, fresh: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidate edges (scope, from_label, to_label, rest) with node ids: this pass's labels first, then the first active
    node of the scope with the label; edges with an end unresolved are left out.

    fresh: scope, label, id.
    """
    first = latest(nodes.where("status = 'active'"), ["scope", "label"], [F.col("ord")]).select("scope", "label", F.col("id").alias("held"))
    new = fresh.groupBy("scope", "label").agg(F.min("id").alias("new"))
    known = new.join(first, ["scope", "label"], "full").select("scope", "label", F.coalesce("new", "held").alias("node"))
    side = lambda p: known.select("scope", F.col("label").alias(f"{p}_label"), F.col("node").alias(p))
    return edges.join(side("from"), ["scope", "from_label"]).join(side("to"), ["scope", "to_label"])


def running_budget(lines: DataFrame, by: list[str], room: int) -> DataFrame:
    """Lines (by, rk, length) that fit a character budget: stops at the first overflow; a separator costs one.

    As every line costs at least one, lines beyond rank room + 1 can't fit and are left out before the sum.
    """
    total = F.sum(F.col("length") + 1).over(Window.partitionBy(*by).orderBy("rk").rowsBetween(Window.unboundedPreceding, 0))
    return lines.where(F.col("rk") <= room + 1).withColumn("used", total - 1).where(F.col("used") <= room)


def greedy_budget(items: DataFrame, by: list[str], room: int) -> DataFrame:
    """by, rk of items (by, rk, length) that fit a budget in rank order; one that doesn't fit is skipped and the walk goes on."""
    kind = "struct<left:bigint,kept:array<int>>"

    def step(acc, x):
        fits = x["length"] <= acc["left"]
        taken = F.struct((acc["left"] - x["length"]).alias("left"), F.concat(acc["kept"], F.array(x["rk"])).alias("kept"))
        return F.when(fits, taken).otherwise(acc)

    rows = items.select(*by, F.col("rk").cast("int").alias("rk"), F.col("length").cast("bigint").alias("length"))
    start = F.struct(F.lit(room).cast("bigint").alias("left"), F.array().cast("array<int>").alias("kept")).cast(kind)
    walked = folded_in_blocks(rows, by, "rk", F.struct("rk", "length"), start, step, F.col("state.left") >= 0, F.col("length") <= F.col("state.left"))
    return walked.select(*by, F.explode("state.kept").alias("rk"))
