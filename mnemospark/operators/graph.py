"""Graph operators on plain DataFrames: live edges, spreading activation, closures, families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.numeric import POLICY
from mnemospark.runtime import checkpointed


def live_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are among the nodes."""
    ids = nodes.select("id")
    ends = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    return ends.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def with_endpoints(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Edges with both ends' columns, prefixed src_ and dst_."""
    side = lambda p: nodes.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return edges.join(side("src"), "src").join(side("dst"), "dst")


def spread_activation(seeds: DataFrame, edges: DataFrame, by: list[str], hops: int = POLICY["activation_hops"], falloff: float = POLICY["activation_falloff"], reach: DataFrame | None = None) -> DataFrame:
    """by, node, activation: seeds (by, node, weight) spread over undirected edges (src, dst, confidence).

    Each hop passes weight * falloff * confidence on, from the last hop's contributions only; totals accumulate. A
    self-loop passes twice, as it lies in both directions. A hub's edges are aggregated per target on the map side.
    reach: by, part; an edge of a ``part`` then passes on only for requests that reach it.
    """
    more = [] if reach is None else ["part"]
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("target"), "confidence", *more).unionAll(edges.select("dst", "src", "confidence", *more))
    total = seeds.groupBy(*by, "node").agg(F.sum("weight").alias("weight"))
    frontier, parts = total, [total]
    for _ in range(hops):
        met = frontier.join(both, "node")
        met = met if reach is None else met.join(reach, [*by, "part"], "left_semi")
        passed = met.select(*by, F.col("target").alias("node"), (F.col("weight") * falloff * F.col("confidence")).alias("weight"))
        frontier = passed.where("weight > 0").groupBy(*by, "node").agg(F.sum("weight").alias("weight"))
        parts.append(frontier)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*by, "node").agg(F.sum("weight").alias("activation"))


def reachable(start: DataFrame, links: DataFrame) -> DataFrame:
    """Everything that can be reached from ``start`` (vertex) over directed links (src, dst), the start included.

    Frontier by frontier until nothing is new; each round's frontier and the whole are written to the checkpoint folder,
    so the plan doesn't grow. Cycles end by themselves, since only new vertices go on.
    """
    whole = checkpointed(start.select("vertex").distinct())
    frontier = whole
    while not frontier.isEmpty():
        step = frontier.join(links.select(F.col("src").alias("vertex"), F.col("dst").alias("next")), "vertex").select(F.col("next").alias("vertex")).distinct()
        frontier = checkpointed(step.join(whole, "vertex", "left_anti"))
        whole = checkpointed(whole.unionByName(frontier))
    return whole


def erase_closure(records: DataFrame, nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """kind ('record', 'node', 'edge') and id of all that must go with the erased ``start`` records (id, scope).

    A node goes if it cites an erased record, an edge if it cites one or touches an erased node; ledger records (evidence
    notes by an agent or the API) go with any erased node or edge that cites them. Edges of the user scope count with
    any scope. As one typed link list: the fixpoint over three tables is plain reachability.
    """
    vertex = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    r = records.select(F.col("id").alias("record"), F.col("scope").alias("record_scope"), ((F.col("kind") == "note") & (F.col("record_use") == "evidence") & F.col("provenance.author").isin("agent", "api")).alias("ledger"))
    cites_n = nodes.select("id", "scope", F.explode("evidence").alias("record")).join(r, "record")
    cites_e = edges.select("id", "scope", F.explode("evidence").alias("record")).join(r, "record")
    same = F.col("scope") == F.col("record_scope")
    near = same | (F.col("scope") == "user")
    ends = edges.select("id", "scope", F.explode(F.array("src", "dst")).alias("node")).join(nodes.select(F.col("id").alias("node"), F.col("scope").alias("node_scope")), "node")
    links = [
        cites_n.where(same).select(vertex("record", "record").alias("src"), vertex("node", "id").alias("dst")),
        cites_n.where(F.col("ledger")).select(vertex("node", "id").alias("src"), vertex("record", "record").alias("dst")),
        cites_e.where(near).select(vertex("record", "record").alias("src"), vertex("edge", "id").alias("dst")),
        cites_e.where(F.col("ledger")).select(vertex("edge", "id").alias("src"), vertex("record", "record").alias("dst")),
        ends.where((F.col("scope") == F.col("node_scope")) | (F.col("scope") == "user")).select(vertex("node", "node").alias("src"), vertex("edge", "id").alias("dst")),
    ]
    all_links = links[0]
    for x in links[1:]:
        all_links = all_links.unionByName(x)
    found = reachable(start.select(vertex("record", "id").alias("vertex")), checkpointed(all_links.distinct()))
    return found.select(F.split_part("vertex", F.lit(":"), F.lit(1)).alias("kind"), F.expr("substring(vertex, locate(':', vertex) + 1)").alias("id"))


def chain_roots(rows: DataFrame, parent: str) -> DataFrame:
    """id, root, depth: the end of each row's parent chain, by pointer doubling in log2(longest chain) rounds.

    A parent that isn't among the rows ends the chain. Rows on or behind a cycle come out with root null.
    """
    ids = rows.select(F.col("id").alias("jump"))
    at = rows.select("id", F.col(parent).alias("jump")).join(ids, "jump", "left_semi")
    links = rows.select("id").join(at, "id", "left")
    state = checkpointed(links.select("id", F.coalesce("jump", "id").alias("jump"), F.when(F.col("jump").isNull(), 0).otherwise(1).cast("bigint").alias("depth")))
    n, reach = state.count(), 1
    while True:
        further = state.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("depth").alias("depth2"))
        following = checkpointed(state.join(further, "jump").select("id", F.col("jump2").alias("jump"), (F.col("depth") + F.col("depth2")).alias("depth")))
        reach *= 2
        moved = following.join(state.select("id", F.col("jump").alias("before")), "id").where("jump <> before").limit(1)
        state = following
        if moved.isEmpty() or reach > 2 * n:
            break
    ends = state.join(links.where("jump IS NULL").select(F.col("id").alias("jump")), "jump", "left_semi").select("id", F.col("jump").alias("root"), "depth")
    return rows.select("id").join(ends, "id", "left")


def ancestors(rows: DataFrame, parent: str, limit: int) -> DataFrame:
    """id, ancestor, distance for up to ``limit`` predecessors of each row; a bounded walk, one join per step."""
    links = rows.select("id", F.col(parent).alias("ancestor")).where("ancestor IS NOT NULL").join(rows.select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    step = links.select("id", "ancestor", F.lit(1).alias("distance"))
    out = step
    for i in range(2, limit + 1):
        step = step.select("id", F.col("ancestor").alias("x")).join(links.select(F.col("id").alias("x"), "ancestor"), "x").where("ancestor <> id").select("id", "ancestor", F.lit(i).alias("distance"))
        out = out.unionByName(step)
    return out
