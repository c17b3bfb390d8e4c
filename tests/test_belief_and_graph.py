import pytest
from pyspark.sql import functions as F

from mnemospark.operators import belief as B
from mnemospark.operators import context as C
from mnemospark.operators import evaluation as E
from mnemospark.operators import graph as G
from mnemospark.operators import mining as M

NODE = "id string, scope string, node_type string, label string, status string, origin string, confidence double, half_life_ms bigint, support struct<observations:int,reinforcements:int,contradictions:int,sessions:int,first_seen_at:bigint,last_seen_at:bigint>, evidence array<string>, ord bigint"


def node(id_, confidence=0.5, origin="inferred", status="active", half=100, seen=0, obs=1, evidence=(), label=None, ord_=0):
    return (id_, "s", "routine", label or id_, status, origin, confidence, half, (obs, 0, 0, 1, 0, seen), list(evidence), ord_)


def test_decay_comes_before_the_floor_and_asserted_beliefs_stay(rows):
    n = rows(NODE, node("a", 0.5), node("b", 0.5, origin="asserted"), node("c", 0.5, half=None), node("d", 0.5, status="retracted"))
    assert [r["id"] for r in B.retired(n, 400).collect()] == ["a"]
    assert {r["id"] for r in B.believed(n, 100, 0.3).collect()} == {"c"}


def test_profile_prefers_supported_beliefs(rows):
    n = rows(NODE, node("a", 0.9, half=None, obs=1), node("b", 0.6, half=None, obs=20), node("c", 0.1, half=None))
    p = B.profile(n, 0, 2).orderBy("rk").collect()
    assert [r["id"] for r in p] == ["b", "a"]
    assert p[0]["total"] == 3


def test_reinforce_and_contradict(rows):
    n = rows(NODE, node("a", 0.4, seen=5), node("b", 0.4, status="retracted"), node("c", 0.4))
    s = rows("id string, verdict string, at bigint", ("a", "reinforce", 9), ("a", "contradict", 50), ("b", "reinforce", 9))
    got = {r["id"]: r for r in B.reinforce(n, s).collect()}
    assert got["a"]["confidence"] == pytest.approx(0.275)
    assert got["a"]["support"]["last_seen_at"] == 9
    assert got["b"]["confidence"] == got["c"]["confidence"] == 0.4


def test_eviction_never_orphans(rows):
    r = rows("id string, scope string, created_at bigint, ord bigint", *[(f"r{i}", "s", i, i) for i in range(5)])
    n = rows(NODE, node("a", evidence=["r0"]))
    assert sorted(x["id"] for x in B.evicted(r, [n], 3).collect()) == ["r1", "r2"]


def test_upsert_reinforces_instead_of_duplicating(rows):
    n = rows(NODE, node("a", 0.4, evidence=["x"], label="l"))
    a = rows("scope string, node_type string, label string, summary string, evidence array<string>, at bigint, ord bigint", ("s", "routine", "l", "one", ["x", "y"], 1, 1), ("s", "routine", "new", "two", ["z"], 1, 1))
    got = {r["label"]: r for r in B.upsert_nodes(n, a).collect()}
    assert (got["l"]["id"], got["l"]["created"], got["l"]["new_evidence"]) == ("a", False, 1)
    assert got["l"]["confidence"] == pytest.approx(0.55)
    assert got["new"]["created"] and got["new"]["confidence"] == pytest.approx(0.9)


def test_spread_activation_two_hops_and_self_loop(rows):
    edges = rows("src string, dst string, confidence double", ("a", "b", 1.0), ("b", "c", 0.5), ("d", "d", 1.0))
    seeds = rows("q int, node string, weight double", (1, "a", 1.0), (1, "d", 1.0))
    got = {r["node"]: r["activation"] for r in G.spread_activation(seeds, edges, ["q"], 2, 0.5).collect()}
    assert got == {"a": pytest.approx(1.25), "b": pytest.approx(0.5), "c": pytest.approx(0.125), "d": pytest.approx(1 + 1 + 1)}


def test_reachable_ends_on_cycles(rows):
    links = rows("src string, dst string", ("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"))
    assert {r[0] for r in G.reachable(rows("vertex string", ("a",)), links).collect()} == {"a", "b", "c"}
    assert G.reachable(rows("vertex string"), links).count() == 0


def test_chain_roots(rows):
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(40)]
    df = rows("id string, p string", *chain, ("c1", "c2"), ("c2", "c1"), ("c3", "c1"), ("lone", "gone"))
    got = {r["id"]: (r["root"], r["depth"]) for r in G.chain_roots(df, "p").collect()}
    assert got["n39"] == ("n0", 39) and got["n0"] == ("n0", 0)
    assert got["c1"][0] is got["c2"][0] is got["c3"][0] is None
    assert got["lone"] == ("lone", 0)


def test_erase_closure_follows_ledgers(rows):
    rec = "id string, scope string, kind string, record_use string, provenance struct<author:string>"
    records = rows(rec, ("r1", "s", "user-message", "recallable", ("user",)), ("r2", "s", "note", "evidence", ("agent",)), ("r3", "s", "note", "recallable", ("user",)))
    nodes = rows("id string, scope string, evidence array<string>", ("n1", "s", ["r1", "r2"]), ("n2", "s", ["r2"]), ("n3", "s", ["r3"]))
    edges = rows("id string, scope string, src string, dst string, evidence array<string>", ("e1", "user", "n2", "n3", []))
    got = {(r["kind"], r["id"]) for r in G.erase_closure(records, nodes, edges, records.where("id = 'r1'")).collect()}
    assert got == {("record", "r1"), ("record", "r2"), ("node", "n1"), ("node", "n2"), ("edge", "e1")}


def test_companions(rows):
    schema = "id string, ord bigint, record_use string, text string, terms array<string>, provenance struct<session_id:string,turn:int>"
    r = rows(schema, ("q", 1, "evidence", "which one?", ["x"] * 40, ("s", 1)), ("u", 2, "recallable", "that", ["that"], ("s", 2)), ("a", 3, "evidence", "done", ["done"], ("s", 3)), ("u2", 4, "recallable", "actually no", ["no"], ("s", 4)))
    got = {x["id"]: (x["anchor"], x["confirmation"]) for x in C.companions(r).collect()}
    assert got == {"u": ("q", None), "u2": ("a", None)}


def test_ngrams_never_span_turns(rows):
    a = rows("scope string, id string, session_id string, turn int, ord int, action string", *[("s", str(i), "x", i // 3, i, "ab"[i % 2]) for i in range(9)])
    got = {r["label"]: r["occurrences"] for r in M.ngrams(a, ["scope"], least=1).collect()}
    assert got == {"a > b": 3, "b > a": 3, "a > b > a": 2, "b > a > b": 1}


def test_similar_nodes_never_merge_across_types(rows):
    n = rows(NODE, node("a", label="use tabs in python files", ord_=1), node("b", label="deploy on friday", ord_=2))
    c = rows("id string, scope string, node_type string, label string", ("x", "s", "routine", "tabs in python files"), ("y", "s", "constraint", "use tabs in python files"))
    assert [(r["candidate"], r["node"]) for r in C.similar_nodes(c, n, 0.7).collect()] == [("x", "a")]


def test_budgets(rows):
    lines = rows("g int, rk int, length int", (1, 1, 10), (1, 2, 90), (1, 3, 5))
    assert [r["rk"] for r in C.running_budget(lines, ["g"], 50).collect()] == [1]
    assert sorted(r["rk"] for r in C.greedy_budget(lines, ["g"], 50).collect()) == [1, 3]


def test_retrieval_metrics(rows):
    ranked = rows("query_id int, item string, rk int", (1, "a", 1), (1, "b", 2), (1, "c", 3))
    gold = rows("query_id int, item string", (1, "b"), (1, "z"), (2, "q"))
    got = {r["query_id"]: r for r in E.retrieval_metrics(ranked, gold, (1, 3)).collect()}
    assert (got[1]["rr"], got[1]["recall_1"], got[1]["recall_3"], got[1]["hit_3"]) == (0.5, 0.0, 0.5, 1)
    assert got[1]["ndcg_3"] == pytest.approx((1 / 1.5849625) / (1 + 1 / 1.5849625))
    assert got[2]["rr"] == 0.0


def test_summaries_use_nearest_rank(rows):
    r = rows("g string, v double", *[("x", float(i)) for i in range(1, 21)], ("y", None))
    got = {x["group"]: x for x in E.summaries(r, "g", "v", F.col("v").isNotNull()).collect()}
    assert (got["x"]["p50"], got["x"]["p95"]) == (10.0, 19.0)
    assert got[None]["n"] == 21 and got[None]["completed"] == 20
    assert got["y"]["mean"] is None and got["y"]["mean_with_failures"] == 0.0


def test_round_robin(rows):
    r = rows("g string, id int", *[("a", i) for i in range(5)], ("b", 9))
    assert sorted((x["g"], x["id"]) for x in E.round_robin(r, "g", [F.col("id")], 3).collect()) == [("a", 0), ("a", 1), ("b", 9)]
