import pytest

from mnemospark.api import Memory
from mnemospark.sources.store import StoreError

DAY = 86_400_000
OBS = "scope string, kind string, text string, created_at bigint, session_id string, turn int, skill string"


@pytest.fixture(scope="module")
def memory(spark, rows, tmp_path_factory):
    m = Memory(spark, str(tmp_path_factory.mktemp("memory")))
    said = [
        ("user", "user-message", "I prefer tabs over spaces. Thanks", 1 * DAY, "s1", 1, None),
        ("user", "user-message", "I prefer tabs over spaces.", 2 * DAY, "s2", 1, None),
        ("user", "assistant-message", "I prefer vim", 2 * DAY, "s2", 2, None),
        ("workspace:/x", "user-message", "Deploy the archive on Friday", 3 * DAY, "s3", 1, None),
    ]
    said += [("user", "skill-invocation", f"lint run {i}", (10 + i) * DAY, f"s{i}", 1, "lint") for i in range(3)]
    assert m.remember(rows(OBS, *said)) == 7
    assert m.remember(rows(OBS, *said)) == 0
    return m


def test_remember_refuses_blank_texts(memory, rows):
    with pytest.raises(StoreError, match="invalid-input"):
        memory.remember(rows(OBS, ("user", "note", " ", 1, None, None, None)))


def test_consolidate_search_and_forget(memory, rows):
    assert memory.consolidate(20 * DAY) == 2
    assert memory.consolidate(21 * DAY) == 0
    nodes = {r["label"]: r for r in memory.current("nodes").collect()}
    assert set(nodes) == {"tabs over spaces", "lint"} and nodes["tabs over spaces"]["origin"] == "inferred"
    assert len(nodes["tabs over spaces"]["evidence"]) == 2
    asked = rows("query_id string, scope string, text string", ("q", "user", "tabs or spaces"), ("p", "workspace:/x", "archive friday"))
    hits = memory.search(asked, 20 * DAY).collect()
    assert {r["kind"] for r in hits if r["query_id"] == "q"} == {"node"}  # the records restate it
    assert {r["kind"] for r in memory.search(asked, 20 * DAY, threshold=1.0).collect() if r["query_id"] == "q"} == {"node", "record"}
    assert [r["kind"] for r in hits if r["query_id"] == "p"] == ["record"]
    assert memory.profile(20 * DAY).count() == 2 and memory.suggest(20 * DAY).count() == 0
    assert {r["scope"]: (r["records"], r["quotable"], r["nodes"]) for r in memory.stats().collect()} == {"user": (6, 5, 2), "workspace:/x": (1, 1, 0)}

    a = rows("scope string, node_type string, label string, summary string, evidence array<string>, at bigint", ("user", "preference", "tabs over spaces", "Tabs, always.", [], 22 * DAY), ("user", "project", "archive", "The archive.", [], 22 * DAY))
    assert memory.assert_beliefs(a) == 2
    held = {r["label"]: r for r in memory.current("nodes").collect()}
    assert held["tabs over spaces"]["origin"] == "asserted" and held["tabs over spaces"]["confidence"] == pytest.approx(0.55)
    assert held["tabs over spaces"]["half_life_ms"] is None and len(held["tabs over spaces"]["evidence"]) == 2
    one, two = held["archive"]["id"], held["tabs over spaces"]["id"]
    assert memory.relate(rows("scope string, src string, dst string, relation string, claim string, evidence array<string>, at bigint", ("user", one, two, "uses", "archive uses tabs", [], 1))) == 1
    with pytest.raises(StoreError, match="not-found"):
        memory.relate(rows("scope string, src string, dst string, relation string, claim string, evidence array<string>, at bigint", ("user", one, "gone", "uses", "x", [], 1)))
    assert memory.signal(rows("id string, verdict string, at bigint", (one, "contradict", 5))) == 1
    assert {r["id"]: r["confidence"] for r in memory.current("nodes").collect()}[one] == pytest.approx(0.45)
    assert memory.supersede(rows("outdated string, replacement string", (held["lint"]["id"], one)), 23 * DAY) == 1
    assert memory.retract(rows("id string", (one,)), 24 * DAY) == 1
    assert {r["label"]: r["status"] for r in memory.current("nodes").collect()} == {"tabs over spaces": "active", "lint": "superseded", "archive": "retracted"}

    victim = memory.current("records").where("created_at = 86400000").select("id")
    gone = {(r["kind"], r["id"]) for r in memory.forget(victim).collect()}
    assert ("node", two) in gone and len([1 for k, _ in gone if k == "edge"]) == 1
    assert {r["label"] for r in memory.current("nodes").collect()} == {"lint", "archive"}
    assert memory.current("records").count() == 6
    assert memory.sweep(10_000 * DAY, 4)[1] >= 1
