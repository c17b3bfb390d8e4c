import json

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import render as X
from mnemospark.operators import evaluation as E
from mnemospark.sources import datasets as D


@pytest.mark.parametrize(
    ("raw", "want"),
    [("", ("show", None)), (" Stats ", ("stats", None)), ("search  a  b", ("search", "a b")), ("forget", ("usage", None)), ("forget X", ("forget", "X")), ("dance", ("usage", None))],
)
def test_memory_command(spark, raw, want):
    assert tuple(spark.range(1).select(X.memory_command(F.lit(raw)).alias("c")).first()["c"]) == want


@pytest.mark.parametrize(
    ("tool", "command", "role"),
    [("edit", None, "action"), ("read", "rm x", "unknown"), ("bash", "rm -r build", "action"), ("bash", "echo 'rm x'", "unknown"), ("bash", "cd a && pytest -q", "check"), ("bash", "npm run test", "check"), ("bash", "ls > out.txt", "action"), ("bash", "echo pytest passed", "unknown"), ("pwsh", "git commit -m x", "action"), ("bash", None, "unknown")],
)
def test_call_role(spark, tool, command, role):
    assert spark.range(1).select(X.call_role(F.lit(tool), F.lit(command).cast("string")).alias("r")).first()["r"] == role


@pytest.mark.parametrize(("text", "want"), [("ok", "completed"), ("x [exit code: 0]", "completed"), ("x [exit code: 2]", "failed"), ("[timed out after 5 s]", "incomplete"), ("[killed by signal: 9]", "failed"), (None, "completed")])
def test_call_execution(spark, text, want):
    assert spark.range(1).select(X.call_execution(F.lit(text).cast("string")).alias("r")).first()["r"] == want


def test_first_json_object(rows):
    df = rows("r string", ('say {"a": {"b": "}"}} now',), ("```json\n{\"x\": 1}\n```",), ("none",), (None,), ("{broken",))
    assert [json.loads(r[0]) for r in df.select(X.first_json_object("r")).collect()] == [{"a": {"b": "}"}}, {"x": 1}, {}, {}, {}]


def test_judgement(rows):
    df = rows("question string, answer string, keywords array<string>", ("about a.py", "see b.py", ["a.py", "b.py"]), ("about a.py", "a.py", ["a.py"]), (None, None, ["x"]))
    assert [(r["countable"], r["hits"], r["passed"]) for r in E.keyword_judgement(df).collect()] == [(1, 1, True), (0, 0, False), (1, 0, False)]


def test_random_floor(spark):
    q, items = spark.range(20).withColumnRenamed("id", "query_id"), spark.range(3000).withColumnRenamed("id", "item")
    a = E.random_floor(q, items, 10).collect()
    assert a == E.random_floor(q, items, 10).collect() or sorted(a) == sorted(E.random_floor(q, items, 10).collect())
    assert len({(r["query_id"], r["item"]) for r in a}) == 200 and len({r["item"] for r in a}) > 100
    assert E.random_floor(q, items.limit(3), 10).count() == 60


def test_visible_counts(rows):
    events = rows("episode string, seq bigint, id string", ("e", 1, "a"), ("e", 2, "b"), ("e", 3, "c"), ("f", 1, "x"))
    forgets = rows("episode string, seq bigint, target string", ("e", 3, "a"), ("e", 9, "b"), ("e", 1, "c"))
    tasks = rows("episode string, cutoff bigint, task_id string", ("e", 2, "t2"), ("e", 3, "t3"), ("e", 9, "t9"), ("g", 5, "none"))
    assert {r["task_id"]: r["visible"] for r in E.visible_counts(events, forgets, tasks).collect()} == {"t2": 2, "t3": 1, "t9": 0, "none": 0}


def test_office_memory(spark, tmp_path):
    task = {"task_id": "o", "subtasks": ["Add a new header 'Total Cost' to it", "nothing"], "chat_sessions_info": {"sessions": [{"session": "s", "date": "2020-04-26", "user_requests": ["the total cost matters", "hello", "hello"]}]}, "memory_dependency": {"memory_chains": [{"subtask_index": 0, "related_memories": [{"date": "2020-04-27", "text": "hello"}, {"date": "2020-04-27", "text": "cited text"}]}]}}
    (tmp_path / "o.json").write_text(json.dumps(task))
    docs, declared = D.office_memory(spark, str(tmp_path / "o.json"), False)
    assert {r["id"]: r["turn"] for r in docs.collect()} == {"s@2020-04-26#0": 1, "s@2020-04-26#1": 1, "cited@2020-04-27#cited text": None}
    assert [r["gold"] for r in declared.collect()] == [["cited@2020-04-27#cited text", "s@2020-04-26#1"]]
    assert [r["gold"] for r in D.office_memory(spark, str(tmp_path / "o.json"), True)[1].collect()] == [["s@2020-04-26#0"]]


def test_selected_tasks(spark, tmp_path):
    (tmp_path / "examples/web").mkdir(parents=True)
    for i in "ab":
        (tmp_path / f"examples/web/{i}.json").write_text(json.dumps({"id": i, "instruction": f"do {i}"}))
    (tmp_path / "sel.json").write_text(json.dumps({"web": ["a"]}))
    assert [tuple(r) for r in D.selected_tasks(spark, str(tmp_path), str(tmp_path / "sel.json")).collect()] == [("web", "a", "do a")]
