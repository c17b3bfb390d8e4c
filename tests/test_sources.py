import json

import pytest
from pyspark.sql import functions as F

from mnemospark.sources import datasets as D
from mnemospark.sources.store import ResultLog, StoreError, VersionedTable, change_feed


def table(rows, *data):
    return rows("id string, scope string, text string", *data)


def test_versions_and_scope_isolation(spark, rows, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.put(table(rows, ("a", "user", "one"), ("b", "workspace:/x", "two")))
    t.put(table(rows, ("a", "user", "three")))
    assert {(r["id"], r["text"], r["version"]) for r in t.current().collect()} == {("a", "three", 2), ("b", "two", 1)}
    pruned = t.current(["workspace:/x"])
    assert [r["id"] for r in pruned.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(scope" in t.rows(["workspace:/x"])._jdf.queryExecution().toString() or "PartitionFilters" in t.rows(["workspace:/x"])._jdf.queryExecution().toString()
    with pytest.raises(StoreError, match="identity-conflict"):
        t.put(table(rows, ("a", "user", "x"), ("a", "user", "y")))
    with pytest.raises(StoreError, match="invalid-input"):
        t.put(rows("id string", ("a",)))


def test_erased_bytes_are_gone(spark, rows, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.put(table(rows, ("a", "user", "SECRETTEXT"), ("b", "user", "keep"), ("c", "workspace:/x", "other")))
    t.put(table(rows, ("a", "user", "SECRETTEXT2")))
    assert t.erase(rows("id string, scope string", ("a", "user"), ("zz", "user"))) == 1
    assert {r["id"] for r in t.rows().collect()} == {"b", "c"}
    assert not any(b"SECRETTEXT" in p.read_bytes() for p in (tmp_path / "t").rglob("*.parquet"))
    assert t.erase(rows("id string, scope string", ("a", "user"))) == 0
    t.put(table(rows, ("b", "user", "kept")))
    t.compact()
    assert {(r["id"], r["version"]) for r in t.rows().collect()} == {("b", 2), ("c", 1)}


def test_change_feed(rows):
    got = change_feed(table(rows, ("a", "u", "1"), ("b", "u", "2"), ("d", "u", None)), table(rows, ("a", "u", "1"), ("b", "u", "3"), ("c", "u", "4"), ("d", "u", None)), ["text"])
    assert {(r["id"], r["op"]) for r in got.collect()} == {("b", "update"), ("c", "insert")}


def test_result_log_resumes_only_its_own_run(spark, rows, tmp_path):
    log = ResultLog(spark, str(tmp_path / "log"), {"n": 1})
    log.append(rows("id string, ok boolean", ("a", True)))
    assert ResultLog(spark, str(tmp_path / "log"), {"n": 1}).done("id string, ok boolean").count() == 1
    with pytest.raises(StoreError):
        ResultLog(spark, str(tmp_path / "log"), {"n": 2})


def test_dates(spark):
    got = spark.range(1).select(D.dotted_date(F.lit("2023/05/20 (Sat) 02:21")), D.spoken_date(F.lit("1:56 pm on 8 May, 2023")), D.spoken_date(F.lit("nonsense"))).first()
    assert tuple(got) == (1684549260000, 1683554160000, None)


def test_long_memory(spark, tmp_path):
    turn = lambda c, a=None: {"role": "user", "content": c, **({"has_answer": a} if a is not None else {})}
    data = [
        {"question_id": "q", "question_type": "t", "question": "?", "answer": "x", "haystack_dates": ["2023/05/20 (Sat) 02:21"] * 3, "haystack_session_ids": ["s", "s", "r"], "haystack_sessions": [[turn("a")], [turn("b", True), turn("c", "false")], []], "answer_session_ids": ["s"]},
        {"question_id": "p", "question_type": "t", "question": "?", "answer": "x", "haystack_dates": ["bad"], "haystack_session_ids": ["s"], "haystack_sessions": [[turn("a"), turn("b")]], "answer_session_ids": ["s"]},
    ]
    (tmp_path / "l.json").write_text(json.dumps(data))
    docs, tasks = D.long_memory(spark, str(tmp_path / "l.json"))
    assert {r["id"] for r in docs.collect()} == {"q:s:0", "q:s#2:0", "q:s#2:1", "p:s:0", "p:s:1"}
    assert {r["id"]: r["gold"] for r in tasks.collect()} == {"q": ["q:s#2:0"], "p": ["p:s:0", "p:s:1"]}


def test_dialogue_memory(spark, tmp_path):
    data = [{"sample_id": "1", "conversation": {"speaker_a": "A", "session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "hi", "blip_caption": "a dog"}], "session_1_date_time": "1:56 pm on 8 May, 2023"}, "qa": [{"question": "?", "answer": 5, "evidence": ["D1:1"], "category": 4}, {"question": "?", "evidence": [], "category": 5}]}]
    (tmp_path / "d.json").write_text(json.dumps(data))
    docs, tasks = D.dialogue_memory(spark, str(tmp_path / "d.json"))
    assert [(r["id"], r["session"], r["text"], r["at"]) for r in docs.collect()] == [("D1:1", "session_1", "hi [photo: a dog]", 1683554160000)]
    assert [(r["category"], r["gold"]) for r in tasks.collect()] == [("single-hop", ["D1:1"])]


def test_persona_memory(spark, tmp_path):
    data = [{"name": "N", "profile": {"job": "baker"}, "social_relationship": {"s1": {"name": "B"}}, "events": {"e1": {"what": "x", "when": "y"}}, "dialogues": {"d1": {"contents": {"2023-01-01 00:00:00": ["hello", "bye"]}}}}]
    (tmp_path / "p.json").write_text(json.dumps(data))
    got = {r["id"]: r["text"] for r in D.persona_memory(spark, str(tmp_path / "p.json")).collect()}
    assert got == {"profile:job": "job: baker", "relation:s1": "name: B", "event:e1": "what: x; when: y", "dialogue:d1:2023-01-01 00:00:00:0": "hello", "dialogue:d1:2023-01-01 00:00:00:1": "bye"}


def test_json_lines_count_broken_ones(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n": \n{"id": "c", "n": 3}\n')
    got, health = D.json_lines(spark, str(tmp_path / "x.jsonl"), "id string, n int")
    assert [r["id"] for r in got.collect()] == ["a", "c"]
    assert tuple(health.first()) == (4, 1, 1)


def test_repaired_list(rows):
    df = rows("v array<string>", (["a", "b"],), (list('["x","y"]'),), (['["z"]'],), ([],))
    assert [r[0] for r in df.select(D.repaired_list("v")).collect()] == [["a", "b"], ["x", "y"], ["z"], []]


def test_writers(spark, rows, tmp_path):
    D.write_predictions(rows("question_id string, hypothesis string, x int", ("q", "h", 1)), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).columns == ["hypothesis", "question_id"]
    D.write_documents(rows("id string, markdown string", ("b", "# B\n"), ("a", "# A\n")), str(tmp_path / "m"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "m"), wholetext=True).collect()]
