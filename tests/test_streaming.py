from pyspark.sql import functions as F

from mnemospark.operators.capture import every_nth, gap_sessions, turns
from mnemospark.streaming import capture as S

EVENT = "session_id string, at bigint, ord string, speaker string"


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def events(rows):
    data = []
    for s in range(5):
        for i in range(20):
            data.append((f"s{s}", s * 1000 + i * 40_000_000, f"{i:03}", "user" if i % (s + 2) == 1 else "assistant" if i % 3 else "other"))
    return rows(EVENT, *data)


def test_stream_and_batch_find_the_same_closed_turns(spark, rows, tmp_path):
    batch = events(rows)
    for k in range(2):  # two files in order of time: state goes on between them
        batch.where(F.col("ord").between(f"{k * 10:03}", f"{k * 10 + 9:03}")).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    drain(S.closed_turns(stream), "closed")
    got = {(r["session_id"], r["turn"], r["opened_at"], r["events"], r["answered"]) for r in spark.table("closed").collect()}
    t = turns(batch, F.col("speaker") == "user")
    last = t.groupBy("session_id").agg(F.max("turn").alias("last"))
    want = {(r["session_id"], r["turn"], r["opened_at"], r["events"], r["closed"]) for r in t.join(last, "session_id").where("turn < last").collect()}
    assert got == want and want


def test_session_windows(spark, rows, tmp_path):
    df = rows("user_id int, ts timestamp_ntz", *[(1, __import__("datetime").datetime(2024, 1, 1, h, m)) for h, m in ((0, 0), (0, 10), (2, 0), (9, 0))])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    drain(S.session_counts(stream, "user_id", "ts", "30 minutes", "10 minutes"), "sessions")
    assert sorted(r["events"] for r in spark.table("sessions").collect()) == [1, 2]


def test_repeats_are_dropped(spark, rows, tmp_path):
    df = rows("call string, ts timestamp", *[("a", __import__("datetime").datetime(2024, 1, 1))] * 3, ("b", __import__("datetime").datetime(2024, 1, 1)))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    drain(S.without_repeats(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["call"], "ts", "1 hour"), "calls")
    assert spark.table("calls").count() == 2


def test_gap_sessions_over_midnight(rows):
    import datetime as dt

    at = dt.datetime(2024, 1, 1, 23, 50)
    df = rows("event_id int, user_id int, ts timestamp_ntz", *[(i, 1, at + dt.timedelta(minutes=m)) for i, m in enumerate((0, 20, 49, 80))])
    assert sorted(r["events"] for r in gap_sessions(df, "user_id", "ts", 1800).collect()) == [1, 3]


def test_every_nth_and_foreach_batch(spark, rows):
    t = rows("session_id string, turn int, closed boolean", *[("s", i, i != 2) for i in range(1, 8)])
    assert sorted(r["turn"] for r in every_nth(t, 2).collect()) == [3, 5, 7]
    seen = []
    S.on_every_nth(3, F.col("turn"), lambda df: seen.extend(r["turn"] for r in df.collect()))(t, 0)
    assert sorted(seen) == [3, 6]


def test_observations(rows):
    block = "array<struct<type:string,text:string,uri:string>>"
    df = rows(
        f"session_id string, seq int, type string, source_kind string, content {block}, tool string, arguments string, at bigint",
        ("s", 1, "user/message", "user", [("text", "hello world", None), ("image", None, "i1")], None, None, 1),
        ("s", 2, "user/message", "harness", [("text", "injected", None)], None, None, 2),
        ("s", 3, "tool/call", None, None, "edit", '{"path": "a/b"}', 3),
        ("s", 4, "turn/end", None, None, None, None, 4),
        ("s", 5, "assistant/message", None, [("reasoning", "x", None)], None, None, 5),
    )
    got = {r["seq"]: r for r in S.observations(df, max_text=5).collect()}
    assert set(got) == {1, 3}
    assert (got[1]["text"], got[1]["fidelity"], got[1]["record_use"], got[1]["attachments"][0]["uri"]) == ("hello", "summary", "recallable", "attachment:i1")
    assert (got[3]["kind"], got[3]["text"], got[3]["record_use"]) == ("tool-invocation", "edit ", "evidence")
