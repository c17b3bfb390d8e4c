import random

from mnemospark.llm.conversations import kahn_order, rebuild_conversations, reply_parents, session_report

SCHEMA = "id string, session_id string, role string, at_ms bigint, text string, session string, stretch int, turn_no int"


def msg(i, s, role, at, text="x"):
    return (i, s, role, at, text, "clash", 7, 9)


def test_kahn():
    assert kahn_order([3, 1, 2], [-1, -1, 1]) == ([1, 2, 0], [])
    assert kahn_order([0, 1, 2, 3], [-1, 2, 1, 2]) == ([0], [1, 2, 3])
    assert kahn_order([], []) == ([], [])
    assert reply_parents([0, 0, 1, 0]) == [-1, -1, 1, 2]


def run(rows, *data):
    return sorted((r["session_id"], r["turn_no"], r["message_id"]) for r in rebuild_conversations(rows(SCHEMA, *data)).collect())


def test_order_and_repeats(rows):
    base = 1_700_000_000_000
    data = [
        msg("b", " S1 ", "Assistant", base // 1000 + 5),  # seconds
        msg("a", "s1", "human", base),
        msg("a2", "s1", "USER", base),  # the same message: the smaller id stays
        msg("t", "s1", "tool", None, None),  # left out before anything else
        msg("d", "S1", "bot", base + 9000),
        msg("c", "s1", "user", base + 9000),  # same time: user first
    ]
    assert run(rows, *data) == [("s1", 0, "a"), ("s1", 1, "b"), ("s1", 2, "c"), ("s1", 3, "d")]


def test_broken_sessions(rows):
    data = []
    for s, bad in (("role", msg("x", "role", None, 2)), ("name", msg("x", "name", "narrator", 2)), ("time", msg("x", "time", "user", None)), ("blank", msg("x", "blank", "assistant", 2, " \u200b\u3000")), ("null", msg("x", "null", "assistant", 2, None)), ("open", msg("x", "open", "user", 10**12 + 9))):
        data += [msg(f"{s}1", s, "user", 10**12), msg(f"{s}2", s, "assistant", 10**12 + 1), bad]
    data += [msg("y", "twice", "user", 1), msg("z", "twice", "user", 2), msg("w", "twice", "assistant", 3), msg("v", "twice", "assistant", 4)]
    data += [msg("q", "late", "assistant", 1), msg("r", "late", "user", 2), msg("n", None, "user", 1), msg("m", " ", "user", 1), msg("o", "only", "system", 1)]
    df = rows(SCHEMA, *data)
    kept = rebuild_conversations(df)
    assert kept.count() == 0
    assert {r["outcome"]: r["sessions"] for r in session_report(df, kept).collect()} == {"bad_role": 2, "bad_time": 1, "unseen_text": 2, "missing_reply": 1, "not_alternating": 2}
    assert rebuild_conversations(df.limit(0)).count() == 0


def test_a_session_spread_over_partitions(spark, rows):
    n = 4000
    data = [msg(f"m{i:05}", "big", "user" if i % 2 == 0 else "ai", 10**12 + i, "long" * (2000 if i == 7 else 1)) for i in range(n)]
    data += [msg(f"k{i:05}", "bad", "user" if i % 2 == (i > 2000) else "ai", 10**12 + i) for i in range(n)]
    random.seed(1)
    random.shuffle(data)
    got = run(rows, *data)
    assert got == [("big", i, f"m{i:05}") for i in range(n)]
