"""Rebuilding conversations from message rows.

Rows are normalised and repeats merged; sessions with a broken row, or with unequal numbers of user and assistant
messages, are out before anything is sorted. The rest is range-partitioned by (session, time, role, id), so a session
of any size is spread over tasks; each stretch of a session is a reply graph that Kahn's algorithm orders, and the
stretches' summaries decide about the whole session.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.runtime import checkpointed

#: Spellings of the speakers; rows of the last set are left out.
USER, ASSISTANT, ASIDE = ("user", "human"), ("assistant", "ai", "bot", "model"), ("system", "tool")
#: An at_ms below this counts seconds.
SECONDS_BELOW = 100_000_000_000
#: Characters that can't be seen, besides white space: zero-width ones, joiners, marks of direction, soft hyphen.
_UNSEEN = r"(?U)[\s\x{0000}-\x{001f}\x{007f}-\x{00a0}\x{00ad}\x{034f}\x{061c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180e}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{2800}\x{3000}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}]+"


def _trimmed(c: str) -> Column:
    return F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))


def normal_messages(messages: DataFrame) -> DataFrame:
    """session STRING, speaker INT (0 user, 1 assistant, null any other), at BIGINT ms, seen BOOLEAN, id — repeats merged.

    Rows of equal session, speaker as written, time and text are one message with the smallest id; two 128-bit hashes
    stand for the text, so it isn't shuffled. System and tool rows and rows without a session are left out.
    """
    role = _trimmed("role")
    speaker = F.when(role.isin(*USER), 0).when(role.isin(*ASSISTANT), 1)
    at = F.when(F.col("at_ms") < SECONDS_BELOW, F.col("at_ms") * 1000).otherwise(F.col("at_ms"))
    seen = F.coalesce(F.length(F.regexp_replace("text", _UNSEEN, "")) > 0, F.lit(False))
    rows = messages.select(
        _trimmed("session_id").alias("session"),
        role.alias("role"),
        speaker.alias("speaker"),
        at.alias("at"),
        seen.alias("seen"),
        F.xxhash64("text").alias("h1"),
        F.xxhash64(F.lit(7), F.reverse("text")).alias("h2"),
        F.col("text").isNull().alias("no_text"),
        "id",
    ).where("session <> ''")
    rows = rows.where(F.col("role").isNull() | ~F.col("role").isin(*ASIDE))
    other = F.when(F.col("speaker").isNull(), F.col("role"))
    return rows.withColumn("role", other).groupBy("session", "speaker", "role", "at", "h1", "h2", "no_text").agg(F.min("id").alias("id"), F.first("seen").alias("seen")).select("session", "speaker", "at", "seen", "id")


def session_states(messages: DataFrame) -> DataFrame:
    """One row per session of ``normal_messages``: session, messages, users, assistants, bad_role, bad_time, unseen (counts)."""
    return messages.groupBy("session").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("speaker") == 0).alias("users"),
        F.count_if(F.col("speaker") == 1).alias("assistants"),
        F.count_if(F.col("speaker").isNull()).alias("bad_role"),
        F.count_if(F.col("at").isNull()).alias("bad_time"),
        F.count_if(~F.col("seen")).alias("unseen"),
    )


def reply_parents(speakers: Sequence[int]) -> list[int]:
    """For each message of a stretch in time order: the latest earlier message of the other speaker, -1 if none.

    Rows without reply ids have no other graph; parents drawn from the order can't form a cycle, so Kahn's leftover is empty
    for them and the order is that of time, speaker and id.
    """
    last, parents = [-1, -1], []
    for i, s in enumerate(speakers):
        parents.append(last[1 - s])
        last[s] = i
    return parents


def kahn_order(keys: Sequence, parents: Sequence[int]) -> tuple[list[int], list[int]]:
    """(order, leftover): the messages in topological order of their replies, the least key first among those that are
    ready; leftover are the messages on or behind a cycle.
    """
    children: dict[int, list[int]] = {}
    for i, p in enumerate(parents):
        if p >= 0:
            children.setdefault(p, []).append(i)
    ready = [(keys[i], i) for i, p in enumerate(parents) if p < 0]
    heapq.heapify(ready)
    order: list[int] = []
    while ready:
        _, i = heapq.heappop(ready)
        order.append(i)
        for c in children.get(i, ()):
            heapq.heappush(ready, (keys[c], c))
    if len(order) == len(parents):
        return order, []
    placed = set(order)
    return order, [i for i in range(len(parents)) if i not in placed]


def _stretches(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    """Sorted messages of a partition -> each with its stretch, its place in it and the stretch's summary."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    for frame in frames:
        sessions, speakers, times, ids = (frame[c].tolist() for c in ("session", "speaker", "at", "id"))
        n, begin, out = len(sessions), 0, []
        while begin < n:
            end = begin + 1
            while end < n and sessions[end] == sessions[begin]:
                end += 1
            who = speakers[begin:end]
            parents = reply_parents(who)
            order, cycle = kahn_order(list(zip(times[begin:end], who, ids[begin:end])), parents)
            # strictly alternating: every message after the first answers the one just before it
            ok = not cycle and all(parents[b] == a for a, b in zip(order, order[1:]))
            first, last = who[order[0]] if order else 0, who[order[-1]] if order else 0
            stretch = (part << 40) + number
            for place, i in enumerate([*order, *cycle]):
                out.append((sessions[begin], ids[begin + i], who[i], times[begin + i], stretch, place, len(who), ok, first, last))
            number += 1
            begin = end
        yield pd.DataFrame(out, columns=["session", "id", "speaker", "at", "stretch", "place", "size", "ok", "first", "last"])


def rebuild_conversations(messages: DataFrame) -> DataFrame:
    """messages: id, session_id, role, at_ms BIGINT, text -> session_id, turn_no BIGINT from 0, message_id, role, at_ms.

    Kept sessions have at least one message, no row of an unknown role, without time or without a visible character, and
    strictly alternate, user first and assistant last, ordered by time, user before assistant, id. Extra columns are
    ignored; an empty table gives an empty result.
    """
    normal = checkpointed(normal_messages(messages))
    states = session_states(normal)
    whole = states.where("bad_role = 0 AND bad_time = 0 AND unseen = 0 AND users = assistants AND users > 0").select("session")
    wanted = checkpointed(normal.join(whole, "session", "left_semi").select("session", "speaker", "at", "id"))
    order = ["session", "at", "speaker", "id"]
    placed = checkpointed(
        wanted.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInPandas(_stretches, "session string, id string, speaker int, at bigint, stretch bigint, place int, size int, ok boolean, first int, last int")
    )
    by_time = Window.partitionBy("session").orderBy("stretch")
    stretches = placed.where("place = 0").select("session", "stretch", "size", "ok", "first", "last")
    stretches = stretches.select(
        "*",
        (F.sum("size").over(by_time) - F.col("size")).alias("offset"),
        F.coalesce(F.lag("last").over(by_time), F.lit(1)).alias("before"),
    )
    joined = stretches.withColumn("ok", F.col("ok") & (F.col("before") != F.col("first")))
    kept = joined.groupBy("session").agg(F.min("ok").alias("ok"), F.max_by("last", "stretch").alias("end")).where("ok AND end = 1").select("session")
    offsets = joined.join(kept, "session", "left_semi").select("stretch", "offset")
    named = F.when(F.col("speaker") == 0, "user").otherwise("assistant")
    return placed.join(offsets, "stretch").select(F.col("session").alias("session_id"), (F.col("offset") + F.col("place")).cast("bigint").alias("turn_no"), F.col("id").alias("message_id"), named.alias("role"), F.col("at").alias("at_ms"))


def session_report(messages: DataFrame, kept: DataFrame) -> DataFrame:
    """Sessions and messages per outcome: 'kept', or the first reason that applies: bad_role, bad_time, unseen_text,
    missing_reply (unequal numbers of user and assistant messages), not_alternating.
    """
    whole = kept.select(F.col("session_id").alias("session")).distinct().withColumn("kept", F.lit(True))
    outcome = (
        F.when(F.col("kept"), "kept")
        .when(F.col("bad_role") > 0, "bad_role")
        .when(F.col("bad_time") > 0, "bad_time")
        .when(F.col("unseen") > 0, "unseen_text")
        .when(F.col("users") != F.col("assistants"), "missing_reply")
        .otherwise("not_alternating")
    )
    states = session_states(normal_messages(messages)).join(whole, "session", "left")
    return states.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("messages").alias("messages"))
