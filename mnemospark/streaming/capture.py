"""Structured Streaming twins of the capture operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemospark.functions.text import tokenize, tool_digest, visible_text

#: Event types that give an observation, and their record kinds.
OBSERVED = {"user/message": "user-message", "assistant/message": "assistant-message", "tool/call": "tool-invocation", "tool/ptc-dispatch-start": "tool-invocation"}


def observations(events: DataFrame, max_text: int = 4000, digest: int = 120) -> DataFrame:
    """Records from session events, the same for a batch and a stream.

    events: session_id, seq, type, source_kind, content ARRAY<STRUCT<type, text, uri>>, tool, arguments (JSON), at. Other
    types, text injected by a harness, user text without a source and blank messages are dropped; a clipped text is a summary.
    """
    message = F.col("type").endswith("/message")
    kind = F.create_map(*[F.lit(x) for kv in OBSERVED.items() for x in kv])[F.col("type")]
    own = F.when(F.col("source_kind") == "skill-invocation", F.lit("skill-invocation")).when(F.col("source_kind") == "user", kind)
    full = F.when(message, visible_text("content")).otherwise(F.concat_ws(" ", "tool", tool_digest("arguments", digest)))
    named = events.where(F.col("type").isin(*OBSERVED)).withColumn("kind", F.when(F.col("type") == "user/message", own).otherwise(kind)).withColumn("full", full)
    kept = named.where("kind IS NOT NULL AND full <> ''")
    pictures = F.transform(F.filter("content", lambda b: b["type"] == "image"), lambda b: F.struct(F.lit("image").alias("kind"), F.concat(F.lit("attachment:"), b["uri"]).alias("uri")))
    use = F.when(F.col("kind").isin("user-message", "skill-invocation"), "recallable").otherwise("evidence")
    clipped = F.left("full", F.lit(max_text))
    return kept.select("session_id", "seq", "at", "kind", clipped.alias("text"), F.when(F.length("full") > max_text, "summary").otherwise("verbatim").alias("fidelity"), use.alias("record_use"), tokenize(clipped).alias("terms"), pictures.alias("attachments"))


def closed_turns(events: DataFrame) -> DataFrame:
    """A row per closed turn: session_id, turn, opened_at, events, answered — emitted when the next turn opens.

    events: session_id, at BIGINT, ord, speaker, in order per session (rows of one micro-batch are sorted). State per
    session: the open turn's number, start and counts. Events before a session's first turn are dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        turn, opened, n, answered = state.get if state.exists else (0, 0, 0, 0)
        out = []
        rows = pd.concat(list(frames)).sort_values(["at", "ord"], kind="stable")
        for at, speaker in zip(rows["at"].tolist(), rows["speaker"].tolist()):
            if speaker == "user":
                if turn:
                    out.append((key[0], turn, opened, n, bool(answered)))
                turn, opened, n, answered = turn + 1, at, 1, 0
            elif turn:
                n += 1
                answered |= speaker == "assistant"
        state.update((turn, opened, n, int(answered)))
        yield pd.DataFrame(out, columns=["session_id", "turn", "opened_at", "events", "answered"])

    return events.groupBy("session_id").applyInPandasWithState(step, "session_id string, turn bigint, opened_at bigint, events bigint, answered boolean", "turn bigint, opened bigint, n bigint, answered int", "append", GroupStateTimeout.NoTimeout)


def without_repeats(events: DataFrame, key: list[str], at: str, lateness: str) -> DataFrame:
    """Each key once, as long as its repeats come within the lateness."""
    return events.withWatermark(at, lateness).dropDuplicatesWithinWatermark(key)


def session_counts(events: DataFrame, by: str, at: str, gap: str, lateness: str) -> DataFrame:
    """Events per session window; windows come out once the watermark has passed them."""
    return events.withWatermark(at, lateness).groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("events")).select(by, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "events")


def on_every_nth(n: int, counter: Column, job: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands the rows whose counter is divisible by n to a job."""

    def run(batch: DataFrame, _: int) -> None:
        due = batch.where(counter % n == 0)
        if not due.isEmpty():
            job(due)

    return run
