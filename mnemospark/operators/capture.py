"""Event-stream sessionisation, as batch operators; ``streaming.capture`` has the streaming twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_count(rows: DataFrame, by: list[str], bucket: str, order: list[str], flag: str, name: str) -> DataFrame:
    """Adds ``name``: the flags up to each row in order within ``by``; ``bucket`` must ascend with the order.

    Counts run inside a bucket and, separately, over the buckets' sums, so a group that holds a large share of all rows is
    spread over as many tasks as it has buckets.
    """
    sums = rows.groupBy(*by, bucket).agg(F.sum(flag).alias("__in"))
    before = F.sum("__in").over(Window.partitionBy(*by).orderBy(bucket)) - F.col("__in")
    inner = F.sum(flag).over(Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__own", inner).join(sums.select(*by, bucket, before.alias("__before")), [*by, bucket]).withColumn(name, F.col("__own") + F.col("__before")).drop("__own", "__before")


def turns(events: DataFrame, opens: Column) -> DataFrame:
    """One row per turn: session_id, turn (from 1), opened_at, events, closed, closed_at.

    events: session_id, at BIGINT ms, ord, speaker. A turn starts with each event for which ``opens`` holds and ends with
    the last assistant event before the next; events before a session's first turn belong to none and are dropped.
    """
    marked = events.withColumn("__open", opens.cast("int")).withColumn("__day", F.floor(F.col("at") / 86_400_000))
    numbered = running_count(marked, ["session_id"], "__day", ["at", "ord"], "__open", "turn").where("turn > 0")
    answered = F.max(F.when(F.col("speaker") == "assistant", F.col("at")))
    return numbered.groupBy("session_id", "turn").agg(F.min("at").alias("opened_at"), F.count(F.lit(1)).alias("events"), answered.isNotNull().alias("closed"), answered.alias("closed_at"))


def gap_sessions(events: DataFrame, by: str, at: str, gap_seconds: int) -> DataFrame:
    """Sessions of events closer than the gap: by, session (from 1), started, ended, events.

    events: by, ``at`` TIMESTAMP, event_id. A day's first event is held against the last one of the days before.
    """
    us = F.unix_micros(F.col(at).cast("timestamp"))
    rows = events.withColumn("__us", us).withColumn("__day", F.to_date(at))
    days = rows.groupBy(by, "__day").agg(F.max("__us").alias("__last"))
    days = days.select(by, "__day", F.lag("__last").over(Window.partitionBy(by).orderBy("__day")).alias("__prior"))
    inside = F.lag("__us").over(Window.partitionBy(by, "__day").orderBy("__us", "event_id"))
    gapped = rows.withColumn("__inside", inside).join(days, [by, "__day"]).withColumn("__back", F.coalesce("__inside", "__prior"))
    fresh = F.coalesce(F.col("__us") - F.col("__back") >= gap_seconds * 1_000_000, F.lit(True)).cast("int")
    numbered = running_count(gapped.withColumn("__fresh", fresh), [by], "__day", ["__us", "event_id"], "__fresh", "session")
    return numbered.groupBy(by, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("events"))


def every_nth(turn_rows: DataFrame, n: int) -> DataFrame:
    """Turns at which an every-n-turns job of their session fires: the n-th, 2n-th, ... closed one. Counted by thousands of
    turns, so that a session of any length is spread over tasks.
    """
    closed = turn_rows.where("closed").withColumns({"__one": F.lit(1), "__bucket": F.floor(F.col("turn") / 1000)})
    counted = running_count(closed, ["session_id"], "__bucket", ["turn"], "__one", "nth").drop("__one", "__bucket")
    return counted.where(F.col("nth") % n == 0)


def running_max(rows: DataFrame, by: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the greatest value of the rows before each row in order within ``by``, null for the first; ``bucket``
    must ascend with the order. Maxima run inside a bucket and, separately, over the buckets.
    """
    tops = rows.groupBy(*by, bucket).agg(F.max(value).alias("__top"))
    before = F.max("__top").over(Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    inner = F.max(value).over(Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    both = rows.withColumn("__own", inner).join(tops.select(*by, bucket, before.alias("__before")), [*by, bucket])
    return both.withColumn(name, F.greatest("__own", "__before")).drop("__own", "__before")
