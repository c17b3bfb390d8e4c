"""Queries of the versioned tables and of continuous capture: each writes, reads back and compares with plain SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.views import first_arrivals
from mnemospark.plans import sqltext as S
from mnemospark.runtime import checkpointed, shared_folder, table
from mnemospark.sources.store import VersionedTable, change_feed


def _stored(spark: SparkSession, d: str) -> tuple[VersionedTable, DataFrame, DataFrame]:
    """Edges, by kind of scope, put into a fresh table, then those of even ord put again with a lower confidence: table, first state, edges."""
    edges = checkpointed(first_arrivals(table(spark, d, "memory_edges")).select("id", F.split_part("scope", F.lit(":"), F.lit(1)).alias("scope"), "relation", "confidence", "ord"))
    store = VersionedTable(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.put(edges)
    before = checkpointed(store.current())
    store.put(edges.where("ord % 2 = 0").withColumn("confidence", F.col("confidence") / 2))
    return store, before, edges


def store_current(spark: SparkSession, d: str) -> DataFrame:
    """The current rows after two puts, one of half the ids."""
    store, _, _ = _stored(spark, d)
    return store.current().select("id", "scope", "version", F.round("confidence", 6).alias("confidence"))


def store_erased(spark: SparkSession, d: str) -> DataFrame:
    """All versions left after every third id is erased and the rest compacted."""
    store, _, edges = _stored(spark, d)
    store.erase(edges.where("ord % 3 = 0").select("id", "scope"))
    store.compact()
    return store.rows().select("id", F.col("scope").cast("string").alias("scope"), "version")


def store_changes(spark: SparkSession, d: str) -> DataFrame:
    """What the second put changed."""
    store, before, _ = _stored(spark, d)
    feed = change_feed(before, store.current(), ["confidence"])
    return feed.select("id", "op", F.round("before.confidence", 6).alias("before"), F.round("after.confidence", 6).alias("after"))


def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events read as a stream, one trigger for all there are, counted with state and written by batch; then read back."""
    batch = table(spark, d, "events")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    counted = stream.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("events"), F.max("event_id").alias("last_event"))
    write = lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/out")
    counted.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def queries() -> dict:
    return {f.__name__: f for f in [store_current, store_erased, store_changes, stream_event_counts]}


def oracle_sql() -> dict[str, str]:
    e = S.first_arrivals("memory_edges")
    return {
        "store_current": f"SELECT id, split_part(scope, ':', 1) AS scope, CASE WHEN ord % 2 = 0 THEN 2 ELSE 1 END AS version, round(CASE WHEN ord % 2 = 0 THEN confidence / 2 ELSE confidence END, 6) AS confidence FROM {e}",
        "store_erased": f"SELECT id, split_part(scope, ':', 1) AS scope, CASE WHEN ord % 2 = 0 THEN 2 ELSE 1 END AS version FROM {e} WHERE ord % 3 <> 0",
        "store_changes": f"SELECT id, 'update' AS op, round(confidence, 6) AS before, round(confidence / 2, 6) AS after FROM {e} WHERE ord % 2 = 0 AND confidence <> 0",
        "stream_event_counts": "SELECT user_id, event_type, count(*) AS events, max(event_id) AS last_event FROM events GROUP BY ALL",
    }
