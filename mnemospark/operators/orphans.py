"""References to records that do not exist.

Keys of parents and references are dictionary-encoded as integers, spread over key ranges of at most 2**16 ids;
for each range and period the referenced keys and the keys that were there before the period are compressed bitmaps.
reference AND-NOT parent leaves the bits of suspects, which are decoded and, where the parent came in the very
period of the reference, held against the exact arrival times.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.runtime import checkpointed

#: Ids of one key range fill one bitmap container.
RANGE_BITS = 16
#: A container with fewer ids than this is kept as a sorted list of 16-bit numbers, else as bits.
ARRAY_LIMIT = 4096


def normal_key(column: Column | str) -> Column:
    """Keys are equal after trimming (any white space) and lower-casing; blank keys are null."""
    c = F.col(column) if isinstance(column, str) else column
    trimmed = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(trimmed != "", trimmed)


def pack(ids: np.ndarray) -> bytes:
    """A compressed bitmap of ids in [0, 2**16): a tag, then a sorted list or zlib-compressed bits."""
    ids = np.unique(ids.astype(np.uint16))
    if len(ids) < ARRAY_LIMIT:
        return b"a" + ids.tobytes()
    bits = np.zeros(1 << RANGE_BITS, np.uint8)
    bits[ids] = 1
    return b"b" + zlib.compress(np.packbits(bits).tobytes(), 1)


def unpack(data: bytes | None) -> np.ndarray:
    """The 2**16 booleans of a packed bitmap; all false for none."""
    bits = np.zeros(1 << RANGE_BITS, bool)
    if data:
        if data[:1] == b"a":
            bits[np.frombuffer(data[1:], np.uint16)] = True
        else:
            bits = np.unpackbits(np.frombuffer(zlib.decompress(data[1:]), np.uint8)).astype(bool)
    return bits


def encode_keys(keys: DataFrame, ranges: int) -> DataFrame:
    """Dictionary of the distinct (kind, key) rows of ``keys``: adds key_range INT and key_id INT, dense within a range.

    Keys are spread over the ranges by hash, so a range stays below 2**16 ids when ``ranges`` is at least the
    number of keys / 2**15. No window spans more than one range.
    """
    from pyspark.sql import Window

    spread = keys.select("kind", "key").distinct().withColumn("key_range", F.pmod(F.xxhash64("kind", "key"), F.lit(ranges)).cast("int"))
    order = Window.partitionBy("key_range").orderBy("kind", "key")
    return spread.withColumn("key_id", F.row_number().over(order) - 1)


def and_not(groups: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    """Rows (key_range, period, refs, known) with packed bitmaps -> (key_range, period, key_id) of refs AND NOT known."""
    for frame in groups:
        out: list[tuple[np.ndarray, int, int]] = []
        for r, p, refs, known in zip(frame["key_range"], frame["period"], frame["refs"], frame["known"]):
            out.append((np.flatnonzero(unpack(refs) & ~unpack(known)).astype(np.int32), r, p))
        n = [len(ids) for ids, _, _ in out]
        yield pd.DataFrame(
            {
                "key_range": np.repeat(np.array([r for _, r, _ in out], np.int32), n),
                "period": np.repeat(np.array([p for _, _, p in out], np.int32), n),
                "key_id": np.concatenate([ids for ids, _, _ in out]) if out else np.array([], np.int32),
            }
        )


def period_of(timestamp: Column) -> Column:
    """Month of a timestamp as an integer, year * 12 + month."""
    return (F.year(timestamp) * 12 + F.month(timestamp)).cast("int")


@F.pandas_udf(T.BinaryType())
def _pack_udf(ids: pd.Series) -> bytes:
    return pack(ids.to_numpy())


def orphan_references(references: DataFrame, parents: DataFrame, ranges: int | None = None) -> DataFrame:
    """References whose parent is missing, erased or came later.

    references: source_table, source_id, field_name, kind, key, seen_at TIMESTAMP — one row per referring id and field.
    parents: kind, key, first_at TIMESTAMP (earliest put that holds the key; null if none), alive BOOLEAN.
    Result: the references' columns and ``reason``: 'missing' (no parent row), 'erased' (not alive) or 'later'.

    A null or blank key refers to nothing and never comes out. A null seen_at can't be earlier than its parent: such
    rows come out only as missing or erased. Repeated rows come out once each. Other columns are dropped at the door,
    so names that clash with inner ones do no harm. Empty inputs give an empty result or all references as missing.
    """
    refs = references.select("source_table", "source_id", "field_name", "kind", normal_key("key").alias("key"), "seen_at").where("key IS NOT NULL")
    no_period = F.lit(1 << 30)
    # both sides are read several times: each is computed once
    refs = checkpointed(refs.withColumn("period", F.coalesce(period_of(F.col("seen_at")), no_period)))
    held = parents.select("kind", normal_key("key").alias("key"), "first_at", "alive").where("key IS NOT NULL")
    # a parent that isn't alive is as good as none for the bitmaps; the reason is looked up for the survivors only
    held = checkpointed(held.groupBy("kind", "key").agg(F.min("first_at").alias("first_at"), F.max("alive").alias("alive")))

    # pre-aggregated: one row per key and period, however often a hot key is referred to
    wanted = refs.groupBy("kind", "key", "period").agg(F.lit(1).alias("one"))
    if ranges is None:
        n = held.select(F.count(F.lit(1)).alias("n")).first()["n"] + wanted.select(F.count(F.lit(1)).alias("n")).first()["n"]
        ranges = max(4, -(-n // (1 << (RANGE_BITS - 1))))
    codes = checkpointed(encode_keys(held.select("kind", "key").unionByName(wanted.select("kind", "key")), ranges))

    ref_bits = wanted.join(codes, ["kind", "key"]).groupBy("key_range", "period").agg(_pack_udf("key_id").alias("refs"))
    # a parent counts as known to a period when it was there before the period began: one bitmap per range and
    # period of arrival, then a running union over the periods that refer to the range
    there = held.where("alive").join(codes, ["kind", "key"]).withColumn("since", period_of(F.col("first_at")))
    known_bits = there.where("since IS NOT NULL").groupBy("key_range", "since").agg(_pack_udf("key_id").alias("bits"))
    ref_lists = ref_bits.groupBy("key_range").agg(F.collect_list(F.struct("period", "refs")).alias("by_period"))
    known_lists = known_bits.groupBy("key_range").agg(F.collect_list(F.struct("since", "bits")).alias("by_since"))
    suspects = (
        ref_lists.join(known_lists.hint("merge"), "key_range", "left")  # bitmaps, which the planner would take for small
        .mapInPandas(_range_suspects, "key_range int, period int, key_id int")
        .join(codes, ["key_range", "key_id"])
        .select("kind", "key", "period")
    )
    # decoded bits: the exact times decide where the parent came in the period of the reference
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    suspects = suspects.join(held, ["kind", "key"], "left").withColumn("salt", F.explode(salts))
    salted = refs.withColumn("salt", F.pmod(F.xxhash64("source_table", "source_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(suspects, ["kind", "key", "period", "salt"])
    reason = (
        F.when(F.col("alive").isNull() | F.col("first_at").isNull() & F.col("alive"), "missing")
        .when(~F.col("alive"), "erased")
        .when(F.col("first_at") > F.col("seen_at"), "later")
    )
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select("source_table", "source_id", "field_name", "kind", "key", "seen_at", "reason")


#: A key that a third of all rows refer to is looked up by so many tasks.
SALTS = 16


def _range_suspects(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    """For each key range: walk the periods in order, OR-ing in the parents of earlier periods, and AND-NOT."""
    for frame in frames:
        rows: list[tuple[int, int, bytes, bytes]] = []
        for r, by_period, by_since in zip(frame["key_range"], frame["by_period"], frame["by_since"]):
            known, at = np.zeros(1 << RANGE_BITS, bool), 0
            since = sorted(((x["since"], x["bits"]) for x in by_since), key=lambda x: x[0]) if by_since is not None else []
            for period, refs in sorted(((x["period"], x["refs"]) for x in by_period), key=lambda x: x[0]):
                while at < len(since) and since[at][0] < period:
                    known |= unpack(since[at][1])
                    at += 1
                rows.append((r, period, refs, pack(np.flatnonzero(known))))
        yield from and_not(iter([pd.DataFrame(rows, columns=["key_range", "period", "refs", "known"])]))


def orphan_report(orphans: DataFrame, references: DataFrame) -> DataFrame:
    """Orphans per source_table, field_name and month of the referring row (null where its time is unknown).

    Columns: source_table, field_name, period STRING 'yyyy-MM', missing, erased, later, orphans, refs BIGINT (non-blank references).
    """
    month = F.date_format("seen_at", "yyyy-MM").alias("period")
    keys = ["source_table", "field_name", "period"]
    n = lambda r: F.count_if(F.col("reason") == r).alias(r)
    found = orphans.select(*keys[:2], month, "reason").groupBy(keys).agg(n("missing"), n("erased"), n("later"), F.count(F.lit(1)).alias("orphans"))
    total = references.where(normal_key("key").isNotNull()).select(*keys[:2], month).groupBy(keys).agg(F.count(F.lit(1)).alias("refs"))
    match = (total["source_table"] == found["source_table"]) & (total["field_name"] == found["field_name"]) & total["period"].eqNullSafe(found["period"])
    zero = [F.coalesce(found[c], F.lit(0).cast("long")).alias(c) for c in ("missing", "erased", "later", "orphans")]
    return total.join(found, match, "left").select(total["source_table"], total["field_name"], total["period"], *zero, total["refs"])
