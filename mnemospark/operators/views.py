"""Current views of versioned and resent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.runtime import checkpointed


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def first_arrivals(df: DataFrame) -> DataFrame:
    """Resent rows (same id) are one record: the one of least ord."""
    return latest(df, ["id"], [F.col("ord")])


def current_versions(df: DataFrame) -> DataFrame:
    """The highest version of each id, if it isn't an erase; of resent rows the first."""
    return latest(df, ["id"], [F.col("version").desc(), F.col("ord")]).where("op = 'put'")


def folded_in_blocks(rows: DataFrame, by: list[str], rank: str, item: Column, start: Column, step, open_: Column, fits: Column | None = None, attach=None, most: int = 1024, size: int = 64) -> DataFrame:
    """by, state: an order-dependent fold over each group's rows by rank, some ranks at a time.

    A group's rows are never gathered as a whole: each round folds the next ``size``, four times as many, at last ``most`` of them into the state,
    and goes on only with groups for which ``open_`` (on ``state``) still holds. ``fits`` (on a row's columns and ``state``)
    drops rows that can't change the state any more, so a round ends a group or takes something. ``attach`` adds columns that
    ``item`` needs to a round's rows alone. ranks are distinct within a group.
    """
    rows = checkpointed(rows)
    state = None
    while True:
        left = rows
        if state is not None:
            left = rows.join(state.where(open_), by).where(F.col(rank) > F.col("__last"))
            left = (left if fits is None else left.where(fits)).select(*rows.columns)
            if size == most:  # later rounds read what is left of the groups still open, not all rows
                rows = left = checkpointed(left)
        # the limit by rank is applied before the shuffle
        part = left.withColumn("__nth", F.row_number().over(Window.partitionBy(*by).orderBy(rank))).where(F.col("__nth") <= size)
        part = part if attach is None else attach(part)
        lists = checkpointed(part.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("__items"), F.max(rank).alias("__last")))
        if state is None:
            folded = lists.select(*by, F.aggregate("__items", start, step).alias("state"), "__last")
        elif lists.isEmpty():
            return state.drop("__last")
        else:
            met = state.drop("__last").join(lists.hint("merge"), by).select(*by, F.aggregate("__items", F.col("state"), step).alias("state"), "__last")
            folded = met.unionByName(state.join(lists.select(*by), by, "left_anti"))
        state, size = checkpointed(folded), min(most, size * 4)
