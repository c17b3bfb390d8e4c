"""Retrieval metrics, summaries, sampling and leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.operators.capture import running_count


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, cutoffs: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per query: gold size, reciprocal rank, and recall, hit and nDCG at each cutoff.

    ranked: query_id, item, rk (1-based); gold: query_id, item (distinct). Queries with gold but no result score 0;
    queries without gold are left out. The ideal of nDCG has min(gold, cutoff) hits.
    """
    g = gold.select("query_id", "item").distinct()
    hits = ranked.join(g, ["query_id", "item"], "left_semi").groupBy("query_id", "item").agg(F.min("rk").alias("rk"))
    sizes = g.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold"))
    return _metrics(sizes, hits, cutoffs)


def _metrics(sizes: DataFrame, hits: DataFrame, cutoffs: tuple[int, ...]) -> DataFrame:
    found = sizes.join(hits, "query_id", "left")
    gain = 1 / F.log2(F.col("rk") + 1)
    aggs: list[Column] = [F.coalesce(F.max(1 / F.col("rk")), F.lit(0.0)).alias("rr")]
    for k in cutoffs:
        aggs += [F.count_if(F.col("rk") <= k).alias(f"n{k}"), F.coalesce(F.sum(F.when(F.col("rk") <= k, gain)), F.lit(0.0)).alias(f"dcg{k}")]
    m = found.groupBy("query_id", "gold").agg(*aggs)
    out: list[Column] = [F.col("query_id"), F.col("gold"), F.col("rr")]
    for k in cutoffs:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        out += [(F.col(f"n{k}") / F.col("gold")).alias(f"recall_{k}"), (F.col(f"n{k}") > 0).cast("int").alias(f"hit_{k}"), (F.col(f"dcg{k}") / ideal).alias(f"ndcg_{k}")]
    return m.select(*out)


def labelled_metrics(ranked: DataFrame, labels: DataFrame, cutoffs: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """``retrieval_metrics`` where an item is gold if it has the query's label: gold is counted per label and only returned
    items are looked at, so queries and their gold are never paired.

    ranked: query_id, item, rk; labels: item, label; a query is an item itself and no gold of its own.
    """
    asked = labels.select(F.col("item").alias("query_id"), F.col("label").alias("wanted"))
    sizes = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("gold")).where("gold > 0")
    queries = ranked.select("query_id").distinct().join(asked, "query_id")
    hits = ranked.join(asked, "query_id").join(labels, "item").where("label = wanted AND item <> query_id").select("query_id", "item", "rk")
    return _metrics(queries.join(sizes.withColumnRenamed("label", "wanted"), "wanted").select("query_id", "gold"), hits, cutoffs)


def metric_averages(metrics: DataFrame, cutoffs: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: queries, mrr, unattributed (share of queries without any gold returned), and the means of recall, hit and nDCG
    at each cutoff.
    """
    means = [F.avg(f"{m}_{k}").alias(f"{m}_{k}") for k in cutoffs for m in ("recall", "hit", "ndcg")]
    return metrics.agg(F.count(F.lit(1)).alias("queries"), F.avg("rr").alias("mrr"), F.avg((F.col("rr") == 0).cast("double")).alias("unattributed"), *means)


def keep_first(ranked: DataFrame, by: list[str], group: str) -> DataFrame:
    """The best item of each group, ranked again: session-level results from item-level ones."""
    best = ranked.groupBy(*by, group).agg(F.min("rk").alias("best"))
    return best.select(*by, F.col(group), F.row_number().over(Window.partitionBy(*by).orderBy("best")).alias("rk"))


def summaries(results: DataFrame, group: str, value: str, completed: Column) -> DataFrame:
    """Overall (group null) and per group: rows, completed, mean over completed, mean with failures as 0, p50 and p95 by
    nearest rank over completed.
    """
    v = F.when(completed, F.col(value))
    rows = results.select(F.col(group).alias("group"), F.col(value).alias("v"), completed.alias("ok"), v.alias("done"))
    return rows.groupingSets([["group"], []], "group").agg(
        F.grouping("group").cast("int").alias("overall"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("ok").alias("completed"),
        F.avg("done").alias("mean"),
        (F.sum(F.coalesce("done", F.lit(0.0))) / F.count(F.lit(1))).alias("mean_with_failures"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY done)").alias("p50"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY done)").alias("p95"),
    )


def round_robin(rows: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """A sample that takes every group's first row, then every group's second, and so on, until ``limit``.

    A sampling operator: the limit is the feature. Within a seat, groups come in order of their first row.
    """
    w = Window.partitionBy(group).orderBy(*order)
    seated = rows.withColumn("seat", F.row_number().over(w)).where(F.col("seat") <= limit)
    return seated.orderBy("seat", F.col(group).asc_nulls_first()).limit(limit)


def shared_members(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """training, held_out, shared: members that both sets of a pair hold (a leak). sets: name, member; pairs: training, held_out."""
    s = sets.where("member IS NOT NULL").select("name", "member").distinct()
    left = pairs.distinct().join(s.withColumnRenamed("name", "training"), "training")
    both = left.join(s.withColumnRenamed("name", "held_out"), ["held_out", "member"])
    return both.groupBy("training", "held_out").agg(F.count(F.lit(1)).alias("shared"))


def as_of(versions: DataFrame, cutoffs: list, at: str = "stored_at") -> DataFrame:
    """The rows that were current at each cutoff: the highest version stored by then, if not an erase. cutoffs: timestamps."""
    points = F.array(*[F.lit(c).cast("timestamp") for c in sorted(set(cutoffs))])
    seen = versions.withColumn("cutoff", F.explode(F.filter(points, lambda c: c >= F.col(at).cast("timestamp"))))
    rank = F.row_number().over(Window.partitionBy("cutoff", "id").orderBy(F.col("version").desc(), "ord"))
    return seen.withColumn("__rank", rank).where("__rank = 1 AND op = 'put'").drop("__rank")


def keyword_judgement(answers: DataFrame) -> DataFrame:
    """Adds countable (keywords the question doesn't already hold), hits and passed. answers: question, answer, keywords."""
    q, a = F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))
    countable = F.filter("keywords", lambda k: ~F.contains(q, k))
    hits = F.filter(countable, lambda k: F.contains(a, k))
    return answers.select("*", F.size(countable).alias("countable"), F.size(hits).alias("hits"), (F.size(hits) > 0).alias("passed"))


def random_floor(queries: DataFrame, items: DataFrame, limit: int, slots: int = 1 << 20) -> DataFrame:
    """query_id, item, rk: ``limit`` items per query, reproducibly at random — a floor for retrieval scores.

    Every item sits in one of the slots by hash; a query draws a run of slots from a hashed start and takes the first
    items it meets. No query looks at more than the slots of its run, so queries x items are never paired.

    queries: query_id; items: item. With fewer items than asked for, all come out.
    """
    n = max(1, items.count())
    width = min(slots, max(1, -(-slots * (limit * 8 + 64) // n)))
    cell = max(1, width)
    cells = -(-slots // cell)
    digest = lambda salt, c: F.conv(F.left(F.md5(F.concat(F.lit(salt), F.col(c).cast("string"))), F.lit(8)), 16, 10).cast("bigint")
    placed = items.select("item", F.pmod(digest("item", "item"), F.lit(slots)).alias("slot")).withColumn("cell", F.floor(F.col("slot") / cell))
    begin = F.pmod(digest("query", "query_id"), F.lit(slots))
    runs = queries.select("query_id", begin.alias("begin"))
    spans = runs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(min(1, cells - 1))))).withColumn("cell", F.pmod(F.floor(F.col("begin") / cell) + F.col("k"), F.lit(cells)))
    met = placed.join(spans, "cell").withColumn("far", F.pmod(F.col("slot") - F.col("begin"), F.lit(slots)))
    order = Window.partitionBy("query_id").orderBy("far", "item")
    return met.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= limit).select("query_id", "item", "rk")


def visible_counts(events: DataFrame, forgets: DataFrame, tasks: DataFrame, bucket: int = 1000) -> DataFrame:
    """task_id, visible: events of the task's episode up to its cutoff that weren't forgotten by then.

    events: episode, seq, id; forgets: episode, seq, target (an event id); tasks: episode, cutoff, task_id. A running sum
    over events (+1), their ends (-1) and tasks (0) in order of seq replaces the range join; it runs over buckets of seq.
    """
    ends = forgets.groupBy("episode", F.col("target").alias("id")).agg(F.min("seq").alias("end"))
    known = events.select("episode", "seq", "id").join(ends, ["episode", "id"], "left")
    none = F.lit(None).cast(dict(tasks.dtypes)["task_id"])
    plus = known.select("episode", F.col("seq").alias("at"), F.lit(1).alias("d"), F.lit(0).alias("kind"), none.alias("task_id"))
    minus = known.where("end IS NOT NULL").select("episode", F.greatest("seq", "end").alias("at"), F.lit(-1).alias("d"), F.lit(0).alias("kind"), none.alias("task_id"))
    asked = tasks.select("episode", F.col("cutoff").alias("at"), F.lit(0).alias("d"), F.lit(1).alias("kind"), "task_id")
    rows = plus.unionByName(minus).unionByName(asked).withColumn("__bucket", F.floor(F.col("at") / bucket))
    return running_count(rows, ["episode"], "__bucket", ["at", "kind"], "d", "visible").where("kind = 1").select("task_id", "visible")
