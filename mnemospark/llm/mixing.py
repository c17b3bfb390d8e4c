"""Mixing sources to target weights.

Efraimidis-Spirakis sampling: each document draws an exponential key scaled by its quality weight; within its source the
documents with the least keys come first, and their tokens are summed up to the source's budget. Sources that need more
than they have are used in complete epochs first; the rest is the fractional selection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.encode import TOKENIZERS, count_tokens
from mnemospark.runtime import checkpointed

#: Keys of a source are cut into so many ranges; prefix sums run over the ranges, then inside the one range where the
#: budget ends.
KEY_RANGES = 4096


def source_name(column: str) -> Column:
    """Source names are equal after trimming, lower-casing and with hyphens and blanks as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")), r"[\s-]+", "_")


def quality_weight(column: str) -> Column:
    """0.25 plus the share of letters and digits among the characters that aren't white space: clean text is likelier."""
    dense = F.length(F.regexp_replace(column, r"(?U)\s+", ""))
    return F.lit(0.25) + F.coalesce(F.try_divide(F.length(F.regexp_replace(column, r"[^\p{L}\p{N}]+", "")), dense), F.lit(0.0))


def sampling_key(key: str, weight: str, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) hashed from the document's key."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / F.col(weight)


def sized_documents(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, seed: int = 17) -> DataFrame:
    """doc_id, text, source -> doc_id, source (normal name), n_tokens, sample_key; documents without tokens are left out."""
    named = documents.select("doc_id", source_name("source").alias("source"), quality_weight("text").alias("weight"), "text").where("text <> '' AND source IS NOT NULL")
    return count_tokens(named, tokenizer, folder).where("n_tokens > 0").withColumn("sample_key", sampling_key("doc_id", "weight", seed)).drop("weight")


def mixing_plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target: source, target_share, max_repeats, documents, available, budget, epochs, remainder (tokens).

    The total is the largest that every source with documents can give its share of without using one more than
    max_repeats times, or ``total_tokens`` if that is less. A target without documents, or with share 0, gets a budget
    of 0 and doesn't hold the others back. Repeated target rows of a source count once (the first share by size).
    """
    goals = targets.where("source IS NOT NULL AND target_share IS NOT NULL").groupBy(source_name("source").alias("source")).agg(F.max("target_share").alias("target_share"), F.coalesce(F.min("max_repeats"), F.lit(1)).alias("max_repeats"))
    have = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("available"))
    plan = goals.join(have, "source", "left").na.fill(0, ["documents", "available"])
    ceiling = F.when((F.col("available") > 0) & (F.col("target_share") > 0), F.col("max_repeats") * F.col("available") / F.col("target_share"))
    total = F.min(ceiling).over(Window.partitionBy(F.lit(1)))  # over the targets, a handful of rows
    if total_tokens is not None:
        total = F.least(total, F.lit(float(total_tokens)))
    budget = F.when(F.col("available") > 0, F.floor(F.col("target_share") * total + 1e-6)).otherwise(0).cast("bigint")
    plan = plan.withColumn("budget", F.coalesce(budget, F.lit(0)))
    plan = plan.withColumn("epochs", F.coalesce(F.floor(F.try_divide("budget", "available")), F.lit(0)).cast("bigint"))
    return plan.withColumn("remainder", F.col("budget") - F.col("epochs") * F.col("available"))


def mix_sources(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """doc_id, source, n_tokens, repeats INT: how often each chosen document is used.

    sized: doc_id, source, n_tokens, sample_key (see ``sized_documents``). Ties of keys are broken by doc_id. A source
    may hold any share of the rows: its prefix sums run over key ranges, only the range where the budget ends is summed
    document by document. No document is used more than max_repeats times, as budgets end at that.
    """
    plan = mixing_plan(sized, targets, total_tokens)
    ranged = sized.select("doc_id", "source", "n_tokens", "sample_key", F.floor(F.col("sample_key") / (F.col("sample_key") + 1) * KEY_RANGES).cast("int").alias("key_range"))
    sums = ranged.groupBy("source", "key_range").agg(F.sum("n_tokens").alias("in_range"))
    upto = F.sum("in_range").over(Window.partitionBy("source").orderBy("key_range"))
    ranges = sums.withColumn("upto", upto).join(plan.select("source", "epochs", "remainder", "max_repeats"), "source")
    ranges = ranges.select("source", "key_range", "epochs", "remainder", (F.col("upto") - F.col("in_range")).alias("before"), "upto")
    # only ranges from which anything is taken; at most targets x KEY_RANGES rows
    taken = ranges.where("epochs > 0 OR before < remainder")
    placed = ranged.join(taken, ["source", "key_range"])
    crossing = "before < remainder AND upto > remainder"
    whole = placed.where(f"NOT ({crossing})").withColumn("extra", F.when(F.col("upto") <= F.col("remainder"), 1).otherwise(0))
    running = F.sum("n_tokens").over(Window.partitionBy("source", "key_range").orderBy("sample_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.where(crossing).withColumn("extra", F.when(F.col("before") + running <= F.col("remainder"), 1).otherwise(0))
    repeats = (F.col("epochs") + F.col("extra")).cast("int")
    return whole.unionByName(edge).withColumn("repeats", repeats).where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")


def mixture_shares(mixture: DataFrame, plan: DataFrame) -> DataFrame:
    """The shares reached: source, target_share, max_repeats, documents, available, epochs, chosen (documents),
    most_repeats, mixed_tokens, actual_share (of all mixed tokens; null if there are none).
    """
    got = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("chosen"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"))
    joined = plan.join(got, "source", "left").na.fill(0, ["chosen", "most_repeats", "mixed_tokens"])
    share = F.try_divide("mixed_tokens", F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1))))  # over the targets, a handful of rows
    return joined.select("source", "target_share", "max_repeats", "documents", "available", "epochs", "chosen", "most_repeats", "mixed_tokens", share.alias("actual_share"))


def prepared(documents: DataFrame, **options) -> DataFrame:
    """``sized_documents`` written once: planning, ranging and choosing read it without encoding again."""
    return checkpointed(sized_documents(documents, **options))
