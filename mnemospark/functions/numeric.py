"""Belief and vector arithmetic as Column expressions, and the policy constants they default to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions.text import column

#: The shipped policy.
POLICY = {
    "bm25_k1": 1.2, "bm25_b": 0.75, "rrf_k": 60,
    "recall_limit": 12, "profile_limit": 12, "inferred_confidence": 0.4, "asserted_confidence": 0.9,
    "inferred_half_life_ms": 5_184_000_000, "reinforcement_rate": 0.25, "contradiction_rate": 0.5,
    "retirement_floor": 0.05, "activation_hops": 2, "activation_falloff": 0.45, "record_budget": 5000,
    "support_weight": 0.0, "duplicate_threshold": 0.8, "diversity_threshold": 0.7, "vector_weight": 1.0,
    "min_observations": 3, "saturation": 6.0, "max_confidence": 0.85, "min_sequence": 2, "max_sequence": 4,
    "min_repeats": 3, "max_characters": 4000, "max_text": 4000, "digest": 120, "duplicate_similarity": 0.85,
}


def decayed(confidence: Column | str, half_life_ms: Column | str, last_seen_at: Column | str, now: Column | int) -> Column:
    """Confidence halved per half-life since last seen; unchanged without a half-life or before it."""
    c, h, t = column(confidence), column(half_life_ms), column(last_seen_at)
    n = now if isinstance(now, Column) else F.lit(now)
    return F.when(h.isNull() | (h <= 0) | (n <= t), c).otherwise(c * F.pow(F.lit(2.0), -(n - t) / h))


def reinforced(confidence: Column | str, rate: float, times: Column | int = 1) -> Column:
    """c + r (1 - c), ``times`` times, in closed form."""
    return 1 - (1 - column(confidence)) * F.pow(F.lit(1.0 - rate), times if isinstance(times, Column) else F.lit(times))


def weakened(confidence: Column | str, rate: float) -> Column:
    return F.greatest(F.lit(0.0), column(confidence) * (1 - rate))


def clamped(value: Column | str) -> Column:
    """Into [0, 1]; NaN, which Spark orders above all numbers, becomes 0."""
    c = column(value)
    return F.when(F.isnan(c), 0.0).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def frequency_confidence(count: Column | str, most: float = POLICY["max_confidence"], saturation: float = POLICY["saturation"]) -> Column:
    return most * (1 - F.exp(-column(count) / saturation))


def support_boost(observations: Column | str, reinforcements: Column | str, weight: float = POLICY["support_weight"]) -> Column:
    return F.lit(1.0) if weight <= 0 else 1 + weight * F.log1p(column(observations) + column(reinforcements))


def rank_score(position: Column | str) -> Column:
    """1 / (60 + rank) of a 1-based rank; 0 where unranked."""
    return F.coalesce(1 / (POLICY["rrf_k"] + column(position)), F.lit(0.0))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity of ARRAY<DOUBLE>; 0 where either norm is 0. Unequal lengths raise an error."""
    n = norm(left) * norm(right)
    value = F.when(n == 0, 0.0).otherwise(dot(left, right) / n)
    return F.when(F.size(left) == F.size(right), value).otherwise(F.raise_error(F.lit("vectors of unequal lengths")).cast("double"))


def normalized(vector: Column) -> Column:
    n = norm(vector)
    return F.when(n == 0, vector).otherwise(F.transform(vector, lambda x: x / n))
