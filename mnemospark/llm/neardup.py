"""Near-duplicate records: DartMinHash signatures, banded joining, exact check, groups.

A weighted set throws darts into the region under its weights: each element owns the area weight x rank, cut into
cells whose number of darts is a Poisson draw hashed from the element. A dart that lies under the element's weight
counts; each of the K coordinates keeps its dart of least rank. Two sets agree in a coordinate with the probability
of their weighted Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.runtime import checkpointed

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


#: No dart yet.
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    with np.errstate(over="ignore"):
        x = x + _STEP
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson draws from uniforms by the inverse of the distribution."""
    top = int(mean + 12 * math.sqrt(mean) + 20)
    logs = np.arange(top + 1) * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in range(top + 1)])
    return np.searchsorted(np.cumsum(np.exp(logs)), u)


class DartMinHash:
    """Signatures of ``k`` coordinates; ``seed`` picks the darts."""

    def __init__(self, k: int, seed: int = 1) -> None:
        self.k, self.seed = k, np.uint64(seed)
        #: Darts for one set in the first round: with k (ln k + 4) about one set in 50 needs a second round.
        self.darts = k * (math.log(k) + 4)

    def _throw(self, elements: np.ndarray, level: int, step: float, height: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(element position, weight, rank, hash) of the darts of a layer, ordered by element.

        The layer has weights [0, 1) at level 0 and [2**(level - 1), 2**level) above; ranks step * height to (step + 1) * height.
        """
        low, high = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0**level)
        with np.errstate(over="ignore"):
            base = _mix(elements ^ _mix(np.uint64(level * 1_000_003 + int(step)) + self.seed * _STEP))
            n = _poisson(_unit(_mix(base)), (high - low) * height)
            of = np.repeat(np.arange(len(elements)), n)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            dart = _mix(base[of] + (nth.astype(np.uint64) + np.uint64(1)) * _STEP)
        weight = low + (high - low) * _unit(_mix(dart ^ np.uint64(0xA5A5)))
        rank = (step + _unit(_mix(dart ^ np.uint64(0x5A5A)))) * height
        return of, weight, rank, dart

    def signatures(self, words: np.ndarray, lengths: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """uint64 matrix (sets, k) of the kept darts; sets are concatenated, empty ones give rows of zeros.

        weights: of each word in each set, 1 if none are given.
        """
        out = np.zeros((len(lengths), self.k), np.uint64)
        # rounds by size, so that every set throws about self.darts darts whatever its total weight; the height of the
        # layers is a power of two, so sets of unlike sizes look at the same darts
        total = lengths.astype(float) if weights is None else np.add.reduceat(np.append(weights, 0), np.minimum(np.cumsum(lengths) - lengths, len(weights)))[: len(lengths)] * (lengths > 0)
        starts = np.cumsum(lengths) - lengths
        for i0 in range(0, len(lengths), 512):
            rows = np.arange(i0, min(i0 + 512, len(lengths)))
            rows = rows[total[rows] > 0]
            best = np.full((len(rows), self.k), _NONE)
            todo, depth = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            while len(todo):
                at = rows[todo]
                size = lengths[at]
                pick = np.repeat(starts[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                owner = np.repeat(todo, size)
                w = np.ones(len(pick)) if weights is None else weights[pick]
                need = np.repeat(np.ceil(self.darts / total[at]).astype(np.int64), size)
                self._fill(words[pick].view(np.uint64), owner, w, need, np.repeat(depth[todo], size), best)
                depth[todo] += 1
                todo = todo[(best[todo] == _NONE).any(axis=1)]
            out[rows] = best
        return out

    #: Ranks are cut into layers of this height; a set of total weight t looks at ceil(darts / t / HEIGHT) of them at a time.
    HEIGHT = 16.0

    def _fill(self, elements: np.ndarray, owner: np.ndarray, w: np.ndarray, need: np.ndarray, depth: np.ndarray, best: np.ndarray) -> None:
        layers = np.ceil(need / self.HEIGHT).astype(np.int64)
        first, last = depth * layers, (depth + 1) * layers
        levels = np.ceil(np.log2(np.maximum(w, 1.0))).astype(np.int64)
        flat = best.reshape(-1)
        for level in range(int(levels.max()) + 1 if len(levels) else 0):
            for step in range(int(first.min()), int(last.max())):
                use = np.flatnonzero((first <= step) & (step < last) & (levels >= level))
                if not len(use):
                    continue
                distinct, back = np.unique(elements[use], return_inverse=True)
                of, weight, rank, dart = self._throw(distinct, level, step, self.HEIGHT)
                # one number a dart, ordered by rank: 40 bits of the rank, then 24 of the dart's hash
                value = (rank.view(np.uint64) & ~np.uint64(0xFFFFFF)) | (dart >> np.uint64(40))
                coordinate = (dart % np.uint64(self.k)).astype(np.int64)
                n = np.bincount(of, minlength=len(distinct))
                begin = np.cumsum(n) - n
                m = n[back]
                pick = np.repeat(begin[back] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                row = np.repeat(owner[use], m)
                if len(weight) and w[use].min() <= weight.max():
                    under = weight[pick] < np.repeat(w[use], m)
                    row, pick = row[under], pick[under]
                np.minimum.at(flat, row * self.k + coordinate[pick], value[pick])


def bands_for(threshold: float, rows: int, miss: float = 1e-4) -> int:
    """Bands of ``rows`` coordinates so that a pair at the threshold is missed with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def band_keys(sets: DataFrame, rows: int, bands: int, seed: int = 1) -> DataFrame:
    """set_no, words -> set_no, n (words), sketch_a, sketch_b (128 one-bit coordinates), keys ARRAY<BIGINT> (one per band)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        dart, sketcher = DartMinHash(rows * bands, seed), np.uint64(0xFF51AFD7ED558CCD)
        for frame in frames:
            lengths = frame["words"].map(len).to_numpy(np.int64)
            words = np.concatenate([*frame["words"], np.array([], np.int64)]).astype(np.int64)
            sig = dart.signatures(words, lengths)
            keys = np.full((len(frame), bands), 0, np.uint64)
            with np.errstate(over="ignore"):
                for j in range(rows):
                    keys = _mix(keys ^ sig[:, j::rows])
                keys = keys ^ _mix(np.arange(bands, dtype=np.uint64))
                bits = (_mix(sig[:, :128] * sketcher) >> np.uint64(63)).astype(np.uint8)
            packed = np.packbits(np.pad(bits, ((0, 0), (0, 128 - bits.shape[1]))), axis=1).view(np.int64)
            yield pd.DataFrame({"set_no": frame["set_no"], "n": lengths.astype(np.int32), "sketch_a": packed[:, 0], "sketch_b": packed[:, 1], "keys": list(keys.view(np.int64))})

    return sets.select("set_no", "words").mapInPandas(run, "set_no bigint, n int, sketch_a bigint, sketch_b bigint, keys array<bigint>")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sketch_limit(threshold: float, bits: int, deviations: float = 5.5) -> int:
    """Differing sketch bits beyond which a pair at the threshold lies more than ``deviations`` standard deviations off."""
    p = (1 - threshold) / 2
    return min(bits, math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p))))


def similar_sets(sets: DataFrame, threshold: float, rows: int = 6, miss: float = 1e-4) -> DataFrame:
    """Pairs of distinct word sets whose overlap is at least ``threshold``: set_a < set_b, shared INT, overlap DOUBLE.

    sets: set_no BIGINT, words ARRAY<BIGINT> sorted; one row per distinct set. Candidates agree in a whole band; those
    whose sizes or 128 sketch bits are too far apart are dropped, the others counted exactly. A pair just at the threshold
    is lost with a chance of ``miss`` (bands) plus 2e-8 (sketch), a likelier pair with less.

    What is shuffled a band is its key and the set's number alone; the two sides of the self-join read the same exchange.
    Buckets that many alike sets share are split by AQE's skew join: nothing is grouped in one task.
    """
    bands = bands_for(threshold, rows, miss)
    keyed = checkpointed(band_keys(sets, rows, bands))
    banded = keyed.select("set_no", F.explode("keys").alias("key"))
    # lists of words and bands are longer than the planner thinks: it must not broadcast what carries them
    joined = banded.alias("a").hint("merge").join(banded.alias("b").hint("merge"), F.col("a.key") == F.col("b.key")).where("a.set_no < b.set_no")
    pairs = joined.select(F.col("a.set_no").alias("set_a"), F.col("b.set_no").alias("set_b")).distinct()
    facts = lambda x: keyed.select(F.col("set_no").alias(f"set_{x}"), F.struct("n", "sketch_a", "sketch_b").alias(x))
    near = pairs.join(facts("a"), "set_a").join(facts("b"), "set_b")
    lengths_fit = (F.col("a.n") >= F.col("b.n") * threshold - 1e-9) & (F.col("b.n") >= F.col("a.n") * threshold - 1e-9)
    close = _distance(F.col("a.sketch_a"), F.col("b.sketch_a")) + _distance(F.col("a.sketch_b"), F.col("b.sketch_b")) <= sketch_limit(threshold, min(128, rows * bands))
    side = lambda x: sets.select(F.col("set_no").alias(f"set_{x}"), F.col("words").alias(f"words_{x}")).hint("merge")
    both = near.where(lengths_fit & close).select("set_a", "set_b").join(side("a"), "set_a").join(side("b"), "set_b")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    overlap = F.col("shared") / (F.size("words_a") + F.size("words_b") - F.col("shared"))
    return both.withColumn("shared", shared).withColumn("overlap", overlap).where(F.col("overlap") >= threshold).select("set_a", "set_b", "shared", "overlap")


def components(pairs: DataFrame, a: str = "set_a", b: str = "set_b") -> DataFrame:
    """Connected components of links: node BIGINT, component BIGINT (its least node); only linked nodes come out.

    Alternating large-star and small-star rounds, each written to the checkpoint folder; a node's many links are
    never gathered, only their minimum. The number of rounds grows with the logarithm of the longest path.
    """
    edges = checkpointed(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        following = checkpointed(small)
        if _sum(following) == _sum(edges):
            break
        edges = following
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def near_duplicates(records: DataFrame, threshold: float, rows: int = 6) -> tuple[DataFrame, DataFrame]:
    """(members, links) of records: id STRING, words ARRAY<BIGINT> (``words.word_set``).

    members: id, set_no — records with equal word sets are one class (told by 128 bits of hash); links: pairs of classes
    with their overlap. A record without words has no class. Extra columns are ignored; ties need no order; a repeated row
    counts once, an id with two texts is a member of two classes.
    """
    # filtered after the checkpoint: a filter pushed below it would compute the words twice
    keyed = checkpointed(records.select("id", "words").withColumns({"key_a": F.xxhash64("words"), "key_b": F.xxhash64(F.lit(1), "words")})).where("size(words) > 0")
    distinct = keyed.groupBy("key_a", "key_b").agg(F.any_value("words").alias("words"))
    sets = checkpointed(distinct.withColumn("set_no", F.monotonically_increasing_id()))
    members = keyed.select("id", "key_a", "key_b").join(sets.select("key_a", "key_b", "set_no"), ["key_a", "key_b"]).select("id", "set_no").distinct()
    return members, similar_sets(sets.select("set_no", "words"), threshold, rows)


def near_duplicate_pairs(records: DataFrame, threshold: float, rows: int = 6) -> DataFrame:
    """All pairs id_a < id_b of records whose word sets overlap by ``threshold`` or more, equal sets included."""
    members, links = near_duplicates(records, threshold, rows)
    a, b = (members.select(F.col("id").alias(f"id_{x}"), F.col("set_no").alias(f"set_{x}")) for x in "ab")
    apart = links.join(a, "set_a").join(b, "set_b").where("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    same = a.join(b, F.col("set_a") == F.col("set_b")).where("id_a < id_b").select("id_a", "id_b")
    return apart.unionByName(same)


def near_duplicate_groups(records: DataFrame, threshold: float, rows: int = 6) -> DataFrame:
    """One row per record: id, class_id (least id of the records with its word set), group_id (least id of the linked
    classes' records), copies (records of the class), links (classes linked to its class). Records without words have null
    class and group, one copy and no link.
    """
    members, links = near_duplicates(records, threshold, rows)
    members, links = checkpointed(members), checkpointed(links)
    degree = links.select(F.explode(F.array("set_a", "set_b")).alias("set_no")).groupBy("set_no").agg(F.count(F.lit(1)).alias("links"))
    classes = members.groupBy("set_no").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("class_id")).join(degree, "set_no", "left").join(components(links).withColumnRenamed("node", "set_no"), "set_no", "left")
    classes = checkpointed(classes.select("set_no", "class_id", "copies", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"), F.coalesce("component", "set_no").alias("component")))
    named = classes.join(classes.groupBy("component").agg(F.min("class_id").alias("group_id")), "component")
    known = members.join(named, "set_no").select("id", "class_id", "group_id", "copies", "links")
    none = F.lit(None).cast("string")
    empty = records.where("words IS NULL OR size(words) = 0").select("id").distinct()
    return known.unionByName(empty.select("id", none.alias("class_id"), none.alias("group_id"), F.lit(1).cast("bigint").alias("copies"), F.lit(0).cast("bigint").alias("links")))
