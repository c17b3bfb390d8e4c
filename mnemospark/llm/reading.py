"""Reading level of each document.

Two interpolated bigram models, one of easy and one of hard text, are trained on the rated documents: a document rated l
counts with (l - 1.5) / 3, cut to [0, 1], in the hard one and with the rest in the easy one. The surprisal of every word
of a document under both gives its distribution; how much more the easy model is surprised than the hard one, as a mean
over the document's words, is mapped to the ratings by isotonic regression, fitted on scores of documents that the
scoring models haven't seen, for each group (language) that has enough ratings and for all documents together.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.words import slices
from mnemospark.runtime import checkpointed

#: Counts of each n-gram order are hashed into so many buckets, whatever the vocabulary: the models take 3 MB.
BITS = 17
BUCKETS = 1 << BITS
ORDERS = 2
#: Weight of the lower order in the interpolation, in observations of the context; added counts of single words.
PRIOR, ADDED = 1024.0, 0.5
#: Rated documents that isotonic regression is fitted on at most (chosen by hash); n-grams are counted over all of them.
MOST_FITTED = 200_000
LEVELS = (1, 5)
#: A group gets a mapping of its own from so many rated documents on; the others use the common one.
LEAST_IN_GROUP = 30

_TOKEN = re.compile(r"[一-鿿]|[^\W\d_一-鿿]+|\d+|[.!?;:,。！？；，：]")


class Tokens:
    """Word hashes of texts; numbers are one word, Chinese characters are words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        known, out, sizes = self.known, [], []
        for text in texts:
            words = _TOKEN.findall(text.lower()) if text else ()
            for w in words:
                h = known.get(w)
                if h is None:
                    if len(known) > 500_000:
                        known.clear()
                    h = known[w] = xxhash.xxh64_intdigest(b"0" if w[0].isdigit() else w.encode())
                out.append(h)
            sizes.append(len(words))
        return np.array(out, np.uint64), np.array(sizes, np.int64)


def ngram_buckets(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(ORDERS, words): the bucket of the n-gram that ends at each word; n-grams don't reach over a text's start."""
    mult = np.uint64(0x9E3779B97F4A7C15)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(words)) - first
    out = np.empty((ORDERS, len(words)), np.int64)
    h = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(ORDERS):
            earlier = np.concatenate((np.zeros(min(n, len(words)), np.uint64), words[: max(0, len(words) - n)]))
            h = (h ^ np.where(place >= n, earlier, np.uint64(1))) * mult
            h ^= h >> np.uint64(31)
            out[n] = ((h * (mult | np.uint64(2 * n + 1))) >> np.uint64(64 - BITS)).astype(np.int64)
    return out


def _surprisal(buckets: np.ndarray, place: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Bits of surprise of each word under one model: tables (ORDERS, BUCKETS) of counts."""
    total = max(float(tables[0].sum()), 1.0)
    p = (tables[0][buckets[0]] + ADDED) / (total + ADDED * BUCKETS)
    for n in range(1, ORDERS):
        # the context of the n-gram at a word is the (n-1)-gram at the word before
        context = tables[n - 1][np.concatenate(([0], buckets[n - 1][:-1]))] if len(place) else place
        context = np.where(place > 0, context, 0.0)
        p = (np.minimum(tables[n][buckets[n]], context) + PRIOR * p) / (context + PRIOR)
    return -np.log2(p)


class Model:
    """Easy and hard n-gram counts, (2, ORDERS, BUCKETS)."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts

    def describe(self, words: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
        """Per text: score, surprisal_mean, surprisal_sd, surprisal_p90 (easy model), n_words; NaN without words."""
        buckets = ngram_buckets(words, sizes)
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(words)) - np.repeat(starts, sizes)
        easy, hard = (_surprisal(buckets, place, c) for c in self.counts)
        gain = np.clip(easy - hard, -8, 8)
        some = np.flatnonzero(sizes > 0)
        out = pd.DataFrame(np.nan, index=range(len(sizes)), columns=["score", "surprisal_mean", "surprisal_sd", "surprisal_p90"])
        if len(some):
            n, at = sizes[some], starts[some]
            mean = np.add.reduceat(easy, at) / n
            out.loc[some, "score"] = np.add.reduceat(gain, at) / n
            out.loc[some, "surprisal_mean"] = mean
            out.loc[some, "surprisal_sd"] = np.sqrt(np.maximum(np.add.reduceat(easy * easy, at) / n - mean * mean, 0))
            order = np.lexsort((easy, np.repeat(np.arange(len(sizes)), sizes)))
            out.loc[some, "surprisal_p90"] = easy[order][at + ((n - 1) * 9) // 10]
        return out.assign(n_words=sizes)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (x ascending, non-decreasing fitted y); ties of x are pooled first."""
    if not len(x):
        return np.array([0.0]), np.array([float(sum(LEVELS)) / 2])
    order = np.argsort(x, kind="stable")
    knots, start = np.unique(x[order], return_index=True)
    sums = np.add.reduceat(y[order].astype(float), start)
    counts = np.diff(np.append(start, len(x))).astype(float)
    blocks: list[list[float]] = []  # sum, count, first knot, last knot
    for i in range(len(knots)):
        blocks.append([sums[i], counts[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][3] = last
    middle = np.array([(knots[int(b[2])] + knots[int(b[3])]) / 2 for b in blocks])
    return middle, np.array([b[0] / b[1] for b in blocks])


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id, level DOUBLE: the mean of a document's ratings; repeated rows count once, null and out-of-range ones never."""
    valid = labels.where(F.col("reading_level").between(*LEVELS)).select("doc_id", "rater", "reading_level").distinct()
    return valid.groupBy("doc_id").agg(F.avg("reading_level").alias("level"))


def hardness(level: np.ndarray) -> np.ndarray:
    """How much of a rated document counts as hard text."""
    return np.clip((level - 1.5) / 3, 0, 1)


def train_counts(rated: DataFrame) -> np.ndarray:
    """doc_id, text, level, fold -> (2 folds, 2 models, ORDERS, BUCKETS) counts, summed where the rows are.

    Each task sums into tables of fixed size; what reaches the driver is 2 x ORDERS packed tables per model.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        tokens, sums = Tokens(), np.zeros((2, 2, ORDERS, BUCKETS), np.float32)
        for frame in (f.iloc[s] for f in frames for s in slices(f["text"].tolist())):
            words, sizes = tokens(frame["text"])
            buckets = ngram_buckets(words, sizes)
            hard = np.repeat(hardness(frame["level"].to_numpy()), sizes)
            fold = np.repeat(frame["fold"].to_numpy(), sizes)
            for f in (0, 1):
                own = fold == f
                for n in range(ORDERS):
                    b = buckets[n][own]
                    sums[f, 0, n] += np.bincount(b, 1 - hard[own], BUCKETS).astype(np.float32)
                    sums[f, 1, n] += np.bincount(b, hard[own], BUCKETS).astype(np.float32)
        flat = sums.reshape(-1)
        at = np.flatnonzero(flat)
        yield pd.DataFrame({"cell": at, "n": flat[at].astype(np.float64)})

    cells = rated.select("text", "level", "fold").mapInPandas(count, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    width = 1 << 14

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["cell"].iloc[0]) // width
        dense = np.zeros(width, np.float32)
        dense[frame["cell"].to_numpy() % width] = frame["n"].to_numpy()
        return pd.DataFrame({"part": [part], "counts": [dense.tobytes()]})

    packed = cells.groupBy(F.floor(F.col("cell") / width).alias("p")).applyInPandas(pack, "part bigint, counts binary")
    out = np.zeros(2 * 2 * ORDERS * BUCKETS, np.float32)
    for row in packed.toLocalIterator():  # at most 96 rows of 64 KB
        out[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["counts"], np.float32)
    return out.reshape(2, 2, ORDERS, BUCKETS)


def _score(documents: DataFrame, models: list[Model], model_of: str) -> DataFrame:
    """documents (doc_id, text, model_of INT, rest) -> rest and the description by the model of the row's number."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast([m.counts for m in models])
    rest = [f for f in documents.schema.fields if f.name not in ("text", model_of)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "score double, surprisal_mean double, surprisal_sd double, surprisal_p90 double, n_words bigint"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        tokens, own = Tokens(), [Model(c) for c in shared.value]
        for frame in (f.iloc[s] for f in frames for s in slices(f["text"].tolist())):
            for number, part in frame.groupby(model_of, sort=False):
                described = own[int(number)].describe(*tokens(part["text"]))
                described.index = part.index
                yield pd.concat([part[[f.name for f in rest]], described], axis=1)

    return documents.mapInPandas(run, schema)


class ReadingLevels:
    """A fitted reading-level model: n-gram counts and one monotone mapping per group, None's for all others."""

    def __init__(self, model: Model, mappings: dict[str | None, tuple[np.ndarray, np.ndarray]]) -> None:
        self.model, self.mappings = model, mappings

    @classmethod
    def fit(cls, documents: DataFrame, labels: DataFrame, most_fitted: int = MOST_FITTED) -> ReadingLevels:
        """documents: doc_id, text and perhaps group_name; labels: doc_id, rater, reading_level. Without ratings every
        text gets the middle level.
        """
        group = F.col("group_name") if "group_name" in documents.columns else F.lit(None).cast("string")
        fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
        texts = documents.select("doc_id", "text", group.alias("group_name")).where("text IS NOT NULL")
        rated = checkpointed(texts.join(ratings(labels), "doc_id").withColumn("fold", fold))
        counts = train_counts(rated)
        # each half is scored by the models of the other half
        fitted = rated.orderBy(F.xxhash64(F.lit(3), "doc_id")).limit(most_fitted)
        held_out = _score(fitted.select("text", "level", "group_name", (1 - F.col("fold")).alias("by")), [Model(c) for c in counts], "by")
        pairs = held_out.where("n_words > 0").select("level", "score", "group_name").toPandas()
        mappings = {name: isotonic(g["score"].to_numpy(), g["level"].to_numpy()) for name, g in pairs.groupby("group_name") if len(g) >= LEAST_IN_GROUP}
        mappings[None] = isotonic(pairs["score"].to_numpy(), pairs["level"].to_numpy())
        return cls(Model(counts.sum(axis=0)), mappings)

    def levels(self, documents: DataFrame) -> DataFrame:
        """The columns of ``documents`` but text and group_name, and score, surprisal_mean, surprisal_sd, surprisal_p90,
        n_words, level_score DOUBLE and reading_level INT (both from 1, easiest, to 5).

        Monotone in score within a group. A text without any word has nothing to decode: level 1, its surprisals null.
        Whole texts are scored; null texts count as texts without words.
        """
        if "group_name" not in documents.columns:
            documents = documents.withColumn("group_name", F.lit(None).cast("string"))
        scored = _score(documents.withColumn("__model", F.lit(0)), [self.model], "__model")
        mappings = {g: (k.tolist(), v.tolist()) for g, (k, v) in self.mappings.items()}

        @F.pandas_udf("double")
        def mapped(score: pd.Series, group: pd.Series) -> pd.Series:
            out = pd.Series(float(LEVELS[0]), index=score.index)
            known = group.where(group.isin([g for g in mappings if g is not None]), "")
            for g, own in score.groupby(known):
                knots, values = mappings[g or None]
                out[own.index] = np.where(own.isna(), LEVELS[0], np.interp(own.fillna(0), knots, values))
            return out

        number = lambda c: F.when(F.col("n_words") > 0, F.col(c)).alias(c)
        columns = ["score", "surprisal_mean", "surprisal_sd", "surprisal_p90"]
        out = scored.withColumns({c: number(c) for c in columns}).withColumn("level_score", mapped("score", "group_name"))
        return out.withColumn("reading_level", F.round("level_score").cast("int")).drop("group_name")


def reading_levels(documents: DataFrame, labels: DataFrame, most_fitted: int = MOST_FITTED) -> DataFrame:
    """Reading level of every document: doc_id, text, perhaps group_name (the language, say) and other columns, which
    are kept unless they are named as a result column. Null texts come out with null levels; repeated documents come out
    as often as they go in; an empty table gives an empty result. See ``ReadingLevels``.
    """
    documents = documents.drop("score", "surprisal_mean", "surprisal_sd", "surprisal_p90", "n_words", "level_score", "reading_level")
    fitted = ReadingLevels.fit(documents, labels, most_fitted)
    known = fitted.levels(documents.where("text IS NOT NULL"))
    none = documents.where("text IS NULL").drop("text", "group_name")
    return known.unionByName(none, allowMissingColumns=True)


def level_profile(levels: DataFrame, by: tuple[str, ...] = ("scope", "source", "lang")) -> DataFrame:
    """Documents, rated texts, mean level and documents per level, for each combination of ``by`` that occurs."""
    share = [F.count_if(F.col("reading_level") == n).alias(f"level_{n}") for n in range(LEVELS[0], LEVELS[1] + 1)]
    return levels.groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), F.count("reading_level").alias("levelled"), F.avg("level_score").alias("mean_level"), *share)
