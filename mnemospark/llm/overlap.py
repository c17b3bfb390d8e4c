"""Same or near-same records across splits.

The held-out records are cut into shards; a shard's texts, in their own word order, become a compressed full-text index
(suffix array, C table, wavelet matrix with sampled ranks over the Burrows-Wheeler transform). Training records are
streamed through it: backward search starts at each of a record's rarest words (its anchors), the intervals say in
which held-out records they occur, and a pair that shares too few anchors is out for certain. From the anchors of the
others the search grows word by word to maximal matches, which are merged into spans and counts.

The threshold is on word sets, so it can't be read off the spans: the same words in another order have only matches of
one word. What makes the result exact is a bound on anchors (see ``prefix_length``): a pair above the threshold shares
at least k of the anchors of either record. The pairs left are counted exactly.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.words import WordHashes, words_of
from mnemospark.runtime import busy_partitions, checkpointed

#: Words of one shard's index and of one block of training records.
SHARD_WORDS = 2_000_000
#: Record pairs counted at once, and matches expanded at once.
CELLS = 4_000_000
#: Anchors that a pair must share, where its records have as many words.
ANCHORS = 3


def needed(n: np.ndarray | int, threshold: float) -> np.ndarray:
    """The least number of words that a set of n shares with any set that overlaps it by ``threshold`` or more."""
    return np.ceil(np.asarray(n) * threshold - 1e-9).astype(np.int64)


def prefix_length(n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(length, k): sets that overlap by the threshold share at least k words among the first ``length`` of either.

    If A and B share o words, drop all but the first |A| - o + k of A and |B| - o + k of B: at most o - k of the
    shared words lie in A's tail, and whichever set's prefix ends first in the common order has k shared words in
    both prefixes.
    """
    o = needed(n, threshold)
    k = np.minimum(ANCHORS, np.maximum(o, 1))
    return np.minimum(n, n - o + k), k


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of an integer text by prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    while True:
        second = np.full(n, -1, np.int64)
        second[:-step or None] = rank[step:] if step < n else second[:-step or None]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        step *= 2
        if n == 0 or rank[order[-1]] == n - 1 or step >= n:
            return order


class WaveletMatrix:
    """Ranks of any symbol in a sequence; a bit a level and position, and a count every 64 positions."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.n, self.levels = len(sequence), max(1, int(symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        left = sequence
        for level in range(self.levels - 1, -1, -1):
            bit = (left >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1].astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            left = np.concatenate((left[bit == 0], left[bit == 1]))
        self.starts = self._walk(np.zeros(symbols, np.int64), np.arange(symbols))

    def _walk(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            block = at >> 6
            ones = self.counts[i][block] + np.bitwise_count(self.words[i][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> level) & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """How often symbol stands before position ``at``."""
        return self._walk(at, symbol) - self.starts[symbol]


class FullTextIndex:
    """Compressed full-text index of records; a record is a sequence of words and belongs to a group (a dataset's number)."""

    def __init__(self, sequences: list[np.ndarray], groups: np.ndarray) -> None:
        words = np.concatenate([*sequences, np.array([], np.int64)]).astype(np.int64)
        self.lengths, self.groups = np.array([len(s) for s in sequences], np.int64), np.asarray(groups, np.int64)
        self.alphabet = np.unique(words)
        # symbol 0 closes every record; words follow from 1 on
        self.text = np.zeros(len(words) + len(self.lengths), np.int64)
        self.text[self._inside()] = np.searchsorted(self.alphabet, words) + 1
        self.sa = suffix_array(self.text)
        self._derive()

    def _inside(self) -> np.ndarray:
        self.starts = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        inside = np.ones(int((self.lengths + 1).sum()), bool)
        inside[self.starts + self.lengths] = False
        return inside

    def _derive(self) -> None:
        self.symbols = len(self.alphabet) + 1
        counts = np.bincount(self.text, minlength=self.symbols)
        self.c = np.concatenate(([0], np.cumsum(counts)))
        self.bwt = self.text[self.sa - 1]
        self.ranks = WaveletMatrix(self.bwt, self.symbols)
        #: The common order of words: those not in the index first, then the rarer first.
        self.place = np.empty(self.symbols, np.int64)
        self.place[np.argsort(counts, kind="stable")] = np.arange(self.symbols)
        # distinct words of each record, rarest first; the first place of each in the text
        record = np.repeat(np.arange(len(self.lengths)), self.lengths)
        at = np.flatnonzero(self.text)
        self.words, self.first, self.sizes = distinct(record, self.place[self.text[at]], at, len(self.lengths))

    def to_bytes(self) -> bytes:
        """Alphabet, lengths, groups, text and suffix array; the transform and its ranks are derived again."""
        head = np.array([len(self.alphabet), len(self.lengths), len(self.sa)], np.int64)
        parts = (head, self.alphabet, self.lengths.astype(np.int32), self.groups.astype(np.int32), self.text.astype(np.int32), self.sa.astype(np.int32))
        return zlib.compress(b"".join(p.tobytes() for p in parts), 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> FullTextIndex:
        self, raw = cls.__new__(cls), zlib.decompress(data)
        a, m, n = np.frombuffer(raw, np.int64, 3)
        self.alphabet = np.frombuffer(raw, np.int64, a, 24)
        rest = np.frombuffer(raw, np.int32, 2 * m + 2 * n, 24 + 8 * a).astype(np.int64)
        self.lengths, self.groups, self.text, self.sa = rest[:m], rest[m : 2 * m], rest[2 * m : 2 * m + n], rest[2 * m + n :]
        self._inside()
        self._derive()
        return self

    def anchors(self, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffix array rows, records) of the first places of each record's rarest ``prefix`` words, in suffix order."""
        begins = np.cumsum(self.sizes) - self.sizes
        anchor = np.zeros(len(self.text), bool)
        anchor[self.first[np.arange(len(self.words)) - np.repeat(begins, self.sizes) < np.repeat(prefix, self.sizes)]] = True
        rows = np.flatnonzero(anchor[self.sa])
        return rows, np.searchsorted(self.starts, self.sa[rows], side="right") - 1

    def symbols_of(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words, -1 for those not in the index."""
        if not len(self.alphabet):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, -1)

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the suffixes that start with symbol and go on as those in [low, high)."""
        known = symbol > 0
        s = np.where(known, symbol, 0)
        low, high = np.split(self.ranks.rank(np.concatenate((low, high)), np.concatenate((s, s))) + np.tile(self.c[s], 2), 2)
        return np.where(known, low, 0), np.where(known, high, 0)

    def longest_matches(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each position of the concatenated sequences: the longest match in the index that ends there."""
        low, high = np.zeros(len(symbols), np.int64), np.full(len(symbols), len(self.text), np.int64)
        length, alive, at = np.zeros(len(symbols), np.int64), np.arange(len(symbols)), np.arange(len(symbols))
        first = np.repeat(starts, np.diff(np.append(starts, len(symbols)))) if len(starts) else starts
        while len(alive):
            low_, high_ = self.extend(low[alive], high[alive], symbols[at[alive]])
            ok = high_ > low_
            alive = alive[ok]
            low[alive], high[alive] = low_[ok], high_[ok]
            length[alive] += 1
            at[alive] -= 1
            alive = alive[at[alive] >= first[alive]]
        return length

    def grown(self, symbols: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of the maximal matches of a sequence with single rows: backward search from one row of an anchor's
        interval, growing to the left while the row's suffix goes on as the sequence does; to the right by the text.

        at: the anchors' positions in ``symbols``; first, last: the bounds of their sequences; row: suffix array rows.
        """
        begin, end, held = at.copy(), at + 1, self.sa[row]
        alive, r = np.flatnonzero(begin > first), row.copy()
        while len(alive):
            s = symbols[begin[alive] - 1]
            alive = alive[(self.bwt[r[alive]] == s) & (s > 0)]
            s = symbols[begin[alive] - 1]
            r[alive] = self.c[s] + self.ranks.rank(r[alive], s)
            begin[alive] -= 1
            alive = alive[begin[alive] > first[alive]]
        alive = np.flatnonzero(end < last)
        while len(alive):
            there = self.text[np.minimum(held[alive] + end[alive] - at[alive], len(self.text) - 1)]
            alive = alive[(symbols[end[alive]] == there) & (there > 0)]
            end[alive] += 1
            alive = alive[end[alive] < last[alive]]
        return begin, end


def distinct(record: np.ndarray, place: np.ndarray, at: np.ndarray, records: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of each record's distinct words in ascending order, ``at`` of their first appearances, words a record)."""
    top = int(place.max(initial=0)) + 1
    code, index = np.unique(record * top + place, return_index=True)
    return code % top, at[index], np.bincount(code // top, minlength=records)


def merged(pair: np.ndarray, begin: np.ndarray, end: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, longest) of the spans that the matches of each pair merge into."""
    room = int(end.max(initial=0)) + 1
    order = np.lexsort((begin, pair))
    pair = pair[order]
    begin, end = pair * room + begin[order], np.maximum.accumulate(pair * room + end[order])
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(begin)), bool), begin[1:] >= end[:-1])))
    last = np.append(new[1:], len(begin)) - 1
    longest = np.zeros(pairs, np.int64)
    np.maximum.at(longest, pair[new], end[last] - begin[new])
    return np.bincount(pair[new], minlength=pairs), longest


def matched_pairs(index: FullTextIndex, sequences: list[np.ndarray], groups: np.ndarray, allowed: np.ndarray, threshold: float) -> Iterable[tuple[np.ndarray, ...]]:
    """(training position, index position, shared words, spans, longest span, equal) of all pairs whose word sets overlap by
    the threshold or more, as arrays.

    groups: the sequences' groups; allowed: boolean matrix, group of a sequence x group of an indexed record.
    """
    groups = np.asarray(groups)
    for g in np.unique(groups):
        mine = np.flatnonzero(groups == g)
        theirs = np.flatnonzero(allowed[g, index.groups])
        if len(theirs):
            for i, j, *found in _matched(index, [sequences[k] for k in mine], theirs, threshold):
                yield mine[i], theirs[j], *found


def _matched(index: FullTextIndex, sequences: list[np.ndarray], theirs: np.ndarray, threshold: float) -> Iterable[tuple[np.ndarray, ...]]:
    """``matched_pairs`` of sequences of one group with the indexed records ``theirs``; positions are those in both lists."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    raw = np.concatenate([*sequences, np.array([], np.int64)]).astype(np.int64)
    text = index.symbols_of(raw)
    starts = np.cumsum(lengths) - lengths
    # places: words that aren't in the index come first, each with a place of its own
    place = np.where(text > 0, index.place[np.maximum(text, 0)], 0)
    unknown = np.flatnonzero(text < 0)
    fresh, back = np.unique(raw[unknown], return_inverse=True)
    place = place + len(fresh)
    place[unknown] = back
    words, at, sizes = distinct(np.repeat(np.arange(len(lengths)), lengths), place, np.arange(len(raw)), len(lengths))
    begins = np.cumsum(sizes) - sizes
    offset = np.arange(len(words)) - np.repeat(begins, sizes)
    # anchors of the indexed records, in suffix order
    m, sizes_b = len(theirs), index.sizes[theirs]
    prefix_b, k_b = prefix_length(index.sizes, threshold)
    k_b, begins_b = k_b[theirs], (np.cumsum(index.sizes) - index.sizes)[theirs]
    column = np.full(len(index.lengths), -1, np.int64)
    column[theirs] = np.arange(m)
    rows, record = index.anchors(prefix_b)
    record = column[record]
    rows, record = rows[record >= 0], record[record >= 0]
    upto = np.searchsorted(rows, np.arange(len(index.text) + 1))
    # one step of backward search from every anchor of the training records
    prefix_a, k_a = prefix_length(sizes, threshold)
    query = np.flatnonzero((offset < np.repeat(prefix_a, sizes)) & (words >= len(fresh)))
    of = np.repeat(np.arange(len(lengths)), sizes)[query]
    low, high = index.extend(np.zeros(len(query), np.int64), np.full(len(query), len(index.text), np.int64), text[at[query]])
    low, high = upto[low], upto[high]
    hits = high - low
    total = np.concatenate(([0], np.cumsum(hits)))
    query_from = np.searchsorted(of, np.arange(len(lengths) + 1))
    flags = np.zeros(len(fresh) + index.symbols, bool)
    done, step, least = 0, max(1, CELLS // max(m, 1)), int(max(1, min(k_a.min(initial=ANCHORS), k_b.min(initial=ANCHORS))))
    held: list[tuple[np.ndarray, ...]] = []
    while done < len(lengths):
        # whole training records at a time: about CELLS pairs, about CELLS matches
        end = min(len(lengths), done + step, max(done + 1, int(np.searchsorted(total[query_from], total[query_from[done]] + CELLS, side="right")) - 1))
        q0, q1 = query_from[done], query_from[end]
        n = hits[q0:q1]
        pick = np.repeat(low[q0:q1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        cells = np.repeat((of[q0:q1] - done) * m, n) + record[pick]
        count = np.bincount(cells, minlength=(end - done) * m)
        cell = np.flatnonzero(count >= least)
        a, b = cell // m + done, cell % m
        near = (count[cell] >= np.minimum(k_a[a], k_b[b])) & (sizes_b[b] >= needed(sizes[a], threshold)) & (sizes[a] >= needed(sizes_b[b], threshold))
        a, b, cell = a[near], b[near], cell[near]
        shared = np.zeros(len(a), np.int64)
        edges = np.flatnonzero(np.diff(a, prepend=-1, append=-1)) if len(a) else np.array([], np.int64)
        for x, y in zip(edges[:-1], edges[1:]):
            own = words[begins[a[x]] : begins[a[x]] + sizes[a[x]]]
            flags[own] = True
            size = sizes_b[b[x:y]]
            begin = np.cumsum(size) - size
            tokens = np.repeat(begins_b[b[x:y]] - begin, size) + np.arange(int(size.sum()))
            shared[x:y] = np.add.reduceat(flags[len(fresh) + index.words[tokens]], begin, dtype=np.int64)
            flags[own] = False
        good = shared >= threshold * (sizes[a] + sizes_b[b] - shared) - 1e-9
        a, b, cell, shared = a[good], b[good], cell[good], shared[good]
        if len(a):
            wanted = np.zeros(len(count), bool)
            wanted[cell] = True
            kept = wanted[cells]
            held.append((a, b, shared, np.repeat(at[query[q0:q1]], n)[kept], rows[pick[kept]], np.searchsorted(cell, cells[kept])))
        done = end
        if held and (done == len(lengths) or sum(len(h[3]) for h in held) >= CELLS):
            # the anchors of the pairs left grow to maximal matches
            first = np.cumsum([0, *[len(h[0]) for h in held[:-1]]])
            a, b, shared, position, row = (np.concatenate([h[c] for h in held]) for c in range(5))
            pair = np.concatenate([h[5] + f for h, f in zip(held, first)])
            owner = a[pair]
            spans, longest = merged(pair, *index.grown(text, starts[owner], starts[owner] + lengths[owner], position, row), len(a))
            yield a, b, shared, spans, longest, (shared == sizes[a]) & (shared == sizes_b[b])
            held = []


def overlapping_texts(texts: DataFrame, pairs: list[tuple[str, str]], threshold: float = 0.7, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Pairs of distinct texts, one of a training and one of a held-out dataset, whose word sets overlap by the threshold or
    more.

    texts: dataset, key_a, key_b (128 bits that stand for the text), text, one row per dataset and distinct text; pairs:
    (training, held out), one per bank. Result: training, held_out, a_a, a_b, b_a, b_b (the keys of the training and of the
    held-out text), shared, spans, longest, exact.

    Shards and blocks are cut by the hash of the text over all datasets, so a dataset of any size is spread. A training
    text is sent to every shard, a shard to every block: work grows with held-out shards x training texts.
    """
    spark = texts.sparkSession
    names = sorted({x for p in pairs for x in p})
    number = {x: i for i, x in enumerate(names)}
    named = np.array(names, object)
    allowed = np.zeros((len(names), len(names)), bool)
    for training, held_out in pairs:
        allowed[number[training], number[held_out]] = True
    jobs = busy_partitions(spark)
    size = F.sum(F.length("text") / 5)
    held_chars, train_chars = (texts.where(F.col("dataset").isin(sorted({p[i] for p in pairs}))).agg(size).first()[0] or 0 for i in (1, 0))
    # shards and blocks of bounded size; few shards, as each reads the training texts again, and blocks to keep the cores busy
    shards = max(math.ceil(held_chars / shard_words), min(round(jobs**0.5), math.ceil(held_chars / 400_000)), 1)
    blocks = max(math.ceil(train_chars / shard_words), min(math.ceil(jobs / shards), math.ceil(train_chars / 50_000)), 1)

    def side(i: int, parts: int, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64("key_a", F.lit(name)), F.lit(parts)).cast("int").alias(name)
        return texts.where(F.col("dataset").isin(sorted({p[i] for p in pairs}))).select("dataset", "key_a", "key_b", "text", part)

    def read(frame: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
        hashes = WordHashes()
        return [hashes.sequence(words_of(t)) for t in frame["text"]], frame["dataset"].map(number).to_numpy(np.int64)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        keys = frame[["key_a", "key_b"]].to_numpy(np.int64)
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "index": [FullTextIndex(*read(frame)).to_bytes()], "keys": [zlib.compress(keys.tobytes(), 1)]})

    # indexes are far larger than the planner thinks: they must not be broadcast, and the cogroup doesn't
    indexes = checkpointed(side(1, shards, "shard").repartition(shards, "shard").groupBy("shard").applyInPandas(build, "shard int, index binary, keys binary"))
    spread = lambda n: F.explode(F.array(*[F.lit(i) for i in range(n)]))
    streamed = side(0, blocks, "block").withColumn("shard", spread(shards)) if shards > 1 else side(0, blocks, "block").withColumn("shard", F.lit(0))
    shipped = indexes.withColumn("block", spread(blocks)).select(F.col("shard").alias("of_shard"), F.col("block").alias("of_block"), "index", "keys")
    columns = ["training", "held_out", "a_a", "a_b", "b_a", "b_b", "shared", "spans", "longest", "exact"]

    def search(block: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(block) and len(shard):
            index = FullTextIndex.from_bytes(shard["index"].iloc[0])
            theirs = np.frombuffer(zlib.decompress(shard["keys"].iloc[0]), np.int64).reshape(-1, 2)
            sequences, groups = read(block)
            mine = block[["key_a", "key_b"]].to_numpy(np.int64)
            for i, j, shared, spans, longest, exact in matched_pairs(index, sequences, groups, allowed, threshold):
                out.append((named[groups[i]], named[index.groups[j]], mine[i, 0], mine[i, 1], theirs[j, 0], theirs[j, 1], shared, spans, longest, exact))
        return pd.DataFrame({c: pd.Series(np.concatenate([o[k] for o in out]) if out else [], dtype=object if k < 2 else None) for k, c in enumerate(columns)})

    schema = "training string, held_out string, a_a bigint, a_b bigint, b_a bigint, b_b bigint, shared int, spans int, longest int, exact boolean"
    # a job computes long on few bytes: a partition each, up to three a core
    n = min(jobs, shards * blocks)
    left, right = streamed.repartition(n, "shard", "block"), shipped.repartition(n, "of_shard", "of_block")
    return left.groupBy("shard", "block").cogroup(right.groupBy("of_shard", "of_block")).applyInPandas(search, schema)


def cross_split_overlaps(records: DataFrame, pairs: DataFrame, threshold: float = 0.7, shard_words: int = SHARD_WORDS) -> DataFrame:
    """All overlaps between the records of paired datasets.

    records: id STRING, dataset STRING, text STRING (repeated rows count once); pairs: training, held_out, one row per
    bank (repeated rows and rows with a null do nothing; the list of pairs is read by the driver). Other columns are ignored.
    Result: training, held_out, training_id, held_out_id, shared (words), spans, longest (of maximal matches grown from the
    shared anchors, merged, in words), exact BOOLEAN (equal word sets).

    A record without words, of null or blank text, overlaps with nothing; one without dataset belongs to no split. A record
    never comes out against itself. Equal texts are compared once, however many records hold them, and expanded at the end.
    """
    spark = records.sparkSession
    linked = [(r[0], r[1]) for r in pairs.select("training", "held_out").where("training IS NOT NULL AND held_out IS NOT NULL").distinct().collect()]
    if not linked:
        return spark.createDataFrame([], "training string, held_out string, training_id string, held_out_id string, shared int, spans int, longest int, exact boolean")
    used = records.select("id", "dataset", "text").where(F.col("dataset").isin(sorted({x for p in linked for x in p})) & F.col("text").rlike(r"[\p{L}\p{N}_]|[^\x00-\x7f]"))
    keyed = used.select("id", "dataset", F.xxhash64("text").alias("key_a"), F.xxhash64(F.lit(1), "text").alias("key_b"), "text")
    # texts are grouped once for both sides; the members carry keys alone
    texts = checkpointed(keyed.groupBy("dataset", "key_a", "key_b").agg(F.any_value("text").alias("text")))
    found = overlapping_texts(texts, linked, threshold, shard_words)
    members = keyed.select("id", "dataset", "key_a", "key_b").distinct()
    a = members.select(F.col("dataset").alias("training"), F.col("key_a").alias("a_a"), F.col("key_b").alias("a_b"), F.col("id").alias("training_id"))
    b = members.select(F.col("dataset").alias("held_out"), F.col("key_a").alias("b_a"), F.col("key_b").alias("b_b"), F.col("id").alias("held_out_id"))
    expanded = found.join(a, ["training", "a_a", "a_b"]).join(b, ["held_out", "b_a", "b_b"]).where("training_id <> held_out_id")
    return expanded.select("training", "held_out", "training_id", "held_out_id", "shared", "spans", "longest", "exact")


def overlap_report(overlaps: DataFrame, sources: DataFrame) -> DataFrame:
    """Overlaps per pair of datasets, split ('training' or 'held_out') and source.

    sources: id, source. Result: training, held_out, split, source (null where unknown), cases (records with an overlap),
    exact_cases, links (overlaps they take part in).
    """
    side = lambda s: F.struct(F.lit(s).alias("split"), F.col(f"{s}_id").alias("id"))
    ends = overlaps.select("training", "held_out", "exact", F.explode(F.array(side("training"), side("held_out"))).alias("e"))
    cases = ends.select("training", "held_out", "exact", "e.*").groupBy("training", "held_out", "split", "id").agg(F.count(F.lit(1)).alias("n"), F.max("exact").alias("exact"))
    return (
        cases.join(sources.select("id", "source"), "id", "left")
        .groupBy("training", "held_out", "split", "source")
        .agg(F.count(F.lit(1)).alias("cases"), F.count_if("exact").alias("exact_cases"), F.sum("n").alias("links"))
    )
