import random

import numpy as np
import pytest

from mnemospark.llm.overlap import FullTextIndex, WaveletMatrix, cross_split_overlaps, matched_pairs, overlap_report, prefix_length, suffix_array
from mnemospark.llm.words import words_of

RECORD = "id string, dataset string, text string, key_a string, shared int"
PAIR = "training string, held_out string, shared int"


def pairs_of(*args):
    return [tuple(x.item() for x in row) for found in matched_pairs(*args) for row in zip(*found)]


def test_words():
    assert words_of("Ｆｏｏ_1, bar-BAZ!\u200b é") == ["foo_1", "bar", "baz", "é"]
    assert words_of(None) == words_of(" \n") == []


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 200):
        text = rng.integers(0, 4, n)
        assert suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    for symbols, n in ((1, 5), (2, 64), (7, 200), (300, 1000)):
        x = rng.integers(0, symbols, n)
        w = WaveletMatrix(x, symbols)
        at, s = rng.integers(0, n + 1, 50), rng.integers(0, symbols, 50)
        assert w.rank(at, s).tolist() == [int((x[:i] == c).sum()) for i, c in zip(at, s)]


def test_index_round_trip_and_longest_matches():
    index = FullTextIndex.from_bytes(FullTextIndex([np.array([5, 7, 9]), np.array([7, 9, 11])], np.array([1, 2])).to_bytes())
    sequence = np.array([5, 7, 9, 11, 8, 7])
    assert index.longest_matches(index.symbols_of(sequence), np.array([0, 5])).tolist() == [1, 2, 3, 3, 0, 1]
    assert index.groups.tolist() == [1, 2] and index.sizes.tolist() == [3, 3]


def test_matches_grow_to_spans():
    index = FullTextIndex([np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10])], np.array([0]))
    other = np.array([1, 2, 3, 4, 99, 6, 7, 8, 9, 10])
    (_, _, shared, spans, longest, equal), = pairs_of(index, [other], np.array([0]), np.array([[True]]), 0.7)
    assert (shared, longest, equal) == (9, 5, False) and spans in (1, 2)
    turned = list(pairs_of(index, [np.arange(10, 0, -1)], np.array([0]), np.array([[True]]), 0.7))
    assert [(t[2], t[4], t[5]) for t in turned] == [(10, 1, True)]


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_no_pair_is_lost(threshold):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(150):
        base = rng.integers(0, 40, rng.integers(1, 15))
        texts.append(base)
        texts.append(rng.permutation(np.concatenate([base[rng.random(len(base)) > 0.15], rng.integers(0, 60, 2)])))
    texts.append(np.array([], np.int64))
    groups = rng.integers(0, 2, len(texts))
    allowed = np.array([[True, False], [True, True]])
    index = FullTextIndex(texts, groups)
    got = {(i, j, s) for i, j, s, *_ in pairs_of(index, texts, groups, allowed, threshold)}
    sets = [set(t.tolist()) for t in texts]
    want = {(i, j, len(a & b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if a and allowed[groups[i], groups[j]] and len(a & b) >= threshold * len(a | b)}
    assert got == want


def test_prefix_is_never_longer_than_the_set():
    n = np.arange(1, 50)
    length, k = prefix_length(n, 0.7)
    assert (length <= n).all() and (k >= 1).all()


def test_against_brute_force_with_small_shards(spark, rows):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(60)]
    data = []
    for i in range(300):
        words = random.sample(vocabulary, 12) if i % 3 or not data else [w for w in data[-1][2].split() if random.random() > 0.1] + ["extra"]
        data.append((f"c{i:03}", "abc"[i % 3 if i % 2 else 0], " ".join(words)))
    df = rows("id string, dataset string, text string", *data)
    pairs = rows("training string, held_out string", ("a", "b"), ("a", "b"), ("a", "c"), ("c", "a"), (None, "a"), ("a", None))
    got = {(r["training_id"], r["held_out_id"]) for r in cross_split_overlaps(df, pairs, 0.7, shard_words=300).collect()}
    sets = [(i, d, set(words_of(t))) for i, d, t in data]
    want = {(i, j) for i, d, a in sets for j, e, b in sets if (d, e) in {("a", "b"), ("a", "c"), ("c", "a")} and len(a & b) >= 0.7 * len(a | b)}
    assert got == want and want


def test_edges(spark, rows):
    long = [f"w{i}" for i in range(20_000)]
    df = rows(RECORD, ("1", "a", "x y z", "x", 0), ("2", "b", "x y z", "x", 0), ("3", "b", "Z, y x!", "x", 0), ("3", "b", "Z, y x!", "x", 1), ("4", "b", "", "x", 0), ("5", "a", " \u200b", "x", 0), ("6", None, "x y z", "x", 0), ("7", "b", None, "x", 0), ("8", "a", " ".join(long), "x", 0), ("9", "b", " ".join(long[5:]), "x", 0))
    found = cross_split_overlaps(df, rows(PAIR, ("a", "b", 1)))
    got = {(r["training_id"], r["held_out_id"], r["exact"], r["longest"]) for r in found.collect()}
    assert got == {("1", "2", True, 3), ("1", "3", True, 1), ("8", "9", False, 19_995)}
    report = overlap_report(found, rows("id string, source string", ("1", "s"), ("2", None))).collect()
    assert {(r["split"], r["source"], r["cases"], r["exact_cases"], r["links"]) for r in report} == {("training", "s", 1, 1, 2), ("training", None, 1, 0, 1), ("held_out", None, 3, 2, 3)}
    assert cross_split_overlaps(df.limit(0), rows(PAIR, ("a", "b", 1))).count() == 0
    assert cross_split_overlaps(df, rows(PAIR)).count() == 0
