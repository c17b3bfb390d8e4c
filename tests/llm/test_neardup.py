import random

import numpy as np
import pytest

from mnemospark.llm.neardup import DartMinHash, bands_for, components, near_duplicate_groups, near_duplicate_pairs, sketch_limit
from mnemospark.llm.words import word_set, words_of


@pytest.mark.parametrize("overlap", [0.2, 0.5, 0.75, 0.9])
def test_signatures_agree_with_the_similarity(overlap):
    rng = np.random.default_rng(1)
    same = int(round(200 * overlap / (1 + overlap)))
    a = rng.integers(-(2**62), 2**62, 100)
    b = np.concatenate([a[:same], rng.integers(-(2**62), 2**62, 100 - same)])
    s = DartMinHash(2000).signatures(np.concatenate([a, b]), np.array([100, 100]))
    true = same / (200 - same)
    assert abs((s[0] == s[1]).mean() - true) < 5 * np.sqrt(true * (1 - true) / 2000)


def test_weighted_signatures():
    rng = np.random.default_rng(2)
    words, wa, wb = rng.integers(-(2**62), 2**62, 40), rng.uniform(0.2, 6, 40), rng.uniform(0.2, 6, 40)
    s = DartMinHash(2000).signatures(np.concatenate([words, words]), np.array([40, 40]), np.concatenate([wa, wb]))
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((s[0] == s[1]).mean() - true) < 5 * np.sqrt(true * (1 - true) / 2000)


def test_signatures_don_t_depend_on_company():
    rng = np.random.default_rng(4)
    sets = [rng.integers(-(2**62), 2**62, n) for n in (1, 3, 500, 20, 0)]
    d = DartMinHash(64)
    together = d.signatures(np.concatenate(sets), np.array([len(s) for s in sets]))
    for s, row in zip(sets, together):
        assert (d.signatures(s, np.array([len(s)]))[0] == row).all()
    assert not together[-1].any()


def test_bands():
    b = bands_for(0.75, 8)
    assert (1 - 0.75**8) ** b <= 1e-4 < (1 - 0.75**8) ** (b - 1)
    assert 16 < sketch_limit(0.75, 128) < 64


def test_against_brute_force(spark, rows):
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(400)]
    data = []
    for i in range(250):
        text = random.sample(vocabulary, 30) if i % 2 == 0 else [w if random.random() > 0.08 else "new" for w in random.choice(data)[1].split()]
        data.append((f"s{i:03}", " ".join(text)))
    data += [("copy", data[0][1]), ("turned", " ".join(reversed(data[0][1].split())))]
    df = rows("id string, text string", *data).select("id", word_set("text").alias("words"))
    got = [(r["id_a"], r["id_b"]) for r in near_duplicate_pairs(df, 0.75).collect()]
    sets = [(i, set(words_of(t))) for i, t in data]
    want = {tuple(sorted((i, j))) for i, a in sets for j, b in sets if i < j and len(a & b) >= 0.75 * len(a | b)}
    assert set(got) == want and len(got) == len(want) > 50


def test_edges(spark, rows):
    long = list(range(1, 30_001))
    df = rows("id string, words array<bigint>, set_key string, links int", ("a", [1, 2, 3, 4], "x", 1), ("b", [1, 2, 3, 4], "x", 1), ("c", [1, 2, 3, 4, 5], "x", 1), ("d", [], "x", 1), ("e", None, "x", 1), ("f", long, "x", 1), ("g", long[100:], "x", 1))
    got = {r["id"]: r for r in near_duplicate_groups(df, 0.75).collect()}
    assert (got["a"]["class_id"], got["b"]["class_id"], got["c"]["class_id"]) == ("a", "a", "c")
    assert (got["a"]["group_id"], got["c"]["group_id"], got["f"]["group_id"], got["g"]["group_id"]) == ("a", "a", "f", "f")
    assert (got["a"]["copies"], got["a"]["links"], got["c"]["links"]) == (2, 1, 1)
    assert got["d"]["class_id"] is None and got["e"]["group_id"] is None and got["d"]["links"] == 0
    assert near_duplicate_pairs(df.limit(0), 0.75).count() == 0
    assert near_duplicate_groups(df.limit(0), 0.75).count() == 0


def test_components(rows):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 100)]
    got = {r["node"]: r["component"] for r in components(rows("set_a bigint, set_b bigint", *chain)).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and got[103] == got[101] == 100
