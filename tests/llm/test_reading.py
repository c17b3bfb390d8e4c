import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from mnemospark.llm.reading import isotonic, level_profile, ratings, reading_levels

EASY = "the cat sat . we go home . a dog is big . i like it . she has a red map .".split(" . ")
HARD = "notwithstanding prior considerations , asynchronous corroboration remains irreducibly contingent . idiosyncratic provenance militates against deterministic interpretability . such operationalisation presupposes hierarchical instantiation".split(" . ")


@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(1, 5)), min_size=1, max_size=40))
def test_isotonic_is_monotone_and_keeps_the_mean(pairs):
    x, y = (np.array(v, float) for v in zip(*pairs))
    knots, values = isotonic(x, y)
    assert (np.diff(knots) > 0).all() and (np.diff(values) > 0).all()
    assert y.min() - 1e-9 <= values.min() <= values.max() <= y.max() + 1e-9


def test_isotonic_pools_violators():
    knots, values = isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([1.0, 3.0, 2.0, 4.0]))
    assert values.tolist() == [1.0, 2.5, 4.0] and knots.tolist() == [1.0, 2.5, 4.0]


def corpus(rows, n=300):
    random.seed(3)
    docs, labels = [], []
    for i in range(n):
        share = random.random()
        text = ". ".join(random.choice(HARD if random.random() < share else EASY) for _ in range(12))
        docs.append((i, text, f"s{i % 2}", "clash"))
        labels.append((i, "r", 1 + round(4 * share)))
    return docs, labels


def test_held_out_levels_follow_the_ratings(rows):
    docs, labels = corpus(rows)
    got = reading_levels(rows("doc_id bigint, text string, scope string, score string", *docs), rows("doc_id bigint, rater string, reading_level int", *labels[:200])).toPandas()
    true = np.array([x for _, _, x in labels])
    held_out = got[got.doc_id >= 200]
    error = np.abs(held_out.level_score.to_numpy() - true[held_out.doc_id]).mean()
    assert error < 0.7 < np.abs(true[200:] - true.mean()).mean()
    rank = held_out.sort_values("score").level_score.to_numpy()
    assert (np.diff(rank) >= -1e-9).all()


def test_edges(rows):
    docs, labels = corpus(rows, 80)
    schema = "doc_id bigint, text string, scope string, score string"
    odd = [(900, None, None, "c"), (901, "", None, "c"), (902, " \u200b", None, "c"), (903, "the cat sat . " * 50_000, None, "c"), (903, "the cat sat . " * 50_000, None, "c")]
    label = "doc_id bigint, rater string, reading_level int"
    wrong = [(900, "r", 3), (901, None, None), (902, "r", 9), (None, "r", 2)]
    levels = reading_levels(rows(schema, *docs, *odd), rows(label, *labels, *wrong))
    got = {r["doc_id"]: r for r in levels.collect()}
    assert got[900]["reading_level"] is None and got[901]["reading_level"] == got[902]["reading_level"] == 1
    assert got[901]["surprisal_mean"] is None and got[903]["reading_level"] <= 2
    assert levels.where("doc_id = 903").count() == 2
    profile = {r["scope"]: r for r in level_profile(levels, ("scope",)).collect()}
    assert (profile[None]["documents"], profile[None]["levelled"]) == (5, 4)
    unrated = reading_levels(rows(schema, *docs[:3]), rows(label)).collect()
    assert {r["level_score"] for r in unrated} == {3.0}
    assert reading_levels(rows(schema), rows(label)).count() == 0


def test_ratings_are_means_of_distinct_rows(rows):
    df = rows("doc_id bigint, rater string, reading_level int", (1, "a", 2), (1, "a", 2), (1, "b", 5), (2, "a", None), (3, "a", 7))
    assert {r["doc_id"]: r["level"] for r in ratings(df).collect()} == {1: 3.5}
