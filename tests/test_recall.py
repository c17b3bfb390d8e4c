"""Recall ranks all cues of a request where they are scored."""

import math

import numpy as np
import pytest

from mnemospark.operators.cues import ordered
from mnemospark.plans import experience as E


@pytest.mark.parametrize("name", ["recall_filtered", "recall_cues", "recall_scopes", "recall_signals"])
def test_no_cue_is_shuffled_or_sorted_by_spark(spark, name):
    plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above, found, _ = plan.partition("MapInArrow")
    assert found and not any(x in above for x in ("Exchange", "Window", "Join", "Sort"))


def test_order_is_by_score_to_9_decimals_then_position():
    score = np.array([0.5, 0.25, 0.5000000001, math.nan, 0.7, math.nan, -1.0, 0.0])
    null = np.array([False, False, False, False, False, True, False, False])
    assert ordered(score, null).tolist() == [3, 4, 0, 2, 1, 7, 6, 5]
    assert ordered(score[:3]).tolist() == [0, 2, 1] and ordered(score[:0]).tolist() == []
    assert ordered(np.array([1e12, 2e12, 1e12])).tolist() == [1, 0, 2]


def test_recall_diverse_stores_only_what_the_walk_picks(spark, monkeypatch):
    from mnemospark.operators import recall as Q

    written, stored = [], Q.stored
    monkeypatch.setattr(Q, "stored", lambda df: written.append(df.columns) or stored(df))
    assert E.recall_diverse(spark, "/root/testdata/sf0.001").count() > 0
    assert written and all("pick" in c for c in written if "signals" in c)
