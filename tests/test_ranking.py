import math
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import numeric as N
from mnemospark.operators import ranking as R


def corpus(rows):
    return rows("doc_id string, terms array<string>", ("a", ["pnpm", "install", "workspace"]), ("b", ["npm", "install"]), ("c", ["deploy", "release"]), ("d", []))


def test_bm25_puts_the_rarest_term_first(rows):
    asked = rows("query_id int, terms array<string>", (1, ["pnpm", "install"]), (2, []), (3, ["nothing"]))
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in R.bm25(asked, corpus(rows)).collect()}
    assert set(got) == {(1, "a"), (1, "b")}
    n, avg = 4, 7 / 4
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    w = lambda dl: 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avg))
    assert got[1, "a"] == pytest.approx((idf(1) + idf(2)) * w(3))
    assert got[1, "b"] == pytest.approx(idf(2) * w(2))


def test_bm25_repeated_query_terms_add_again(rows):
    one = R.bm25(rows("query_id int, terms array<string>", (1, ["npm"])), corpus(rows)).first()["score"]
    two = R.bm25(rows("query_id int, terms array<string>", (1, ["npm", "npm"])), corpus(rows)).first()["score"]
    assert two == pytest.approx(2 * one)


def test_bm25_on_nothing(rows):
    none = rows("doc_id string, terms array<string>")
    assert R.bm25(rows("query_id int, terms array<string>", (1, ["npm"])), none).count() == 0


def test_cosine(spark, rows):
    v = rows("a array<double>, b array<double>", ([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]))
    assert [r[0] for r in v.select(N.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_cosine_neighbours_is_exact(rows):
    data = [(i, [math.cos(i), math.sin(i), i / 50]) for i in range(50)]
    v = rows("vec_id bigint, v array<double>", *data)
    got = R.cosine_neighbours(v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "v"), v, 3).collect()

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    for q in range(0, 50, 10):
        best = sorted(((round(cos(data[q][1], v), 9), -i) for i, v in data if i != q), reverse=True)[:3]
        assert [-i for _, i in best] == [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rk"])]


def test_rrf_drops_lists_without_weight(rows):
    lists = rows("q int, id string, list_no int, rk int, weight double", (1, "a", 0, 1, 1.0), (1, "b", 0, 2, 1.0), (1, "b", 1, 1, 1.0), (1, "c", 2, 1, 0.0))
    got = {r["id"]: r["score"] for r in R.reciprocal_rank_fusion(lists, ["q"], "id").collect()}
    assert got == {"a": pytest.approx(1 / 61), "b": pytest.approx(1 / 62 + 1 / 61)}


def test_interleave_takes_seats_in_turn(rows):
    lists = rows("q int, id string, list_no int, rk int", (1, "a", 0, 1), (1, "b", 0, 2), (1, "c", 0, 3), (1, "b", 1, 1), (1, "d", 1, 2))
    got = R.interleave(lists, ["q"], "id").orderBy("rk").collect()
    assert [r["id"] for r in got] == ["a", "b", "d", "c"]


def test_diversify_skips_restatements(rows):
    cues = rows("q int, id string, rk int, terms array<string>", (1, "1", 1, ["x", "y"]), (1, "2", 2, ["x", "y"]), (1, "3", 3, ["z"]), (1, "4", 4, ["w"]))
    assert [r["id"] for r in R.diversify(cues, ["q"], 2, 0.7).orderBy("pick").collect()] == ["1", "3"]
    assert [r["id"] for r in R.diversify(cues, ["q"], 2, 1.0).orderBy("pick").collect()] == ["1", "2"]


def test_belief_arithmetic(spark):
    row = spark.range(1).select(
        N.decayed(F.lit(0.8), F.lit(100), F.lit(0), 100).alias("half"),
        N.decayed(F.lit(0.8), F.lit(None).cast("bigint"), F.lit(0), 100).alias("never"),
        N.decayed(F.lit(0.8), F.lit(100), F.lit(200), 100).alias("later"),
        N.reinforced(F.lit(0.4), 0.25).alias("up"),
        N.reinforced(F.lit(0.4), 0.25, 2).alias("up2"),
        N.weakened(F.lit(0.4), 0.5).alias("down"),
        N.clamped(F.lit(float("nan"))).alias("nan"),
        N.clamped(F.lit(7.0)).alias("high"),
    ).first()
    assert row.asDict() == {"half": pytest.approx(0.4), "never": 0.8, "later": 0.8, "up": pytest.approx(0.55), "up2": pytest.approx(0.6625), "down": 0.2, "nan": 0.0, "high": 1.0}


def scored(rows, seed=1, n=200):
    """Documents (some alike, some of no words), requests and BM25 of all pairs."""
    rng = random.Random(seed)
    texts = [[rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))] for _ in range(n)]
    docs = rows("doc_id bigint, scope string, at bigint, terms array<string>", *[(i, rng.choice(["x", "y", "z", "w", None]), rng.choice([None, rng.randint(0, 9)]), t + [None] * (i % 9 == 0)) for i, t in enumerate(texts)])
    asked = docs.where("doc_id % 20 = 1").select(F.col("doc_id").alias("query_id"), "terms")
    return asked, docs, [(r["query_id"], r["doc_id"], round(r["score"], 9)) for r in R.bm25(asked, docs).collect()]


def test_bm25_best_groups_are_those_of_all_matches(rows):
    asked, docs, pairs = scored(rows)
    scope = {r["doc_id"]: r["scope"] for r in docs.collect()}
    first = {}
    for q, d, s in sorted(pairs, key=lambda x: (x[0], -x[2], x[1])):
        first.setdefault((q, scope[d]), (-s, d))
    want = {q: sorted((*v, g) for (p, g), v in first.items() if p == q)[:3] for q, _ in first}
    got = {}
    for r in R.bm25(asked, docs, best=3, group="scope").collect():
        got.setdefault((r["query_id"], r["scope"]), []).append((-round(r["score"], 9), r["doc_id"]))
    assert want and {q: sorted((*min(v), g) for (p, g), v in got.items() if p == q)[:3] for q in want} == want


@pytest.mark.parametrize("weight, k", [(0.25, 10), (0.5, 3), (2.0, 3)])
def test_fusion_with_recency_is_that_of_whole_rankings(rows, weight, k):
    asked, docs, pairs = scored(rows)
    at = {r["doc_id"]: r["at"] for r in docs.collect()}
    want = set()
    for q in {p[0] for p in pairs}:
        lexical = [d for _, d, _ in sorted((p for p in pairs if p[0] == q), key=lambda p: (-p[2], p[1]))]
        recent = sorted(lexical, key=lambda d: (at[d] is None, -(at[d] or 0), d))
        fused = sorted((-round(1 / (61 + i) + weight / (61 + recent.index(d)), 9), i, d) for i, d in enumerate(lexical))[:k]
        want |= {(q, d, n + 1) for n, (_, _, d) in enumerate(fused)}
    got = R.fused_with_recency(asked, docs, "at", weight, k)
    assert {(r["query_id"], r["doc_id"], r["rk"]) for r in got.collect()} == want


@pytest.mark.parametrize("some, threshold", [(2, 0.3), (3, 0.6), (500, 0.3), (2, 0.0), (2, 1.0)])
def test_diverse_matches_are_those_of_the_walk_over_all(rows, some, threshold):
    asked, docs, pairs = scored(rows)
    asked = asked.withColumn("terms", F.filter("terms", lambda x: x.isNotNull()))
    docs = docs.withColumn("terms", F.filter("terms", lambda x: x.isNotNull()))
    sets = {r["doc_id"]: set(r["terms"]) for r in docs.collect()}
    pairs = [(r["query_id"], r["doc_id"], round(r["score"], 9)) for r in R.bm25(asked, docs).collect()]
    want = set()
    for q in {p[0] for p in pairs}:
        kept = []
        for rk, (_, d, _) in enumerate(sorted((p for p in pairs if p[0] == q), key=lambda p: (-p[2], p[1])), 1):
            if len(kept) < 5 and (threshold >= 1 or all(len(sets[d] & sets[k]) / len(sets[d] | sets[k]) < threshold for k in kept)):
                kept.append(d)
                want.add((q, d, rk, len(kept)))
    got = R.diverse_matches(asked, docs, 5, threshold, some)
    assert want and {tuple(r) for r in got.select("query_id", "doc_id", "rk", "pick").collect()} == want
