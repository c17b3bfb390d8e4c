import pytest
from pyspark.sql import functions as F

from mnemospark.llm.mixing import mix_sources, mixing_plan, mixture_shares, sized_documents

SIZED = "doc_id bigint, source string, n_tokens bigint, sample_key double, key_range string, epochs string"
TARGET = "source string, target_share double, max_repeats int, documents string"


def sized(rows, **sources):
    data, n = [], 0
    for s, (count, tokens) in sources.items():
        for _ in range(count):
            n += 1
            data.append((n, s, tokens + n % 3, (n * 7919 % 1000 + 1) / 500, "c", "c"))
    return rows(SIZED, *data)


def test_shares_and_repeats(rows):
    s = sized(rows, big=(600, 10), small=(20, 10), none=(5, 10))
    targets = rows(TARGET, ("big", 0.7, 1, "c"), (" Small", 0.3, 4, "c"), ("absent", 0.0, 2, "c"))
    mixture = mix_sources(s, targets)
    shares = {r["source"]: r for r in mixture_shares(mixture, mixing_plan(s, targets)).collect()}
    assert shares["small"]["most_repeats"] == 4 and shares["small"]["epochs"] == 4
    assert shares["big"]["actual_share"] == pytest.approx(0.7, abs=0.01)
    assert shares["absent"]["mixed_tokens"] == 0
    assert mixture.where("source = 'none'").count() == 0
    assert mixture.groupBy("doc_id").count().where("count > 1").count() == 0


def test_the_least_keys_come_first_whatever_the_range(rows):
    s = sized(rows, a=(500, 3))
    targets = rows(TARGET, ("a", 1.0, 2, "c"))
    total = s.agg(F.sum("n_tokens")).first()[0]
    for budget in (0, 1, 7, total // 3, total, total + total // 2, 2 * total):
        got = {r["doc_id"]: r["repeats"] for r in mix_sources(s, targets, budget).collect()}
        left, want = budget % total if budget < 2 * total else 0, {}
        for r in s.orderBy("sample_key", "doc_id").collect():
            left -= r["n_tokens"]
            n = budget // total + (left >= 0 and budget < 2 * total)
            if left < 0:
                left = -(10**9)
            if n:
                want[r["doc_id"]] = n
        assert got == want


def test_weights_draw_more_of_the_better(spark, rows):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("clean words only here")).otherwise(F.lit("## || ** && words")).alias("text"), F.lit("A-b").alias("source"))
    s = sized_documents(docs)
    assert s.select("source").distinct().first()[0] == "a_b"
    half = s.agg(F.sum("n_tokens")).first()[0] // 2
    got = mix_sources(s, rows(TARGET, ("a_b", 1.0, 1, "c")), half)
    clean = got.where("doc_id % 2 = 0").count()
    assert clean > 1.3 * (got.count() - clean)


def test_edges(rows):
    docs = rows("doc_id bigint, text string, source string, weight string, n_tokens string", (1, None, "a", "c", "c"), (2, "", "a", "c", "c"), (3, "x", None, "c", "c"), (4, "y " * 100_000, "a", "c", "c"))
    s = sized_documents(docs)
    assert [r["doc_id"] for r in s.collect()] == [4]
    targets = rows(TARGET, ("a", 1.0, None, "c"), ("a", 1.0, None, "c"), (None, 0.5, 1, "c"))
    assert [(r["doc_id"], r["repeats"]) for r in mix_sources(s, targets).collect()] == [(4, 1)]
    assert mix_sources(s.limit(0), targets).count() == 0
    assert mix_sources(s, targets.limit(0)).count() == 0
    assert mixture_shares(mix_sources(s.limit(0), targets), mixing_plan(s.limit(0), targets)).first()["actual_share"] is None
