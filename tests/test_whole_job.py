"""Queries over small tables of their own that hold what a cut would lose."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import experience as X
from mnemospark.plans import belief as B
from mnemospark.plans import graph as G
from mnemospark.plans import text as T

DOCUMENTS = "doc_id long, text string, created_at timestamp"


def stored(tmp_path, **tables):
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_diversify_topk_reaches_distinct_documents_behind_many_copies(spark, rows, tmp_path):
    copies = [(i, "alpha beta gamma delta", None) for i in range(1, 61)]
    far = [(70 + i, " ".join(["alpha", *[f"only{i}x{k}" for k in range(9)]]), None) for i in range(7)]
    d = stored(tmp_path, documents=rows(DOCUMENTS, (100, "alpha beta gamma delta", None), *copies, *far))
    got = {r["doc_id"]: (r["rk"], r["pick"]) for r in T.diversify_topk(spark, d).collect()}
    assert got == {1: (1, 1), **{70 + i: (62 + i, 2 + i) for i in range(7)}}


def fnv1a(term):
    h = 0x811C9DC5
    units = term.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * 0x01000193) & 0xFFFFFFFF
    return h


def test_hashes_and_embedding_hold_terms_of_every_script(spark, rows, tmp_path):
    d = stored(tmp_path, documents=rows(DOCUMENTS, (1, "快照 é plain", None), (2, "共享", None), (3, "\U00020000 \U0001d5d4", None)))
    got = {r["term"]: r["hash"] for r in T.fnv_hashes(spark, d).collect()}
    # "快照" is a word and a bigram
    assert got == {t: fnv1a(t) for t in ("快照", "é", "plain", "共享", "\U00020000", "\U0001d5d4")}
    cells = {}
    for r in T.hash_embedding(spark, d).collect():
        cells.setdefault(r["doc_id"], {})[r["bucket"]] = r["value"]
    signed = lambda t, x: {fnv1a(t) % 512: round(-x if fnv1a(t) >> 31 else x, 6)}
    assert cells[2] == signed("共享", 1.0)
    twice, norm = 1 + math.log(2), math.sqrt((1 + math.log(2)) ** 2 + 2)
    assert cells[1] == {**signed("快照", twice / norm), **signed("é", 1 / norm), **signed("plain", 1 / norm)}
    assert len(cells[3]) == 2


def test_rrf_fusion_ranks_recency_among_all_matches(spark, rows, tmp_path):
    # equal texts rank by id; 11 is the latest of the first fifty, but 51 to 400 are later still
    day = lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=500 if i == 11 else 1000 + i if i > 50 else i)
    d = stored(tmp_path, documents=rows(DOCUMENTS, *[(i, "alpha beta", day(i)) for i in range(1, 401)]))
    got = [r["doc_id"] for r in T.rrf_fusion(spark, d).where("query_id = 100").orderBy("rk").collect()]
    recent = sorted(range(1, 401), key=day, reverse=True)
    score = {i: round(1 / (60 + i) + 0.25 / (61 + recent.index(i)), 9) for i in recent}
    assert got == sorted(score, key=lambda i: (-score[i], i))[:10] == list(range(1, 11))


@pytest.mark.parametrize("query", [B.similar_node_merge, B.assert_upsert])
def test_first_versions_may_start_above_one(spark, tmp_path, query):
    nodes = spark.read.parquet("/root/testdata/sf0.001/memory_nodes.parquet")
    ids = nodes.where("op = 'put' AND version = 1").select("id").distinct()
    nodes = nodes.join(ids, "id", "left_semi")
    one, three = (stored(tmp_path / str(k), memory_nodes=nodes.withColumn("version", F.col("version") + F.lit(k))) for k in (0, 2))
    expected = sorted(map(str, query(spark, one).collect()))
    assert expected
    assert sorted(map(str, query(spark, three).collect())) == expected


def test_skill_search_skips_restatements_and_walks_on(spark, rows):
    schema = "id string, confidence double, kind string, required_tools array<string>, title string, description string, applicability array<string>, tags array<string>, procedure_steps array<string>"
    skill = lambda i, text, kind="procedure", tools=(): (i, 0.9, kind, list(tools), text, None, [], [], [])
    same = "alpha one two three four five six"
    skills = rows(schema, skill("a", same), skill("b", same), skill("c", same, "caution"), skill("d", same, tools=["shell"]), skill("e", same + " seven"), skill("f", "alpha " + " ".join(f"other{i}" for i in range(12))))
    got = X.skill_search(rows("query_id long, terms array<string>", (1, ["alpha", "one"])), skills, 4).orderBy("rk").collect()
    # b and e (7 of 8 terms) restate a
    assert [(r["id"], r["rk"]) for r in got] == [("a", 1), ("c", 2), ("d", 3), ("f", 4)]
    assert [r["score"] for r in got] == pytest.approx([0.9 / 61, 0.9 / 63, 0.9 / 64, 0.9 / 66])


def test_cooccur_edges_know_actions_used_three_times(spark, rows, tmp_path):
    at = lambda day, hour: datetime.datetime(2024, 1, day, hour)
    events = [(3 * day + k, day, at(day, k), kind) for day in (1, 2, 3) for k, kind in enumerate(["open", "read"])]
    d = stored(tmp_path, events=rows("event_id long, user_id long, ts timestamp, event_type string", *events))
    got = {(r["from_label"], r["to_label"], r["relation"]) for r in G.cooccur_edges(spark, d).collect()}
    assert got == {("open", "open > read", "part-of"), ("read", "open > read", "part-of"), ("open", "read", "co-occurs")}


@pytest.mark.parametrize("some", [1, 2, 500])
def test_skill_search_ends_with_the_hits_of_the_walk_over_all(rows, some):
    from mnemospark.operators import ranking as R

    rng = random.Random(4)
    given = [(f"s{i:02}", "t", " ".join(rng.choice("abcdefgh") for _ in range(4)), rng.choice([None, 0.01, 0.3, 0.9, 0.99]), rng.choice(["x", None])) for i in range(60)]
    skills = rows("id string, title string, description string, confidence double, kind string, required_tools array<string>, applicability array<string>, tags array<string>, procedure_steps array<string>", *[(*x, None, None, None, None) for x in given])
    asked = rows("query_id bigint, terms array<string>", (1, ["a", "b"]), (2, ["c"]), (3, ["nothing"]), (4, ["t"]))
    docs = skills.select(F.col("id").alias("doc_id"), X.tokenize(X.search_text()).alias("terms"))
    sets, by = {r["doc_id"]: set(r["terms"]) for r in docs.collect()}, {x[0]: x for x in given}
    want, pairs = set(), R.bm25(asked, docs).collect()
    for q in {r["query_id"] for r in pairs}:
        ids = [r["doc_id"] for r in sorted((r for r in pairs if r["query_id"] == q), key=lambda r: (-round(r["score"], 9), r["doc_id"]))]
        score = {d: None if by[d][3] is None else by[d][3] / (61 + n) for n, d in enumerate(ids)}
        kept = []
        for d in sorted(ids, key=lambda d: (score[d] is None, -round(score[d] or 0, 9), d)):
            if len(kept) < 3 and all(by[k][4] != by[d][4] or len(sets[d] & sets[k]) / len(sets[d] | sets[k]) < 0.85 for k in kept):
                kept.append(d)
                want.add((q, d, len(kept)))
    assert want and {(r["query_id"], r["id"], r["rk"]) for r in X.skill_search(asked, skills, 3, some).collect()} == want


def test_recall_stores_its_cues_without_their_terms(spark, monkeypatch):
    from mnemospark.operators import recall as Q
    from mnemospark.plans import experience as E

    written, stored = [], Q.stored
    monkeypatch.setattr(Q, "stored", lambda df: written.append(df.columns) or stored(df))
    assert E.recall_diverse(spark, "/root/testdata/sf0.001").count() > 0
    cues = [c for c in written if "signals" in c]
    assert cues and not any("terms" in c for c in cues)
