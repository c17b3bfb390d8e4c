"""The subpackage's queries on the smallest tables: those with SQL against it, the others against brute force or a rule."""

import pandas as pd
import pytest

import verify
from mnemospark.llm import catalog
from mnemospark.llm.words import words_of

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_runs(spark, name):
    assert not verify.compare(spark, DIR, name).startswith("FAIL")


def test_found_queries_have_the_given_columns(spark):
    columns = {"p1_found": ["id_a", "id_b"], "p2_found": ["source_table", "source_id", "pii_type", "start_pos"], "p3_found": ["id_a", "id_b"], "p4_found": ["session_id", "turn_no", "message_id"], "p6_ids": ["doc_id", "ids"]}
    for name, wanted in columns.items():
        assert catalog.queries()[name](spark, DIR).columns == wanted


def _pairs(sets, wanted, threshold):
    out = set()
    for n, (i, a, x) in enumerate(sets):
        for j, b, y in sets[n + 1 :]:
            if a and wanted(x, y) and len(a & b) >= threshold * len(a | b):
                out.add(tuple(sorted((i, j))))
    return out


def test_p1_against_brute_force(spark):
    cases = pd.read_parquet(f"{DIR}/evaluation_cases.parquet").drop_duplicates("id")
    banks = pd.read_parquet(f"{DIR}/experience_banks.parquet")
    linked = {(b.training_dataset_fingerprint, b.held_out_dataset_fingerprint) for b in banks.itertuples()}
    sets = [(c.id, set(words_of(f"{c.question or ''} {c.reference or ''}")), c.dataset_fingerprint) for c in cases.itertuples()]
    got = {tuple(r) for r in catalog.queries()["p1_found"](spark, DIR).collect()}
    assert got == _pairs(sets, lambda x, y: x is not None and y is not None and ((x, y) in linked or (y, x) in linked), 0.7)


def test_p3_against_brute_force(spark):
    skills = pd.read_parquet(f"{DIR}/experience_skills.parquet").drop_duplicates("id")
    join = lambda v: " ".join(x for x in v if x) if v is not None else ""
    sets = [(s.id, set(words_of(" ".join([s.title or "", s.description or "", join(s.procedure_steps), join(s.verification)]))), None) for s in skills.itertuples()]
    got = {tuple(r) for r in catalog.queries()["p3_found"](spark, DIR).collect()}
    assert got == _pairs(sets, lambda x, y: True, 0.75)
