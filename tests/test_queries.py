"""Every query of the core against its SQL twin on the smallest tables."""

import pytest

import verify
from mnemospark.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_matches_its_twin(spark, name):
    assert not verify.compare(spark, DIR, name).startswith("FAIL")


def test_every_core_query_has_a_twin():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
