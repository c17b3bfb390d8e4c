import datetime as dt

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from mnemospark.operators.orphans import orphan_references, orphan_report, pack, unpack

REF = "source_table string, source_id string, field_name string, kind string, key string, seen_at timestamp, period string, alive int"
PAR = "kind string, key string, first_at timestamp, alive boolean, period int"
T = lambda day, hour=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


@given(st.sets(st.integers(0, 65535), max_size=300))
def test_bitmaps_round_trip(ids):
    assert set(np.flatnonzero(unpack(pack(np.array(sorted(ids), np.int64))))) == ids


def test_dense_bitmap_round_trip():
    ids = np.arange(0, 65536, 3)
    assert (np.flatnonzero(unpack(pack(ids))) == ids).all()
    assert not unpack(None).any()


def test_reasons(rows):
    refs = rows(
        REF,
        ("e", "1", "src", "node", " N1 ", T(50), "x", 1),  # there, other case and padding
        ("e", "2", "src", "node", "n2", T(50), "x", 1),  # erased
        ("e", "3", "src", "node", "n3", T(50), "x", 1),  # never there
        ("e", "4", "src", "node", "n4", T(50), "x", 1),  # stored a month later
        ("e", "5", "src", "node", "n5", T(50, 1), "x", 1),  # stored an hour before, same period
        ("e", "6", "src", "node", "n5", T(49), "x", 1),  # the day before, same period
        ("e", "7", "src", "node", None, T(50), "x", 1),
        ("e", "8", "src", "node", " \t", T(50), "x", 1),
        ("e", "9", "src", "episode", "n1", T(50), "x", 1),  # another kind
        ("e", "10", "src", "node", "n1", None, "x", 1),  # unknown time: not later
        ("e", "11", "src", "node", "n9", None, "x", 1),
    )
    parents = rows(PAR, ("node", "n1", T(0), True, 1), ("node", "n2", T(0), False, 1), ("node", "n4", T(90), True, 1), ("node", "n5", T(50), True, 1), ("node", None, T(0), True, 1))
    got = {r["source_id"]: r["reason"] for r in orphan_references(refs, parents).collect()}
    assert got == {"2": "erased", "3": "missing", "4": "later", "6": "later", "9": "missing", "11": "missing"}
    report = {(r["period"]): (r["orphans"], r["refs"]) for r in orphan_report(orphan_references(refs, parents), refs).collect()}
    assert report == {"2024-02": (5, 7), None: (1, 2)}


def test_empty_tables(rows):
    refs = rows(REF, ("e", "1", "src", "node", "a", T(1), "x", 1))
    assert [r["reason"] for r in orphan_references(refs, rows(PAR)).collect()] == ["missing"]
    assert orphan_references(rows(REF), rows(PAR, ("node", "a", T(0), True, 1))).count() == 0


def test_a_hot_key_keeps_every_row(rows):
    refs = rows(REF, *[("e", str(i), "src", "node", "gone" if i % 3 else "here", T(i % 60), "x", 1) for i in range(900)])
    got = orphan_references(refs, rows(PAR, ("node", "here", T(-1), True, 1)), ranges=4)
    assert got.count() == 600
