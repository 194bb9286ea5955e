import collections
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import exact_dedup
from ledgerloom.llm.exact_dedup import exact_duplicates, golomb_decode, golomb_encode, rice_parameter


def brute(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        if t is not None:
            groups[t].append(i)
    out = []
    for ids in groups.values():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], n) for n, i in enumerate(ids) if n]
    return sorted(out, key=repr)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**40 - 1), max_size=200))
def test_golomb_round_trip(values):
    v = np.sort(np.array(values, np.int64))
    k = rice_parameter(len(v), 1 << 40)
    assert (golomb_decode(golomb_encode(v, k), len(v), k) == v).all()


def test_matches_brute_force_on_awkward_rows(docs):
    rows = [(1, "a"), (2, "a"), (2, "a"), (None, "a"), (3, ""), (4, ""), (5, None), (6, None), (7, "A"), (8, "x" * 300_000), (9, "x" * 300_000), (9, "y")]
    for bits in (48, 8):  # 8 bits: false suspects, never false results
        got = sorted(map(tuple, exact_duplicates(docs(rows), bits=bits).collect()), key=repr)
        assert got == brute(rows)


def test_empty(docs):
    assert exact_duplicates(docs([])).collect() == []


def test_a_class_over_many_ranges(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RANGE_ROWS", 7)
    rng = random.Random(3)
    rows = [(rng.randrange(60), "hot") for _ in range(80)] + [(None, "hot"), (None, "hot")] + [(i, f"text {i % 9}") for i in range(30)] + [(99, "alone")]
    got = sorted(map(tuple, exact_duplicates(docs(rows)).collect()), key=repr)
    assert got == brute(rows)
    # texts of one fingerprint are told apart
    assert sorted(map(tuple, exact_duplicates(docs(rows), bits=1).collect()), key=repr) == brute(rows)
