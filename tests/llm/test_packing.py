import collections
import random

import numpy as np
import pytest

from ledgerloom.llm import queries
from ledgerloom.llm.packing import WEIGHTS, Capacity, best_fit, pack_documents


def slow_fit(tokens, cap, rule):
    full = (cap.tokens, cap.documents, cap.attention)
    bins, out = [], []
    for n in tokens:
        d = (n, 1, n * n)
        best = None
        for i, left in enumerate(bins):
            if all(a >= b for a, b in zip(left, d)):
                if rule == "dot":
                    s = -sum(w * x / f * y / f for w, x, y, f in zip(WEIGHTS, d, left, full))
                else:
                    s = sum(w * ((y - x) / f) ** 2 for w, x, y, f in zip(WEIGHTS, d, left, full))
                if best is None or s < best[0] - 1e-12:
                    best = (s, i)
        if best is None:
            bins.append(list(full))
            best = (0, len(bins) - 1)
        bins[best[1]] = [a - b for a, b in zip(bins[best[1]], d)]
        out.append(best[1])
    return out


def test_best_fit_matches_slow_version():
    rng = random.Random(9)
    cap = Capacity(100, 4, 4000)
    for rule in ("norm", "dot"):
        tokens = sorted((rng.randint(1, 60) for _ in range(150)), reverse=True)
        assert best_fit(np.array(tokens), cap, rule).tolist() == slow_fit(tokens, cap, rule)


def brute(rows, cap, rule):
    """The bins as sets of (id, piece) by the slow version over all items."""
    items = []
    for i, t in rows:
        n = sum(any(c.isalnum() for c in w) for w in (t or "").split())
        items += [(min(cap.longest, n - at), i, at // cap.longest) for at in range(0, n, cap.longest)]
    items.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))
    bins = collections.defaultdict(list)
    for item, b in zip(items, slow_fit([n for n, *_ in items], cap, rule)):
        bins[b].append(item[1:])
    return sorted(sorted(b, key=repr) for b in bins.values())


def bins_of(df):
    bins = collections.defaultdict(list)
    for r in df.collect():
        bins[r["bin"]].append((r["doc_id"], r["piece"]))
    return sorted(sorted(b, key=repr) for b in bins.values())


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_matches_brute_force(docs, rule):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(1, 70))) for i in range(150)] + [(500, "w " * 700), (501, None), (502, ""), (503, "..."), (504, "a b")]
    assert bins_of(pack_documents(docs(rows), Capacity(64, 5, 3000), rule=rule)) == brute(rows, Capacity(64, 5, 3000), rule)


def test_query_matches_brute_force(spark, tmp_path):
    """The registered query with its own parameters: long texts in pieces,
    short ones that fill bins up to the number of documents."""
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice((2, 40, 700, 2000, 9000)))) for i in range(90)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert bins_of(queries.op7_packing(spark, str(tmp_path))) == brute(rows, Capacity(), "norm")


def test_groups_share_their_part_filled_bins(docs):
    """Items of many groups take no more bins than those of one: the bins that
    each group leaves part-filled are packed together."""
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 30)) for i in range(600)]
    one, many = (bins_of(pack_documents(docs(rows), Capacity(128, 40, 10**6), group_items=n)) for n in (1000, 100))
    assert sorted(x for b in many for x in b) == sorted(x for b in one for x in b)
    assert len(many) <= len(one) + 1


@pytest.mark.parametrize("group_items", [50, 7])
def test_every_token_once_under_every_constraint(docs, group_items):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 90))) for i in range(120)] + [(500, "w " * 1000), (None, "a b"), (7, "same"), (7, "same"), (8, None), (9, ""), (10, "  ...  ")]
    cap = Capacity(64, 5, 3000)
    got = pack_documents(docs(rows), cap, group_items=group_items).collect()
    bins, docs_ = collections.defaultdict(list), collections.Counter()
    for r in got:
        bins[r["bin"]].append(r)
        docs_[r["doc_id"]] += r["tokens"]
        assert r["start"] == r["piece"] * cap.longest
    want = collections.Counter()
    for i, t in rows:
        n = sum(any(c.isalnum() for c in w) for w in (t or "").split())
        if n:
            want[i] += n
    assert docs_ == want
    for items in bins.values():
        n = [r["tokens"] for r in items]
        assert sum(n) <= cap.tokens and len(n) <= cap.documents and sum(x * x for x in n) <= cap.attention
        assert sorted(r["slot"] for r in items) == list(range(len(n)))


def test_empty(docs):
    assert pack_documents(docs([])).collect() == []
