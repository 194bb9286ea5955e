import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import ngram_join
from ledgerloom.llm.ngram_join import Sets, boundary, components, jaccard_classes, jaccard_pairs, keep_one, light_limit, needed, overlaps, subset_keys


def grams(text, n):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def corpus(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.choice((2, 4, 6, 9, 14, 40, 200)))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randrange(4)):
            copy = [rng.choice(words) if rng.random() < 0.04 else w for w in base]
            if rng.random() < 0.3:
                copy = copy[: max(1, len(copy) * 3 // 4)]
            rows.append((len(rows), " ".join(copy)))
    hot = [rng.choice(words) for _ in range(60)]
    for _ in range(25):
        k = rng.randrange(60)
        rows.append((len(rows), " ".join(hot[:k] + ["odd", str(rng.random())[2:6]] + hot[k:])))
    shared = " ".join(rng.choice(words) for _ in range(55))
    rows += [(len(rows) + i, shared + " " + " ".join(rng.choice(words) for _ in range(300))) for i in range(6)]
    return rows + [(9001, None), (9002, ""), (9003, "..."), (9004, "One"), (9005, "one!"), (9006, "long " + " ".join(words * 60)), (9007, " ".join(words * 60))]


def brute(rows, n, t):
    """(pairs of classes with their Jaccard, what ``jaccard_classes`` gives)."""
    sets = [(i, grams(text, n)) for i, text in rows]
    sets = [(i, g) for i, g in sets if g]
    lead = {}
    for i, g in sorted(sets, key=lambda x: (x[0] is None, x[0] or 0)):
        lead.setdefault(g, i)
    pairs = set()
    for (g, i), (h, j) in itertools.combinations(lead.items(), 2):
        s = len(g & h) / len(g | h)
        if s >= t:
            pairs.add((min(i, j), max(i, j), round(s, 9)))
    near = [[x for x, (_, h) in enumerate(sets) if x != k and len(g & h) >= t * len(g | h) - 1e-12] for k, (_, g) in enumerate(sets)]
    rows = []
    for k, (i, _) in enumerate(sets):
        seen, todo = {k}, [k]
        while todo:
            for x in near[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        if near[k]:
            rows.append((i, min((sets[x][0] for x in seen if sets[x][0] is not None), default=None), len(near[k])))
    return pairs, sorted(rows, key=repr)


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("OWNER_ENTRIES", 3000), ("BLOCK_SETS", 7), ("PAIR_BUDGET", 500), ("SEND_ENTRIES", 2000)):
        monkeypatch.setattr(ngram_join, name, value)


@pytest.mark.parametrize("n,t,light,common", [(5, 0.4, 10, 12), (3, 0.5, 0, 3), (2, 0.7, 4, 1)])
def test_pairs_and_classes_match_brute_force(docs, monkeypatch, small_blocks, n, t, light, common):
    monkeypatch.setattr(ngram_join, "boundary", lambda *a: light)
    monkeypatch.setattr(ngram_join, "COMMON", common)
    rows = corpus()
    pairs, classes = brute(rows, n, t)
    got = [(r[0], r[1], round(r[2], 9)) for r in jaccard_pairs(docs(rows), n, t).collect()]
    assert len(got) == len(set(got))
    assert set(got) == pairs
    df = jaccard_classes(docs(rows), n, t)
    assert df.columns == ["doc_id", "class_id", "links"]
    assert sorted(map(tuple, df.collect()), key=repr) == classes


def test_candidates_survive_colliding_values(docs, monkeypatch):
    """Grams of few different list values: each still counts."""
    monkeypatch.setattr(ngram_join, "_LOW32", np.uint64(3))
    monkeypatch.setattr(ngram_join, "boundary", lambda *a: 0)
    rows = corpus(6)[:90]
    pairs, _ = brute(rows, 5, 0.4)
    assert {(r[0], r[1], round(r[2], 9)) for r in jaccard_pairs(docs(rows)).collect()} == pairs


def test_equal_ids_of_different_sets_are_told_apart(docs, monkeypatch):
    """64 bits of the fingerprint agree for all sets: the others decide."""
    made = Sets.__init__

    def same(self, *a):
        made(self, *a)
        self.id = np.zeros_like(self.id)

    monkeypatch.setattr(Sets, "__init__", same)
    rows = [(1, "a b c d e f g"), (2, "h i j k l m n"), (3, "a b c d e f g"), (4, "o p q r s t u v")]
    _, classes, _ = ngram_join.similar_sets(docs(rows), 5, 0.4, "doc_id", "text")
    assert sorted(r["n"] for r in classes.collect()) == [1, 1, 2]


def test_overlaps():
    rng = np.random.default_rng(3)
    for count, span in ((2, 30), (9, 40), (60, 90), (60, 5000)):
        sets = [np.unique(rng.integers(0, span, rng.integers(1, 40))).astype(np.uint64) for _ in range(count)]
        want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
        assert (overlaps(sets) == want).all()
        assert (overlaps(sets, 1) == want[:1, 1:]).all() and (overlaps(sets, count - 1) == want[:-1, -1:]).all()


def traced(make):
    tracemalloc.start()
    try:
        return make(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_lists_of_an_owner_take_few_bytes():
    """All entries of an owner meet in one task."""
    rng = np.random.default_rng(8)
    ids, sizes = rng.permutation(40_000).astype(np.int64), np.full(40_000, 50, np.int32)
    tables, want = [], {}
    for k in range(10):
        low = np.concatenate((rng.integers(0, 2_000, 4_000), rng.integers(10_000, 2**32, 36_000))).astype(np.uint32)
        index = rng.integers(4_000 * k, 4_000 * (k + 1), 40_000).astype(np.int32)
        tables += ngram_join._packed(np.zeros(40_000, np.int32), low, index, ids, sizes, 1)
        for value, i in zip(low.tolist(), index.tolist()):
            want.setdefault(value, []).append(int(ids[i]))
    got, peak = traced(lambda: list(ngram_join._gather(1, 4_000_000)((pa.scalar(0),), iter(tables))))
    # of two equal entries of one task each is a list of its own
    assert sum(r.column("n")[0].as_py() for r in got) == sum(sum(n for k in range(max(map(x.count, set(x)))) if (n := sum(x.count(i) > k for i in set(x))) > 1) for x in want.values() if len(x) > 1)
    assert peak < 40 * 400_000


def test_near_copies_are_verified_in_few_bytes(monkeypatch):
    """Of a part of m sets no more than some bytes for each pair."""
    monkeypatch.setattr(ngram_join, "PAIR_BUDGET", 50_000)
    rng = np.random.default_rng(9)
    base, m = np.arange(40, dtype=np.uint64) * 7, 900
    sets = [np.unique(np.where(rng.random(40) < 0.1, rng.integers(0, 2**60, 40).astype(np.uint64), base)) for _ in range(m)]
    every = [pa.array(np.arange(m)), pa.array(np.ones(m, np.int64)), pa.array(np.zeros(m, np.int64)), pa.array(np.arange(m, dtype=np.int32) % 2), pa.array([x.tobytes() for x in sets], pa.binary())]
    rows = pa.RecordBatch.from_arrays(every, names=["node", "n", "component", "piece", "grams"])
    near = np.array([[len(np.intersect1d(a, b)) >= 0.4 * len(np.union1d(a, b)) for b in sets[:60]] for a in sets[:60]])
    for large, keep in ((False, np.ones((m, m), bool)), (True, np.arange(m)[:, None] % 2 != np.arange(m) % 2)):
        key = tuple(map(pa.scalar, (large, 0, 0, 1 if large else 0)))
        got, peak = traced(lambda: list(ngram_join._verify(0.4, True)(key, iter([rows]))))
        pairs = {(a, b) for r in got for a, b in zip(r.column("a").to_pylist(), r.column("b").to_pylist()) if b < 60}
        assert pairs == {(a, b) for a in range(60) for b in range(a + 1, 60) if near[a, b] and keep[a, b]}
        got, peak = traced(lambda: list(ngram_join._verify(0.4, False)(key, iter([rows]))))
        assert sum(len(r) for r in got) == m
        assert peak < 20 * m * m


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3), few).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert sorted(map(tuple, got)) == sorted((x, r) for x, r in root.items() if x in linked)


def test_case_of_all_scripts(docs):
    rows = [(1, "Жили были старик со старухой у самого синего моря"), (2, "ЖИЛИ БЫЛИ СТАРИК СО СТАРУХОЙ У САМОГО СИНЕГО МОРЯ"), (3, "ΑΒΓ ΔΕΖ ΗΘΙ ΚΛΜ ΝΞΟ ΠΡΤ"), (4, "αβγ δεζ ηθι κλμ νξο πρτ"), (5, "ŁÓDŹ ŻÓŁĆ ČESKÝ ÉCOLE ÄRGER")]
    assert sorted(map(tuple, jaccard_classes(docs(rows)).collect())) == [(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 3, 1)]


def test_keep_one_of_each_group(docs, small_blocks):
    rows = corpus(8)
    _, classes = brute(rows, 5, 0.4)
    gone = {i for i, least, _ in classes if i != least}
    df = docs(rows)
    got = keep_one(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i, _ in rows if i not in gone)


def test_nulls_repeats_and_empty(docs):
    rows = [(None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, None), (4, None), (5, ""), (5, ""), (None, "x y z"), (None, "x y z")]
    got = sorted(map(tuple, jaccard_classes(docs(rows)).collect()), key=repr)
    assert got == sorted([(3, 3, 2), (3, 3, 2), (None, 3, 2), (None, None, 1), (None, None, 1)], key=repr)
    assert jaccard_pairs(docs(rows)).collect() == []
    kept = sorted(((r["doc_id"], r["text"]) for r in keep_one(docs(rows)).collect()), key=repr)
    assert kept == sorted([(3, "a b c d e f g"), (4, None), (4, None), (5, ""), (5, ""), (None, "x y z")], key=repr)
    assert jaccard_pairs(docs([])).collect() == jaccard_classes(docs([])).collect() == []
    assert keep_one(docs([])).collect() == []


def test_extra_columns_pass_unchanged(docs):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "one of its own")]
    df = docs(rows)
    assert sorted(keep_one(df).collect()) == sorted({r for r in df.collect() if r[0] != 2})


def test_boundary_follows_cost():
    assert boundary({3: 10, 8: 10}, {3: 1e9, 8: 1e9}, 0.4) >= 8
    assert boundary({3: 10, 8: 10}, {3: 0.0, 8: 0.0}, 0.4) < 3
    assert subset_keys(3, 10, 0.4)[3, 3] == needed(3, 3, 0.4) == 2


def test_limit_of_light_sets_follows_the_table():
    assert light_limit(10, 0.4) < light_limit(10_000, 0.4) < light_limit(10**9, 0.4) < 40
