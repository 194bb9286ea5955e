import random

from ledgerloom.llm.sharding import shard_documents


def smallest(sizes, k):
    """Least capacity by dynamic programming over cuts."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(k):
        best = [0] + [min(max(best[j], sum(sizes[j:i])) for j in range(i)) for i in range(1, len(sizes) + 1)]
    return best[-1]


def check(docs, rows, k, block):
    got = {}
    out = shard_documents(docs(rows), k, block=block).collect()
    assert len(out) == len(rows)
    for r in out:
        assert got.setdefault(r["doc_id"], r["shard"]) == r["shard"]  # atomic
    sizes = {}
    for i, t in rows:
        sizes[i] = sizes.get(i, 0) + len((t or "").encode())
    order = sorted(sizes, key=lambda i: (i is None, i or 0))
    shards = [got[i] for i in order]
    assert shards == sorted(shards) and (not shards or max(shards) < k)
    load = {}
    for i in order:
        load[got[i]] = load.get(got[i], 0) + sizes[i]
    assert max(load.values(), default=0) == smallest([sizes[i] for i in order], k)


def test_matches_dynamic_programme(docs):
    rng = random.Random(3)
    for block, k in ((4, 3), (1 << 16, 5), (3, 1), (5, 60)):
        rows = [(rng.randrange(40), "é" * rng.randrange(9)) for _ in range(60)]
        rows += [(None, "null"), (None, "xx"), (41, ""), (42, None), (43, "w" * 30)]
        check(docs, rows, k, block)


def test_degenerate(docs):
    assert shard_documents(docs([]), 4).collect() == []
    check(docs, [(1, ""), (2, None), (3, "")], 2, 2)
    check(docs, [(None, "abc")], 3, 2)
    check(docs, [(1, "x" * 100_000), (2, "y")], 2, 1)
