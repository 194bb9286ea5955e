"""The many-query search against brute force."""

import math
import os
import random

import pytest

from ledgerloom import catalogue
from ledgerloom.operators.vector import topk_each

VECTORS = "namespace string, collection string, id string, embedding array<float>"


def brute(rows, queries, k):
    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / size if size else 0.0

    out = set()
    for q, x in queries:
        best = sorted((-round(cosine(v, x), 9), *key) for *key, v in rows)[:k]
        out |= {(q, *key, round(-s, 6), n) for n, (s, *key) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block_rows", [7, 8192])
def test_topk_each_matches_brute_force(spark, block_rows):
    rng = random.Random(3)
    # small whole numbers: many equal scores, in all blocks
    rows = [("n", f"c{i % 3}", f"v{i:03d}", [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(60)]
    queries = [(i, v) for i, (*_, v) in enumerate(rows[:40])] + [(90, [0.0] * 3)]
    asked = spark.createDataFrame(queries, "query_id long, query array<float>")
    got = topk_each(spark.createDataFrame(rows, VECTORS), asked, 5, block_rows)
    assert {(r["query_id"], r["namespace"], r["collection"], r["id"], round(r["score"], 6), r["rank"]) for r in got.collect()} == brute(rows, queries, 5)
    none = topk_each(spark.createDataFrame([], VECTORS), asked, 5, block_rows)
    assert none.columns == got.columns and none.count() == 0
    with pytest.raises(Exception, match="dimension mismatch"):
        topk_each(spark.createDataFrame([("n", "c", "v", [1.0])], VECTORS), asked, 5, block_rows).collect()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_every_row_is_a_query(spark):
    data = "/root/testdata/sf0.001"
    ids = {r[0] for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id").collect()}
    got = catalogue.QUERIES["vector_topk_every"](spark, data).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == dict.fromkeys(ids, 5)
