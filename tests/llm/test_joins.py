"""Joins beyond the broadcast: by bitmap and shuffle, the same rows."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import _common
from ledgerloom.llm.decontaminate import decontaminate
from ledgerloom.llm.exact_dedup import exact_duplicates
from ledgerloom.llm.ngram_join import keep_one
from ledgerloom.llm.repeats import repeated_passages


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti", "left"])
def test_all_ways_agree(spark, monkeypatch, how):
    big = spark.range(500).select((F.col("id") % 90).alias("k"), F.col("id").alias("v")).union(spark.createDataFrame([(None, 1)], "k long, v long"))
    small = spark.range(0, 200, 3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    hashes = (F.xxhash64("k"), F.xxhash64("k"))
    want = sorted(map(tuple, _common.sized_join(big, small, ["k"], how, 8).collect()), key=repr)
    monkeypatch.setattr(_common, "BROADCAST_BYTES", -1)
    for h in (None, hashes):
        for bits in (1 << 16, 8):
            monkeypatch.setattr(_common, "_bits", lambda n, bits=bits: bits)
            assert sorted(map(tuple, _common.sized_join(big, small, ["k"], how, 8, h).collect()), key=repr) == want


def test_operators_beyond_the_broadcast(spark, docs, monkeypatch):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [(1, long), (2, long), (2, long), (3, long + " more"), (None, "q r s t u v"), (4, None), (5, ""), (6, "own words only"), (None, "q r s t u v")]
    items = spark.createDataFrame([(1, "q r s t u v")], "item_id long, text string")
    runs = [lambda: exact_duplicates(docs(rows)), lambda: keep_one(docs(rows)), lambda: decontaminate(docs(rows), items), lambda: repeated_passages(docs(rows))]
    want = [sorted(map(repr, f().collect())) for f in runs]
    monkeypatch.setattr(_common, "BROADCAST_BYTES", -1)
    assert [sorted(map(repr, f().collect())) for f in runs] == want
