import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import quality, queries
from ledgerloom.llm._tokens import _BYTE_MULT, raw_blocks


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    good = [f"lemma{i}" for i in range(200)]
    rows, grades = [], []
    for i in range(n):
        g = i % 3
        words = [rng.choice(good) for _ in range(40)]
        for k in range(40):
            if rng.random() < (0.9, 0.4, 0.02)[g]:
                words[k] = rng.choice(["$$$", "CLICK", "zzzz", "!!!!"])
        rows.append((i, " ".join(words)))
        grades.append((i, float(g)))
    return rows, grades


def test_expected_grade_on_held_out_rows(spark, docs):
    rows, grades = corpus()
    model = quality.train(docs(rows), spark.createDataFrame(grades[:400], "doc_id long, grade double"))
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 2
    got = {r["doc_id"]: r for r in quality.score(docs(rows), model, 1).collect()}
    held = grades[400:]
    assert np.mean([round(got[i]["expected_grade"]) == g for i, g in held]) >= 0.9
    assert np.mean([(got[i]["tail_probability"] >= 0.5) == (g >= 1) for i, g in held]) >= 0.95
    kept = quality.select_quality(docs(rows), model, 1)
    assert kept.columns == docs(rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["tail_probability"] >= 0.5}


@pytest.mark.parametrize("grades", [[], [(1, 1.0)], [(None, 1.0), (1, None), (1, 0.0), (2, 2.0)]])
def test_degenerate_ratings(spark, docs, grades):
    rows = [(1, "some text"), (2, "other words"), (3, None), (None, ""), (3, "y" * 200_000), (3, "y" * 200_000)]
    model = quality.train(docs(rows), spark.createDataFrame(grades, "doc_id long, grade double"))
    got = quality.score(docs(rows), model, 1).collect()
    assert len(got) == len(rows) and all(0 <= r["tail_probability"] <= 1 for r in got)
    assert quality.score(docs([]), model, 1).collect() == []


def test_grades_of_labels(spark):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, 0), (4, 1, None), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert {r[0]: r[1] for r in quality.grades_of_labels(labels).collect()} == {1: 0, 2: 1, 3: 2, 4: 2, 5: None}


M64 = 2**64 - 1


def plain_mix(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M64
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M64
    return h ^ (h >> 31)


def plain_word(word):
    return plain_mix((sum(int(_BYTE_MULT[k & 4095]) * (b + 1) for k, b in enumerate(word)) + len(word)) & M64)


def plain_fields(text):
    """The three fields of a text as lists of buckets, byte by byte."""
    data = (text or "").encode()
    shape = [48 if 48 <= b < 58 else 65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 128 else b for b in data]
    windows = []
    for k in range(len(shape)):
        if k + 4 > len(shape):
            windows.append(0)
            continue
        h = sum(s * m for s, m in zip(shape[k : k + 4], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))) & 0xFFFFFFFF
        h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
        windows.append(h >> 16)
    words = [plain_word(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+", data.lower())]
    bucket = lambda h, salt: plain_mix((h + (salt * 0x9E3779B97F4A7C15 & M64)) & M64) >> 48
    same = [sum(bit for back, bit in ((1, 1), (2, 2), (3, 4)) if k >= back and words[k - back] == words[k]) for k in range(len(words))]
    return windows, [bucket(h, 1) for h in words], [bucket(h, 2) for h in same]


def plain_tails(text, model):
    score = sum(sum(model.weights[b] for b in f) / len(f) for f in plain_fields(text) if f)
    return [1 / (1 + math.exp(-(score - c))) for c in model.thresholds]


def test_features_match_plain_python():
    texts = ["", "abc", "one Two two two", "x", "Zwei zwei, zwei?", "12 ab 12 AB", "é" * 9, "!!!", "one Two two two"]
    (block,) = raw_blocks(pa.array(texts))
    for text, (index, share) in zip(texts, quality.features(block)):
        want = collections.Counter()
        for f in plain_fields(text):
            for b in f:
                want[b] += 1 / len(f)
        got = collections.Counter()
        for b, v in zip(index.tolist(), share.tolist()):
            got[b] += v
        assert got.keys() == want.keys() and all(abs(got[b] - want[b]) < 1e-9 for b in want)


def test_likelihood_and_gradient():
    rng = np.random.default_rng(4)
    params, score, y, weight = np.array([-0.7, 0.2, -0.4]), rng.normal(size=40), rng.integers(0, 4, 40), rng.uniform(0.5, 2, 40)
    value, by_param, by_score = quality.gradient(params, score, y, weight)
    cuts = [params[0]]
    for g in params[1:]:
        cuts.append(cuts[-1] + math.exp(g))
    edge = lambda s, c: 0.0 if c < 0 else 1.0 if c == len(cuts) else 1 / (1 + math.exp(s - cuts[c]))
    assert abs(value - sum(-w * math.log(edge(s, c) - edge(s, c - 1)) for s, c, w in zip(score, y, weight)) / 40) < 1e-9
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        slope = (quality.gradient(params + step, score, y, weight)[0] - quality.gradient(params - step, score, y, weight)[0]) / 2e-6
        assert abs(slope - by_param[k]) < 1e-6
    for k in range(40):
        step = np.eye(40)[k] * 1e-6
        slope = (quality.gradient(params, score + step, y, weight)[0] - quality.gradient(params, score - step, y, weight)[0]) / 2e-6
        assert abs(slope - by_score[k] / 40) < 1e-6


def test_query_matches_plain_python(spark, tmp_path):
    """The registered query: every text scored byte by byte with the model."""
    rows, grades = corpus(240)
    rows += [(900, None), (901, ""), (902, rows[1][1]), (None, rows[2][1]), (903, "long " * 20_000)]
    flags = [(i, int(g > 0), int(g == 1)) for i, g in grades]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(flags, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    read = lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")
    model = quality.train(read("documents"), quality.grades_of_labels(read("labels")))
    want = {}
    for i, t in rows:
        tails = plain_tails(t, model)
        if tails[0] >= 0.5:
            want[i, len(t or "")] = (sum(tails), tails[0])
    got = queries.op4_quality_classifier(spark, str(tmp_path)).collect()
    size = {i: len(t or "") for i, t in rows}
    assert {(r["doc_id"], size[r["doc_id"]]) for r in got} == set(want)
    for r in got:
        expected, tail = want[r["doc_id"], size[r["doc_id"]]]
        assert abs(r["expected_grade"] - expected) < 1e-9 and abs(r["tail_probability"] - tail) < 1e-9


def test_select_quality_on_awkward_rows(docs):
    model = quality.OrdinalModel(np.zeros(quality.BUCKETS), np.array([0.0]), np.array([0.0, 1.0]))
    rows = [(1, None), (1, ""), (None, "a"), (2, "a"), (2, "a"), (3, "b " * 60_000)]
    df = docs(rows)  # all just reach a probability of 0.5
    assert sorted(quality.select_quality(df, model, 1).collect(), key=repr) == sorted(df.collect(), key=repr)
    assert quality.select_quality(df, model, 1, 0.6).collect() == quality.select_quality(docs([]), model, 1).collect() == []
