import numpy as np

import corpus_pipeline
from ledgerloom.llm import _common, queries
from ledgerloom.llm.line_dedup import Cuckoo, LineIndex, dedup_lines


def brute(rows, seen=()):
    """Texts in id order; rows equal in id and text are one document."""
    seen, out = set(seen), {}
    for i, t in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        left, had = [], False
        for line in t.split("\n"):
            if not line.strip():
                left.append(line)
                continue
            had = True
            if line not in seen:
                seen.add(line)
                left.append(line)
        text = "\n".join(left)
        out[i, t] = "" if had and not text.strip() else text
    return sorted(((i, None if t is None else out[i, t]) for i, t in rows), key=repr)


def run(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


ROWS = [(1, "a\nb\n\nc"), (2, "b\nd\n \nd"), (3, "a\nb"), (4, None), (5, ""), (6, "\n\n"), (7, "a "), (None, "d\nz"), (8, "z\n" + "long " * 50_000), (8, "z\n" + "long " * 50_000), (9, "\n".join(f"line {i % 7}" for i in range(5000)))]


def test_matches_brute_force(docs):
    df = docs(ROWS)
    got = dedup_lines(df)
    assert got.columns == df.columns
    assert run(got) == brute(ROWS)


def test_emptied_rows_go_and_extra_columns_stay(docs):
    rows = [(1, "a\nb"), (2, "b\n\na"), (3, ""), (4, None), (5, "\n"), (6, "b\nc")]
    df = docs(rows)
    got = dedup_lines(df, drop_emptied=True)
    assert run(got) == sorted([(1, "a\nb"), (3, ""), (4, None), (5, "\n"), (6, "c")], key=repr)
    kept = {r[0]: tuple(r)[2:] for r in df.collect()}
    assert all(tuple(r)[2:] == kept[r[0]] for r in got.collect())


def test_drops_beyond_the_broadcast(docs, monkeypatch):
    monkeypatch.setattr(_common, "BROADCAST_BYTES", -1)
    assert run(dedup_lines(docs(ROWS))) == brute(ROWS)


def test_empty(docs):
    assert run(dedup_lines(docs([]))) == []


def test_insert_and_delete_are_reversible(spark, docs):
    first, second = [(1, "a\nb"), (2, "b\nc")], [(3, "a\nc\nnew")]
    index = LineIndex.create(spark)
    _, one = index.insert(docs(first))
    assert {r["n"] for r in one.counts().collect()} == {1, 2}
    cleaned, two = one.insert(docs(second))
    assert run(cleaned) == [(3, "new")]
    # deleting what was put in second gives the counts from before
    back = two.delete(docs(second))
    key = lambda i: sorted(map(tuple, i.counts().collect()))
    assert key(back) == key(one)
    assert run(back.insert(docs(second))[0]) == [(3, "new")]
    # without the first documents their lines are new again
    empty = back.delete(docs(first))
    assert empty.counts().count() == 0
    assert run(empty.insert(docs(second))[0]) == [(3, "a\nc\nnew")]
    # what isn't there takes nothing away
    assert empty.delete(docs(first)).counts().count() == 0
    others = [(9, "a\nb"), (1, "b\na"), (None, "a\nb"), (1, None), (1, "")]
    same = two.delete(docs(others)).delete(docs([]))
    assert key(same) == key(two) and sorted(map(tuple, same.documents().collect())) == sorted(map(tuple, two.documents().collect()))
    # repeated rows are one document, null ids too
    _, three = two.insert(docs([(None, "a\nq"), (None, "a\nq")]))
    assert key(three.delete(docs([(None, "a\nq"), (None, "a\nq"), (4, "a\nq")]))) == key(two)


def test_filter_agrees_with_counts_after_growth(spark, docs):
    index = LineIndex.create(spark)
    _, index = index.insert(docs([(1, "only")]))
    _, index = index.insert(docs([(2, "\n".join(f"line {i}" for i in range(3000)))]))
    assert index.counts().count() == 3001
    cleaned, _ = index.insert(docs([(3, "only\nline 7\nfresh")]))
    assert run(cleaned) == [(3, "fresh")]


def test_cuckoo_filter():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    held = Cuckoo.for_keys(len(keys))
    assert held.add(keys) and held.holds(keys).all()
    other = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    assert held.holds(other).mean() < 0.01
    held.remove(keys[:10_000])
    assert held.holds(keys[10_000:]).all() and held.holds(keys[:10_000]).mean() < 0.01


def test_repeated_rows_in_different_partitions(spark, docs):
    rows = [(1, "a\nb\na"), (2, "b\nc"), (None, "d\nz"), (3, "a\nc\ne")]
    every = [*rows, *rows, (4, "e\nf")]
    # every row has its twin in another partition
    parts = spark.sparkContext.parallelize(docs(every).collect(), 3)
    assert all(len(p) == len(set(p)) for p in parts.glom().collect())
    df = spark.createDataFrame(parts, docs([]).schema)
    cleaned, index = LineIndex.create(spark).insert(df)
    assert run(cleaned) == brute(every)
    # an occurrence counts once, and all of them can be taken back
    assert sorted(r["n"] for r in index.counts().collect()) == [1, 1, 1, 2, 2, 2, 3]
    assert index.delete(df).counts().count() == 0
    assert run(dedup_lines(df, drop_emptied=True)) == brute(every)
    left = corpus_pipeline._lines(spark, df.withColumn("n_chars", df["n"]), "")
    assert run(left) == brute(every)


def test_query_asks_and_deletes(spark, docs, tmp_path, monkeypatch):
    asked = []
    held = LineIndex._held

    def spy(self, keys):
        out = held(self, keys)
        asked.append((len(self.changes), keys.count(), out.count()))
        return out

    monkeypatch.setattr(LineIndex, "_held", spy)
    for name, rows in (("rows", ROWS), ("none", []), ("null", [(None, "a\nb"), (None, "a\nb"), (None, None)])):
        asked.clear()
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = run(queries.op3_line_dedup(spark, f"{tmp_path}/{name}"))
        assert got == brute(rows)
        # the later rows are asked for, deleted and asked for again
        assert [n for n, *_ in asked] == [1, 2, 3]
        assert asked[0][1:] == asked[2][1:] and asked[1][1] == asked[1][2] == asked[0][1]
    assert len(got) == 3
