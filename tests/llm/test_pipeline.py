"""The pipeline's stages on a small corpus, each against what it must keep."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(21)
    good = [f"lemma{i}" for i in range(600)]
    line = lambda n: " ".join(rng.choice(good) for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(160):
        junk = i % 4 == 0
        rows.append((i, " ".join(rng.choice(["$$$", "CLICK", "zzz"]) for _ in range(60)) + f" {i}" if junk else "\n".join(line(12) for _ in range(5))))
        labels.append((i, 0 if junk else 1, 0))
    item = line(20)
    one = line(200)
    near = one.split()
    near[50] = near[120] = "edited"
    rows += [(200, rows[1][1]), (201, one), (202, " ".join(near)), (203, line(30) + "\n" + item + "\n" + line(30)), (204, rows[2][1].split("\n")[0] + "\n" + line(40)), (205, line(5000)), (206, line(9)), (206, None)]
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{sf}/{name}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
    return dict(rows), seen, sf


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").distinct().collect()}


def test_stages(spark, made):
    rows, (quality, lines, near, clean, packed), sf = made
    for df in (quality, lines, near, clean):
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {i for i in rows if i < 160 and i % 4} <= ids(quality)
    assert not {i for i in rows if i < 160 and not i % 4} & ids(quality)
    # a copy has no line of its own; a shared line stays with the first
    assert ids(quality) - ids(lines) == {200}
    assert "\n" not in lines.where("doc_id = 204").first()["text"]
    assert lines.where("n_chars <> length(text)").count() == 0
    assert ids(lines) - ids(near) == {202}
    assert ids(near) - ids(clean) == {203}
    words = {r["doc_id"]: r["n"] for r in clean.selectExpr("doc_id", "size(split(trim(text), '\\\\s+')) AS n").where("text IS NOT NULL").collect()}
    got = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "n").collect()}
    assert got == words


def test_run_gives_the_same(spark, made):
    _, seen, sf = made
    key = lambda df: sorted(map(str, df.select("doc_id", "piece", "tokens").collect()))
    assert key(corpus_pipeline.run(spark, sf)) == key(seen[-1])


EXTRA = ["__had", "__key", "__gone", "a.b", "row", "c1"]


def awkward(spark, rows):
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[f"{c} of {i}" for c in EXTRA]) for i, t in rows], kind)


def tables(spark, path, labels, items):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


@pytest.mark.parametrize("labelled", [True, False])
def test_stages_on_awkward_rows(spark, tmp_path, labelled):
    """Repeated rows, nulls, clashing names, with and without labels: columns
    and extra values pass, and each stage keeps what it must."""
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, body(1)), (1, body(1)), (2, body(1)), (None, body(2)), (3, None), (4, ""), (5, "\n \n"), (6, "line one\nline two"), (7, "line two\nline one"), (8, "the item words here")]
    tables(spark, tmp_path, [(1, 1, 0), (6, 1, 0), (None, 1, 0)] if labelled else [], [(1, "ITEM words")])
    df = awkward(spark, rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    sf, got = str(tmp_path), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns
        found = out.collect()
        assert all(tuple(r)[5:] == tuple(f"{c} of {r[0]}" for c in EXTRA) for r in found)
        got[name] = sorted(((r[0], r[1]) for r in found), key=repr)
    every = sorted(rows, key=repr)
    assert got["quality"] == every  # only good grades, or none
    # 2 and 7 have no line of their own; repeated rows are one document
    assert got["lines"] == [r for r in every if r[0] not in (2, 7)]
    assert got["near-duplicates"] == sorted([r for r in set(rows) if r[0] not in (2,)], key=repr)
    assert got["decontamination"] == [r for r in every if r[0] != 8]
    packed = corpus_pipeline.STAGES[-1][1](spark, df, sf).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in packed} == {1: 2, 2: 1, None: 1, 6: 1, 7: 1, 8: 1}


def test_empty_documents(spark, tmp_path):
    tables(spark, tmp_path, [(1, 0, 0), (2, 1, 0)], [(1, "an item")])
    awkward(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
