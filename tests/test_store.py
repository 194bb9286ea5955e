import threading

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import knowledge, manifest, sync
from ledgerloom.operators.store import RECORD, Files, NotFound, RecordStore, Rejected
from ledgerloom.operators.vector import HashedIndex, remove, topk, upsert
from ledgerloom.sources.files import file_tree, ignored, migrate, read_json_store


def record(id, body, counter=0, expected=None, collection="topic", kind="topic", parent=None, labels=None, links=()):
    import hashlib

    h = hashlib.sha256(body).hexdigest()
    return ("ns", collection, id, kind, (counter, h), parent, (body, None, None), (("me", None), "test", counter, counter, labels or {}), list(links), expected)


PUTS = RECORD + ", expected struct<counter: bigint, hash: string>"


def puts(spark, *rows):
    return spark.createDataFrame(list(rows), PUTS)


def plain(spark, *rows):
    return spark.createDataFrame([r[:-1] for r in rows], RECORD)


def outcome(df):
    return sorted((r["id"], r["outcome"]) for r in df.collect())


def test_conditional_writes(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path))
    assert store.version() == 0 and store.list().count() == 0
    first = record("a", b"1")
    assert outcome(store.put(puts(spark, first, record("b/..%", b"x")), retain=True)) == [("a", "committed"), ("b/..%", "committed")]
    assert outcome(store.put(puts(spark, record("a", b"2", 1)))) == [("a", "conflict")]
    assert outcome(store.put(puts(spark, record("a", b"2", 1, first[4])))) == [("a", "committed")]
    with pytest.raises(NotFound):
        store.put(puts(spark, record("none", b"2", 1, first[4])))
    assert store.get("ns", "topic", "a").first()["revision"]["counter"] == 1
    assert store.records(1).where("id = 'a'").first()["revision"]["counter"] == 0
    assert store.status().first()["n"] == 2 and store.blobs().count() == 2
    gone = spark.createDataFrame([("ns", "topic", "a", first[4]), ("ns", "topic", "zz", first[4])], "namespace string, collection string, id string, expected struct<counter: bigint, hash: string>")
    assert outcome(store.delete(gone)) == [("a", "conflict"), ("zz", "deleted")]
    assert outcome(store.delete(gone.withColumn("expected", F.lit(None).cast("struct<counter: bigint, hash: string>")))) == [("a", "deleted"), ("zz", "deleted")]
    assert [r["id"] for r in store.list("ns").collect()] == ["b/..%"]
    assert len(store.history()) == store.version()


def test_one_of_many_racers_wins(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path))
    base = record("k", b"0")
    store.put(puts(spark, base))
    won, lock = [], threading.Lock()

    def race(n):
        got = outcome(RecordStore(spark, str(tmp_path)).put(puts(spark, record("k", f"{n}".encode(), 1, base[4]))))
        with lock:
            won.append(got[0][1])

    threads = [threading.Thread(target=race, args=(n,)) for n in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == ["committed"] + ["conflict"] * 5


def test_racers_within_a_batch(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path))
    got = outcome(store.put(puts(spark, *(record("k", f"{n}".encode()) for n in range(24)))))
    assert sorted(o for _, o in got) == ["committed"] + ["conflict"] * 23


def test_sync_by_class(spark):
    a = plain(spark, record("one", b"x\n"), record("log", b"base\na\n", labels={"k": "a", "p": "1"}, links=[("n", "c", "1")]), record("tier", b'{"name":"b","content":"x"}', 1, parent=(0, "p"), collection="memory_tier", kind="memory_tier"), record("op", b"1", collection="checkpoint", kind="checkpoint"), record("man", b"{1}", collection="graph_manifest", kind="graph_manifest"))
    b = plain(spark, record("two", b"y\n"), record("log", b"base\nb\n", 3, labels={"k": "b"}, links=[("n", "c", "1"), ("n", "c", "2")]), record("tier", b'{"name":"a","content":"y"}', 1, parent=(0, "p"), collection="memory_tier", kind="memory_tier"), record("op", b"2", collection="checkpoint", kind="checkpoint"), record("man", b"{2}", collection="graph_manifest", kind="graph_manifest"))
    ancestry = spark.createDataFrame([("p", b'{"name":"a","content":"x"}')], "hash string, content binary")
    done = sync.sync(a, b, ancestry)
    assert {r["id"]: r["action"] for r in done.report.collect()} == {"one": "copied_to_b", "two": "copied_to_a", "log": "merged", "tier": "merged", "op": "conflict", "man": "merged"}
    left, right = ({r["id"]: r for r in side.collect()} for side in (done.a, done.b))
    assert bytes(left["log"]["body"]["inline"]) == b"base\na\nb\n" and left["log"]["revision"]["counter"] == 4
    assert left["log"]["meta"]["labels"] == {"k": "b", "p": "1"} and len(left["log"]["links"]) == 2 and left["log"]["parent"]["counter"] == 3
    assert bytes(right["tier"]["body"]["inline"]) == b'{"content":"y","name":"b"}'
    assert bytes(left["man"]["body"]["inline"]) == b"{1}"
    assert bytes(left["op"]["body"]["inline"]) == b"1" and bytes(right["op"]["body"]["inline"]) == b"2"
    again = {r["id"]: r["action"] for r in sync.sync(done.a, done.b).report.collect()}
    assert again == {"one": "same", "two": "same", "log": "same", "tier": "same", "op": "conflict", "man": "same"}
    assert {r["id"]: r["action"] for r in sync.sync(a, b).report.collect()}["tier"] == "conflict"


def test_three_way_pull(spark):
    tree = lambda **x: spark.createDataFrame([(p, "topic", c.encode()) for p, c in x.items()], "path string, kind string, content binary")
    got = sync.three_way(tree(a="1\n", b="1\n", c="1\n", d="1\n"), tree(a="1\n", b="1\nL\n", c="2\n", d="1\n"), tree(a="9\n", b="1\nR\n", c="1\n", e="new\n"))
    rows = {r["path"]: (r["action"], None if r["content"] is None else bytes(r["content"])) for r in got.collect()}
    assert rows == {"a": ("applied", b"9\n"), "b": ("merged", b"1\nL\nR\n"), "c": ("kept", b"2\n"), "d": ("deleted", None), "e": ("applied", b"new\n")}


def test_manifest_round_trip(spark):
    m = spark.createDataFrame([("r", "v", 'b"x', "2"), ("r", "v", "a", "1")], "repo string, view_id string, path string, hash string")
    body = manifest.to_body(m)
    assert body.first()["body"] == '{"a":"1","b\\"x":"2"}'
    assert sorted(map(tuple, manifest.from_body(body).collect())) == sorted(map(tuple, m.collect()))


def test_knowledge(spark):
    from ledgerloom.functions.vectors import bag_of_words

    rows = [("ns", "s", "spread", "session", '{"name":"n","turns":[{"role":"u","text":"gamma"},{"role":"u","text":"gamma"},{"role":"u","text":"alpha"},{"role":"u","text":"alpha"}]}'), ("ns", "t", "other", "topic", '{"slug":"s","bullets":["gamma alpha beta delta"]}'), ("ns", "m", "tier", "memory_tier", '{"name":"m","content":"p one\\n\\n\\n\\np two"}'), ("ns", "k", "tick", "ticket", '{"title":"T","labels":["x","y"],"body":{"markdown":"para"}}'), ("ns", "c", "cp", "checkpoint", "junk")]
    records = spark.createDataFrame(rows, "namespace string, collection string, id string, kind string, body string")
    chunks = knowledge.chunk(records)
    texts = {(r["id"], r["ordinal"]): r["text"] for r in chunks.collect()}
    assert texts["spread", 0] == "n\ngamma" and texts["tier", 1] == "p two" and texts["tick", 0] == "T\nx y" and not any(k[0] == "cp" for k in texts)
    empty = spark.createDataFrame([], "namespace string, collection string, id string, ordinal int, chunk_id string, text string, embedding array<float>")
    stored = knowledge.ingest(empty, records, bag_of_words())
    gamma = [float(x) for x in bag_of_words()(["gamma"])[0]]
    got = [r["id"] for r in knowledge.query(stored, gamma, 2).collect()]
    assert got[0] == "spread" and got.count("spread") == 1
    assert [r["id"] for r in knowledge.query_records(stored, records.where("id <> 'other'"), gamma, 2).collect()][0] == "spread"
    shorter = records.where("id = 'spread'").withColumn("body", F.lit('{"name":"n","turns":[]}'))
    assert knowledge.ingest(stored, shorter, bag_of_words()).where("id = 'spread'").count() == 1
    assert knowledge.remove(stored, shorter).where("id = 'spread'").count() == 0


def test_vector_index(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 16)).astype(float)
    rows = [("n", "c", f"v{i:03d}", [float(f) for f in v]) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "namespace string, collection string, id string, embedding array<float>")
    index, hits = HashedIndex(vectors, 16), 0
    for q in x[:5]:
        exact = {r["id"] for r in topk(vectors, list(q), 10).collect()}
        hits += len(exact & {r["id"] for r in index.topk(list(q), 10).collect()})
    assert hits >= 45
    new = spark.createDataFrame([("n", "c", "v000", [1.0] * 16)], vectors.schema)
    assert upsert(vectors, new).count() == 400 and remove(vectors, new).count() == 399
    with pytest.raises(Exception, match="dimension mismatch"):
        topk(vectors, [1.0], 3).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x.md").write_text("hi")
    (tmp_path / "y.log").write_text("no")
    files = file_tree(spark, str(tmp_path))
    assert sorted(r["path"] for r in files.collect()) == ["a b/x.md", "y.log"]
    kept = files.where(~ignored(F.col("path"), ["*.log", "build/"]))
    made = migrate(kept, spark.createDataFrame([], RECORD), "ns", "docs", "topic", "me")
    store = RecordStore(spark, str(tmp_path / "store"))
    assert outcome(store.put(made)) == [("a b/x.md", "committed")]
    assert migrate(kept, store.records(), "ns", "docs", "topic", "me").count() == 0


def test_reads_a_json_store(spark, tmp_path):
    import json

    (tmp_path / "ns" / "topic").mkdir(parents=True)
    doc = {"key": {"namespace": "ns", "collection": "topic", "id": "x"}, "kind": "MemoryTier", "revision": {"counter": 2, "hash": "h"}, "parent": None, "body": {"Inline": [104, 255]}, "meta": {"author": {"id": "me", "display": None}, "origin_system": "o", "created": 1, "updated": 2, "labels": {"a": "b"}}, "links": []}
    (tmp_path / "ns" / "topic" / "x.json").write_text(json.dumps(doc, indent=2))
    r = read_json_store(spark, str(tmp_path)).first()
    assert (r["id"], r["kind"], bytes(r["body"]["inline"]), r["meta"]["labels"]) == ("x", "memory_tier", b"h\xff", {"a": "b"})


def test_a_put_writes_one_collection(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path))
    store.put(puts(spark, record("a", b"1"), record("b", b"2", collection="other"), record("c", b"3", collection="third")), author="me", message="first")
    before = store.history()[-1]
    assert (before["author"], before["message"], len(before["parts"])) == ("me", "first", 3)
    store.put(puts(spark, record("d", b"4", collection="other")))
    after = store.history()[-1]
    assert len(after["changed"]) == 1 and sum(before["parts"][k] != after["parts"][k] for k in after["parts"]) == 1
    assert sorted(r["id"] for r in store.list("ns", "other").collect()) == ["b", "d"]
    # a delete of what isn't there commits nothing
    none = spark.createDataFrame([("ns", "other", "zz", None)], "namespace string, collection string, id string, expected struct<counter: bigint, hash: string>")
    assert outcome(store.delete(none)) == [("zz", "deleted")] and store.version() == 2
    only = none.select("namespace", F.lit("third").alias("collection"), F.lit("c").alias("id"), "expected")
    store.delete(only)
    assert store.list("ns", "third").count() == 0 and store.records().count() == 3
    assert store.vacuum() >= 1 and store.records().count() == 3
    assert store._files.names(f"{tmp_path}/pending") == []


def test_pull_and_push(spark, tmp_path):
    a, b = RecordStore(spark, f"{tmp_path}/a"), RecordStore(spark, f"{tmp_path}/b")
    a.put(puts(spark, record("x", b"1")))
    assert b.pull(a) == {"fast_forwarded": True, "version": 1} and b.pull(a)["fast_forwarded"] is False
    b.put(puts(spark, record("y", b"2", collection="other")))
    assert b.push(a) == {"fast_forwarded": True, "version": 2}
    assert sorted(r["id"] for r in a.records().collect()) == ["x", "y"]
    assert all(p["path"].startswith(f"{tmp_path}/a/") for p in a.history()[-1]["parts"].values())
    a.put(puts(spark, record("z", b"3")))
    with pytest.raises(Rejected):
        b.push(a)
    b.put(puts(spark, record("w", b"4")))
    for call in (lambda: b.pull(a), lambda: b.push(a)):
        with pytest.raises(Rejected):
            call()


def test_blobs_are_listed_and_collected(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path))
    store.put_blobs(spark.createDataFrame([(b"one",), (b"two",)], "content binary"))
    store.put_blobs(spark.createDataFrame([(b"three",), (b"two",)], "content binary"))
    assert sorted(r["len"] for r in store.list_blobs().collect()) == [3, 3, 5]
    import hashlib

    digest = lambda x: hashlib.sha256(x).hexdigest()
    body = '{"p":"%s"}' % digest(b"two")
    store.put(puts(spark, record("v", body.encode(), collection="graph_manifest", kind="graph_manifest")))
    assert tuple(store.collect_garbage().first()) == (2, 1)
    assert [bytes(r["content"]) for r in store.blobs().collect()] == [b"two"]
    assert tuple(store.collect_garbage().first()) == (0, 1)
    assert store.delete_blobs(spark.createDataFrame([(digest(b"two"),), ("x",)], "hash string")) == 1 and store.blobs().count() == 0


def test_stores_without_conditional_writes_are_refused(spark):
    class Odd:
        def getScheme(self):
            return "odd"

    files = Files(spark)
    files._at = lambda path: (Odd(), None)
    with pytest.raises(ValueError, match="conditionally"):
        files.create("odd://x/y", "z")
