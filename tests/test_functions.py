import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import keys, text, vectors
from ledgerloom.functions.merge import merge_append_only, merge_appended_json, merge_structured


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_segment_round_trips_and_is_injective(spark):
    ids = ["plain-id_1", "a/b", "a.b", "a%2Fb", "a b", "é漢", "*~+", "", "a%zz"]
    coded = column(spark, ids, keys.segment)
    assert len(set(coded)) == len(ids) and coded[1] == "a%2Fb" and coded[0] == "plain-id_1"
    assert all(set(c) <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-%") for c in coded)
    assert column(spark, coded, keys.decode_segment) == ids
    assert column(spark, ["50%", "%4", "a+b"], keys.decode_segment) == ["50%", "%4", "a+b"]
    parsed = column(spark, ["a%20b/c/d.json", "a/b", "a/b/c.txt"], keys.parse_object_key)
    assert tuple(parsed[0]) == ("a b", "c", "d") and parsed[1:] == [None, None]
    assert column(spark, ["0" * 64, "0" * 63, "A" * 64], keys.is_blob_hash) == [True, False, False]


def test_paragraphs_headers_chunks(spark):
    assert column(spark, ["a\n\n\u00a0b \n\n \n\nc", ""], text.split_paragraphs) == [["a", "b", "c"], []]
    got = column(spark, [["x", "y"], []], lambda c: text.prepend_header(F.lit("h"), c), "array<string>")
    assert got == [["h\nx", "y"], ["h"]]
    parts = column(spark, ["p\u001f12", "p", "p\u001fx", "a\u001fb\u001f3"], text.parent_of_chunk)
    assert [tuple(p) for p in parts] == [("p", 12), ("p", 0), ("p", 0), ("a\u001fb", 3)]


def test_paths(spark):
    paths = ["node_modules/x.js", "a.min.js", ".hidden/x.rs", "contests/e.rs", "vendor/mylib/x.rs", "vendor/mylib2/x.rs"]
    assert column(spark, paths, lambda c: text.is_indexable(c, ["vendor/mylib/"])) == [False, False, False, True, True, False]
    assert column(spark, ["a/b.rs", "x.tsx", "Makefile", ".rs", "a.b.go", "A.RS"], text.language_of) == ["rust", "tsx", "unknown", "unknown", "go", "unknown"]
    assert column(spark, ["a/tests/b.rs", "contests/e.rs"], text.in_tests) == [True, False]


def test_cosine_guards(spark):
    nan, inf = float("nan"), float("inf")
    values = [[1.0, 0.0], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [2.0, 2.0], [-1.0, 0.0]]
    got = column(spark, values, lambda c: vectors.cosine(c, vectors.literal([1.0, 0.0])), "array<double>")
    assert [round(x, 6) for x in got] == [1, 0, 0, 0, 0.707107, -1]
    unit = column(spark, [[3.0, 4.0], [0.0, 0.0]], vectors.l2_normalize, "array<double>")
    assert [round(x, 6) for x in unit[0]] == [0.6, 0.8] and unit[1] == [0, 0]
    words = vectors.bag_of_words()(["ab ab c", ""])
    assert words[0].sum() == 3 and words[1].sum() == 0


def test_append_merge_keeps_both():
    assert merge_append_only(b"a\n\nyes\nyes\nfrom_a\n", b"a\n\nyes\nyes\nfrom_b\n") == b"a\n\nyes\nyes\nfrom_a\nfrom_b\n"
    assert merge_append_only(b"a", b"a\nb") == b"a\nb"
    assert merge_append_only(b"", b"x\n") == b"x\n"
    assert merge_append_only(b"x\n", b"") == b"x\n"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=5), st.lists(st.sampled_from("xyz"), max_size=4), st.lists(st.sampled_from("xyz"), max_size=4))
def test_append_merge_of_two_continuations(base, one, two):
    lines = lambda x: "".join(f"{c}\n" for c in x).encode()
    same = next((i for i, (p, q) in enumerate(zip(one, two)) if p != q), min(len(one), len(two)))
    assert merge_append_only(lines(base + one), lines(base + two)) == lines(base + one + two[same:])


def structured(base, ours, theirs):
    got = merge_structured(*(json.dumps(x).encode() for x in (base, ours, theirs)))
    return None if got is None else json.loads(got)


def test_structured_merge():
    base = {"name": "a", "content": "x"}
    assert structured(base, {"name": "b", "content": "x"}, {"name": "a", "content": "y"}) == {"content": "y", "name": "b"}
    assert merge_structured(b"", b"{}", b'{"a":1}') is None
    assert structured(base, {"name": "b"}, {"name": "c"}) is None
    assert structured({"a": 1, "b": 2}, {"a": 1}, {"a": 3, "b": 2}) == {"a": 3}
    assert structured({"a": 1}, {}, {"a": 2}) is None
    assert structured({"a": 1}, {"a": 1.0}, {"a": True}) is None
    assert structured({"o": {"x": 1, "y": 1}}, {"o": {"x": 2, "y": 1}}, {"o": {"x": 1, "y": 2}}) == {"o": {"x": 2, "y": 2}}
    assert structured({"l": [1]}, {"l": [1, 2]}, {"l": [1, 3]}) is None
    assert json.loads(merge_appended_json(b'{"l":[1]}', b'{"l":[1,2]}', b'{"l":[1,3]}')) == {"l": [1, 2, 3]}


def test_rich_text(spark):
    doc = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"type": "heading", "content": [{"type": "text", "text": "c"}]}]}
    assert column(spark, [json.dumps(doc), None], text.rich_text) == ["ab\nc", None]


def test_kinds_folders_and_probes(spark):
    assert text.parse_kind("TypeAlias") == text.parse_kind("type-alias") == "type_alias" and text.parse_kind("FUNCTION") == "function"
    with pytest.raises(ValueError):
        text.parse_kind("macro?")
    df = spark.createDataFrame([("src",), ("vendor",), ("vendor/keep",), ("vendor/other",), (".git",)], "p string")
    got = [r[0] for r in df.where(text.should_descend("p", ["vendor/keep/x"])).collect()]
    assert got == ["src", "vendor", "vendor/keep"]
    views = spark.createDataFrame([("org/repo", "v1.0"), ("org_repo", "v1.0"), ("org/repo", "v1_0")], "repo string, view string")
    folders = [r[0] for r in views.select(keys.view_folder("repo", "view")).collect()]
    assert folders == ["org%2Frepo/v1%2E0.db", "org_repo/v1%2E0.db", "org%2Frepo/v1_0.db"]
    assert [r[0] for r in spark.createDataFrame([("/healthz",), ("/x",)], "p string").select(keys.is_probe_path("p")).collect()] == [True, False]


def test_principals(spark):
    known = keys.principals('[[principal]]\nname="ann"\ntoken="t"\nread=["a"]\nwrite=["a", "tickets"]\n[[principal]]\nname="root"\ntoken="r"\nread=["*"]\nwrite=["*"]\n')
    rows = spark.createDataFrame([("a", (("me", None), 1)), ("b", (("me", None), 1))], "namespace string, meta struct<author: struct<id: string, display: string>, n: int>")
    assert [r["namespace"] for r in known["t"].readable(rows).collect()] == ["a"] and known["r"].readable(rows).count() == 2
    known["r"].check_write(rows)
    known["t"].check_write(rows.where("namespace = 'a'"))
    for bad in (rows, rows.withColumn("namespace", F.lit("tickets"))):
        with pytest.raises(PermissionError):
            known["t"].check_write(bad)
    assert {r["meta"]["author"]["id"] for r in known["t"].stamped(rows).collect()} == {"ann"}
    assert {r["meta"]["author"]["id"] for r in keys.Principal(authenticated=False).stamped(rows).collect()} == {"me"}
    with pytest.raises(ValueError):
        keys.principals('[[principal]]\nname="a"\ntoken="t"\n[[principal]]\nname="b"\ntoken="t"\n')


def crash_or_sleep(language, source):
    import os
    import time

    if source == "crash":
        os._exit(3)
    if source == "hang":
        time.sleep(60)
    print("noise")
    return [(source, language, 1, 1)], []


def test_parse_pool_survives_its_children(spark):
    from ledgerloom.operators.extract import slices
    from ledgerloom.operators.parse_pool import ParsePool

    pool = ParsePool(f"{__name__}:crash_or_sleep", 2, 4.0)
    try:
        asked = ["a", "crash", "b", "hang", "c"]
        assert [x and x[0][0][0] for x in (pool.call("python", s) for s in asked)] == ["a", None, "b", None, "c"]
    finally:
        pool.close()
    files = spark.createDataFrame([("m.py", b"def f():\n    g()\n")], "path string, content binary")
    assert slices(files, isolated=True).collect() == slices(files).collect()


def test_update_violations(spark):
    from ledgerloom.operators.sync import update_violations

    ops = spark.createDataFrame([("k", 1, "committed"), ("k", 2, "committed"), ("k", 3, "conflict"), ("l", 1, "committed")], "key string, op_id long, result string")
    members = spark.createDataFrame([("k", 1), ("k", 1), ("l", 1)], "key string, op_id long")
    assert sorted(map(tuple, update_violations(ops, members).collect())) == [("k", 1, "repeated"), ("k", 2, "lost")]
