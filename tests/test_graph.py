from pyspark.sql import functions as F

from ledgerloom.operators import graph
from ledgerloom.operators.extract import extract
from ledgerloom.operators.graph import SymbolFilter
from ledgerloom.operators.index import changed_paths, index, index_changed, stale_entries
from ledgerloom.plans.dispatch import Service, UnknownView


def view(spark, files, name="main"):
    rows = spark.createDataFrame([(p, s.encode()) for p, s in files.items()], "path string, content binary")
    made = index(rows, "r", name)
    return graph.assemble(made.manifest, made.blobs)


def names(df):
    return [r["name"] for r in df.collect()]


def test_chain(spark):
    _, refs = view(spark, {"lib.rs": "fn leaf() {}\nfn mid() { leaf(); }", "main.rs": "fn top() { mid(); }"})
    assert names(graph.callers(refs, "leaf")) == ["mid"]
    assert names(graph.callees(refs, "top")) == ["mid"]
    assert names(graph.impact(refs, "leaf")) == ["mid", "top"]
    assert names(graph.impact(refs, "top")) == []


def test_cycle_terminates(spark):
    _, refs = view(spark, {"a.rs": "fn a() { b(); }\nfn b() { a(); }"})
    assert names(graph.impact(refs, "a")) == ["b"]
    assert names(graph.impact(refs, "b")) == ["a"]


def test_mixed_view(spark):
    symbols, refs = view(spark, {"crates/a/src/lib.rs": "struct A; struct A2; fn new() -> A { A }\nfn run() { new(); helper(); helper(); }", "crates/b/src/lib.rs": "fn new() -> u8 { 0 }", "scripts/tool.py": "def main(): pass"})
    assert graph.totals(symbols, refs).first()["files"] == 3
    best = graph.top(symbols, refs, "definitions").first()
    assert (best["name"], best["score"]) == ("new", 2)
    assert {r["name"]: r["score"] for r in graph.top(symbols, refs, "fan_in").collect()}["helper"] == 2
    assert {r["language"]: r["n"] for r in graph.by_language(symbols).collect()} == {"rust": 5, "python": 1}
    assert names(graph.list_symbols(symbols, SymbolFilter(name_contains="A2")).items) == ["A2"]
    shown = graph.list_symbols(symbols, limit=2)
    assert shown.items.count() == 2 and shown.total == 6 and shown.truncated


def test_unreferenced_and_tests(spark):
    symbols, refs = view(spark, {"lib.rs": "fn used() {}\nfn caller() { used(); }\nfn orphan() {}\nmod tests {\n fn t_helper() {}\n fn t_only() { t_helper(); }\n}"})
    assert names(graph.unreferenced(symbols, refs)) == ["caller", "orphan"]
    assert "t_only" in names(graph.unreferenced(symbols, refs, exclude_tests=False))


def test_diff_ignores_lines(spark):
    a, ra = view(spark, {"x.rs": "fn f() { g(); }"})
    b, rb = view(spark, {"x.rs": "\n\nfn f() { g(); }\nfn h() {}"})
    assert [(r["change"], r["name"]) for r in graph.diff(a, b, graph.SYMBOL_KEY).collect()] == [("added", "h")]
    assert graph.diff(ra, rb, graph.REF_KEY).count() == 0


def test_extractors():
    assert extract("python", "class A:\n def m(self):\n  return f(x.g())\n")[0] == [("A", "class", 1, 3), ("m", "function", 2, 3)]
    assert [r[:2] for r in extract("python", "def a():\n b(c.d())\n")[1]] == [("b", "a"), ("d", "a")]
    assert extract("python", "def broken(") == ([], [])
    assert [s[:2] for s in extract("go", "type T struct {}\nfunc (t T) Run() { go work() } // func no()\n")[0]] == [("T", "struct"), ("Run", "function")]
    assert [s[0] for s in extract("typescript", 'interface I {}\nconst f = (a) => a;\nfunction g() { h("x()"); }')[0]] == ["I", "f", "g"]
    assert [r[0] for r in extract("rust", 'fn a() { b::c(); x.d(); println!("{}", e(1)); }')[1]] == ["c", "d", "e"]
    assert extract("ruby", "def a\n b(1)\nend\n")[1] == [("b", "a", 2)]
    assert extract(None, "x") == ([], [])


def test_incremental_index_equals_full(spark):
    make = lambda d: spark.createDataFrame([(p, s.encode()) for p, s in d.items()], "path string, content binary")
    before, after = {"a.py": "def a(): b()", "b.py": "def b(): pass", "c.py": "x()"}, {"a.py": "def a(): c()", "b.py": "def b(): pass", "d.py": "y()"}
    old, full = index(make(before), "r", "v"), index(make(after), "r", "v")
    trees = [spark.createDataFrame([(p, s) for p, s in d.items()], "path string, hash string") for d in (before, after)]
    moved = {r["path"]: r["change"] for r in changed_paths(*trees).collect()}
    assert moved == {"a.py": "M", "c.py": "D", "d.py": "A"}
    part = index_changed(make({p: after[p] for p in ("a.py", "d.py")}), spark.createDataFrame([("c.py",)], "path string"), "r", "v", old.manifest)
    key = lambda x: sorted((r["path"], r["hash"]) for r in x.manifest.collect())
    assert key(part) == key(full)
    extra = old.manifest.withColumn("path", F.concat(F.lit("vendor/"), "path"))
    assert stale_entries(old.manifest.union(extra)).count() == 3


def test_dispatch(spark):
    symbols, refs = view(spark, {"a.rs": "fn a() { b(); }\nfn b() {}"})
    manifests = symbols.select("repo", "view_id", "path").distinct()
    service = Service(symbols, refs, manifests, spark.createDataFrame([("n", "c", "1")], "namespace string, collection string, id string"))
    assert names(service.dispatch("callers", "r", "main", name="b")) == ["a"]
    assert service.dispatch("views").first()["paths"] == 1
    assert service.dispatch("status").first()["n"] == 1
    assert service.dispatch("node", "r", "main", name="b").count() == 2
    for tool in ("search", "callees", "impact", "explore", "overview", "list", "unreferenced"):
        service.dispatch(tool, "r", "main", name="a").collect()
    assert service.dispatch("top", "r", "main", ranking="fan_in").count() == 1
    assert service.dispatch("diff", "r", "main", other="main").count() == 0
    assert service.readable(service.records, ["m"]).count() == 0 and service.readable(service.records, ["*"]).count() == 1
    try:
        service.dispatch("callers", "r", "nope", name="b")
        raise AssertionError
    except UnknownView:
        pass
