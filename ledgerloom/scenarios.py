"""Queries that drive merges, syncs, trackers, indexing and tools over records
made from the given tables, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _main, _on, _register
from .functions import keys, merge, text, tickets
from .operators import graph, index, knowledge, sync
from .operators.index import changed_paths, stale_entries
from .plans.dispatch import Service
from .plans.views import spark_view
from .sources.files import ignored
from .streaming.watch import tree_changes


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("clerk"), F.col("o_orderpriority").alias("prio"), F.col("o_orderstatus").alias("status"))


_O = "WITH o AS (SELECT o_orderkey AS k, 'c' || o_custkey AS clerk, o_orderpriority AS prio, o_orderstatus AS status FROM orders)\n"


def _by(n: int, *rest: int) -> Column:
    return (F.col("k") % n).isin(*(rest or (0,)))


# --- keys and revisions --------------------------------------------------

_register("key_parse", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", keys.parse_object_key(keys.object_key(F.lit("a b"), F.col("p_type"), F.col("p_name"))).alias("k"), keys.display(F.lit("a b"), "p_type", "p_name").alias("display")).select("p_partkey", "k.*", "display"), (), "SELECT p_partkey, 'a b' AS namespace, p_type AS collection, p_name AS id, 'a b/' || p_type || '/' || p_name AS display FROM part")
_register("revision_next", lambda s, d: _orders(s, d).select("k", keys.next_revision(keys.initial_revision("clerk"), "prio").alias("r")).select("k", "r.*"), (), _O + "SELECT k, 1::BIGINT AS counter, sha256(prio) AS hash FROM o")
_register("scope_filter", lambda s, d: spark_view(s, d, "store_rows").where(keys.allows(F.when(F.col("counter") == 1, F.array(F.lit("other"))).otherwise(F.array(F.lit("x"), F.lit("ns"))), "namespace")).select("store", "id"), ("store_rows",), "SELECT store, id FROM store_rows WHERE counter <> 1")
_register("blob_names", lambda s, d: spark_view(s, d, "store_rows").select(F.when(F.length("id") % 2 == 0, F.col("hash")).otherwise(F.upper("hash")).alias("name")).where(keys.is_blob_hash("name")).distinct(), ("store_rows",), "SELECT DISTINCT CASE WHEN length(id) % 2 = 0 THEN hash ELSE upper(hash) END AS name FROM store_rows WHERE length(id) % 2 = 0 OR regexp_full_match(upper(hash), '[0-9]+')")


# --- merges --------------------------------------------------------------


def _merge_append(spark: SparkSession, sf: str) -> DataFrame:
    ours = F.concat(F.lit("head\n"), "clerk", F.when(_by(5), "").otherwise("\n"))
    theirs = F.when(_by(7), "head\n").otherwise(F.concat(F.lit("head\n"), "prio", F.lit("\n"), F.when(_by(3), "").otherwise("tail")))
    made = merge.merge_bodies(F.lit("append_only"), F.lit(None).cast("binary"), ours.cast("binary"), theirs.cast("binary"))
    return _orders(spark, sf).select("k", made.alias("m")).select("k", "m.outcome", F.col("m.body").cast("string").alias("body"))


_register("merge_append_only", _merge_append, (), _O + r"""
SELECT k, 'merged' AS outcome, 'head' || chr(10) || clerk || CASE WHEN k % 7 = 0 THEN CASE WHEN k % 5 = 0 THEN '' ELSE chr(10) END
  ELSE chr(10) || prio || chr(10) || CASE WHEN k % 3 = 0 THEN '' ELSE 'tail' END END AS body FROM o""")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).cast("binary")


def _merge_structured(spark: SparkSession, sf: str) -> DataFrame:
    p, s = F.col("prio"), F.col("status")
    base = _json(gone=F.lit(1), p=p, s=s)
    ours = _json(p=F.concat(p, F.lit("!")), gone=F.lit(1), s=s)
    theirs = F.when(_by(4), _json(p=F.concat(p, F.lit("?")), s=s)).otherwise(_json(n=F.col("k"), p=p, s=s))
    made = merge.merge_bodies(F.lit("structured"), base, ours, theirs)
    return _orders(spark, sf).select("k", made.alias("m")).select("k", "m.outcome", F.col("m.body").cast("string").alias("body"))


_register("merge_structured", _merge_structured, (), _O + """
SELECT k, CASE WHEN k % 4 = 0 THEN 'conflict' ELSE 'merged' END AS outcome,
  CASE WHEN k % 4 <> 0 THEN '{"n":' || k || ',"p":"' || prio || '!","s":"' || status || '"}' END AS body FROM o""")


# --- sync ----------------------------------------------------------------

_BASE = b'{"a":1,"b":1}'


def _store(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """The orders as records of one store: a kind each by ``k % 4``; those of
    ``k % 5 = 0`` were changed on both sides, B being a revision ahead."""
    a = side == "a"
    changed = _by(5)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("topic", "memory_tier", "checkpoint", "graph_manifest")]), (F.col("k") % 4 + 1).cast("int"))
    plain = F.when(changed, F.col("clerk" if a else "prio")).otherwise(F.col("clerk"))
    tier = F.when(~changed, F.lit(_BASE.decode())).otherwise('{"a":2,"b":1}' if a else F.concat(F.lit('{"a":1,"b":2,"c":"'), "prio", F.lit('"}')))
    body = F.when(kind == "topic", F.concat(F.lit("start\n"), plain, F.lit("\n"))).when(kind == "memory_tier", tier).otherwise(plain).cast("binary")
    no_links = F.array().cast("array<struct<namespace: string, collection: string, id: string>>")
    link = F.array(F.struct(F.lit("n").alias("namespace"), F.lit("c").alias("collection"), F.when(_by(2), "both").otherwise(side).alias("id")))
    meta = F.struct(
        F.struct(F.lit("me").alias("id"), F.lit(None).cast("string").alias("display")).alias("author"),
        F.lit("test").alias("origin_system"),
        F.lit(10 if a else 20).cast("long").alias("created"),
        F.lit(30 if a else 40).cast("long").alias("updated"),
        F.create_map(F.lit("own"), F.lit(side), F.lit(f"only_{side}"), F.col("status")).alias("labels"),
    )
    counter = F.when(changed & F.lit(not a), 1).otherwise(0).cast("long")
    rows = _orders(spark, sf).where(~_by(17 if a else 19))
    return rows.select(
        F.lit("ns").alias("namespace"),
        kind.alias("collection"),
        F.concat(F.lit("o"), F.col("k").cast("string")).alias("id"),
        kind.alias("kind"),
        F.struct(counter.alias("counter"), keys.content_hash(body).alias("hash")).alias("revision"),
        F.struct(F.lit(0).cast("long").alias("counter"), keys.content_hash(F.lit(_BASE)).alias("hash")).alias("parent"),
        F.struct(body.alias("inline"), F.lit(None).cast("string").alias("blob_hash"), F.lit(None).cast("long").alias("blob_len")).alias("body"),
        meta.alias("meta"),
        F.when(_by(3), no_links).otherwise(link).alias("links"),
    )


def _synced(spark: SparkSession, sf: str) -> sync.Synced:
    bases = spark.createDataFrame([(_BASE,)], "content binary").select(keys.content_hash("content").alias("hash"), "content")
    return sync.sync(_store(spark, sf, "a"), _store(spark, sf, "b"), bases)


_IN = """, s AS (SELECT *, k % 17 <> 0 AS in_a, k % 19 <> 0 AS in_b, k % 5 = 0 AS c, k % 4 AS t, 'o' || k AS id,
  CASE k % 4 WHEN 0 THEN 'topic' WHEN 1 THEN 'memory_tier' WHEN 2 THEN 'checkpoint' ELSE 'graph_manifest' END AS collection FROM o WHERE k % 17 <> 0 OR k % 19 <> 0)
"""
_ACTION = "CASE WHEN NOT in_a THEN 'copied_to_a' WHEN NOT in_b THEN 'copied_to_b' WHEN NOT c THEN 'same' WHEN t = 2 THEN 'conflict' ELSE 'merged' END"
_register("sync_actions", lambda s, d: _synced(s, d).report, (), _O + _IN + f"SELECT 'ns' AS namespace, collection, id, {_ACTION} AS action FROM s")


def _after(side: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = _synced(spark, sf)
        r = s.a if side == "a" else s.b
        labels = F.array_join(F.transform(F.array_sort(F.map_entries("meta.labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
        return r.select("id", "revision.counter", F.col("body.inline").cast("string").alias("body"), F.col("parent.counter").alias("parent"), labels.alias("labels"), "meta.created", "meta.updated", F.array_join("links.id", ",").alias("links"))

    return run


def _after_sql(own: str, other: str) -> str:
    take_b = f"(NOT in_a OR (in_b AND {'TRUE' if own == 'b' else 'FALSE'}))"
    return _O + _IN + f""", m AS (SELECT *, in_a AND in_b AND c AND t <> 2 AS merged, {take_b} AS b FROM s)
SELECT id, CASE WHEN merged THEN 2 WHEN c AND b THEN 1 ELSE 0 END::BIGINT AS counter,
  CASE WHEN merged THEN CASE t WHEN 0 THEN 'start' || chr(10) || clerk || chr(10) || prio || chr(10) WHEN 1 THEN '{{"a":2,"b":2,"c":"' || prio || '"}}' ELSE clerk END
    WHEN t = 0 THEN 'start' || chr(10) || CASE WHEN c AND b THEN prio ELSE clerk END || chr(10)
    WHEN t = 1 THEN CASE WHEN NOT c THEN '{{"a":1,"b":1}}' WHEN b THEN '{{"a":1,"b":2,"c":"' || prio || '"}}' ELSE '{{"a":2,"b":1}}' END
    WHEN c AND b THEN prio ELSE clerk END AS body,
  CASE WHEN merged THEN 1 ELSE 0 END::BIGINT AS parent,
  CASE WHEN merged THEN 'only_a=' || status || ',only_b=' || status || ',own=b' WHEN b THEN 'only_b=' || status || ',own=b' ELSE 'only_a=' || status || ',own=a' END AS labels,
  CASE WHEN merged OR NOT b THEN 10 ELSE 20 END::BIGINT AS created, CASE WHEN merged OR b THEN 40 ELSE 30 END::BIGINT AS updated,
  CASE WHEN k % 3 = 0 THEN '' WHEN k % 2 = 0 THEN 'both' WHEN merged THEN 'a,b' WHEN b THEN 'b' ELSE 'a' END AS links FROM m"""


_register("sync_store_a", _after("a"), (), _after_sql("a", "b"))
_register("sync_store_b", _after("b"), (), _after_sql("b", "a"))


def _pull(spark: SparkSession, sf: str) -> DataFrame:
    rows = _orders(spark, sf).select("k", F.concat(F.lit("t/"), F.col("k").cast("string")).alias("path"), F.when(_by(2), "topic").otherwise("checkpoint").alias("kind"), F.concat(F.lit("v\n"), "prio", F.lit("\n")).alias("v"))
    made = lambda df, add: df.select("path", "kind", F.concat("v", F.lit(add)).cast("binary").alias("content"))
    tree = lambda gone, changed, add: made(rows.where(~_by(gone) & ~_by(changed)), "").unionByName(made(rows.where(~_by(gone) & _by(changed)), add))
    new = rows.where(_by(13)).withColumn("path", F.concat("path", F.lit("/new")))
    done = sync.three_way(made(rows, ""), tree(11, 3, "L\n"), tree(7, 5, "R\n").unionByName(made(new, "")))
    return done.select("path", "action", F.col("content").cast("string").alias("content"))


_register("three_way_pull", _pull, (), _O + """, t AS (SELECT k, 't/' || k AS path, 'v' || chr(10) || prio || chr(10) AS v, k % 11 = 0 AS l_gone, k % 7 = 0 AS r_gone, k % 11 = 0 OR k % 3 = 0 AS l_changed, k % 7 = 0 OR k % 5 = 0 AS r_changed, k % 2 = 0 AS topic FROM o),
c AS (SELECT *, CASE WHEN NOT r_changed OR (l_gone AND r_gone) THEN 'kept' WHEN NOT l_changed AND r_gone THEN 'deleted' WHEN NOT l_changed THEN 'applied' WHEN l_gone OR r_gone THEN 'kept' WHEN topic THEN 'merged' ELSE 'conflict' END AS action FROM t)
SELECT path, action, CASE action WHEN 'applied' THEN v || 'R' || chr(10) WHEN 'merged' THEN v || 'L' || chr(10) || 'R' || chr(10) WHEN 'deleted' THEN NULL
  ELSE CASE WHEN NOT l_gone THEN v || CASE WHEN l_changed THEN 'L' || chr(10) ELSE '' END END END AS content FROM c
UNION ALL SELECT path || '/new', 'applied', v FROM t WHERE k % 13 = 0""")


# --- trees and indexing --------------------------------------------------

_register("changed_paths", _on("manifest")(lambda m: changed_paths(_main(m, "a"), _main(m, "b"))), ("manifest",), """
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'A' WHEN b.path IS NULL THEN 'D' ELSE 'M' END AS change
FROM (SELECT path, hash FROM manifest WHERE view_id = 'a') a FULL JOIN (SELECT path, hash FROM manifest WHERE view_id = 'b') b ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash""")

_FOLDERS = ("src/", "node_modules/x/", ".git/", "vendor/keep/", "a/dist/", "web/")


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    folder = F.element_at(F.array(*[F.lit(f) for f in _FOLDERS]), (F.col("k") % 6 + 1).cast("int"))
    ending = F.when(_by(4), ".min.js").when(_by(4, 1), ".log").otherwise(".py")
    return _orders(spark, sf).select(F.concat(folder, F.lit("f"), F.col("k").cast("string"), ending).alias("path"))


_PATHS = _O + ", p AS (SELECT k, CASE k % 6 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FOLDERS)) + " END || 'f' || k || CASE k % 4 WHEN 0 THEN '.min.js' WHEN 1 THEN '.log' ELSE '.py' END AS path FROM o)\n"
_register("stale_entries", lambda s, d: stale_entries(_paths(s, d), ["vendor/keep"]), (), _PATHS + "SELECT path FROM p WHERE k % 6 IN (1, 2, 4) OR (k % 6 IN (0, 5) AND k % 4 = 0)")
_register("ignore_rules", lambda s, d: _paths(s, d).where(ignored(F.col("path"), ["# none", "*.log", "/web/", "dist/", "!f*1.log"])), (), _PATHS + "SELECT path FROM p WHERE k % 6 IN (4, 5) AND NOT (k % 4 = 1 AND k % 10 = 1) OR (k % 6 NOT IN (4, 5) AND k % 4 = 1 AND k % 10 <> 1)")


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """A Python file for each part: a function that calls another, a class."""
    n = F.col("p_partkey").cast("string")
    content = F.concat(F.lit("def f"), n, F.lit("():\n    g"), (F.col("p_partkey") % 7).cast("string"), F.lit("()\n\nclass C"), n, F.lit(":\n    pass\n"))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.concat(F.lit("src/m"), n, F.lit(".py")).alias("path"), content.cast("binary").alias("content"))


def _indexed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    done = index.index(_sources(spark, sf).select("path", "content"), "r", "v")
    return graph.assemble(done.manifest, done.blobs)


_register("index_symbols", lambda s, d: _indexed(s, d)[0], (), "SELECT 'r' AS repo, 'v' AS view_id, 'src/m' || p_partkey || '.py' AS path, 0 AS seq, 'f' || p_partkey AS name, 'function' AS kind, 1::BIGINT AS start_line, 2::BIGINT AS end_line FROM part UNION ALL SELECT 'r', 'v', 'src/m' || p_partkey || '.py', 1, 'C' || p_partkey, 'class', 4, 5 FROM part")
_register("index_references", lambda s, d: _indexed(s, d)[1], (), "SELECT 'r' AS repo, 'v' AS view_id, 'src/m' || p_partkey || '.py' AS path, 0 AS seq, 'g' || p_partkey % 7 AS name, 'f' || p_partkey AS from_fn, 2::BIGINT AS line FROM part")


def _reindexed(spark: SparkSession, sf: str) -> DataFrame:
    every = _sources(spark, sf)
    before = index.index(every.select("path", "content"), "r", "v").manifest
    third = every.where((F.col("p_partkey") % 3 == 0) & (F.col("p_partkey") % 7 != 0)).select("path", F.lit(b"def other():\n    pass\n").alias("content"))
    new = every.where("p_partkey % 11 = 0").select(F.concat(F.lit("new/"), "path").alias("path"), "content")
    done = index.index_changed(third.union(new), every.where("p_partkey % 7 = 0").select("path"), "r", "v", before)
    return done.changes.select("path", "change")


_register("index_changed", _reindexed, (), "SELECT 'src/m' || p_partkey || '.py' AS path, CASE WHEN p_partkey % 7 = 0 THEN 'deleted' WHEN p_partkey % 3 = 0 THEN 'modified' ELSE 'unchanged' END AS change FROM part UNION ALL SELECT 'new/src/m' || p_partkey || '.py', 'added' FROM part WHERE p_partkey % 11 = 0")
_register("graph_replace_paths", _on("symbols")(lambda s: graph.replace_paths(_main(s), _main(s, "next").where("path = 'src/click.rs'")).select("view_id", "path", "seq", "name")), ("symbols",), "SELECT view_id, path, seq, name FROM symbols WHERE (view_id = 'main' AND path <> 'src/click.rs') OR (view_id = 'next' AND path = 'src/click.rs')")
_register("graph_resolve_references", _on("symbols", "refs")(lambda s, r: graph.resolve_references_to(_main(s), _main(r), "f33").select("path", "seq", "resolution", "target")), ("symbols", "refs"), """
, h AS (SELECT DISTINCT path FROM symbols WHERE view_id = 'main' AND name = 'f33')
SELECT path, seq, CASE WHEN path IN (SELECT path FROM h) THEN 'local' WHEN (SELECT count(*) FROM h) = 0 THEN 'unresolved' WHEN (SELECT count(*) FROM h) = 1 THEN 'unique' ELSE 'ambiguous' END AS resolution,
  CASE WHEN path IN (SELECT path FROM h) THEN path WHEN (SELECT count(*) FROM h) = 1 THEN (SELECT min(path) FROM h) END AS target FROM refs WHERE view_id = 'main' AND name = 'f33'""")


# --- tools ---------------------------------------------------------------


def _tool(tool: str, **args):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        symbols, refs = spark_view(spark, sf, "symbols"), spark_view(spark, sf, "refs")
        manifests = symbols.select("repo", "view_id", "path", F.lit("h").alias("hash")).distinct()
        return Service(symbols, refs, manifests).dispatch(tool, "r", "main", **args)

    return run


_register("tool_explore", lambda s, d: _tool("explore", name="f12")(s, d).select("path", "seq", "name", "from_fn", "line"), ("refs",), "SELECT path, seq, name, from_fn, line FROM refs WHERE view_id = 'main' AND name = 'f12'")
_register("tool_list", lambda s, d: _tool("list", kind="struct", limit=7)(s, d).select("path", "seq", "name", "total", "truncated"), ("symbols",), ", f AS (SELECT * FROM symbols WHERE view_id = 'main' AND kind = 'struct') SELECT path, seq, name, (SELECT count(*) FROM f) AS total, (SELECT count(*) > 7 FROM f) AS truncated FROM f ORDER BY path, seq LIMIT 7")
_register("tool_top", lambda s, d: _tool("top", ranking="fan_in", limit=5)(s, d).select("name", "score", "total", "truncated"), ("refs",), ", f AS (SELECT name, count(*) AS score FROM refs WHERE view_id = 'main' GROUP BY name) SELECT name, score, (SELECT count(*) FROM f) AS total, (SELECT count(*) > 5 FROM f) AS truncated FROM f ORDER BY score DESC, name LIMIT 5")


def _overview(spark: SparkSession, sf: str) -> DataFrame:
    flat = lambda c, key: F.array_join(F.transform(c, lambda x: F.concat(x[key], F.lit("="), x["n"].cast("string"))), ",")
    return _tool("overview", largest=3)(spark, sf).select("symbols", "references", "files", flat("by_kind", "name").alias("by_kind"), flat("by_language", "name").alias("by_language"), flat("largest", "path").alias("largest"))


_register("tool_overview", _overview, ("symbols", "refs"), """
, s AS (SELECT *, CASE split_part(path, '.', -1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' ELSE 'unknown' END AS language FROM symbols WHERE view_id = 'main')
SELECT (SELECT count(*) FROM s) AS symbols, (SELECT count(*) FROM refs WHERE view_id = 'main') AS "references", (SELECT count(*) FROM (SELECT path FROM s UNION SELECT path FROM refs WHERE view_id = 'main')) AS files,
  (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM s GROUP BY 1)) AS by_kind,
  (SELECT string_agg(language || '=' || n, ',' ORDER BY language) FROM (SELECT language, count(*) AS n FROM s GROUP BY 1)) AS by_language,
  (SELECT string_agg(path || '=' || n, ',' ORDER BY n DESC, path) FROM (SELECT path, count(*) AS n FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)) AS largest""")
_register("tool_diff", lambda s, d: _tool("diff", other="next")(s, d).where("change = 'removed' AND what = 'symbol'").select("path", "name"), ("symbols",), "SELECT path, name FROM (SELECT DISTINCT path, name, kind FROM symbols a WHERE view_id = 'main' AND NOT EXISTS (SELECT 1 FROM symbols b WHERE b.view_id = 'next' AND b.path = a.path AND b.name = a.name AND b.kind = a.kind))")


# --- knowledge -----------------------------------------------------------


def _kinds(spark: SparkSession, sf: str) -> DataFrame:
    """The orders as records of every kind that bears knowledge."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("memory_tier", "topic", "ticket", "ticket_event", "checkpoint")]), (F.col("k") % 5 + 1).cast("int"))
    tier = F.to_json(F.struct(F.col("clerk").alias("name"), F.concat(F.lit("  one \n\n\n\n"), "prio", F.lit("\n\n ")).alias("content")))
    topic = F.to_json(F.struct(F.col("clerk").alias("slug"), F.when(_by(2), F.array("prio", "status")).otherwise(F.array().cast("array<string>")).alias("bullets")))
    ticket = F.to_json(F.struct(F.col("clerk").alias("title"), F.array("status", F.lit("x")).alias("labels"), F.struct(F.concat("prio", F.lit("\n\nend")).alias("markdown")).alias("body")))
    event = F.to_json(F.struct(F.col("prio").alias("body")))
    body = F.when(kind == "memory_tier", tier).when(kind == "topic", topic).when(kind == "ticket", ticket).when(kind == "ticket_event", event).otherwise("opaque")
    return _orders(spark, sf).select(F.lit("ns").alias("namespace"), kind.alias("collection"), F.col("k").cast("string").alias("id"), kind.alias("kind"), body.alias("body"))


_PIECES = _O + """, c AS (SELECT k, CASE k % 5 WHEN 0 THEN [clerk || chr(10) || 'one', prio] WHEN 1 THEN CASE WHEN k % 2 = 0 THEN [clerk || chr(10) || prio, status] ELSE [clerk] END
  WHEN 2 THEN [clerk || chr(10) || status || ' x', prio, 'end'] WHEN 3 THEN [prio] END AS pieces FROM o WHERE k % 5 <> 4)
"""
_register("chunk_kinds", lambda s, d: knowledge.chunk(_kinds(s, d)).select("id", "ordinal", "chunk_id", "text"), (), _PIECES + "SELECT k::VARCHAR AS id, unnest(range(len(pieces)))::INT AS ordinal, k || chr(31) || unnest(range(len(pieces))) AS chunk_id, unnest(pieces) AS text FROM c")
_register("chunk_parents", lambda s, d: knowledge.chunk(_kinds(s, d)).select("chunk_id", text.parent_of_chunk("chunk_id").alias("p")).select("chunk_id", "p.*"), (), _PIECES + "SELECT k || chr(31) || unnest(range(len(pieces))) AS chunk_id, k::VARCHAR AS id, unnest(range(len(pieces))) AS ordinal FROM c")
_register("knowledge_text", lambda s, d: knowledge.knowledge_text(_kinds(s, d).where("kind <> 'checkpoint'")).select("id", "text"), (), _PIECES + "SELECT k::VARCHAR AS id, array_to_string(pieces, chr(10)) AS text FROM c")


def _replaced(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks after some records were shortened to one chunk and some removed."""
    rows = _kinds(spark, sf)
    chunks = knowledge.chunk(rows)
    shorter = rows.where("kind = 'memory_tier'").withColumn("body", F.lit('{"name": "n", "content": ""}'))
    kept = knowledge.remove(knowledge.remove(chunks, shorter), rows.where("kind = 'topic'"))
    return kept.unionByName(knowledge.chunk(shorter)).select("id", "ordinal", "text")


_register("knowledge_replace", _replaced, (), _PIECES + "SELECT k::VARCHAR AS id, unnest(range(len(pieces)))::INT AS ordinal, unnest(pieces) AS text FROM c WHERE k % 5 NOT IN (0, 1) UNION ALL SELECT k::VARCHAR, 0, 'n' FROM c WHERE k % 5 = 0")
_register("rich_text", lambda s, d: _orders(s, d).select("k", text.rich_text(F.to_json(F.struct(F.lit("doc").alias("type"), F.array(*[F.struct(F.lit(kind).alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.col(c).alias("text"))).alias("content")) for kind, c in (("heading", "clerk"), ("paragraph", "prio"), ("paragraph", "status"))]).alias("content")))).alias("text")), (), _O + "SELECT k, clerk || chr(10) || prio || chr(10) || status AS text FROM o")


# --- trackers ------------------------------------------------------------


def _flat(df: DataFrame) -> DataFrame:
    who = F.array_join(F.transform("actors", lambda a: F.concat(a["role"], F.lit(":"), a["handle"])), ",")
    where = F.array_join(F.transform("containers", lambda c: F.concat(c["kind"], F.lit(":"), F.coalesce(c["id"], F.lit("-")), F.lit(":"), c["primary"].cast("string"))), ",")
    return df.select("provider", "uid", "display", "item_type", "title", "state.category", "state.resolution", "state.raw_name", "priority.level", who.alias("actors"), F.array_join("labels", ",").alias("labels"), where.alias("containers"), F.col("body.markdown").alias("markdown"), F.col("body.format").alias("format"))


def _named(key: str, value: Column) -> Column:
    return F.struct(value.alias(key))


def _github(spark: SparkSession, sf: str) -> DataFrame:
    rows = _orders(spark, sf).select(
        F.col("k").alias("number"), F.lit("N").alias("node_id"), F.col("clerk").alias("title"), F.when(~_by(3), F.col("prio")).alias("body"),
        F.when(F.col("status") == "O", "open").otherwise("closed").alias("state"), F.when(F.col("status") == "P", "not_planned").when(F.col("status") == "F", "completed").alias("state_reason"),
        F.array(_named("name", F.col("status")), _named("name", F.col("prio"))).alias("labels"), F.array(_named("login", F.col("clerk"))).alias("assignees"), F.when(~_by(4), _named("login", F.col("prio"))).alias("user"),
        F.lit("http://h/1").alias("html_url"), F.when(_by(10), _named("url", F.lit("p"))).alias("pull_request"),
    )
    return _flat(tickets.github_issues(rows, "acme/shop"))


_register("ticket_github", _github, (), _O + """
SELECT 'GitHub' AS provider, 'acme/shop#' || k AS uid, '#' || k AS display, 'issue' AS item_type, clerk AS title, CASE status WHEN 'P' THEN 'Canceled' WHEN 'F' THEN 'Done' ELSE 'Open' END AS category,
  CASE status WHEN 'P' THEN 'WontDo' WHEN 'F' THEN 'Done' END AS resolution, CASE status WHEN 'O' THEN 'open' ELSE 'closed' END AS raw_name, NULL::VARCHAR AS level,
  'Assignee:' || clerk || CASE WHEN k % 4 <> 0 THEN ',Submitter:' || prio ELSE '' END AS actors, status || ',' || prio AS labels, 'repo:acme/shop:true' AS containers, CASE WHEN k % 3 = 0 THEN '' ELSE prio END AS markdown, 'Markdown' AS format
FROM o WHERE k % 10 <> 0""")


def _board(spark: SparkSession, sf: str) -> DataFrame:
    content = F.struct(
        F.when(_by(10), "PullRequest").otherwise("Issue").alias("__typename"), F.when(~_by(11), F.col("k")).alias("number"), F.col("clerk").alias("title"), F.col("prio").alias("body"), _named("nameWithOwner", F.lit("acme/shop")).alias("repository"),
        _named("nodes", F.array(_named("name", F.col("status")))).alias("labels"), _named("nodes", F.array(_named("login", F.col("clerk")))).alias("assignees"), _named("login", F.col("prio")).alias("author"),
    )
    rows = _orders(spark, sf).select(content.alias("content"), F.when(~_by(6), F.struct(F.lower("status").alias("name"), F.lit("o").alias("optionId"))).alias("fieldValueByName"))
    return _flat(tickets.github_project_items(rows, {"values": {"O": "Open", "F": "Done"}, "default": "Triage"}))


_register("ticket_github_project", _board, (), _O + """
SELECT 'GitHub' AS provider, 'acme/shop#' || k AS uid, '#' || k AS display, 'issue' AS item_type, clerk AS title, CASE WHEN k % 6 = 0 THEN 'Triage' WHEN status = 'O' THEN 'Open' WHEN status = 'F' THEN 'Done' ELSE 'Triage' END AS category,
  NULL::VARCHAR AS resolution, CASE WHEN k % 6 = 0 THEN '' ELSE lower(status) END AS raw_name, NULL::VARCHAR AS level, 'Assignee:' || clerk || ',Submitter:' || prio AS actors, status AS labels, 'repo:acme/shop:true' AS containers, prio AS markdown, 'Markdown' AS format
FROM o WHERE k % 10 <> 0 AND k % 11 <> 0""")


def _jira(spark: SparkSession, sf: str) -> DataFrame:
    step = F.when(F.col("status") == "F", "done").when(F.col("status") == "P", "indeterminate").otherwise("new")
    adf = F.to_json(F.struct(F.lit("doc").alias("type"), F.array(F.struct(F.lit("paragraph").alias("type"), F.array(_named("text", F.col("prio"))).alias("content"))).alias("content")))
    level = F.element_at(F.array(*[F.lit(x) for x in ("Highest", "High", "odd", "Low", "Trivial")]), (F.col("k") % 5 + 1).cast("int"))
    why = F.element_at(F.array(*[F.lit(x) for x in ("Done", "Won't Fix", "Odd")]), (F.col("k") % 3 + 1).cast("int"))
    person = lambda c: F.struct(F.when(_by(2), F.lit("acc")).alias("accountId"), F.col(c).alias("displayName"))
    fields = F.struct(
        F.col("clerk").alias("summary"), adf.alias("description"), F.struct(F.when(_by(7), "Blocked").otherwise("Review").alias("name"), F.lit("1").alias("id"), _named("key", step).alias("statusCategory")).alias("status"),
        F.when(~_by(8), _named("name", F.lit("Bug"))).alias("issuetype"), F.when(~_by(9), _named("name", level)).alias("priority"), person("clerk").alias("assignee"), F.when(~_by(4), person("prio")).alias("reporter"),
        F.array("status").alias("labels"), F.when(~_by(12), F.struct(F.lit("P").alias("key"), F.lit("Proj").alias("name"))).alias("project"), F.when(F.col("status") == "F", _named("name", why)).alias("resolution"),
    )
    rows = _orders(spark, sf).select(F.concat(F.lit("P-"), F.col("k").cast("string")).alias("key"), F.col("k").cast("string").alias("id"), fields.alias("fields"))
    return _flat(tickets.jira_issues(rows, {"values": {"Blocked": "Pending"}, "default": "Open"}))


_register("ticket_jira", _jira, (), _O + """
SELECT 'Jira' AS provider, 'P-' || k AS uid, 'P-' || k AS display, CASE WHEN k % 8 = 0 THEN 'issue' ELSE 'Bug' END AS item_type, clerk AS title, CASE WHEN k % 7 = 0 THEN 'Pending' WHEN status = 'F' THEN 'Done' WHEN status = 'P' THEN 'InProgress' ELSE 'Open' END AS category,
  CASE WHEN status = 'F' THEN CASE k % 3 WHEN 0 THEN 'Done' WHEN 1 THEN 'WontDo' ELSE 'Odd' END END AS resolution, CASE WHEN k % 7 = 0 THEN 'Blocked' ELSE 'Review' END AS raw_name,
  CASE WHEN k % 9 <> 0 THEN CASE k % 5 WHEN 0 THEN 'Urgent' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Medium' ELSE 'None' END END AS level,
  'Assignee:' || CASE WHEN k % 2 = 0 THEN 'acc' ELSE clerk END || CASE WHEN k % 4 = 0 THEN '' ELSE ',Submitter:' || CASE WHEN k % 2 = 0 THEN 'acc' ELSE prio END END AS actors, status AS labels,
  CASE WHEN k % 12 = 0 THEN '' ELSE 'project:P:true' END AS containers, prio AS markdown, 'Adf' AS format FROM o""".replace("WHEN 2 THEN 'Medium' WHEN 3 THEN 'Medium'", "WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low'"))


def _linear(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("status") == "F", "completed").when(F.col("status") == "P", "started").otherwise("unstarted")
    who = lambda c: _named("displayName", F.col(c))
    rows = _orders(spark, sf).select(
        F.col("k").cast("string").alias("id"), F.concat(F.lit("E-"), F.col("k").cast("string")).alias("identifier"), F.col("clerk").alias("title"), F.col("prio").alias("description"), (F.col("k") % 6).cast("int").alias("priority"),
        F.struct(F.when(_by(7), "Later").otherwise("Doing").alias("name"), kind.alias("type")).alias("state"), F.when(~_by(4), who("clerk")).alias("assignee"), who("prio").alias("creator"), _named("nodes", F.array(_named("name", F.col("status")))).alias("labels"),
        F.when(~_by(5), F.struct(F.lit("E").alias("key"), F.lit("Eng").alias("name"))).alias("team"), F.when(~_by(3), _named("name", F.lit("Q"))).alias("project"),
    )
    return _flat(tickets.linear_issues(rows, {"values": {"Later": "Backlog"}, "default": "Open"}))


_register("ticket_linear", _linear, (), _O + """
SELECT 'Linear' AS provider, k::VARCHAR AS uid, 'E-' || k AS display, 'issue' AS item_type, clerk AS title, CASE WHEN k % 7 = 0 THEN 'Backlog' WHEN status = 'F' THEN 'Done' WHEN status = 'P' THEN 'InProgress' ELSE 'Open' END AS category,
  NULL::VARCHAR AS resolution, CASE WHEN k % 7 = 0 THEN 'Later' ELSE 'Doing' END AS raw_name, CASE k % 6 WHEN 1 THEN 'Urgent' WHEN 2 THEN 'High' WHEN 3 THEN 'Medium' WHEN 4 THEN 'Low' ELSE 'None' END AS level,
  CASE WHEN k % 4 = 0 THEN '' ELSE 'Assignee:' || clerk || ',' END || 'Submitter:' || prio AS actors, status AS labels,
  concat_ws(',', CASE WHEN k % 5 <> 0 THEN 'team:E:true' END, CASE WHEN k % 3 <> 0 THEN 'project:Q:false' END) AS containers, prio AS markdown, 'Markdown' AS format FROM o""")


def _gitlab(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(_by(3), F.array("status")).otherwise(F.array(F.col("status"), F.concat(F.lit("flow::"), F.when(_by(2), "doing").otherwise("else"))))
    rows = _orders(spark, sf).select(
        F.col("k").alias("iid"), F.col("clerk").alias("title"), F.col("prio").alias("description"), F.when(F.col("status") == "F", "closed").otherwise("opened").alias("state"), label.alias("labels"),
        F.array(_named("username", F.col("clerk"))).alias("assignees"), _named("username", F.col("prio")).alias("author"), F.when(_by(4), "incident").alias("issue_type"), F.when(_by(5), _named("full", F.concat(F.lit("x/y#"), F.col("k").cast("string")))).alias("references"),
    )
    return _flat(tickets.gitlab_issues(rows, "g/p", {"values": {"Doing": "InProgress"}, "default": "Backlog", "signal": ("scoped_label", "flow::")}))


_register("ticket_gitlab", _gitlab, (), _O + """, g AS (SELECT *, CASE WHEN k % 3 <> 0 THEN 'flow::' || CASE WHEN k % 2 = 0 THEN 'doing' ELSE 'else' END END AS flow FROM o)
SELECT 'GitLab' AS provider, CASE WHEN k % 5 = 0 THEN 'x/y#' ELSE 'g/p#' END || k AS uid, '#' || k AS display, CASE WHEN k % 4 = 0 THEN 'incident' ELSE 'issue' END AS item_type, clerk AS title,
  CASE WHEN status = 'F' THEN 'Done' WHEN flow IS NULL THEN 'Open' WHEN flow = 'flow::doing' THEN 'InProgress' ELSE 'Backlog' END AS category, NULL::VARCHAR AS resolution, CASE WHEN status = 'F' THEN 'closed' ELSE coalesce(flow, 'opened') END AS raw_name, NULL::VARCHAR AS level,
  'Assignee:' || clerk || ',Submitter:' || prio AS actors, concat_ws(',', status, flow) AS labels, 'project:g/p:true' AS containers, prio AS markdown, 'Markdown' AS format FROM g""")


def _asana(spark: SparkSession, sf: str) -> DataFrame:
    place = lambda p, s: F.struct(F.when(p, F.struct(F.lit("p").alias("gid"), F.lit("Q3").alias("name"))).alias("project"), _named("name", s).alias("section"))
    rows = _orders(spark, sf).select(
        F.col("k").cast("string").alias("gid"), F.col("clerk").alias("name"), F.col("prio").alias("notes"), F.when(_by(4), "<b>").alias("html_notes"), (F.col("status") == "F").alias("completed"), _named("name", F.col("clerk")).alias("assignee"), F.when(~_by(3), _named("name", F.col("prio"))).alias("created_by"),
        F.array(place(~_by(2), F.when(_by(5), "Doing").otherwise("Else")), place(F.lit(True), F.lit("x"))).alias("memberships"), F.array(F.struct(F.lit("f").alias("gid"), F.lit(None).cast("struct<name: string>").alias("enum_value"), F.lit("late").alias("display_value"))).alias("custom_fields"),
        F.array(_named("name", F.col("status"))).alias("tags"), F.lit(None).cast("string").alias("permalink_url"),
    )
    return _flat(tickets.asana_tasks(rows, {"values": {"Doing": "InProgress"}, "default": "Backlog", "signal": "section"}))


_register("ticket_asana", _asana, (), _O + """
SELECT 'Asana' AS provider, k::VARCHAR AS uid, k::VARCHAR AS display, 'task' AS item_type, clerk AS title, CASE WHEN k % 5 = 0 THEN 'InProgress' ELSE 'Backlog' END AS category, NULL::VARCHAR AS resolution, CASE WHEN k % 5 = 0 THEN 'Doing' ELSE 'Else' END AS raw_name, NULL::VARCHAR AS level,
  'Assignee:' || clerk || CASE WHEN k % 3 = 0 THEN '' ELSE ',Submitter:' || prio END AS actors, status AS labels, CASE WHEN k % 2 = 0 THEN '' ELSE 'project:p:true,' END || 'project:p:false' AS containers, prio AS markdown, CASE WHEN k % 4 = 0 THEN 'Html' ELSE 'PlainText' END AS format FROM o""")


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    place = lambda id, first: F.struct(F.lit("p").alias("kind"), F.lit(id).alias("id"), F.lit(None).cast("string").alias("name"), first.alias("primary"))
    rows = _orders(spark, sf).select(F.col("k").cast("string").alias("uid"), F.when(~_by(5), F.col("clerk")).alias("display"), F.when(_by(7), "").otherwise("issue").alias("item_type"), _named("raw_name", F.col("status")).alias("state"), F.array(place("a", F.lit(True)), place("b", _by(3))).alias("containers"))
    return tickets.violations(rows)


_register("ticket_violations", _broken, (), _O + "SELECT k::VARCHAR AS uid, 'display is empty' AS problem FROM o WHERE k % 5 = 0 UNION ALL SELECT k::VARCHAR, 'item_type is empty' FROM o WHERE k % 7 = 0 UNION ALL SELECT k::VARCHAR, 'more than one primary container' FROM o WHERE k % 3 = 0")
_register("ticket_uids", lambda s, d: spark_view(s, d, "tickets").select("uid", tickets.scoped_uid(F.col("uid"), "board").alias("scoped"), tickets.provider_slug(F.when(F.col("priority") == "Low", "AzureDevOps").otherwise("Odd")).alias("slug")), ("tickets",), "SELECT uid, 'board/' || uid AS scoped, CASE WHEN priority = 'Low' THEN 'azure-devops' ELSE 'odd' END AS slug FROM tickets")


# --- audits and listings -------------------------------------------------


def _lost(spark: SparkSession, sf: str) -> DataFrame:
    rows = _orders(spark, sf).select(F.col("prio").alias("key"), F.col("k").alias("op_id"), F.when(_by(4), "conflict").otherwise("committed").alias("result"))
    there = rows.where("result = 'committed' AND op_id % 9 <> 0").select("key", "op_id")
    return sync.update_violations(rows, there.union(there.where("op_id % 10 = 1")))


_register("update_violations", _lost, (), _O + "SELECT prio AS key, k AS op_id, CASE WHEN k % 9 = 0 THEN 'lost' ELSE 'repeated' END AS problem FROM o WHERE k % 4 <> 0 AND (k % 9 = 0 OR k % 10 = 1)")
_register("view_folders", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", keys.view_folder(F.concat(F.lit("org/"), "p_brand"), F.lit("v1.0")).alias("folder")), (), "SELECT p_partkey, 'org%2F' || replace(replace(p_brand, '#', '%23'), ' ', '%20') || '/v1%2E0.db' AS folder FROM part")


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    rows = _orders(spark, sf).select("k", F.concat(F.lit("f"), F.col("k").cast("string")).alias("path"), F.length("prio").cast("long").alias("length"), F.timestamp_seconds(F.col("k")).alias("modified"))
    after = rows.where(~_by(7)).withColumn("modified", F.when(_by(5), F.timestamp_seconds(F.col("k") + 1)).otherwise(F.col("modified")))
    return tree_changes(rows.where(~_by(3)), after)


_register("tree_changes", _listed, (), _O + "SELECT 'f' || k AS path, CASE WHEN k % 3 = 0 THEN 'added' WHEN k % 7 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM o WHERE (k % 3 = 0) <> (k % 7 = 0) OR (k % 3 <> 0 AND k % 7 <> 0 AND k % 5 = 0)")
_register("principal_read", lambda s, d: keys.Principal("p", ("ns", "x"), ()).readable(_orders(s, d).select("k", F.when(_by(3), "secret").when(_by(2), "ns").otherwise("x").alias("namespace"))), (), _O + "SELECT k, CASE WHEN k % 2 = 0 THEN 'ns' ELSE 'x' END AS namespace FROM o WHERE k % 3 <> 0")
_register("walk_folders", lambda s, d: _paths(s, d).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct().where(text.should_descend("folder", ["vendor/keep/deep"])), (), _PATHS + "SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM p WHERE k % 6 IN (0, 3, 5)")
