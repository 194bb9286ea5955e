"""The registered queries and, for each that SQL can express, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys, text, tickets
from .functions.vectors import l2_normalize
from .operators import graph, knowledge, manifest, store, sync, vector
from .operators.tickets import summary, upsert_outcomes
from .plans.views import spark_view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, query: Query, views: tuple[str, ...] = (), oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        lead = with_views(*views) if views else ""
        joint = (",\n" if oracle.lstrip().startswith(",") else "\n") if views else ""
        ORACLE_SQL[name] = lead + joint + oracle.lstrip().lstrip(",")


def _on(*views: str):
    """A query as a function of the named views."""

    def wrap(f: Callable[..., DataFrame]) -> Query:
        return lambda spark, sf: f(*(spark_view(spark, sf, v) for v in views))

    return wrap


def _main(df: DataFrame, view: str = "main") -> DataFrame:
    return df.where(F.col("view_id") == view)


# --- vectors -------------------------------------------------------------

def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    return list(spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id = 0").first()["embedding"])


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_COS = f"coalesce(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 0)"

_register("vector_topk", lambda s, d: _rounded(vector.topk(spark_view(s, d, "vectors"), _query_vector(s, d), 10)), ("vectors",), f"SELECT namespace, collection, id, round({_COS}, 6) AS score FROM vectors ORDER BY {_COS} DESC, id LIMIT 10")
_register("vector_topk_prefix", lambda s, d: _rounded(vector.topk(spark_view(s, d, "vectors"), _query_vector(s, d), 10, "emb", "l3")), ("vectors",), f"SELECT namespace, collection, id, round({_COS}, 6) AS score FROM vectors WHERE collection = 'l3' ORDER BY {_COS} DESC, id LIMIT 10")
_register("vector_topk_each", lambda s, d: _rounded(vector.topk_each(spark_view(s, d, "vectors"), s.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 5)), ("vectors",), """
SELECT query_id, namespace, collection, id, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id AS query_id, v.namespace, v.collection, v.id, s.score, row_number() OVER (PARTITION BY q.vec_id ORDER BY s.score DESC, v.collection, v.id) AS rank
  FROM embeddings q CROSS JOIN vectors v CROSS JOIN LATERAL (SELECT list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score) s WHERE q.vec_id % 50 = 0)
WHERE rank <= 5""")

# every row asks, where vector_topk_each asks for every fiftieth
_register("vector_topk_every", lambda s, d: _rounded(vector.topk_each(spark_view(s, d, "vectors"), s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 5)), ("vectors",), """
SELECT query_id, namespace, collection, id, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id AS query_id, v.namespace, v.collection, v.id, s.score, row_number() OVER (PARTITION BY q.vec_id ORDER BY s.score DESC, v.collection, v.id) AS rank
  FROM embeddings q CROSS JOIN vectors v CROSS JOIN LATERAL (SELECT list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score) s)
WHERE rank <= 5""")


def _approximate(spark: SparkSession, sf: str) -> DataFrame:
    query = _query_vector(spark, sf)
    return _rounded(vector.HashedIndex(spark_view(spark, sf, "vectors"), len(query)).topk(query, 10))


_register("vector_topk_approximate", _approximate)
_register("vector_normalize", lambda s, d: spark_view(s, d, "vectors").select("id", F.round(F.get(l2_normalize(F.col("embedding")), F.lit(0)).cast("double"), 5).alias("first")), ("vectors",), "SELECT id, round((embedding[1]::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12))::FLOAT::DOUBLE, 5) AS first FROM vectors")


# --- knowledge -----------------------------------------------------------

def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark_view(spark, sf, "chunk_vectors")
    return rows.select("namespace", "collection", F.col("parent_id").alias("id"), "ordinal", text.chunk_id("parent_id", "ordinal").alias("chunk_id"), F.concat_ws("/", "parent_id", F.col("ordinal").cast("string")).alias("text"), "embedding")


_SCORED = f", scored AS (SELECT namespace, collection, parent_id, ordinal, concat(parent_id, chr(31), ordinal::VARCHAR) AS chunk_id, {_COS} AS score FROM chunk_vectors)"
_BEST = "SELECT namespace, collection, parent_id AS id, round(max(score), 6) AS score FROM {t} GROUP BY 1, 2, 3 ORDER BY max(score) DESC, parent_id LIMIT 10"
_HITS = ", hits AS (SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT 80)"
_register("knowledge_topk", lambda s, d: _rounded(knowledge.query(_chunks(s, d), _query_vector(s, d), 10)), ("chunk_vectors",), _SCORED + _HITS + _BEST.format(t="hits"))
_register("knowledge_topk_exact", lambda s, d: _rounded(knowledge.query(_chunks(s, d), _query_vector(s, d), 10, overfetch=None)), ("chunk_vectors",), _SCORED + _BEST.format(t="scored"))
_register("knowledge_chunks", lambda s, d: _rounded(knowledge.query_chunks(_chunks(s, d), _query_vector(s, d), 10).drop("chunk_id")), ("chunk_vectors",), _SCORED + "SELECT namespace, collection, parent_id AS id, ordinal, concat(parent_id, '/', ordinal::VARCHAR) AS text, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, chunk_id LIMIT 10")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each parent calls the next even one: a fixed small call graph."""
    p = _chunks(spark, sf).select("id").distinct()
    number = F.substr("id", F.lit(2)).cast("int")
    return p.select(F.col("id").alias("from_fn"), F.concat(F.lit("p"), F.lpad(F.floor(number / 8).cast("string"), 4, "0")).alias("name"))


_register("knowledge_in_subgraph", lambda s, d: _rounded(knowledge.query_in_subgraph(_chunks(s, d), _edges(s, d), "p0003", _query_vector(s, d), 60)), ("chunk_vectors",), _SCORED + """
, hits AS (SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT 480)
, best AS (SELECT namespace, collection, parent_id AS id, max(score) AS score FROM hits GROUP BY 1, 2, 3 ORDER BY score DESC, id LIMIT 60)
, edges AS (SELECT DISTINCT parent_id AS from_fn, concat('p', lpad((substr(parent_id, 2)::INT // 8)::VARCHAR, 4, '0')) AS name FROM chunk_vectors)
SELECT namespace, collection, id, round(score, 6) AS score FROM best
WHERE id IN (SELECT 'p0003' UNION ALL SELECT from_fn FROM edges WHERE name = 'p0003' UNION ALL SELECT name FROM edges WHERE from_fn = 'p0003')""")


def _session_records(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    body = F.to_json(F.struct(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("name"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")))
    return turns.select(F.lit("ns").alias("namespace"), F.lit("session").alias("collection"), F.col("conv_id").cast("string").alias("id"), F.lit("session").alias("kind"), body.alias("body"))


_register("chunk_sessions", lambda s, d: knowledge.chunk(_session_records(s, d)).select(F.col("id").cast("long").alias("conv_id"), F.col("ordinal").cast("long").alias("ordinal"), F.col("text").alias("chunk_text")), ("sessions",), "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY ordinal) - 1) AS ordinal, chunk_text FROM sessions")


def _paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("text").isNotNull())
    loose = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return docs.select("doc_id", F.posexplode(text.split_paragraphs(loose)).alias("ordinal", "piece"))


_register("chunk_paragraphs", _paragraphs, (), r"""
WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: regexp_replace(x, '^[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')), lambda x: x <> '')) AS piece,
  generate_subscripts(list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: regexp_replace(x, '^[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')), lambda x: x <> ''), 1) - 1 AS ordinal FROM documents)
SELECT doc_id, ordinal, piece FROM p""")

# --- code graph ----------------------------------------------------------

_S = ["path", "seq", "name", "kind", "start_line", "end_line"]
_SC = ", ".join(_S)
_RC = "path, seq, name, from_fn, line"
_register("graph_definitions", _on("symbols")(lambda s: graph.definitions(_main(s), "f12").select(*_S)), ("symbols",), f"SELECT {_SC} FROM symbols WHERE view_id = 'main' AND name = 'f12'")
_register("graph_references", _on("refs")(lambda r: graph.references_to(_main(r), "f12").select("path", "seq", "name", "from_fn", "line")), ("refs",), f"SELECT {_RC} FROM refs WHERE view_id = 'main' AND name = 'f12'")
_register("graph_symbols_in_file", _on("symbols")(lambda s: graph.symbols_in_file(_main(s), "src/click.rs").select(*_S)), ("symbols",), f"SELECT {_SC} FROM symbols WHERE view_id = 'main' AND path = 'src/click.rs'")
_register("graph_all_symbols", _on("symbols")(lambda s: _main(s).select(*_S)), ("symbols",), f"SELECT {_SC} FROM symbols WHERE view_id = 'main'")
_register("graph_all_references", _on("refs")(lambda r: _main(r).select("path", "seq", "name", "from_fn", "line")), ("refs",), f"SELECT {_RC} FROM refs WHERE view_id = 'main'")
_register("graph_callers", _on("refs")(lambda r: graph.callers(_main(r), "f12")), ("refs",), "SELECT DISTINCT from_fn AS name FROM refs WHERE view_id = 'main' AND name = 'f12' AND from_fn IS NOT NULL")
_register("graph_callees", _on("refs")(lambda r: graph.callees(_main(r), "f12")), ("refs",), "SELECT DISTINCT name FROM refs WHERE view_id = 'main' AND from_fn = 'f12'")
_register("graph_neighborhood", _on("refs")(lambda r: graph.neighborhood(_main(r), "f12")), ("refs",), "SELECT 'f12' AS name UNION SELECT from_fn FROM refs WHERE view_id = 'main' AND name = 'f12' AND from_fn IS NOT NULL UNION SELECT name FROM refs WHERE view_id = 'main' AND from_fn = 'f12'")
_register("graph_impact", _on("call_tree")(lambda r: graph.impact(r, "c5")), ("call_tree",), ", i AS (SELECT 'c5' AS name UNION SELECT t.from_fn FROM i JOIN call_tree t ON t.name = i.name) SELECT name FROM i WHERE name <> 'c5'")
_register("graph_overview_totals", _on("symbols", "refs")(lambda s, r: graph.totals(_main(s), _main(r))), ("symbols", "refs"), "SELECT (SELECT count(*) FROM symbols WHERE view_id = 'main') AS symbols, (SELECT count(*) FROM refs WHERE view_id = 'main') AS \"references\", (SELECT count(*) FROM (SELECT path FROM symbols WHERE view_id = 'main' UNION SELECT path FROM refs WHERE view_id = 'main')) AS files")
_register("graph_overview_by_kind", _on("symbols")(lambda s: graph.by_kind(_main(s))), ("symbols",), "SELECT kind, count(*) AS n FROM symbols WHERE view_id = 'main' GROUP BY kind")
_register("graph_overview_by_language", _on("symbols")(lambda s: graph.by_language(_main(s))), ("symbols",), "SELECT CASE split_part(path, '.', -1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' ELSE 'unknown' END AS language, count(*) AS n FROM symbols WHERE view_id = 'main' GROUP BY 1")
_register("graph_overview_largest", _on("symbols")(lambda s: graph.largest_files(_main(s), 10)), ("symbols",), "SELECT path, count(*) AS n FROM symbols WHERE view_id = 'main' GROUP BY path ORDER BY n DESC, path LIMIT 10")


def _top(ranking: str) -> Query:
    return _on("symbols", "refs")(lambda s, r: graph.top(_main(s), _main(r), ranking).withColumn("paths", F.array_join("paths", ",")))


_TOP = ", b AS (SELECT name, score FROM t ORDER BY score DESC, name LIMIT 20) SELECT b.name, b.score, coalesce((SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT DISTINCT path FROM symbols s WHERE s.view_id = 'main' AND s.name = b.name)), '') AS paths FROM b"
_register("graph_top_fan_in", _top("fan_in"), ("symbols", "refs"), ", t AS (SELECT name, count(*) AS score FROM refs WHERE view_id = 'main' GROUP BY name)" + _TOP)
_register("graph_top_fan_out", _top("fan_out"), ("symbols", "refs"), ", t AS (SELECT from_fn AS name, count(DISTINCT name) AS score FROM refs WHERE view_id = 'main' AND from_fn IS NOT NULL GROUP BY from_fn)" + _TOP)
_register("graph_top_definitions", _top("definitions"), ("symbols", "refs"), ", t AS (SELECT name, count(DISTINCT path) AS score FROM symbols WHERE view_id = 'main' GROUP BY name)" + _TOP)
_register("graph_list_filtered", _on("symbols")(lambda s: graph.list_symbols(_main(s), graph.SymbolFilter("src/brand1", "struct", "f1")).items.select(*_S)), ("symbols",), f"SELECT {_SC} FROM symbols WHERE view_id = 'main' AND starts_with(path, 'src/brand1') AND kind = 'struct' AND contains(name, 'f1') ORDER BY path, seq LIMIT 100")
_DEAD = "SELECT path, seq, name, kind, start_line, end_line FROM symbols s WHERE view_id = 'main' AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.view_id = 'main' AND r.name = s.name)"
_register("graph_unreferenced_with_tests", _on("symbols", "refs")(lambda s, r: graph.unreferenced(_main(s), _main(r), exclude_tests=False).select(*_S)), ("symbols", "refs"), _DEAD)
_register("graph_unreferenced", _on("symbols", "refs")(lambda s, r: graph.unreferenced(_main(s), _main(r)).select(*_S)), ("symbols", "refs"), _DEAD + " AND NOT list_contains(string_split(path, '/'), 'tests') AND NOT EXISTS (SELECT 1 FROM symbols m WHERE m.view_id = 'main' AND m.kind = 'module' AND m.name IN ('tests', 'test') AND m.path = s.path AND s.start_line >= m.start_line AND s.end_line <= m.end_line)")
_RESOLVED = """, h AS (SELECT DISTINCT name, path FROM symbols WHERE view_id = 'main'), n AS (SELECT name, count(*) AS homes, min(path) AS only FROM h GROUP BY name),
x AS (SELECT r.path, r.seq, r.name, r.from_fn, r.line, CASE WHEN h.path IS NOT NULL THEN 'local' WHEN n.homes IS NULL THEN 'unresolved' WHEN n.homes = 1 THEN 'unique' ELSE 'ambiguous' END AS resolution,
      CASE WHEN h.path IS NOT NULL THEN r.path WHEN n.homes = 1 THEN n.only END AS target
      FROM refs r LEFT JOIN n ON n.name = r.name LEFT JOIN h ON h.name = r.name AND h.path = r.path WHERE r.view_id = 'main')"""
_register("graph_resolve", _on("symbols", "refs")(lambda s, r: graph.resolve(_main(s), _main(r)).drop("repo", "view_id")), ("symbols", "refs"), _RESOLVED + " SELECT * FROM x")
_register("graph_resolved_callers", _on("symbols", "refs")(lambda s, r: graph.resolved_callers(_main(s), _main(r), "src/click.rs", "f33")), ("symbols", "refs"), _RESOLVED + " SELECT DISTINCT from_fn AS name FROM x WHERE name = 'f33' AND target = 'src/click.rs' AND from_fn IS NOT NULL")


def _diff(view: str, key: list[str], change: str) -> Query:
    return _on(view)(lambda v: graph.diff(_main(v), _main(v, "next"), key).where(F.col("change") == change).select(*key, "seq"))


for _change, _a, _b in (("removed", "main", "next"), ("added", "next", "main")):
    _register(f"graph_diff_symbols_{_change}", _diff("symbols", graph.SYMBOL_KEY, _change), ("symbols",), f"SELECT path, name, kind, min(seq) AS seq FROM symbols a WHERE view_id = '{_a}' AND NOT EXISTS (SELECT 1 FROM symbols b WHERE b.view_id = '{_b}' AND b.path = a.path AND b.name = a.name AND b.kind = a.kind) GROUP BY 1, 2, 3")
    _register(f"graph_diff_refs_{_change}", _diff("refs", graph.REF_KEY, _change), ("refs",), f"SELECT path, from_fn, name, min(seq) AS seq FROM refs a WHERE view_id = '{_a}' AND NOT EXISTS (SELECT 1 FROM refs b WHERE b.view_id = '{_b}' AND b.path = a.path AND b.name = a.name AND b.from_fn IS NOT DISTINCT FROM a.from_fn) GROUP BY 1, 2, 3")


def _assembled(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols to slices, slices to blobs, and back through the manifest."""
    s = _main(spark_view(spark, sf, "symbols"))
    entry = F.struct("seq", F.struct("name", "kind", "start_line", "end_line").alias("x"))
    slices = s.groupBy("repo", "view_id", "path").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    slices = slices.withColumn("content", F.to_json(F.struct(F.col("e.x").alias("symbols"), F.array().alias("references"))))
    slices = slices.withColumn("hash", keys.content_hash("content"))
    blobs = slices.select("hash", F.col("content").cast("binary").alias("content")).dropDuplicates(["hash"])
    return graph.assemble(slices.select("repo", "view_id", "path", "hash"), blobs)[0].drop("repo", "view_id")


_register("graph_assemble", _assembled, ("symbols",), "SELECT path, (row_number() OVER (PARTITION BY path ORDER BY seq, name) - 1)::INT AS seq, name, kind, start_line, end_line FROM symbols WHERE view_id = 'main'")

# --- manifests and blobs -------------------------------------------------

_PAIR = "(SELECT path, hash FROM manifest WHERE view_id = 'a') a FULL JOIN (SELECT path, hash FROM manifest WHERE view_id = 'b') b ON a.path = b.path"
_register("manifest_reconcile", _on("manifest")(lambda m: manifest.reconcile(_main(m, "a"), _main(m, "b")).select("path", "change")), ("manifest",), f"SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.hash <> b.hash THEN 'modified' ELSE 'unchanged' END AS change FROM {_PAIR}")
_register("manifest_body", _on("manifest")(lambda m: manifest.to_body(m).select("view_id", F.sha2("body", 256).alias("digest"))), ("manifest",), "SELECT view_id, sha256('{' || string_agg('\"' || path || '\":\"' || hash || '\"', ',' ORDER BY path) || '}') AS digest FROM manifest GROUP BY view_id")
_register("views_summary", _on("manifest")(manifest.views), ("manifest",), "SELECT repo, view_id, count(*) AS paths FROM manifest GROUP BY 1, 2")
_register("blob_gc", _on("blobs", "manifest")(manifest.sweep), ("blobs", "manifest"), "SELECT hash FROM blobs WHERE hash NOT IN (SELECT hash FROM manifest)")
_register("blob_gc_report", _on("blobs", "manifest")(manifest.gc_report), ("blobs", "manifest"), "SELECT count(*) FILTER (WHERE hash NOT IN (SELECT hash FROM manifest)) AS freed, count(*) FILTER (WHERE hash IN (SELECT hash FROM manifest)) AS retained FROM blobs")
_register("blob_dedup", lambda s, d: manifest.distinct_blobs(s.read.parquet(f"{d}/documents.parquet"), "text"), (), "SELECT sha256(text) AS hash, any_value(strlen(text)) AS len, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")

# --- stores --------------------------------------------------------------


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("store") == name).drop("store")


_AB = "(SELECT * FROM store_rows WHERE store = 'A') a FULL JOIN (SELECT * FROM store_rows WHERE store = 'B') b ON a.namespace = b.namespace AND a.collection = b.collection AND a.id = b.id"
_KEYS = "coalesce(a.namespace, b.namespace) AS namespace, coalesce(a.collection, b.collection) AS collection, coalesce(a.id, b.id) AS id"
# without ancestry a structured body has an empty base and always conflicts
_register("sync_classify", _on("store_rows")(lambda r: sync.classify(_side(r, "A"), _side(r, "B"), F.col("collection").isin("topic", "graph_manifest"))), ("store_rows",), f"SELECT {_KEYS}, CASE WHEN a.id IS NULL THEN 'copied_to_a' WHEN b.id IS NULL THEN 'copied_to_b' WHEN a.counter = b.counter AND a.hash = b.hash THEN 'same' WHEN a.collection IN ('topic', 'graph_manifest') THEN 'merged' ELSE 'conflict' END AS action FROM {_AB}")
_register("sync_merged_envelope", _on("store_rows")(lambda r: sync.envelope(_side(r, "A"), _side(r, "B"))), ("store_rows",), f"SELECT {_KEYS}, greatest(a.counter, b.counter) + 1 AS counter, CASE WHEN b.counter > a.counter THEN b.hash ELSE a.hash END AS parent_hash FROM {_AB} WHERE a.id IS NOT NULL AND b.id IS NOT NULL AND (a.counter <> b.counter OR a.hash <> b.hash)")


def _revised(df: DataFrame, name: str = "revision") -> DataFrame:
    return df.select("namespace", "collection", "id", F.struct(F.col("counter").cast("long").alias("counter"), "hash").alias(name))


_register("put_batch", _on("store_rows")(lambda r: store.outcomes(_revised(_side(r, "A")), _revised(_side(r, "B"), "expected").withColumn("arrival", F.col("id"))).select("namespace", "collection", "id", "outcome")), ("store_rows",), "SELECT b.namespace, b.collection, b.id, CASE WHEN a.id IS NULL THEN 'not_found' WHEN a.counter = b.counter AND a.hash = b.hash THEN 'committed' ELSE 'conflict' END AS outcome FROM (SELECT * FROM store_rows WHERE store = 'B') b LEFT JOIN (SELECT * FROM store_rows WHERE store = 'A') a ON a.collection = b.collection AND a.id = b.id")
_register("delete_batch", _on("store_rows")(lambda r: store.delete_outcomes(_revised(_side(r, "A")), _revised(_side(r, "B"), "expected")).select("namespace", "collection", "id", "outcome")), ("store_rows",), "SELECT b.namespace, b.collection, b.id, CASE WHEN a.id IS NULL OR (a.counter = b.counter AND a.hash = b.hash) THEN 'deleted' ELSE 'conflict' END AS outcome FROM (SELECT * FROM store_rows WHERE store = 'B') b LEFT JOIN (SELECT * FROM store_rows WHERE store = 'A') a ON a.collection = b.collection AND a.id = b.id")
_register("store_status", _on("store_rows")(lambda r: _side(r, "A").groupBy("namespace", "collection").agg(F.count("*").alias("n"))), ("store_rows",), "SELECT namespace, collection, count(*) AS n FROM store_rows WHERE store = 'A' GROUP BY 1, 2")
_register("list_prefix", _on("store_rows")(lambda r: _side(r, "A").where(keys.matches("ns", "topic")).select("namespace", "collection", "id")), ("store_rows",), "SELECT namespace, collection, id FROM store_rows WHERE store = 'A' AND namespace = 'ns' AND collection = 'topic'")
_register("merge_class", _on("store_rows")(lambda r: _side(r, "A").groupBy(keys.merge_class("collection").alias("class")).agg(F.count("*").alias("n"))), ("store_rows",), "SELECT CASE collection WHEN 'topic' THEN 'append_only' WHEN 'memory_tier' THEN 'structured' WHEN 'checkpoint' THEN 'opaque' ELSE 'derived' END AS class, count(*) AS n FROM store_rows WHERE store = 'A' GROUP BY 1")
_register("key_encode", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", keys.object_key(F.lit("a b"), F.col("p_type"), F.col("p_name")).alias("object_key"), keys.decode_segment(keys.segment("p_name")).alias("name")), (), "SELECT p_partkey, 'a%20b/' || replace(replace(p_type, ' ', '%20'), '#', '%23') || '/' || replace(replace(p_name, ' ', '%20'), '#', '%23') || '.json' AS object_key, p_name AS name FROM part")

# --- tickets -------------------------------------------------------------

_STATUS = {"values": {"F": "Done", "p": "InProgress", "O": "Open"}, "default": "Triage"}
_register("ticket_state_map", _on("tickets")(lambda t: t.select("uid", tickets.category_of(F.col("raw_name"), _STATUS).alias("category"))), ("tickets",), "SELECT uid, category FROM tickets")
_register("ticket_priority_rank", _on("tickets")(lambda t: t.select("uid", tickets.priority_rank(F.col("priority")).cast("int").alias("rank"))), ("tickets",), "SELECT uid, CASE priority WHEN 'Urgent' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END AS rank FROM tickets")
_register("ticket_upsert_outcomes", _on("store_rows")(lambda r: upsert_outcomes(_side(r, "A"), _side(r, "B").select("namespace", "collection", "id", "hash"), ["namespace", "collection", "id"]).select("namespace", "collection", "id", "outcome")), ("store_rows",), "SELECT b.namespace, b.collection, b.id, CASE WHEN a.id IS NULL THEN 'imported' WHEN a.hash <> b.hash THEN 'updated' ELSE 'unchanged' END AS outcome FROM (SELECT * FROM store_rows WHERE store = 'B') b LEFT JOIN (SELECT * FROM store_rows WHERE store = 'A') a ON a.collection = b.collection AND a.id = b.id")
_register("ticket_ingest_summary", _on("store_rows")(lambda r: summary(upsert_outcomes(_side(r, "A"), _side(r, "B").select("namespace", "collection", "id", "hash"), ["namespace", "collection", "id"]))), ("store_rows",), "SELECT count(*) FILTER (WHERE a.id IS NULL) AS imported, count(*) FILTER (WHERE a.hash <> b.hash) AS updated, count(*) FILTER (WHERE a.hash = b.hash) AS unchanged FROM (SELECT * FROM store_rows WHERE store = 'B') b LEFT JOIN (SELECT * FROM store_rows WHERE store = 'A') a ON a.collection = b.collection AND a.id = b.id")

from . import scenarios as _scenarios  # noqa: E402, F401  (registers its queries here)
