"""Views of the given tables in the shape of the engine's own tables.

``{name}`` stands for a source table and ``SHA(x)`` for the hex SHA-256 of a
string; the rest of the text runs unchanged on Spark and on DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "symbols": """
SELECT v.repo, v.view_id,
  CASE WHEN p_partkey % 10 = 3 THEN 'src/click.rs' ELSE concat('src/', lower(replace(p_brand,'#','')), '/', CASE WHEN p_partkey % 19 = 0 THEN 'tests' ELSE lower(p_type) END,
         CASE p_partkey % 5 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '.ts' WHEN 3 THEN '.go' ELSE '.txt' END) END AS path,
  p_partkey AS seq,
  CASE WHEN p_partkey % 97 = 0 THEN 'tests' ELSE concat('f', CAST(p_partkey % 1900 AS STRING)) END AS name,
  CASE WHEN p_partkey % 97 = 0 THEN 'module' WHEN p_partkey % 4 = 0 THEN 'struct' WHEN p_partkey % 4 = 1 THEN 'class' ELSE 'function' END AS kind,
  p_partkey AS start_line,
  CASE WHEN p_partkey % 97 = 0 THEN p_partkey + 900 ELSE p_partkey + p_size END AS end_line
FROM {part} CROSS JOIN (SELECT 'r' AS repo, 'main' AS view_id UNION ALL SELECT 'r', 'next') v
WHERE v.view_id = 'main' OR p_partkey % 23 <> 0""",
    "refs": """
SELECT v.repo, v.view_id, concat('src/', event_type, '.rs') AS path, event_id AS seq,
  concat('f', CAST(CASE WHEN event_id % 4 = 0 THEN event_id % 40 ELSE event_id % 2100 END AS STRING)) AS name,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('f', CAST(user_id AS STRING)) END AS from_fn,
  event_id + CASE WHEN v.view_id = 'next' THEN 5 ELSE 1 END AS line
FROM {events} CROSS JOIN (SELECT 'r' AS repo, 'main' AS view_id UNION ALL SELECT 'r', 'next') v
WHERE v.view_id = 'main' OR event_id % 13 <> 0""",
    "call_tree": """
SELECT concat('c', CAST(CAST(floor((c_custkey - 1) / 2.0) AS BIGINT) AS STRING)) AS name,
  concat('c', CAST(c_custkey AS STRING)) AS from_fn FROM {customer}""",
    "manifest": """
SELECT 'r' AS repo, v.view_id, concat('doc/', CAST(doc_id AS STRING)) AS path,
  CASE WHEN v.view_id = 'b' AND doc_id % 7 = 0 THEN SHA(concat(text, '!')) ELSE SHA(text) END AS hash
FROM {documents} CROSS JOIN (SELECT 'a' AS view_id UNION ALL SELECT 'b') v
WHERE (v.view_id = 'a' AND doc_id % 10 <> 0) OR (v.view_id = 'b' AND doc_id % 10 <> 1)""",
    "blobs": "SELECT DISTINCT SHA(text) AS hash FROM {documents} UNION SELECT SHA(concat(text, '?')) FROM {documents} WHERE doc_id % 9 = 0",
    "store_rows": """
SELECT s.store, 'ns' AS namespace,
  CASE WHEN o_orderkey % 4 = 0 THEN 'topic' WHEN o_orderkey % 4 = 1 THEN 'memory_tier' WHEN o_orderkey % 4 = 2 THEN 'checkpoint' ELSE 'graph_manifest' END AS collection,
  concat('o', CAST(o_orderkey AS STRING)) AS id,
  CASE WHEN s.store = 'B' AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS counter,
  SHA(concat(o_orderpriority, CASE WHEN s.store = 'B' AND o_orderkey % 5 = 0 THEN '*' ELSE '' END)) AS hash
FROM {orders} CROSS JOIN (SELECT 'A' AS store UNION ALL SELECT 'B') s
WHERE (s.store = 'A' AND o_orderkey % 17 <> 0) OR (s.store = 'B' AND o_orderkey % 19 <> 0)""",
    "vectors": """
SELECT 'emb' AS namespace, concat('l', CAST(label AS STRING)) AS collection,
  concat('v', lpad(CAST(vec_id AS STRING), 6, '0')) AS id, embedding FROM {embeddings}""",
    "chunk_vectors": """
SELECT namespace, 'parents' AS collection, concat('p', lpad(CAST(vec_id % 125 AS STRING), 4, '0')) AS parent_id,
  CAST(floor(vec_id / 125.0) AS BIGINT) AS ordinal, embedding FROM (SELECT 'emb' AS namespace, vec_id, embedding FROM {embeddings}) e""",
    "sessions": """
SELECT conv_id, turn AS ordinal, CASE WHEN turn = 0 THEN concat('conv-', CAST(conv_id AS STRING), chr(10), text) ELSE text END AS chunk_text FROM {conversations}""",
    "tickets": """
SELECT concat('acme/shop#', CAST(o_orderkey AS STRING)) AS uid, o_orderstatus AS raw_name,
  CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'P' THEN 'InProgress' WHEN 'O' THEN 'Open' ELSE 'Triage' END AS category,
  CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'Urgent' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium' WHEN '5' THEN 'Low' ELSE 'None' END AS priority
FROM {orders}""",
}


def _sources(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name].replace("SHA(", "sha_hex(")
    # sha2 takes the digest's length as its second argument
    text = re.sub(r"sha_hex\((concat\((?:[^()]|\([^()]*\))*\)|\w+)\)", r"sha2(\1, 256)", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _sources(text)})


def duckdb_view(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name].replace("SHA(", "sha256("))


def with_views(*names: str) -> str:
    """The beginning of a DuckDB query over the named views."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({duckdb_view(n)})" for n in names)
