"""One query per operator, over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, toxicity, warc
from .decontaminate import contaminated
from .exact_dedup import exact_duplicates
from .line_dedup import dedup_lines_reversibly
from .ngram_join import jaccard_classes
from .packing import pack_documents
from .repeats import repeated_passages
from .sharding import shard_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


ORACLE_SQL["op1_exact_dedup"] = """
SELECT doc_id, keep_id, copy_no
FROM (SELECT doc_id, first_value(doc_id) OVER w AS keep_id, row_number() OVER w - 1 AS copy_no
      FROM documents WHERE text IS NOT NULL
      WINDOW w AS (PARTITION BY text ORDER BY doc_id))
WHERE copy_no > 0
"""


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are more likely toxic than not."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("toxicity") >= 0.5)


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text as the line index leaves it, the later
    half of them put in, taken out and put in again."""
    return dedup_lines_reversibly(read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL["op3_line_dedup"] = r"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM s WHERE text IS NOT NULL),
r AS (SELECT doc_id, line, pos, regexp_matches(line, '[^ \t\r\f\v]') AS solid,
             row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1 AS first FROM l),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE first OR NOT solid) AS kept,
             count(*) FILTER (WHERE solid) AS had, count(*) FILTER (WHERE solid AND first) AS has FROM r GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN k.has = 0 AND k.had > 0 THEN '' WHEN s.text IS NULL THEN NULL ELSE k.kept END AS text
FROM s LEFT JOIN k ON s.doc_id = k.doc_id
"""


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, with expected grade and P(grade >= 1)."""
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, quality.grades_of_labels(read(spark, sf_dir, "labels")))
    return quality.score(docs, model, 1).where(F.col("tail_probability") >= 0.5)


def _rot() -> Column:
    """The byte of the md5 of a page's id that decides what happened to it."""
    return F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)


def rotten(pages: DataFrame) -> DataFrame:
    """The records of a replica of ``pages`` after bit rot: the first character
    of 2 pages in 256 changed, 1 in 256 was lost and 1 lies 16 bytes further;
    the others are where they were."""
    html = F.when(_rot().isin("00", "01"), F.concat(F.lit("\u0000"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    found = warc.records(pages.select("page_id", "url", html.alias("html")))
    byte = F.coalesce(_rot(), F.lit(""))
    return found.where(byte != "02").withColumn("offset", F.col("offset") + F.when(byte == "03", 16).otherwise(0))


@query
def op5_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a rotten replica of the pages' WARC files differs from them."""
    pages = read(spark, sf_dir, "pages")
    return warc.audit(warc.records(pages), rotten(pages))


ORACLE_SQL["op5_warc_audit"] = """
WITH r AS (SELECT page_id, url, page_id // 4096 AS file,
  strlen('WARC/1.0..WARC-Type: resource..WARC-Record-ID: <urn:page:') + strlen(page_id::VARCHAR) + strlen('>..WARC-Target-URI: ') + strlen(url)
  + strlen('..Content-Type: text/html..Content-Length: ') + strlen(strlen(html)::VARCHAR) + 4 + strlen(html) + 4 AS length FROM pages),
o AS (SELECT *, (sum(length) OVER (PARTITION BY file ORDER BY page_id))::BIGINT AS stop, substr(md5(page_id::VARCHAR), 1, 2) AS rot FROM r)
SELECT file, page_id, CASE rot WHEN '02' THEN 'missing' WHEN '03' THEN 'moved' ELSE 'altered' END AS damage,
       stop - length AS "begin", stop AS "end"
FROM o WHERE rot IN ('00', '01', '02', '03')
"""

#: Shards of the documents table.
SHARDS = 64


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return shard_documents(read(spark, sf_dir, "documents"), SHARDS)


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin of every piece of every document."""
    return pack_documents(read(spark, sf_dir, "documents"))


@query
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and the number of links of every document that has any."""
    return jaccard_classes(read(spark, sf_dir, "documents"))


ORACLE_SQL["op8_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10ffff}]+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(0, greatest(len(w) - 4, 1)), lambda p: array_to_string(w[p + 1:p + 5], ' ')))) AS s FROM w WHERE len(w) > 0),
c AS (SELECT s, min(doc_id) AS lead, list(doc_id) AS ids FROM g GROUP BY s),
i AS (SELECT lead, len(s) AS size, unnest(s) AS gram FROM c),
o AS (SELECT a.lead AS a, b.lead AS b, any_value(a.size) + any_value(b.size) AS sizes, count(*) AS common
      FROM i a JOIN i b ON a.gram = b.gram AND a.lead <> b.lead GROUP BY 1, 2),
e AS (SELECT a, b FROM o WHERE common / (sizes - common)::DOUBLE >= 0.4),
r AS (SELECT lead AS a, lead AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
l AS (SELECT c.lead, len(any_value(c.ids)) - 1 + coalesce(sum(len(d.ids)), 0) AS links
      FROM c LEFT JOIN e ON e.a = c.lead LEFT JOIN c d ON d.lead = e.b GROUP BY c.lead)
SELECT m.doc_id, k.class_id, l.links::BIGINT AS links
FROM (SELECT lead, unnest(ids) AS doc_id FROM c) m JOIN k ON k.a = m.lead JOIN l ON l.lead = m.lead
WHERE l.links > 0
"""


@query
def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents repeat passages of 50 words and more."""
    return repeated_passages(read(spark, sf_dir, "documents"))


ORACLE_SQL["op9_repeated_passages"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10ffff}]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS p FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, p, count(*) OVER (PARTITION BY array_to_string(w[p + 1:p + 50], ' ')) AS n FROM g),
r AS (SELECT doc_id, p, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -100) > 50 AS head FROM h WHERE n > 1),
s AS (SELECT doc_id, p, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM r)
SELECT doc_id, min(p)::INT AS start, (max(p) + 50)::INT AS "end" FROM s GROUP BY doc_id, k
"""


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which benchmark items."""
    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


ORACLE_SQL["op10_decontaminate"] = r"""
WITH dw AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10ffff}]+') AS w FROM documents),
iw AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10ffff}]+') AS w FROM benchmark),
ig AS (SELECT id, len(w) AS m, least(len(w), 5) AS n, unnest(range(0, greatest(len(w) - 4, 1))) AS p, w FROM iw WHERE len(w) > 0),
s AS (SELECT DISTINCT id, m, n, array_to_string(w[p + 1:p + n], ' ') AS g FROM ig),
k AS (SELECT id, count(*) AS shingles FROM s GROUP BY id),
dg AS (SELECT id, n, unnest(range(0, len(w) - n + 1)) AS p, w FROM dw, (SELECT DISTINCT n FROM s) WHERE len(w) >= n),
h AS (SELECT dg.id AS doc_id, dg.p, s.id AS item_id, s.m, s.g
      FROM dg JOIN s ON s.n = dg.n AND s.g = array_to_string(dg.w[dg.p + 1:dg.p + dg.n], ' ')),
win AS (SELECT a.doc_id, a.item_id, a.p, count(DISTINCT b.g) AS found
        FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.item_id = b.item_id
                         AND b.p BETWEEN a.p AND a.p + greatest(a.m - 5, 0)
        GROUP BY 1, 2, 3)
SELECT win.doc_id, win.item_id, max(win.found) AS found, any_value(k.shingles) AS shingles
FROM win JOIN k ON k.id = win.item_id
GROUP BY 1, 2 HAVING max(win.found) >= ceil(any_value(k.shingles) * 0.7 - 1e-9)
"""
