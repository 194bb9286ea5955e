"""Knowledge store: records in chunks, chunks as vectors, hits as records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import KEY, matches
from ..functions.text import chunk_id, prepend_header, split_paragraphs
from ..functions.vectors import Embedder, check_dim, cosine, embed_column, literal
from .vector import topk

#: Chunks read per wanted record, so that several of one record do no harm.
OVERFETCH = 8

_STRICT = {"mode": "FAILFAST"}


def _pieces(kind: Column, body: Column) -> Column:
    """The chunks of a body by the record's kind, null for opaque kinds.  A
    body that isn't of its kind is an error."""
    tier = F.from_json(body, "name string, content string", _STRICT)
    topic = F.from_json(body, "slug string, bullets array<string>", _STRICT)
    session = F.from_json(body, "name string, turns array<struct<role: string, text: string>>", _STRICT)
    ticket = F.from_json(body, "title string, labels array<string>, body struct<markdown: string>", _STRICT)
    event = F.from_json(body, "body string", _STRICT)
    none = F.array().cast("array<string>")
    heading = F.concat(ticket["title"], F.lit("\n"), F.array_join(F.coalesce(ticket["labels"], none), " "))
    return (
        F.when(kind == "memory_tier", prepend_header(tier["name"], split_paragraphs(tier["content"])))
        .when(kind == "topic", prepend_header(topic["slug"], F.coalesce(topic["bullets"], none)))
        .when(kind == "session", prepend_header(session["name"], F.transform(F.coalesce(session["turns"], F.from_json(F.lit("[]"), "array<struct<role: string, text: string>>")), lambda t: t["text"])))
        .when(kind == "ticket", F.concat(F.array(heading), split_paragraphs(F.coalesce(ticket["body"]["markdown"], F.lit("")))))
        .when(kind == "ticket_event", F.array(event["body"]))
    )


def chunk(records: DataFrame) -> DataFrame:
    """``namespace, collection, id, ordinal, chunk_id, text`` of the records
    (``kind``, ``body`` as text) that bear knowledge."""
    pieces = _pieces(F.col("kind"), F.col("body"))
    rows = records.where(~F.col("kind").isin("checkpoint", "graph_manifest")).select(*KEY, F.posexplode(pieces).alias("ordinal", "text"))
    return rows.select(*KEY, F.col("ordinal").cast("int").alias("ordinal"), chunk_id("id", "ordinal").alias("chunk_id"), "text")


def knowledge_text(records: DataFrame) -> DataFrame:
    return records.select(*KEY, F.array_join(_pieces(F.col("kind"), F.col("body")), "\n").alias("text"))


def ingest(chunks: DataFrame, records: DataFrame, embedder: Embedder) -> DataFrame:
    """The chunk vectors with those of ``records`` replaced: a record that got
    shorter leaves no orphans."""
    fresh = chunk(records).withColumn("embedding", embed_column(F.col("text"), embedder))
    return remove(chunks, records).unionByName(fresh)


def remove(chunks: DataFrame, records: DataFrame) -> DataFrame:
    return chunks.join(records.select(*KEY).distinct(), list(KEY), "left_anti")


def query(chunks: DataFrame, vector: Sequence[float], k: int, namespace: str | None = None, collection: str | None = None, overfetch: int | None = OVERFETCH) -> DataFrame:
    """``namespace, collection, id, score``: the ``k`` records whose best chunk
    is nearest.  Only ``k * overfetch`` chunks are looked at; None looks at
    all, which one record with very many near chunks may need."""
    if overfetch is not None:
        hits = topk(chunks, vector, k * overfetch, namespace, collection, (*KEY[:2], "chunk_id"))
    else:
        hits = chunks.where(matches(namespace, collection)).withColumn("score", cosine(check_dim(F.col("embedding"), len(vector)), literal(vector)))
    return hits.groupBy(*KEY).agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), *KEY).limit(k)


def query_records(chunks: DataFrame, records: DataFrame, vector: Sequence[float], k: int, **options) -> DataFrame:
    """The records of ``query``; those that are gone are missing."""
    return query(chunks, vector, k, **options).join(records, list(KEY)).orderBy(F.col("score").desc(), *KEY)


def query_chunks(chunks: DataFrame, vector: Sequence[float], k: int, namespace: str | None = None, collection: str | None = None) -> DataFrame:
    """The ``k`` nearest chunks themselves, with ordinal and text."""
    return topk(chunks, vector, k, namespace, collection, (*KEY[:2], "chunk_id")).withColumn("text", F.coalesce("text", F.lit("")))


def query_in_subgraph(chunks: DataFrame, refs: DataFrame, root: str, vector: Sequence[float], k: int, **options) -> DataFrame:
    """The rows of ``query`` whose id is the root, a caller or a callee."""
    from .graph import neighborhood

    near = neighborhood(refs, root).select(F.col("name").alias("id"))
    return query(chunks, vector, k, **options).join(near, "id", "left_semi").select(*KEY, "score").orderBy(F.col("score").desc(), *KEY)
