"""Idempotent ingestion of tickets into the record store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import KEY, content_hash
from ..functions.tickets import provider_slug, scoped_uid
from .store import RecordStore


def upsert_outcomes(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``incoming`` (key, ``hash``) with ``outcome``: ``imported``,
    ``updated``, or ``unchanged`` where the stored hash is the same."""
    now = current.select(*key, F.col("hash").alias("stored"))
    outcome = F.when(F.col("stored").isNull(), "imported").when(F.col("stored") != F.col("hash"), "updated").otherwise("unchanged")
    return incoming.join(now, key, "left").withColumn("outcome", outcome).drop("stored")


def summary(outcomes: DataFrame) -> DataFrame:
    kinds = ("imported", "updated", "unchanged")
    return outcomes.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])


def as_records(tickets: DataFrame, author: str, scope: str | None = None) -> DataFrame:
    """Tickets as records of the ``tickets`` namespace; of several tickets of
    one key the last by body stays."""
    body = F.to_json(F.struct(*tickets.columns), {"ignoreNullFields": "false"}).cast("binary")
    rows = tickets.select(F.lit("tickets").alias("namespace"), provider_slug(F.col("provider")).alias("collection"), scoped_uid(F.col("uid"), scope).alias("id"), body.alias("content"))
    last = Window.partitionBy(*KEY).orderBy(F.col("content").desc())
    rows = rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    labels = F.from_json(F.lit("{}"), "map<string, string>")
    meta = F.struct(F.struct(F.lit(author).alias("id"), F.lit(None).cast("string").alias("display")).alias("author"), F.lit("ticket-ingest").alias("origin_system"), F.lit(0).cast("long").alias("created"), F.lit(0).cast("long").alias("updated"), labels.alias("labels"))
    return rows.select(
        *KEY,
        F.lit("ticket").alias("kind"),
        F.struct(F.lit(0).cast("long").alias("counter"), content_hash("content").alias("hash")).alias("revision"),
        F.lit(None).cast("struct<counter: bigint, hash: string>").alias("parent"),
        F.struct(F.col("content").alias("inline"), F.lit(None).cast("string").alias("blob_hash"), F.lit(None).cast("long").alias("blob_len")).alias("body"),
        meta.alias("meta"),
        F.array().cast("array<struct<namespace: string, collection: string, id: string>>").alias("links"),
    )


def ingest(store: RecordStore, tickets: DataFrame, author: str, scope: str | None = None) -> DataFrame:
    """Write the tickets that are new or changed; ``imported, updated,
    unchanged``.  What another writer changed meanwhile is a conflict row of
    the store and an error here."""
    incoming = store._stored(as_records(tickets, author, scope))
    current = store.list("tickets").select(*KEY, F.col("revision").alias("now"))
    judged = incoming.join(current, list(KEY), "left")
    changed = judged.where(F.col("now").isNull() | (F.col("now.hash") != F.col("revision.hash")))
    counter = F.coalesce(F.col("now.counter") + 1, F.lit(0)).cast("long")
    puts = changed.withColumn("revision", F.struct(counter.alias("counter"), F.col("revision.hash").alias("hash"))).withColumn("parent", F.col("now")).withColumnRenamed("now", "expected")
    outcome = F.when(F.col("now").isNull(), "imported").when(F.col("now.hash") != F.col("revision.hash"), "updated").otherwise("unchanged")
    report = summary(store._stored(judged.select(outcome.alias("outcome"))))
    done = store.put(puts)
    clash = done.where(F.col("outcome") != "committed").select(*KEY).first()
    if clash:
        raise RuntimeError(f"conflict on {'/'.join(clash)}")
    return report
