"""Manifests and content-addressed blobs: reconcile, mark and sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import content_hash


def desired(files: DataFrame) -> DataFrame:
    """``path, hash`` of files given as ``path, content``."""
    return files.select("path", content_hash("content").alias("hash"))


def reconcile(recorded: DataFrame, wanted: DataFrame) -> DataFrame:
    """``path, change`` of every path of two manifests: ``added``, ``deleted``,
    ``modified`` or ``unchanged``.  One full outer join on path."""
    a, b = recorded.select("path", F.col("hash").alias("old")), wanted.select("path", F.col("hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", "old", "new", change.alias("change"))


def live(manifests: DataFrame) -> DataFrame:
    """The hashes that any view of any repository holds."""
    return manifests.select("hash").distinct()


def sweep(blobs: DataFrame, manifests: DataFrame) -> DataFrame:
    """The blobs that no manifest holds."""
    return blobs.join(live(manifests), "hash", "left_anti")


def gc_report(blobs: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row: ``freed, retained``."""
    marked = blobs.select("hash").distinct().join(live(manifests).withColumn("live", F.lit(True)), "hash", "left")
    return marked.agg(F.count_if(F.col("live").isNull()).alias("freed"), F.count_if(F.col("live").isNotNull()).alias("retained"))


def distinct_blobs(contents: DataFrame, column: str) -> DataFrame:
    """``hash, len, copies`` of the distinct contents."""
    rows = contents.where(F.col(column).isNotNull()).select(content_hash(column).alias("hash"), F.octet_length(column).cast("long").alias("len"))
    return rows.groupBy("hash").agg(F.first("len").alias("len"), F.count("*").alias("copies"))


def views(manifests: DataFrame) -> DataFrame:
    return manifests.groupBy("repo", "view_id").agg(F.count("*").alias("paths")).orderBy("repo", "view_id")


def to_body(manifest: DataFrame) -> DataFrame:
    """``repo, view_id, body``: the manifest as JSON with sorted keys."""
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    entry = F.struct("path", F.concat(quoted("path"), F.lit(":"), quoted("hash")).alias("text"))
    made = manifest.groupBy("repo", "view_id").agg(F.sort_array(F.collect_list(entry)).alias("x"))
    return made.select("repo", "view_id", F.concat(F.lit("{"), F.array_join("x.text", ","), F.lit("}")).alias("body"))


def from_body(bodies: DataFrame) -> DataFrame:
    entries = F.from_json("body", "map<string, string>", {"mode": "FAILFAST"})
    return bodies.select("repo", "view_id", F.explode(entries).alias("path", "hash"))
