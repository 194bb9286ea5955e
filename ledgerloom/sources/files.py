"""Trees of files as tables."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import KEY, content_hash


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (relative to ``root``) and ``content`` of every file below it."""
    if "://" not in root:
        root = "file://" + root
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    scheme, _, rest = root.rstrip("/").partition("://")
    lead = len(rest) + 1
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(plain, rf"^{scheme}:/+", "/")
    return raw.select(F.substr(path, F.lit(lead + 1)).alias("path"), "content")


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """Whether ignore rules hide a path: globs, ``/`` at the end for folders,
    ``/`` elsewhere to anchor, ``!`` to re-admit; the last match decides."""
    rules = [p.strip() for p in patterns if p.strip() and not p.startswith("#")]

    def hit(path: str, rule: str) -> bool:
        folder, rule = rule.endswith("/"), rule.rstrip("/")
        parts = path.split("/")
        for end in range(1, len(parts) + 1):
            if folder and end == len(parts):
                break
            whole = "/".join(parts[:end])
            if fnmatch.fnmatchcase(whole, rule.lstrip("/")) if "/" in rule else fnmatch.fnmatchcase(parts[end - 1], rule):
                return True
        return False

    def decide(s: pd.Series) -> pd.Series:
        out = []
        for p in s:
            state = False
            for r in rules:
                if hit(p, r.lstrip("!")):
                    state = not r.startswith("!")
            out.append(state)
        return pd.Series(out, dtype=bool)

    return F.pandas_udf(decide, "boolean")(path) if rules else F.lit(False)


def migrate(files: DataFrame, existing: DataFrame, namespace: str, collection: str, kind: str, author: str) -> DataFrame:
    """Files as new records, the path being the id; ids that exist are left."""
    fresh = files.select(F.lit(namespace).alias("namespace"), F.lit(collection).alias("collection"), F.col("path").alias("id"), "content").join(existing.select(*KEY), list(KEY), "left_anti")
    labels = F.from_json(F.lit("{}"), "map<string, string>")
    meta = F.struct(F.struct(F.lit(author).alias("id"), F.lit(None).cast("string").alias("display")).alias("author"), F.lit("migrate").alias("origin_system"), F.lit(0).cast("long").alias("created"), F.lit(0).cast("long").alias("updated"), labels.alias("labels"))
    return fresh.select(
        *KEY,
        F.lit(kind).alias("kind"),
        F.struct(F.lit(0).cast("long").alias("counter"), content_hash("content").alias("hash")).alias("revision"),
        F.lit(None).cast("struct<counter: bigint, hash: string>").alias("parent"),
        F.struct(F.col("content").alias("inline"), F.lit(None).cast("string").alias("blob_hash"), F.lit(None).cast("long").alias("blob_len")).alias("body"),
        meta.alias("meta"),
        F.array().cast("array<struct<namespace: string, collection: string, id: string>>").alias("links"),
        F.lit(None).cast("struct<counter: bigint, hash: string>").alias("expected"),
    )


_WIRE = (
    "key struct<namespace: string, collection: string, id: string>, kind string, revision struct<counter: bigint, hash: string>, parent struct<counter: bigint, hash: string>, "
    "body struct<Inline: array<smallint>, Blob: struct<hash: string, len: bigint>>, meta struct<author: struct<id: string, display: string>, origin_system: string, created: bigint, updated: bigint, labels: map<string, string>>, "
    "links array<struct<namespace: string, collection: string, id: string>>"
)


def read_json_store(spark: SparkSession, root: str) -> DataFrame:
    """Records of an existing store of one JSON document per record.  Inline
    bodies are arrays of byte values; a document that can't be read is an
    error.  Hashes stay as they are written."""
    files = file_tree(spark, root).where(F.col("path").rlike(r"^[^/]+/[^/]+/[^/]+\.json$"))
    r = files.select(F.from_json(F.col("content").cast("string"), _WIRE, {"mode": "FAILFAST"}).alias("r"))
    hexed = F.array_join(F.transform("r.body.Inline", lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")
    body = F.struct(F.when(F.col("r.body.Inline").isNotNull(), F.unhex(hexed)).alias("inline"), F.col("r.body.Blob.hash").alias("blob_hash"), F.col("r.body.Blob.len").alias("blob_len"))
    snake = F.lower(F.regexp_replace("r.kind", "(?<=[a-z])(?=[A-Z])", "_"))
    return r.select("r.key.*", snake.alias("kind"), "r.revision", "r.parent", body.alias("body"), "r.meta", "r.links")
