"""Two-store synchronisation with a merge per class of record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import KEY, content_hash, merge_class
from ..functions.merge import merge_bodies

MAX_PASSES = 16


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join on key; ``a`` and ``b`` are structs, null where absent."""
    side = lambda df, name: df.select(*KEY, F.struct(*df.columns).alias(name))
    return side(a, "a").join(side(b, "b"), list(KEY), "full_outer")


def classify(a: DataFrame, b: DataFrame, mergeable: Column) -> DataFrame:
    """Keys with ``action``: ``copied_to_a``, ``copied_to_b``, ``same``,
    ``merged`` or ``conflict``, for revisions ``counter, hash``."""
    same = (F.col("a.counter") == F.col("b.counter")) & (F.col("a.hash") == F.col("b.hash"))
    action = F.when(F.col("a").isNull(), "copied_to_a").when(F.col("b").isNull(), "copied_to_b").when(same, "same").when(mergeable, "merged").otherwise("conflict")
    return aligned(a, b).select(*KEY, action.alias("action"))


def merged_labels(a: Column, b: Column) -> Column:
    """The union of two maps; ``b`` wins."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def merged_links(a: Column, b: Column) -> Column:
    """All of ``a``, then what only ``b`` has."""
    return F.when(b.isNull(), a).when(a.isNull(), b).otherwise(F.concat(a, F.array_except(b, a)))


@dataclass
class Synced:
    """``report``: keys with their action; ``a`` and ``b``: the stores after."""

    report: DataFrame
    a: DataFrame
    b: DataFrame


def sync(a: DataFrame, b: DataFrame, ancestry: DataFrame | None = None, author: str = "sync") -> Synced:
    """Reconcile two stores of records.

    One-sided records are copied, equal revisions left alone, others merged by
    class and written to both sides, or reported as conflicts and left as they
    are.  The base is the shared parent's body in ``ancestry`` (``hash,
    content``), else empty.  A body that is only a reference to a blob can't
    be merged and conflicts.
    """
    both = aligned(a, b)
    same = F.col("a.revision").eqNullSafe(F.col("b.revision"))
    both = both.withColumn("base_hash", F.when(F.col("a.parent").eqNullSafe(F.col("b.parent")), F.col("a.parent.hash")))
    if ancestry is not None:
        bases = ancestry.select(F.col("hash").alias("base_hash"), F.col("content").alias("base")).dropDuplicates(["base_hash"])
        both = both.join(bases, "base_hash", "left")
    else:
        both = both.withColumn("base", F.lit(None).cast("binary"))
    differing = F.col("a").isNotNull() & F.col("b").isNotNull() & ~same
    inline = F.col("a.body.inline").isNotNull() & F.col("b.body.inline").isNotNull()
    merged = merge_bodies(F.when(inline, merge_class("a.kind")), "base", "a.body.inline", "b.body.inline")
    joint = both.where(differing).withColumn("m", merged)
    quiet = both.where(~differing).withColumn("action", F.when(F.col("a").isNull(), "copied_to_a").when(F.col("b").isNull(), "copied_to_b").otherwise("same"))
    rest = joint.withColumn("action", F.col("m.outcome"))

    higher = F.when(F.col("b.revision.counter") > F.col("a.revision.counter"), F.col("b.revision")).otherwise(F.col("a.revision"))
    meta = F.struct(
        F.struct(F.lit(author).alias("id"), F.lit(None).cast("string").alias("display")).alias("author"),
        F.lit("sync").alias("origin_system"),
        F.least("a.meta.created", "b.meta.created").alias("created"),
        F.greatest("a.meta.updated", "b.meta.updated").alias("updated"),
        merged_labels(F.col("a.meta.labels"), F.col("b.meta.labels")).alias("labels"),
    )
    counter = F.greatest("a.revision.counter", "b.revision.counter") + 1
    record = F.struct(
        *KEY,
        F.col("a.kind").alias("kind"),
        F.struct(counter.alias("counter"), content_hash(F.col("m.body")).alias("hash")).alias("revision"),
        higher.alias("parent"),
        F.struct(F.col("m.body").alias("inline"), F.lit(None).cast("string").alias("blob_hash"), F.lit(None).cast("long").alias("blob_len")).alias("body"),
        meta.alias("meta"),
        merged_links(F.col("a.links"), F.col("b.links")).alias("links"),
    )
    report = quiet.select(*KEY, "action").union(rest.select(*KEY, "action"))

    def store(own: str) -> DataFrame:
        still = quiet.select(F.coalesce(F.col(own), F.col("b" if own == "a" else "a")).alias("r"))
        stays = rest.where(F.col("action") == "conflict").select(F.col(own).alias("r"))
        made = rest.where(F.col("action") == "merged").select(record.alias("r"))
        return still.select("r.*").unionByName(stays.select("r.*")).unionByName(made.select("r.*"))

    return Synced(report, store("a"), store("b"))


def update_violations(operations: DataFrame, members: DataFrame) -> DataFrame:
    """``key, op_id, problem`` of a run of concurrent writers: ``lost`` for an
    operation (``key, op_id, result``) that was committed and isn't among the
    final ``members`` (``key, op_id``), ``repeated`` for one that is there more
    than once."""
    committed = operations.where(F.col("result") == "committed").select("key", "op_id").distinct()
    lost = committed.join(members.select("key", "op_id").distinct(), ["key", "op_id"], "left_anti").withColumn("problem", F.lit("lost"))
    again = members.groupBy("key", "op_id").count().where("count > 1").select("key", "op_id", F.lit("repeated").alias("problem"))
    return lost.unionByName(again)


def envelope(a: DataFrame, b: DataFrame) -> DataFrame:
    """The new revision's counter and parent of keys that both stores hold in
    different revisions ``counter, hash``."""
    both = aligned(a, b).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = both.where((F.col("a.counter") != F.col("b.counter")) | (F.col("a.hash") != F.col("b.hash")))
    parent = F.when(F.col("b.counter") > F.col("a.counter"), F.col("b.hash")).otherwise(F.col("a.hash"))
    return both.select(*KEY, (F.greatest("a.counter", "b.counter") + 1).alias("counter"), parent.alias("parent_hash"))


def three_way(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """A pull that can't fast-forward: ``path, action, content`` for trees of
    ``path, kind, content``.  What only the remote changed is applied, what
    both changed is merged, and a conflict or one-sided deletion keeps local."""
    pick = lambda df, p: df.select("path", F.col("kind").alias(f"{p}_kind"), F.col("content").alias(f"{p}_content"), F.lit(True).alias(p))
    t = pick(base, "o").join(pick(local, "l"), "path", "full_outer").join(pick(remote, "r"), "path", "full_outer")
    o, mine, other = F.col("o_content"), F.col("l_content"), F.col("r_content")
    remote_changed, local_changed = ~other.eqNullSafe(o), ~mine.eqNullSafe(o)
    t = t.withColumn("m", F.when(remote_changed & local_changed & F.col("l").isNotNull() & F.col("r").isNotNull(), merge_bodies(merge_class("l_kind"), o, mine, other)))
    action = (
        F.when(~remote_changed | mine.eqNullSafe(other), "kept")
        .when(~local_changed & F.col("r").isNull(), "deleted")
        .when(~local_changed, "applied")
        .when(F.col("l").isNull() | F.col("r").isNull(), "kept")
        .otherwise(F.col("m.outcome"))
    )
    content = F.when(action == "applied", other).when(action == "merged", F.col("m.body")).when(action != "deleted", mine)
    return t.select("path", action.alias("action"), content.alias("content"))
