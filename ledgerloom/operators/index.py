"""Index pipeline: files to slices, blobs, a manifest and queryable views."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import content_hash
from ..functions.text import is_indexable
from .extract import slices
from .manifest import reconcile


@dataclass
class Indexed:
    """The new manifest, the blobs it needs and what changed."""

    manifest: DataFrame
    blobs: DataFrame
    changes: DataFrame


def index(files: DataFrame, repo: str, view: str, recorded: DataFrame | None = None, include: Sequence[str] = ()) -> Indexed:
    """A full index of ``path, content``; ``recorded`` is the view's manifest
    so far, by default empty."""
    kept = slices(files.where(is_indexable("path", include)))
    hashed = kept.withColumn("hash", content_hash("content"))
    wanted = hashed.select("path", "hash")
    old = files.sparkSession.createDataFrame([], "path string, hash string") if recorded is None else recorded.select("path", "hash")
    made = wanted.select(F.lit(repo).alias("repo"), F.lit(view).alias("view_id"), "path", "hash")
    return Indexed(made, hashed.select("hash", "content").dropDuplicates(["hash"]), reconcile(old, wanted))


def index_changed(changed: DataFrame, deleted: DataFrame, repo: str, view: str, recorded: DataFrame, include: Sequence[str] = ()) -> Indexed:
    """An incremental index: only ``changed`` files (``path, content``) are
    parsed; ``deleted`` paths and recorded paths that the rules no longer
    admit are dropped."""
    fresh = index(changed, repo, view, None, include)
    touched = changed.select("path").union(deleted.select("path")).distinct()
    carried = recorded.where(is_indexable("path", include)).join(touched, "path", "left_anti").select("repo", "view_id", "path", "hash")
    made = carried.unionByName(fresh.manifest)
    return Indexed(made, fresh.blobs, reconcile(recorded, made))


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, change`` (``A``, ``M`` or ``D``) between two trees of
    ``path, hash``; a rename is a deletion and an addition."""
    letters = F.create_map(*[F.lit(x) for x in ("added", "A", "modified", "M", "deleted", "D")])
    return reconcile(before, after).where(F.col("change") != "unchanged").select("path", F.element_at(letters, F.col("change")).alias("change"))


def stale_entries(recorded: DataFrame, include: Sequence[str] = ()) -> DataFrame:
    return recorded.where(~is_indexable("path", include)).orderBy("path")
