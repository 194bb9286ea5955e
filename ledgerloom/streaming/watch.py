"""Watching a tree of files: quiet periods and re-indexing by micro-batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

QUIET_MS, RECONCILE_S = 500, 300


class Debouncer:
    """Fires once no event has come for a whole quiet period."""

    def __init__(self, quiet_s: float, clock: Callable[[], float] = time.monotonic):
        self.quiet_s, self.clock, self.last = quiet_s, clock, None

    def event(self) -> None:
        self.last = self.clock()

    def due(self) -> bool:
        if self.last is None or self.clock() - self.last < self.quiet_s:
            return False
        self.last = None
        return True


def quiet_groups(events: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """A stream of ``key`` events to ``key, events``: one row per burst, put
    out when its key has been quiet for ``quiet_ms`` of processing time."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (n,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "events": [n]})
            return
        n = sum(len(b) for b in batches) + (state.get[0] if state.exists else 0)
        state.update((n,))
        state.setTimeoutDuration(quiet_ms)

    return events.groupBy("key").applyInPandasWithState(step, "key string, events long", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tree_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, change`` (``added``, ``modified``, ``deleted``) between two
    listings of ``path, length, modified``."""
    a, b = before.select("path", F.struct("length", "modified").alias("old")), after.select("path", F.struct("length", "modified").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def watch_tree(spark: SparkSession, root: str, on_changes: Callable[[DataFrame, DataFrame], None], state: str, trigger: dict | None = None) -> StreamingQuery:
    """Changed and deleted files below ``root`` as micro-batches.

    Each turn lists the tree (paths, sizes and times, no contents) and compares
    it with the listing that the last successful turn left in ``state``;
    ``on_changes`` gets ``path, content`` of what is new or changed and the
    deleted ``path``s.  A turn that fails is reported and comes again with the
    next, as its listing isn't kept.
    """
    schema = "path string, length long, modified timestamp"

    def listing() -> DataFrame:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        return raw.select("path", "length", F.col("modificationTime").alias("modified"))

    def turn(_: DataFrame, batch: int) -> None:
        try:
            kept = f"{state}/listing-{batch}"
            listing().write.mode("overwrite").parquet(kept)
            now = spark.read.schema(schema).parquet(kept)
            known = [f"{state}/{line}" for line in spark.read.text(f"{state}/current").toPandas()["value"]] if batch_done(spark, f"{state}/current") else []
            before = spark.read.schema(schema).parquet(*known) if known else spark.createDataFrame([], schema)
            changes = tree_changes(before, now).cache()
            if not changes.isEmpty():
                files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
                on_changes(files.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi"), changes.where("change = 'deleted'").select("path"))
            changes.unpersist()
            spark.createDataFrame([(f"listing-{batch}",)], "value string").coalesce(1).write.mode("overwrite").text(f"{state}/current")
        except Exception as e:  # a bad file must not end the watch
            print(f"watch: {e}")

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(turn).option("checkpointLocation", f"{state}/checkpoint").trigger(**(trigger or {"processingTime": f"{QUIET_MS} milliseconds"})).start()


def batch_done(spark: SparkSession, path: str) -> bool:
    """Whether a finished output lies at ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def watch(spark: SparkSession, root: str, on_files: Callable[[DataFrame], None], checkpoint: str, reconcile: Callable[[], None] | None = None, trigger: dict | None = None, clock: Callable[[], float] = time.monotonic) -> StreamingQuery:
    """New files below ``root`` as micro-batches of ``path, content``.

    A batch's failure is reported and doesn't end the stream; every
    ``RECONCILE_S`` seconds ``reconcile`` runs a full pass after a batch.
    """
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length long, content binary").load(root)
    last = [clock()]

    def each(batch: DataFrame, _: int) -> None:
        try:
            on_files(batch.select("path", "content"))
            if reconcile is not None and clock() - last[0] >= RECONCILE_S:
                reconcile()
                last[0] = clock()
        except Exception as e:  # a bad file must not end the watch
            print(f"watch: {e}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": f"{QUIET_MS} milliseconds"})).start()
