"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses ``spark.checkpoint.dir``; only a local session gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    context.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows up to which a materialised side of a join is broadcast.
BROADCAST_ROWS = 200_000


def sized(small: DataFrame) -> DataFrame:
    """A materialised frame, marked for broadcast if it is small."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small
