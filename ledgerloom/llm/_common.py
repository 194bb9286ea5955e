"""Shared folder, lineage cuts and small join helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many bytes, measured on a
#: materialised table by its row count; beyond it the join is a shuffle.
BROADCAST_BYTES = 32 << 20
#: Spark deletes the shuffles of a statement at its end if this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one named by ``spark.checkpoint.dir`` (or already set on the
    context).  Only a local session without the setting gets a temporary
    folder; a cluster without it is an error, since a machine-local folder
    would not outlive an executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if named is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
            named = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        context.setCheckpointDir(named)
        current = context.getCheckpointDir()
    return named or current


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder as a checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def run_folder(spark: SparkSession) -> str:
    """Where in the shared folder this application keeps its tables."""
    return f"{shared_dir(spark).rstrip('/')}/ledgerloom/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the application's folder that nothing uses yet."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Compressed and columnar, so better than a checkpoint for anything wide.
    The shuffles that led to it are deleted as soon as it is written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(spark: SparkSession, *written: DataFrame) -> None:
    """Delete tables that ``table`` wrote and nothing reads any more."""
    for df in written:
        files = df.inputFiles()
        if files:
            _delete(spark, files[0].rsplit("/", 1)[0])


def clean_up(spark: SparkSession) -> None:
    """Delete every table this application has written.  To be called when the
    results of the operators have been stored, as they are read from there."""
    _delete(spark, run_folder(spark))


def plain(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named c0, c1, ... by place, and what ``columns``
    are called in it.  No name that a caller may have chosen, with dots or in
    another case, can clash with those of an operator's own columns; ``toDF``
    with the old names undoes it."""
    require(df, columns)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{df.columns.index(c)}" for c in columns]


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_enough(materialised: DataFrame, row_bytes: int, limit: int | None = None) -> bool:
    """Whether a materialised frame may be broadcast, by counting its rows.

    ``row_bytes`` are those of its values; the hashed rows that are sent hold
    them twice, with about 72 bytes for each row.
    """
    return materialised.count() * (72 + 2 * row_bytes) <= (BROADCAST_BYTES if limit is None else limit)


def _bits(rows: int) -> int:
    """Bits of a bitmap of hashes, a power of two up to 32 MiB of them."""
    return 1 << min(28, max(16, (rows * 16).bit_length()))


def _marked(small: DataFrame, key: Column, bits: int) -> np.ndarray:
    """The bitmap of the low bits of ``key``, a long of even hashes."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = [np.empty(0, np.int64)]
        for b in batches:
            slots.append(np.unique(b.column(0).drop_null().to_numpy() & (bits - 1)))
        slot = np.unique(np.concatenate(slots))
        used, back = np.unique(slot >> 3, return_inverse=True)
        value = np.zeros(len(used), np.int32)
        np.bitwise_or.at(value, back, np.left_shift(np.int32(1), (slot & 7).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(value)], names=["at", "bits"])

    got = small.select(key.alias("key")).mapInArrow(part, "at long, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 3, np.uint8)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy().astype(np.uint8)
    return out


def sized_join(big: DataFrame, small: DataFrame, on: Column | list[str], how: str, row_bytes: int, hashes: tuple[Column, Column] | None = None) -> DataFrame:
    """Join that broadcasts ``small`` only after its size has been checked.

    ``small`` must be materialised.  Beyond the limit both sides are shuffled.
    With ``hashes``, a long of even hashes of the key on either side, rows of
    ``big`` whose hash is surely not in ``small`` (by a bitmap of bounded size)
    are not: of an anti or left join they are results as they are.
    """
    if small_enough(small, row_bytes):
        return big.join(F.broadcast(small), on, how)
    if hashes is None:
        return big.join(small, on, how)
    bits = _bits(small.count())
    shared = big.sparkSession.sparkContext.broadcast(_marked(small, hashes[1], bits))

    @F.pandas_udf("boolean")
    def may(keys: pd.Series) -> pd.Series:
        slot = keys.fillna(0).to_numpy(np.int64) & (bits - 1)
        return pd.Series((shared.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1)

    found = big.where(may(hashes[0])).join(small, on, how)
    if how not in ("left", "left_anti"):
        return found
    # a join by names puts these first
    first = on if isinstance(on, list) else []
    kept = big.where(~may(hashes[0]))
    rest = kept.select(*first, *[c for c in kept.columns if c not in first]) if first else kept
    for f in found.schema.fields[len(big.columns) :]:
        rest = rest.withColumn(f.name, F.lit(None).cast(f.dataType))
    return found.union(rest)


def require(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
