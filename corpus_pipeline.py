"""A corpus pipeline of the operators in ``ledgerloom.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.

Ids may be null or repeated, and columns beside those of ``documents`` pass
through all stages but the last, whatever their names.  An empty table gives
an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import line_dedup, ngram_join, packing, quality
from ledgerloom.llm._common import plain, table
from ledgerloom.llm.decontaminate import decontaminate


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are more likely of low quality.

    Each row is judged by its text alone: repeated rows stay or go together, a
    null text is judged as an empty one, a probability of just a half stays.
    With no usable label every row stays.
    """
    rated = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(rated, quality.grades_of_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.select_quality(docs, model, 1)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of earlier documents.

    Of equal lines that of the smallest id (nulls last) stays, then that of
    the smallest text hash and place.  A document that has no line left goes;
    one without a line before, null and empty texts too, stays.  Rows equal in
    id and text are one document and keep the same lines.
    """
    left = line_dedup.dedup_lines(docs, drop_emptied=True)
    safe, (text, n_chars) = plain(left, "text", "n_chars")
    counted = F.when(F.col(text).isNotNull(), F.length(text)).otherwise(F.col(n_chars)).cast(docs.schema["n_chars"].dataType)
    return safe.withColumn(n_chars, counted).toDF(*left.columns)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    The smallest id (nulls last) of a group stays, at a tie the smallest text
    hash; of rows equal in id and text one.  Null and empty texts and those
    without a word are like nothing and all stay.
    """
    return ngram_join.keep_one(docs)


def _clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item.

    Null and empty texts hold none and stay, repeated rows stay or go
    together.  Without items every row stays.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes.

    Null and empty texts and those without a word have no piece; repeated rows
    have pieces of their own.
    """
    return packing.pack_documents(docs)


STAGES = [("quality", _quality), ("lines", _lines), ("near-duplicates", _near), ("decontamination", _clean), ("packing", _pack)]

#: A classifier is trained on the way, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
