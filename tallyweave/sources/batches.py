"""Imports stored as two tables, raw rows and entries, that appear and disappear together.

A write stages both tables under a new version and then adds one file to the manifest; only what the manifest
names is read. A job that fails before leaves files that no one sees, and one that fails after has already
succeeded. Later writes of a batch replace it, deletions are lines of the manifest too, and nothing is overwritten,
so readers that started before keep what they saw.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("raw_rows", "entries")
MANIFEST = "batch string, version string, place long"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """All lines so far; none where nothing was written."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _commit(batches: DataFrame, path: str) -> None:
    """Adds the lines (batch, version) as one file, which is there whole or not at all."""
    place = (_manifest(batches.sparkSession, path).agg(F.max("place")).first()[0] or 0) + 1
    batches.withColumn("place", F.lit(place).cast("long")).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def write_import(raw_rows: DataFrame, entries: DataFrame, path: str, by: str = "batch_id") -> str:
    """Stores the batches of ``raw_rows`` with their entries and gives the version; either both tables show them or neither.

    Entries of a batch that has no raw rows are refused.
    """
    spark, version = raw_rows.sparkSession, uuid.uuid4().hex
    for table, rows in zip(TABLES, (raw_rows, entries), strict=True):
        rows.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{path}/{table}")
    staged = [spark.read.parquet(f"{path}/{t}").filter(F.col("version") == version).select(F.col(by).cast("string").alias("batch")).distinct() for t in TABLES]
    if not staged[1].join(staged[0], "batch", "left_anti").isEmpty():
        raise ValueError("entries of batches without raw rows")
    _commit(staged[0].withColumn("version", F.lit(version)), path)
    return version


def delete_import(batches: DataFrame, path: str, by: str = "batch_id") -> None:
    """Takes the batches (a column ``by``) out of both tables at once."""
    _commit(batches.select(F.col(by).cast("string").alias("batch"), F.lit(None).cast("string").alias("version")).distinct(), path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """(batch, version) of the batches that are there: the last line of each, unless it deletes."""
    last = _manifest(spark, path).groupBy("batch").agg(F.max_by("version", F.struct("place", "version")).alias("version"))
    return last.filter("version is not null")


def read_import(spark: SparkSession, path: str, table: str, by: str = "batch_id") -> DataFrame:
    """The rows of one of TABLES as the manifest has them now; versions that are not current are not scanned."""
    live = current(spark, path).withColumnRenamed("version", "_version")
    rows = spark.read.parquet(f"{path}/{table}")
    return rows.join(live, (F.col(by).cast("string") == F.col("batch")) & (F.col("version") == F.col("_version"))).select(*(c for c in rows.columns if c != "version"))
