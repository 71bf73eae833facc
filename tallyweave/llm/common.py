"""Column helpers shared by the text operators."""

from __future__ import annotations

import gc
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of single-byte characters take the fast way."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from the md5 of seed and keys, the same on every run and engine."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from files that every executor can read.

    ``checkpoint()`` writes to the folder of spark.checkpoint.dir. Where a session has none
    (tests on one machine) a folder under the warehouse is set first. Spark deletes the shuffle
    files that led to the rows once the driver has collected its garbage, so that is asked for
    here: a long chain of steps then holds the files of one step at a time.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    out = df.checkpoint(eager=True)
    gc.collect()
    context._jvm.System.gc()
    return out
