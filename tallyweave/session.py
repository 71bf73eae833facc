"""Session and table helpers shared by the catalogue, the bench and the tests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events".split()


def local_session(cores: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench rely on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyweave")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables; ``sf_dir`` may be any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bench_dir() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir or, without one, the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from files in the session's checkpoint folder; one in the shared folder is set where it has none."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(f"{shared_folder(df.sparkSession)}/checkpoints")
    return df.checkpoint(eager=True)
