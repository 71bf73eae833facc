"""Running totals of a stream of amounts; a watermark bounds the state that is kept."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.session import shared_folder

MONEY = "decimal(20,2)"


def windowed(stream: DataFrame, time: str, keys: list[str], measures: list[Column], width: str = "1 day", late: str = "1 day") -> DataFrame:
    """The measures per time window and keys. A window is forgotten once ``late`` has passed since its end; rows that come later still are dropped."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("_window"), *keys).agg(*measures)
    return grouped.withColumn("window_start", F.col("_window.start").cast("timestamp_ntz")).drop("_window")


def windowed_totals(stream: DataFrame, time: str, kind: str, amount: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, kind, n, total): count and exact total."""
    measures = [F.count(F.lit(1)).alias("n"), F.sum(F.col(amount).cast(MONEY)).alias("total")]
    return windowed(stream, time, [kind], measures, width, late)


def windowed_balances(stream: DataFrame, time: str, voucher: str, debit: Column, credit: Column, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, voucher, debit, credit): both sides of each voucher; null amounts are zero."""
    side = lambda c, name: F.sum(F.coalesce(c.cast(MONEY), F.lit(0).cast(MONEY))).alias(name)
    return windowed(stream, time, [voucher], [side(debit, "debit"), side(credit, "credit")], width, late)


def run_available(totals: DataFrame, out: str, checkpoint: str) -> None:
    """Works off all that is there now. Each batch writes the windows that it changed to a folder of its own, which a repeated batch overwrites."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    totals.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(keep).start().awaitTermination()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The windows as the last batch that changed them left them."""
    found = spark.read.parquet(out)
    values = [c for c in found.columns if c not in (*keys, "batch")]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last")).select(*keys, "_last.*")


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """The rows at ``path`` as a stream, one file a batch."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file in no other way
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(pattern)


def _streamed(spark: SparkSession, totals: DataFrame, keys: list[str]) -> DataFrame:
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run_available(totals, f"{folder}/out", f"{folder}/state")
    return latest(spark, f"{folder}/out", keys)


def stream_totals(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """Totals of the events at ``path`` by day and type, by way of a stream; ``late`` bounds how far files may be out of order."""
    return _streamed(spark, windowed_totals(events_stream(spark, path), "ts", "event_type", "value", late=late), ["window_start", "event_type"])


def stream_balances(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """Users as vouchers by day, whose purchases are debits and other events credits, with their difference."""
    paid = F.col("event_type") == "purchase"
    sides = windowed_balances(events_stream(spark, path), "ts", "user_id", F.when(paid, F.col("value")), F.when(~paid, F.col("value")), late=late)
    found = _streamed(spark, sides, ["window_start", "user_id"])
    apart = (F.col("debit") - F.col("credit")).cast("decimal(30,2)")
    return found.withColumn("difference", apart).withColumn("balanced", F.abs("difference") <= F.lit("0.01").cast(MONEY))
