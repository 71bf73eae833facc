"""Contiguous shards of equal bytes from global prefix sums.

Documents are put in order of id (null last, then by checksum and size) and cut where the
running byte count passes each multiple of total/shards, so every shard is a contiguous range
of ids. The running sum is global without a global sort: quantiles of the id split the order
into ranges of about equal row counts, one small total per range gives the offset of the next
one, and a window inside a range does the rest. The ranges are literals of the plan, so a
recomputed task sees the same cuts.

A null text has only the added byte. Rows with equal id, checksum and size share a range and
any order among them gives the same result. An empty table gives no rows. The law held is
``bytes``: every shard ends within one document of its target, also when equal texts repeat.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges per shuffle partition, and the most there are: the bound on what the driver gathers.
RANGES_EACH, MAX_RANGES = 4, 8192


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _ranges(rows: DataFrame, key: str) -> list[float]:
    """Cut points of the id: at most MAX_RANGES numbers."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(MAX_RANGES, RANGES_EACH * partitions))
    return sorted(set(rows.approxQuantile(key, [i / n for i in range(1, n)], 1 / (4 * n))))


def shard_by_bytes(rows: DataFrame, shards: int, key: str = "doc_id", size: str = "size", tie: str = "text_crc32") -> DataFrame:
    """``rows`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 inside a shard)."""
    cuts = _ranges(rows, key) or [0.0]  # an empty table has no quantiles
    splits = [-float("inf"), *cuts, float("inf")]
    number = rows.withColumn("_key", F.col(key).cast("double"))
    bucket = Bucketizer(splits=splits, inputCol="_key", outputCol="_range", handleInvalid="keep")
    last = F.lit(len(splits) - 1)  # of null ids
    placed = bucket.transform(number).withColumn("_range", F.coalesce(F.col("_range").cast("int"), last)).drop("_key")
    totals = sorted(placed.groupBy("_range").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).collect())
    total = sum(r["bytes"] for r in totals)
    offsets, so_far, n_far = [(0, 0)] * len(splits), 0, 0
    for r in totals:
        offsets[r["_range"]] = (so_far, n_far)
        so_far, n_far = so_far + r["bytes"], n_far + r["n"]
    before = F.get(F.lit([o for o, _ in offsets]), F.col("_range"))
    inside = Window.partitionBy("_range").orderBy(F.col(key).asc_nulls_last(), tie, size)
    start = before + F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(start, before)
    # a document goes where its middle byte lies
    middle = (F.lit(2) * start + F.col(size)).cast("decimal(38,0)")
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(1, 2 * total)).cast("decimal(38,0)"))).cast("int")
    numbered = placed.withColumns({"shard": shard, "_nth": F.row_number().over(inside)})
    counts = sorted(numbered.groupBy("shard", "_range").agg(F.min("_nth").alias("first")).collect()) if totals else []
    firsts: dict[int, int] = {}
    for r in counts:  # the global place of a shard's first row
        at = offsets[r["_range"]][1] + r["first"]
        firsts[r["shard"]] = min(at, firsts.get(r["shard"], at))
    nth = F.get(F.lit([n for _, n in offsets]), F.col("_range")) + F.col("_nth")
    first = F.get(F.lit([firsts.get(s, 0) for s in range(shards)]), F.col("shard"))
    return numbered.withColumn("slot", (nth - first).cast("long")).drop("_range", "_nth")
