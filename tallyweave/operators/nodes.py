"""Unique account nodes: folding duplicate rows, spreading results back, finding conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique_nodes(rows: DataFrame, key: str, row: str, carried: list[str]) -> DataFrame:
    """One row per node: its smallest row, that row's columns, and how many rows it stands for."""
    picked = F.min(F.struct(row, *carried)).alias("first")
    return rows.groupBy(key).agg(picked, F.count(F.lit(1)).alias("n_rows")).select(key, "n_rows", F.col(f"first.{row}").alias("representative"), *(F.col(f"first.{c}").alias(c) for c in carried))


def compression(rows: DataFrame, key: str) -> DataFrame:
    counts = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_nodes"))
    return counts.withColumn("duplicates", F.col("n_rows") - F.col("n_nodes")).withColumn("ratio", F.round(F.col("n_rows") / F.col("n_nodes"), 2))


def conflicting_targets(rows: DataFrame, key: str, target: str) -> DataFrame:
    """Keys with several targets, with the sorted targets. A null target is none."""
    found = rows.filter(F.col(target).isNotNull()).select(key, target).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_targets"), F.array_sort(F.collect_list(target)).alias("targets"))
    return found.filter("n_targets > 1")


def first_resolved(rows: DataFrame, key: str, row: str, target: str, into: str) -> DataFrame:
    """Each row with the first non-null target of its node, by row order."""
    first = rows.filter(F.col(target).isNotNull()).groupBy(key).agg(F.min_by(target, row).alias(into))
    return rows.join(first, key, "left")


def fill_forward(rows: DataFrame, group: str, order: list[str], value: str, into: str) -> DataFrame:
    """The last non-null value up to each row; a hot group is one window, sorted and spilled by Spark."""
    window = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.last(value, ignorenulls=True).over(window))


def unresolved(rows: DataFrame, key: str, participates: str, target: str) -> DataFrame:
    """Nodes with participating rows of which none has a target."""
    return rows.filter(participates).groupBy(key).agg(F.bool_or(F.col(target).isNotNull()).alias("resolved"), F.count(F.lit(1)).alias("n_rows")).filter("not resolved").drop("resolved")
