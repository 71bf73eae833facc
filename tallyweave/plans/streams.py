"""Queries that run as streams over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.streaming import balance

#: The files of a table come in any order of time, and none of its rows may be dropped.
ALL_LATE = "36500 days"


def streaming_daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.stream_totals(spark, f"{sf_dir}/events.parquet", ALL_LATE)


def streaming_voucher_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = balance.stream_balances(spark, f"{sf_dir}/events.parquet", ALL_LATE)
    total = lambda c: F.col(c).cast("decimal(30,2)").alias(c)
    return found.select("window_start", "user_id", total("debit"), total("credit"), "difference", "balanced")


QUERIES = {"streaming_daily_totals": streaming_daily_totals, "streaming_voucher_balance": streaming_voucher_balance}
ORACLES = {
    "streaming_daily_totals": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(20,2))) AS total FROM events GROUP BY 1, 2",
    "streaming_voucher_balance": """WITH s AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, user_id, CAST(coalesce(sum(CAST(value AS DECIMAL(20,2))) FILTER (event_type = 'purchase'), 0) AS DECIMAL(30,2)) AS debit,
  CAST(coalesce(sum(CAST(value AS DECIMAL(20,2))) FILTER (event_type <> 'purchase'), 0) AS DECIMAL(30,2)) AS credit FROM events GROUP BY 1, 2)
SELECT *, CAST(debit - credit AS DECIMAL(30,2)) AS difference, abs(debit - credit) <= 0.01 AS balanced FROM s""",
}
