"""Streams over several files: windows that several batches change, and rows beyond the watermark."""

import datetime as dt
import time

from tallyweave.streaming import balance

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp, event_type string, value double, user_id long"


def written(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken by their time, in seconds


def test_windows_of_several_batches_add_up(spark, tmp_path):
    at = lambda d: DAY + dt.timedelta(days=d, hours=1)
    folder = f"{tmp_path}/events.parquet"
    written(spark, folder, [[(at(0), "purchase", 2.0, 1), (at(0), "view", 1.0, 1)], [(at(0), "purchase", 3.5, 1), (at(9), "view", None, 2)]])
    found = {(r["window_start"].day, r["user_id"]): (float(r["debit"]), float(r["credit"]), r["balanced"]) for r in balance.stream_balances(spark, folder).collect()}
    assert found == {(1, 1): (5.5, 1.0, False), (10, 2): (0.0, 0.0, True)}


def test_rows_beyond_the_watermark_are_dropped_unless_it_reaches_back(spark, tmp_path):
    at = lambda d: DAY + dt.timedelta(days=d, hours=1)
    folder = f"{tmp_path}/events.parquet"
    written(spark, folder, [[(at(9), "view", 1.0, 1)], [(at(9), "view", 1.0, 1)], [(at(0), "view", 7.0, 1)]])
    total = lambda late: {r["window_start"].day: float(r["total"]) for r in balance.stream_totals(spark, folder, late).collect()}
    assert total("1 day") == {10: 2.0}
    assert total("30 days") == {1: 7.0, 10: 2.0}
