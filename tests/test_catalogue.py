"""Every query of the catalogue against its SQL; those without SQL must run and keep their columns."""

import pytest
from oracle import assert_same

import __spark_entry__
from tallyweave.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert_same(catalogue.QUERIES[name](spark, sf), catalogue.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, sf, name):
    found = catalogue.QUERIES[name](spark, sf)
    assert len(set(found.columns)) == len(found.columns) and found.count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_batch_lists_hold_all_customers_and_keep_zeros(spark, sf, tmp_path):
    customers, orders = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "orders"))
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    orders.filter("o_custkey % 3 <> 0").write.parquet(f"{tmp_path}/orders.parquet")
    every = {r["batch"]: r["n_entries"] for r in catalogue.QUERIES["batch_list_all_counts"](spark, str(tmp_path)).collect()}
    held = {r["o_custkey"]: r["count"] for r in orders.filter("o_custkey % 3 <> 0").groupBy("o_custkey").count().collect()}
    assert every == {r["c_custkey"]: held.get(r["c_custkey"], 0) for r in customers.collect()} and 0 in every.values()
    some = {r["batch"] for r in catalogue.QUERIES["batch_list_word_counts"](spark, str(tmp_path)).collect()}
    assert some == {r["c_custkey"] for r in customers.filter("c_mktsegment = 'HOUSEHOLD'").collect()}


def test_entry(spark, sf):
    assert __spark_entry__.entry(spark).columns
