"""Balance checks, amount splitting and parsing over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import amounts, parsing
from tallyweave.operators import balance, erp, validation
from tallyweave.session import table


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a journal: status F lines are debits, the others credits."""
    lines = table(spark, sf_dir, "lineitem")
    amount, debit = balance.money("l_extendedprice"), F.col("l_linestatus") == "F"
    zero = F.lit(0).cast(balance.MONEY)
    return lines.select(
        F.col("l_orderkey").alias("voucher_no"),
        F.when(debit, amount).otherwise(zero).alias("debit_amount"),
        F.when(debit, zero).otherwise(amount).alias("credit_amount"),
    )


def voucher_balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.unbalanced_groups(journal(spark, sf_dir), ["voucher_no"], "debit_amount", "credit_amount")


def period_balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    zero = F.lit(0).cast(balance.MONEY)
    open_side = F.col("o_orderstatus") == "O"
    rows = orders.select(
        F.year("o_orderdate").alias("fiscal_year"),
        F.month("o_orderdate").alias("period"),
        F.when(open_side, balance.money("o_totalprice")).otherwise(zero).alias("ending_debit"),
        F.when(open_side, zero).otherwise(balance.money("o_totalprice")).alias("ending_credit"),
    )
    return balance.unbalanced_groups(rows, ["fiscal_year", "period"], "ending_debit", "ending_credit")


def amount_split_by_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    side = F.when(F.col("c_nationkey") % 5 == 4, None).when(F.col("c_nationkey") % 2 == 0, "debit").otherwise("credit")
    parts = amounts.transform_period("ending", "single_by_direction", amount=balance.money("c_acctbal"), direction=side)
    return customers.select("c_custkey", *(c.alias(n) for n, c in parts.items()))


def amount_split_by_source_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    side = F.when(F.col("o_orderkey") % 11 == 0, "??").when(F.col("o_orderstatus") == "F", "借").when(F.col("o_orderstatus") == "O", " 贷方 ").otherwise("平")
    signed = F.when(F.col("o_orderkey") % 3 == 0, -balance.money("o_totalprice")).otherwise(balance.money("o_totalprice"))
    parts = amounts.transform_period("current", "single_by_source_direction", amount=signed, direction=side)
    return orders.select("o_orderkey", *(c.alias(n) for n, c in parts.items()))


def tolerant_decimal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    plain = balance.money("c_acctbal").cast("string")
    kind = F.col("c_custkey") % 7
    text = (
        F.when(kind == 0, F.lit(None).cast("string")).when(kind == 1, "").when(kind == 2, F.concat(F.lit(" "), plain, F.lit(" ")))
        .when(kind == 3, "—").when(kind == 4, F.regexp_replace(plain, r"(\d)(\d{3}\.)", "$1,$2")).when(kind == 5, F.concat(plain, F.lit("x"))).otherwise(plain)
    )
    return customers.select("c_custkey", parsing.to_decimal(text).alias("amount"), parsing.decimal_or_zero(text).alias("amount_or_zero"), parsing.to_int(text).alias("whole"))


def multi_format_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    kind, day = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = (
        F.when(kind == 0, F.date_format(day, "yyyy-MM-dd")).when(kind == 1, F.date_format(day, "yyyy/M/d")).when(kind == 2, F.date_format(day, "yyyyMMdd"))
        .when(kind == 3, F.date_format(day, "yyyy年M月d日")).otherwise("no date")
    )
    return orders.select("o_orderkey", parsing.to_date(text).alias("voucher_date"))


def row_validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    rows = orders.select(
        "o_orderkey",
        F.when(key % 7 == 0, None).otherwise((F.year("o_orderdate") + F.when(key % 11 == 0, 500).otherwise(0)).cast("string")).alias("fiscal_year"),
        F.when(key % 5 == 0, "13").otherwise(F.month("o_orderdate").cast("string")).alias("period"),
        F.when(key % 13 == 0, "abc").otherwise(F.col("o_totalprice").cast("decimal(20,2)").cast("string")).alias("debit_amount"),
    )
    checks = [
        validation.required("fiscal_year", F.col("fiscal_year")),
        validation.whole_between("fiscal_year", F.col("fiscal_year"), 2000, 2100),
        validation.whole_between("period", F.col("period"), 1, 12),
        validation.numeric("debit_amount", F.col("debit_amount")),
    ]
    bad = validation.split_valid(validation.row_errors(rows, checks))[1]
    return bad.select("o_orderkey", F.array_join("errors", "; ").alias("errors"))


def required_field_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    ordered = lines.filter("l_quantity >= 45")
    return validation.missing_references(parts.select("p_partkey", "p_brand"), ordered, "p_partkey", "l_partkey")


def erp_balance_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, nations, regions = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    balances = customers.select(
        F.col("c_nationkey").alias("account_id"), F.lit(2024).alias("year"), F.lit(12).alias("period"), F.lit(0).alias("currency_id"),
        (F.col("c_custkey") % 2).alias("detail_id"), balance.money("c_acctbal").alias("opening"), F.lit(1).alias("debit"), F.lit(2).alias("credit"), (-balance.money("c_acctbal")).alias("ending"),
    )
    accounts = nations.select(F.col("n_nationkey").alias("account_id"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("code"))
    labels = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("account_id"), F.when(F.col("r_regionkey") < 3, 2052).otherwise(1033).alias("locale_id"), F.concat_ws("/", "r_name", "n_name").alias("name"))
    return erp.from_balances(balances, accounts, labels, 2024, 12, 2052)


def erp_detail_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    owed = F.col("o_orderstatus") == "F"
    details = orders.select(
        F.when(F.col("o_custkey") % 10 == 0, " ").otherwise(F.concat(F.lit("C"), F.col("o_custkey") % 100)).alias("code"),
        F.col("o_custkey").alias("account_id"),
        F.when(F.month("o_orderdate") == 1, "00").otherwise(F.lpad(F.month("o_orderdate").cast("string"), 2, "0")).alias("period"),
        F.when(owed, balance.money("o_totalprice")).alias("debit"),
        F.when(~owed, balance.money("o_totalprice")).alias("credit"),
    )
    names = customers.select(F.col("c_custkey").alias("account_id"), F.when(F.col("c_custkey") % 3 == 0, F.concat_ws("/", "c_mktsegment", "c_name")).alias("display"), F.col("c_name").alias("name"))
    return erp.from_details(details, names)


_ALL = (
    voucher_balance_check, period_balance_check, amount_split_by_direction, amount_split_by_source_direction, tolerant_decimal_parse, multi_format_date_parse,
    row_validation_errors, required_field_anti_join, erp_balance_extract, erp_detail_extract,
)
QUERIES = {f.__name__: f for f in _ALL}

_M = "DECIMAL(20,2)"
ORACLES = {
    "voucher_balance_check": """
WITH sums AS (
  SELECT l_orderkey AS voucher_no,
         CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(20,2)) ELSE 0 END) AS DECIMAL(30,2)) AS debit_total,
         CAST(sum(CASE WHEN l_linestatus = 'F' THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(20,2)) END) AS DECIMAL(30,2)) AS credit_total,
         count(*) AS n_lines
  FROM lineitem GROUP BY 1)
SELECT *, CAST(debit_total - credit_total AS DECIMAL(30,2)) AS difference
FROM sums WHERE debit_total > 0 AND credit_total > 0 AND abs(debit_total - credit_total) > 0.01""",
    "period_balance_check": """
WITH sums AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CAST(month(o_orderdate) AS INTEGER) AS period,
         CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(20,2)) ELSE 0 END) AS DECIMAL(30,2)) AS debit_total,
         CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE CAST(o_totalprice AS DECIMAL(20,2)) END) AS DECIMAL(30,2)) AS credit_total,
         count(*) AS n_lines
  FROM orders GROUP BY 1, 2)
SELECT *, CAST(debit_total - credit_total AS DECIMAL(30,2)) AS difference
FROM sums WHERE debit_total > 0 AND credit_total > 0 AND abs(debit_total - credit_total) > 0.01""",
    "amount_split_by_direction": f"""
WITH a AS (SELECT c_custkey, CAST(c_acctbal AS {_M}) AS v,
  CASE WHEN c_nationkey % 5 = 4 THEN NULL WHEN c_nationkey % 2 = 0 THEN 'debit' ELSE 'credit' END AS d FROM customer)
SELECT c_custkey,
  CAST(CASE WHEN d = 'debit' THEN greatest(v, 0) WHEN d = 'credit' THEN greatest(-v, 0) ELSE 0 END AS {_M}) AS ending_debit,
  CAST(CASE WHEN d = 'debit' THEN greatest(-v, 0) WHEN d = 'credit' THEN greatest(v, 0) ELSE 0 END AS {_M}) AS ending_credit,
  CASE WHEN v <> 0 AND d IS NULL THEN 'direction missing' END AS ending_issue FROM a""",
    "amount_split_by_source_direction": f"""
WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -CAST(o_totalprice AS {_M}) ELSE CAST(o_totalprice AS {_M}) END AS v,
  CASE WHEN o_orderkey % 11 = 0 THEN '?' WHEN o_orderstatus = 'F' THEN 'd' WHEN o_orderstatus = 'O' THEN 'c' ELSE 'f' END AS s FROM orders)
SELECT o_orderkey,
  CAST(CASE s WHEN 'd' THEN greatest(v, 0) WHEN 'c' THEN greatest(-v, 0) WHEN 'f' THEN v ELSE 0 END AS {_M}) AS current_debit,
  CAST(CASE s WHEN 'd' THEN greatest(-v, 0) WHEN 'c' THEN greatest(v, 0) ELSE 0 END AS {_M}) AS current_credit,
  CASE WHEN v = 0 THEN NULL WHEN s = '?' THEN 'direction unknown' WHEN s = 'f' THEN 'flat with an amount, taken as debit' END AS current_issue FROM a""",
    "tolerant_decimal_parse": f"""
WITH a AS (SELECT c_custkey, CAST(c_acctbal AS {_M}) AS v, c_custkey % 7 AS k FROM customer)
SELECT c_custkey, CASE WHEN k IN (2, 4, 6) THEN v END AS amount, CAST(CASE WHEN k IN (2, 4, 6) THEN v ELSE 0 END AS {_M}) AS amount_or_zero,
  CASE WHEN k IN (2, 4, 6) THEN CAST(trunc(CAST(v AS DOUBLE)) AS INTEGER) END AS whole FROM a""",
    "multi_format_date_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderdate AS DATE) END AS voucher_date FROM orders",
    "row_validation_errors": """
WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE year(o_orderdate) + CASE WHEN o_orderkey % 11 = 0 THEN 500 ELSE 0 END END AS y FROM orders),
e AS (SELECT o_orderkey, list_filter([
   CASE WHEN y IS NULL THEN 'fiscal_year: missing' END,
   CASE WHEN y NOT BETWEEN 2000 AND 2100 THEN 'fiscal_year: out of range' END,
   CASE WHEN o_orderkey % 5 = 0 THEN 'period: out of range' END,
   CASE WHEN o_orderkey % 13 = 0 THEN 'debit_amount: not a number' END], lambda x: x IS NOT NULL) AS l FROM a)
SELECT o_orderkey, array_to_string(l, '; ') AS errors FROM e WHERE len(l) > 0""",
    "required_field_anti_join": "SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)",
    "erp_balance_extract": f"""
SELECT 'N' || n_nationkey AS code, coalesce(l.name, 'N' || n_nationkey) AS name,
  CAST(greatest(v, 0) AS {_M}) AS opening_debit, CAST(greatest(-v, 0) AS {_M}) AS opening_credit, CAST(1 AS {_M}) AS current_debit, CAST(2 AS {_M}) AS current_credit,
  CAST(greatest(-v, 0) AS {_M}) AS ending_debit, CAST(greatest(v, 0) AS {_M}) AS ending_credit
FROM (SELECT *, CAST(c_acctbal AS {_M}) AS v FROM customer WHERE c_custkey % 2 = 0) b
JOIN nation n ON n.n_nationkey = b.c_nationkey
LEFT JOIN (SELECT n_nationkey AS k, r_name || '/' || n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3) l ON l.k = n.n_nationkey""",
    "erp_detail_extract": f"""
WITH d AS (SELECT CASE WHEN o_custkey % 10 = 0 THEN ' ' ELSE 'C' || (o_custkey % 100) END AS code, o_custkey, month(o_orderdate) = 1 AS opens,
    CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS {_M}) ELSE 0 END AS dr, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE CAST(o_totalprice AS {_M}) END AS cr FROM orders),
s AS (SELECT code, max(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || '/' || c_name ELSE '' END) AS disp, max(coalesce(c_name, '')) AS fb,
    sum(CASE WHEN opens THEN dr - cr ELSE 0 END) AS o, sum(CASE WHEN opens THEN 0 ELSE dr END) AS dr, sum(CASE WHEN opens THEN 0 ELSE cr END) AS cr
  FROM d LEFT JOIN customer ON c_custkey = o_custkey WHERE trim(code) <> '' GROUP BY code)
SELECT code, CASE WHEN disp LIKE '%/%' THEN array_to_string(string_split(disp, '/')[2:], '_') WHEN disp <> '' THEN disp ELSE fb END AS name,
  CAST(greatest(o, 0) AS {_M}) AS opening_debit, CAST(greatest(-o, 0) AS {_M}) AS opening_credit, CAST(dr AS {_M}) AS current_debit, CAST(cr AS {_M}) AS current_credit,
  CAST(greatest(o + dr - cr, 0) AS {_M}) AS ending_debit, CAST(greatest(-(o + dr - cr), 0) AS {_M}) AS ending_credit FROM s""",
}
