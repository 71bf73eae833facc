"""Hierarchies, roll-ups, classification and reconciliation over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import names
from tallyweave.operators import balance, classification, hierarchy, views
from tallyweave.session import table


def coded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("code"), "p_name")


def prefix_parent_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hierarchy.by_code(coded_parts(spark, sf_dir), "p_partkey", "code")
    return found.filter("parent_code is not null").select("p_partkey", "parent_code")


def code_hierarchy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hierarchy.by_code(coded_parts(spark, sf_dir), "p_partkey", "code")
    return found.select("p_partkey", "level", "is_leaf", F.array_join(F.array_append("path", F.col("code")), "\\").alias("full_path"))


def hierarchy_merge_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hierarchy.by_code(coded_parts(spark, sf_dir), "p_partkey", "code")
    kind = F.col("p_partkey") % 3
    flat = F.struct(F.lit(1).alias("level"), F.lit("flat").alias("level_source"))
    by_code = F.struct(F.col("level"), F.lit("code_prefix").alias("level_source"))
    by_indent = F.struct((F.col("p_partkey") % 4 + 1).cast("int").alias("level"), F.lit("indent_suggested").alias("level_source"))
    return found.withColumn("merged", hierarchy.merged(flat, (kind == 0, by_code), (kind == 1, by_indent))).select("p_partkey", "merged.*")


def geography(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, parent) region, nation and customer, and the customers with their balance."""
    regions, nations, customers = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    node = lambda kind, key: F.concat(F.lit(kind), F.col(key))
    edges = regions.select(node("R", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    edges = edges.union(nations.select(node("N", "n_nationkey"), node("R", "n_regionkey"))).union(customers.select(node("C", "c_custkey"), node("N", "c_nationkey")))
    return edges, customers.select(node("C", "c_custkey").alias("node"), node("N", "c_nationkey").alias("parent"), balance.money("c_acctbal").alias("amount"), "c_custkey")


def chart_recursive_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = geography(spark, sf_dir)
    up = hierarchy.closure(edges, "node", "parent", 4)
    return up.groupBy("node").agg((F.max("distance") + 1).alias("depth"), F.max_by("ancestor", "distance").alias("root"))


def rollup_tree_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, customers = geography(spark, sf_dir)
    debit, credit = F.greatest("amount", F.lit(0).cast(balance.MONEY)), F.greatest(-F.col("amount"), F.lit(0).cast(balance.MONEY))
    entries = customers.select("node", debit.alias("ending_debit"), credit.alias("ending_credit"))
    up = hierarchy.closure(edges, "node", "parent", 4)
    sums = hierarchy.roll_up(entries.withColumnRenamed("node", "entry"), "entry", ["ending_debit", "ending_credit"], up)
    tree = views.tree_nodes(edges, sums, up, only_with_amounts=True)
    total = lambda c: F.col(c).cast("decimal(30,2)").alias(c)
    return tree.select("node", "parent", "depth", total("ending_debit"), total("ending_credit"), "entry_count")


def drifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nation totals of which every third is off, and the customers below them."""
    _, customers = geography(spark, sf_dir)
    sums = customers.groupBy("parent").agg(F.sum("amount").alias("amount"))
    off = F.when(F.substring("parent", 2, 9).cast("int") % 3 == 0, F.lit("0.02")).otherwise(F.lit("0")).cast(balance.MONEY)
    return sums.select("parent", (F.col("amount") + off).cast("decimal(30,2)").alias("net")), customers.select("parent", F.col("amount").alias("net"))


def parent_leaf_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, leaves = drifted(spark, sf_dir)
    found = hierarchy.reconcile(parents, leaves, "parent", ["net"])
    return found.select("parent", F.col("parent_amount").cast("decimal(30,2)").alias("parent_amount"), F.col("leaf_amount").cast("decimal(30,2)").alias("leaf_amount"), "difference")


def duplicate_aggregate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, leaves = drifted(spark, sf_dir)
    return classification.duplicate_aggregates(parents, leaves, "parent", ["net"]).select("parent", "n_children", "is_duplicate")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with row classes: keyword rows, zero rows and ignored rows come from its fields."""
    lines = table(spark, sf_dir, "lineitem")
    name = F.when(F.col("l_linenumber") == 7, "本页合计").when((F.col("l_linenumber") == 6) & (F.col("l_returnflag") == "R"), "不过帐").otherwise("货款")
    code = F.when((F.col("l_linenumber") == 5) & (F.col("l_returnflag") == "A"), "制单人").otherwise(F.col("l_partkey").cast("string"))
    tax = F.when(F.col("l_discount") == 0, 0).otherwise(F.col("l_extendedprice")).cast(balance.MONEY)
    rows = lines.select("l_orderkey", "l_partkey", "l_linenumber", tax.alias("debit"), F.lit(0).cast(balance.MONEY).alias("credit"), code.alias("code"), name.alias("name"), (F.col("l_suppkey") % 10 == 0).alias("ignored"))
    summary = classification.has_summary_word(F.col("code"), F.col("name")) | classification.is_footer_or_config(F.col("code"), F.col("name"))
    return rows.withColumn("row_class", classification.row_class(F.col("ignored"), summary, classification.all_zero([F.col("debit"), F.col("credit")])))


def row_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("l_orderkey", "l_partkey", "l_linenumber", "row_class")


def classification_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classification.class_identity(classified(spark, sf_dir))


def business_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classification.business_reconciliation(classified(spark, sf_dir), ["debit", "credit"])


def summary_keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.filter(names.contains_any(F.col("p_name"), ("red", "blue", "steel"))).select("p_partkey", "p_name")


_ALL = (
    prefix_parent_join, code_hierarchy_levels, hierarchy_merge_priority, chart_recursive_depth, rollup_tree_sums, parent_leaf_reconciliation, duplicate_aggregate_rows,
    row_classification, classification_identity, business_reconciliation, summary_keyword_filter,
)
QUERIES = {f.__name__: f for f in _ALL}

_UP = """WITH c AS (SELECT p_partkey, p_partkey::VARCHAR AS code FROM part),
up AS (SELECT a.p_partkey, b.code AS anc FROM (SELECT p_partkey, code, unnest(range(1, length(code))) AS n FROM c) a JOIN c b ON b.code = substr(a.code, 1, a.n::INT)),
h AS (SELECT c.p_partkey, c.code, list_sort(coalesce(list(anc) FILTER (anc IS NOT NULL), [])) AS path FROM c LEFT JOIN up USING (p_partkey) GROUP BY ALL)"""
_EDGES = """e AS (SELECT 'R' || r_regionkey AS node, NULL::VARCHAR AS parent FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer),
t AS (SELECT node, node AS anc, 0 AS d FROM e UNION ALL SELECT t.node, e.parent, d + 1 FROM t JOIN e ON e.node = t.anc WHERE e.parent IS NOT NULL)"""
_DRIFT = """WITH s AS (SELECT 'N' || c_nationkey AS parent, c_nationkey AS k, sum(CAST(c_acctbal AS DECIMAL(20,2))) AS leaf, count(*) AS n FROM customer GROUP BY ALL),
p AS (SELECT parent, n, CAST(leaf AS DECIMAL(30,2)) AS leaf_amount, CAST(leaf + CASE WHEN k % 3 = 0 THEN 0.02 ELSE 0 END AS DECIMAL(30,2)) AS parent_amount FROM s)"""
_CLASS = """WITH r AS (SELECT *, CAST(CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice END AS DECIMAL(20,2)) AS debit FROM lineitem),
k AS (SELECT *, CASE WHEN l_suppkey % 10 = 0 THEN 'ignored'
   WHEN l_linenumber = 7 OR (l_linenumber = 6 AND l_returnflag = 'R') OR (l_linenumber = 5 AND l_returnflag = 'A') THEN 'summary_total'
   WHEN abs(debit) <= 0.01 THEN 'zero_amount' ELSE 'eligible' END AS row_class FROM r)"""
ORACLES = {
    "prefix_parent_join": f"{_UP} SELECT p_partkey, path[-1] AS parent_code FROM h WHERE len(path) > 0",
    "code_hierarchy_levels": f"{_UP} SELECT p_partkey, CAST(len(path) + 1 AS INTEGER) AS level, code NOT IN (SELECT anc FROM up) AS is_leaf, array_to_string(list_append(path, code), chr(92)) AS full_path FROM h",
    "hierarchy_merge_priority": f"""{_UP} SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN len(path) + 1 WHEN 1 THEN p_partkey % 4 + 1 ELSE 1 END AS INTEGER) AS level,
  CASE p_partkey % 3 WHEN 0 THEN 'code_prefix' WHEN 1 THEN 'indent_suggested' ELSE 'flat' END AS level_source FROM h""",
    "chart_recursive_depth": f"WITH RECURSIVE {_EDGES} SELECT node, CAST(max(d) + 1 AS INTEGER) AS depth, arg_max(anc, d) AS root FROM t GROUP BY node",
    "rollup_tree_sums": f"""WITH RECURSIVE {_EDGES},
a AS (SELECT 'C' || c_custkey AS node, CAST(c_acctbal AS DECIMAL(20,2)) AS v FROM customer),
s AS (SELECT anc AS node, sum(greatest(v, 0)) AS dr, sum(greatest(-v, 0)) AS cr, count(*) AS n FROM t JOIN a USING (node) GROUP BY anc),
dd AS (SELECT node, max(d) + 1 AS depth FROM t GROUP BY node)
SELECT node, parent, CAST(depth AS INTEGER) AS depth, CAST(dr AS DECIMAL(30,2)) AS ending_debit, CAST(cr AS DECIMAL(30,2)) AS ending_credit, n AS entry_count
FROM e JOIN s USING (node) JOIN dd USING (node)""",
    "parent_leaf_reconciliation": f"{_DRIFT} SELECT parent, parent_amount, leaf_amount, CAST(parent_amount - leaf_amount AS DECIMAL(30,2)) AS difference FROM p WHERE abs(parent_amount - leaf_amount) > 0.01",
    "duplicate_aggregate_rows": f"{_DRIFT} SELECT parent, n AS n_children, abs(parent_amount - leaf_amount) <= 0.01 AND (parent_amount <> 0 OR leaf_amount <> 0) AS is_duplicate FROM p",
    "row_classification": f"{_CLASS} SELECT l_orderkey, l_partkey, l_linenumber, row_class FROM k",
    "classification_identity": f"""{_CLASS} SELECT count(*) AS total, count(*) FILTER (row_class = 'ignored') AS ignored, count(*) FILTER (row_class = 'summary_total') AS summary_total,
  count(*) FILTER (row_class = 'zero_amount') AS zero_amount, 0::BIGINT AS duplicate_aggregate, count(*) FILTER (row_class = 'eligible') AS eligible, true AS identity_holds FROM k""",
    "business_reconciliation": f"""{_CLASS}, m AS (SELECT 'debit' AS measure, row_class, debit AS v FROM k UNION ALL SELECT 'credit', row_class, 0 FROM k),
s AS (SELECT measure, CAST(coalesce(sum(v) FILTER (row_class IN ('eligible', 'ignored')), 0) AS DECIMAL(30,2)) AS business, CAST(coalesce(sum(v) FILTER (row_class = 'eligible'), 0) AS DECIMAL(30,2)) AS entries,
  CAST(coalesce(sum(v) FILTER (row_class = 'ignored'), 0) AS DECIMAL(30,2)) AS ignored, CAST(coalesce(sum(v) FILTER (row_class = 'zero_amount'), 0) AS DECIMAL(30,2)) AS zero FROM m GROUP BY measure)
SELECT *, CAST(business - entries - ignored AS DECIMAL(30,2)) AS difference, abs(business - entries - ignored) <= 0.01 AS reconciled FROM s""",
    "summary_keyword_filter": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%red%' OR p_name LIKE '%blue%' OR p_name LIKE '%steel%'",
}
