"""Charts, gates, lookups and batch upserts of an import over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import vocabulary as V
from tallyweave.operators import charts, classification, experience, gates, matching, views
from tallyweave.plans.mapping import chart
from tallyweave.plans.trees import classified, coded_parts
from tallyweave.session import table

ROOTS = ("11", "120", "1999")


def separated_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys as account codes, every seventh with a separator before its last digit."""
    key = F.col("p_partkey").cast("string")
    cut = F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit("."), F.substring(key, F.length(key), F.lit(1)))
    return table(spark, sf_dir, "part").select("p_partkey", F.when((F.col("p_partkey") % 7 == 0) & (F.length(key) > 1), cut).otherwise(key).alias("code"))


def chart_hierarchy_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.chart_hierarchy(separated_parts(spark, sf_dir), "code", ROOTS).select("p_partkey", "code", "parent_code", "level", "is_leaf")


def chart_repeated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), F.concat_ws("-", "p_brand", "p_size").alias("code"))
    return charts.repeated_codes(rows, "code", "row")


def descendant_leaf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.descendant_leaves(coded_parts(spark, sf_dir), "p_partkey", "code")


def unique_code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat_ws("-", "p_brand", "p_size").alias("code"), F.col("p_partkey").alias("found_row"))
    key = F.col("c_custkey")
    code = F.concat(F.lit("Brand#"), F.col("c_nationkey") + 1, F.lit("-"), key % 50 + 1)
    return gates.unique_lookup(table(spark, sf_dir, "customer").select("c_custkey", code.alias("code")), parts, "code", "found_row")


def direction_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_custkey").alias("code"), F.col("o_orderpriority").alias("name"), "o_orderstatus")
    side = F.when(F.col("o_orderstatus") == "F", "debit").when(F.col("o_orderstatus") == "O", "credit")
    known = rows.filter("row % 9 = 0").withColumn("direction", side)
    return gates.with_direction(rows.drop("o_orderstatus"), known, "row", "code", "name", "direction")


def ignored_row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select((F.col("o_custkey") - 10).alias("row"))
    leaves = table(spark, sf_dir, "customer").filter("c_nationkey <> 3").select(F.col("c_custkey").alias("row"))
    return gates.ignored_row_faults(asked, leaves, "row")


def business_leaf_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), "c_nationkey")
    structural = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("row"))
    return gates.leaf_sets(customers, structural, customers.filter("c_nationkey % 3 = 0"), "row")


def mapping_status_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    target = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))
    role = F.when(F.startswith("o_orderpriority", F.lit("1")), "structural_summary").when(F.startswith("o_orderpriority", F.lit("2")), "anchor")
    code = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey").cast("string"))
    name = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    status = gates.mapping_status(F.col("o_custkey") % 10 == 0, target, role, code, name)
    return orders.select("o_orderkey", status.alias("mapping_status"))


def warning_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    texts = F.array(*map(F.lit, ("父级金额不一致", "金额为负数", "由缩进推断", "负数且不一致", "方向缺失", "无法按标准方向拆分")))
    said = F.get(texts, F.pmod("s_suppkey", F.lit(6)).cast("int"))
    message = F.when(F.col("s_nationkey") % 4 == 0, said).otherwise(F.concat(F.lit("行 "), "s_suppkey", F.lit(": "), said))
    skipped = table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("row"))
    found = gates.open_warnings(suppliers.select("s_suppkey", message.alias("message")), "message", skipped, "row")
    return found.select("s_suppkey", "row", "category", gates.error_category(F.col("message")).alias("as_error"))


def response_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("nodes"))
    asked = F.when(F.col("l_linenumber") == 1, "legacy").when(F.col("l_linenumber") == 2, "node").otherwise("auto")
    return lines.select("l_returnflag", "l_linenumber", gates.response_mode(asked, F.col("n"), F.col("nodes"), F.col("n") - F.col("nodes")).alias("mode"))


def legacy_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classification.legacy_reconciliation(classified(spark, sf_dir), ["debit", "credit"])


def rows_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return views.filtered(customers, among={"c_mktsegment": ["BUILDING", "MACHINERY"]})


def name_anchor_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the first word of their name, or by two letters inside it."""
    word = F.get(F.split("p_name", " "), F.lit(0))
    anchor = F.when(F.col("p_partkey") % 2 == 0, word).otherwise(F.substring(word, 2, 2))
    return matching.anchor_matches(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("client"), anchor.alias("anchor")), chart(spark, sf_dir))


def code_class_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with codes of known and unknown classes against suppliers named after the classes."""
    names, codes = list(V.CODE_ANCHORS.values()), list(V.CODE_ANCHORS)
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), F.pmod(n, F.lit(len(values))).cast("int"))
    key = F.col("c_custkey")
    clients = table(spark, sf_dir, "customer").select(key.alias("client"), F.concat(F.when(key % 8 == 0, "99").otherwise(""), pick(codes, key), key).alias("code"))
    n = F.col("s_suppkey")
    name = F.concat(F.when(n % 3 == 0, "减：").otherwise(""), pick(names, n), F.when(n % 2 == 0, "明细").otherwise(""))
    accounts = table(spark, sf_dir, "supplier").select(F.lpad(n.cast("string"), 8, "0").alias("code"), name.alias("name"), (n % 5 != 0).alias("active"))
    return matching.anchor_matches(matching.code_class_anchors(clients), accounts)


def batch_upsert_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    code, name = key.cast("string"), F.col("c_name")
    held = customers.filter(key % 5 != 0).select(F.when(key % 3 != 2, code).alias("code"), F.when(key % 3 != 1, F.concat(name, F.lit(" "))).alias("name"), F.when(key % 17 != 0, F.col("c_nationkey")).alias("target"))
    given = F.col("c_nationkey") + F.when(key % 4 == 0, 1).otherwise(0)
    incoming = customers.select("c_custkey", F.when(key % 11 != 0, code).alias("code"), F.when(key % 13 != 0, name).alias("name"), given.alias("target"), (key % 7 == 0).alias("overwrite"))
    return experience.batch_upsert(held, incoming, "target").select("c_custkey", "held_target", "action")


_ALL = (
    chart_hierarchy_overrides, chart_repeated_codes, descendant_leaf_counts, unique_code_lookup, direction_fallback, ignored_row_validation, business_leaf_sets,
    mapping_status_rows, warning_messages, response_modes, legacy_reconciliation, rows_in_list, name_anchor_match, code_class_match, batch_upsert_fallback,
)
QUERIES = {f.__name__: f for f in _ALL}

_ROOTS = ", ".join(f"'{r}'" for r in ROOTS)
_CLASS_NAMES = "(VALUES " + ", ".join(f"({i}, '{p}', '{a}')" for i, (p, a) in enumerate(V.CODE_ANCHORS.items())) + ") anchors(i, prefix, anchor)"
ORACLES = {
    "chart_hierarchy_overrides": f"""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 AND p_partkey > 9 THEN (p_partkey // 10)::VARCHAR || '.' || (p_partkey % 10)::VARCHAR ELSE p_partkey::VARCHAR END AS code FROM part),
up AS (SELECT a.code, arg_max(b.code, length(b.code)) AS parent FROM (SELECT code, unnest(range(1, length(code))) AS n FROM c) a JOIN c b ON b.code = substr(a.code, 1, a.n::INT) GROUP BY a.code),
h AS (SELECT p_partkey, code, CASE WHEN code NOT IN ({_ROOTS}) THEN parent END AS parent_code, CAST(CASE WHEN code NOT IN ({_ROOTS}) AND code LIKE '%.%' THEN 2 ELSE 1 END AS INTEGER) AS level FROM c LEFT JOIN up USING (code))
SELECT *, NOT EXISTS (SELECT 1 FROM h k WHERE k.parent_code = h.code) AS is_leaf FROM h""",
    "chart_repeated_codes": """SELECT p_partkey AS row, code, first_row FROM (SELECT p_partkey, p_brand || '-' || p_size AS code, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS first_row FROM part) WHERE p_partkey > first_row""",
    "descendant_leaf_counts": """WITH c AS (SELECT p_partkey::VARCHAR AS code FROM part),
leaf AS (SELECT code FROM c WHERE NOT EXISTS (SELECT 1 FROM (SELECT substr(d.code, 1, n::INT) AS p FROM (SELECT code, unnest(range(1, length(code))) AS n FROM c) d) q WHERE q.p = c.code)),
below AS (SELECT substr(code, 1, n::INT) AS code, count(*) AS n_leaves FROM (SELECT code, unnest(range(1, length(code))) AS n FROM leaf) GROUP BY ALL)
SELECT code, 1::BIGINT AS n_leaves FROM leaf UNION ALL SELECT code, n_leaves FROM below JOIN c USING (code)""",
    "unique_code_lookup": """WITH p AS (SELECT p_brand || '-' || p_size AS code, min(p_partkey) AS found_row FROM part GROUP BY ALL HAVING count(*) = 1)
SELECT c_custkey, code, found_row FROM (SELECT c_custkey, 'Brand#' || (c_nationkey + 1) || '-' || (c_custkey % 50 + 1) AS code FROM customer) LEFT JOIN p USING (code)""",
    "direction_fallback": """WITH k AS (SELECT o_orderkey AS row, o_custkey AS code, o_orderpriority AS name, CASE o_orderstatus WHEN 'F' THEN 'debit' WHEN 'O' THEN 'credit' END AS d FROM orders WHERE o_orderkey % 9 = 0 AND o_orderstatus IN ('F', 'O')),
a AS (SELECT code, name, arg_min(d, row) AS d FROM k GROUP BY ALL), b AS (SELECT code, arg_min(d, row) AS d FROM k GROUP BY ALL)
SELECT o_orderkey AS row, o_custkey AS code, o_orderpriority AS name, coalesce(k.d, a.d, b.d) AS direction FROM orders
LEFT JOIN k ON k.row = o_orderkey LEFT JOIN a ON a.code = o_custkey AND a.name = o_orderpriority LEFT JOIN b ON b.code = o_custkey""",
    "ignored_row_validation": """WITH r AS (SELECT o_custkey - 10 AS row, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL)
SELECT row, 'negative' AS fault FROM r WHERE row < 0 UNION ALL SELECT row, 'repeated' FROM r WHERE n > 1
UNION ALL SELECT row, 'not a base leaf' FROM r WHERE row NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)""",
    "business_leaf_sets": """WITH b AS (SELECT c_custkey AS row FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
SELECT row, 'business' AS leaf_set FROM b UNION ALL SELECT row, 'ignored' FROM (SELECT row FROM b INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey % 3 = 0)""",
    "mapping_status_rows": """SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'ignored' WHEN o_orderstatus = 'F' THEN 'mapped' WHEN o_orderpriority LIKE '1%' THEN 'ignored'
  WHEN o_orderkey % 13 <> 0 OR o_orderkey % 3 <> 0 THEN 'unmapped' ELSE 'ignored' END AS mapping_status FROM orders""",
    "warning_messages": """WITH m AS (SELECT s_suppkey, ['父级金额不一致', '金额为负数', '由缩进推断', '负数且不一致', '方向缺失', '无法按标准方向拆分'][s_suppkey % 6 + 1] AS said, CASE WHEN s_nationkey % 4 <> 0 THEN s_suppkey END AS row FROM supplier)
SELECT s_suppkey, row, CASE WHEN said LIKE '%不一致%' THEN 'parent_amount_mismatch' WHEN said LIKE '%负数%' THEN 'negative_amount' WHEN said LIKE '%缩进%' THEN 'indent_suggested' ELSE 'other' END AS category,
  CASE WHEN said LIKE '%方向缺失%' OR said LIKE '%无法按标准方向%' THEN 'no_direction' ELSE 'missing_amount' END AS as_error
FROM m WHERE row IS NULL OR row NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)""",
    "response_modes": """SELECT l_returnflag, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'legacy' WHEN l_linenumber = 2 THEN 'node'
  WHEN count(*) >= 5000 AND (count(*) >= 10 * count(DISTINCT l_suppkey) OR count(*) - count(DISTINCT l_suppkey) >= 1000) THEN 'node' ELSE 'hybrid' END AS mode FROM lineitem GROUP BY l_returnflag, l_linenumber""",
    "legacy_reconciliation": """WITH r AS (SELECT *, CAST(CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice END AS DECIMAL(20,2)) AS debit FROM lineitem),
k AS (SELECT debit, CASE WHEN l_suppkey % 10 = 0 THEN 'ignored' WHEN l_linenumber = 7 OR (l_linenumber = 6 AND l_returnflag = 'R') OR (l_linenumber = 5 AND l_returnflag = 'A') THEN 'summary'
  WHEN abs(debit) <= 0.01 THEN 'zero' ELSE 'entry' END AS kind FROM r),
m AS (SELECT 'debit' AS measure, kind, debit AS v FROM k UNION ALL SELECT 'credit', kind, 0 FROM k),
s AS (SELECT measure, CAST(coalesce(sum(v) FILTER (kind <> 'summary'), 0) AS DECIMAL(30,2)) AS source, CAST(coalesce(sum(v) FILTER (kind = 'entry'), 0) AS DECIMAL(30,2)) AS entry,
  CAST(coalesce(sum(v) FILTER (kind = 'ignored'), 0) AS DECIMAL(30,2)) AS ignored, CAST(coalesce(sum(v) FILTER (kind = 'zero'), 0) AS DECIMAL(30,2)) AS zero_skip FROM m GROUP BY measure)
SELECT *, CAST(source - entry - ignored - zero_skip AS DECIMAL(30,2)) AS difference FROM s""",
    "rows_in_list": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "name_anchor_match": """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part), c AS (SELECT 'W' || substr(md5(name), 1, 6) AS target, name, length(name) % 5 <> 0 AS active FROM w),
a AS (SELECT p_partkey AS client, CASE WHEN p_partkey % 2 = 0 THEN string_split(p_name, ' ')[1] ELSE substr(string_split(p_name, ' ')[1], 2, 2) END AS anchor FROM part),
h AS (SELECT client, target, name = anchor AS exact, row_number() OVER (PARTITION BY client ORDER BY name <> anchor, NOT active, target) AS rank FROM a JOIN c ON contains(name, anchor) AND anchor <> '')
SELECT client, target, exact, CAST(rank AS INTEGER) AS rank FROM h WHERE rank <= 5""",
    "code_class_match": f"""WITH k AS (SELECT * FROM {_CLASS_NAMES}), n AS (SELECT count(*) AS n FROM k),
cl AS (SELECT c_custkey AS client, (CASE WHEN c_custkey % 8 = 0 THEN '99' ELSE '' END) || prefix || c_custkey AS code FROM customer, n JOIN k ON k.i = c_custkey % n.n),
a AS (SELECT client, anchor FROM cl JOIN k ON starts_with(code, prefix)),
c AS (SELECT lpad(s_suppkey::VARCHAR, 8, '0') AS target, anchor || (CASE WHEN s_suppkey % 2 = 0 THEN '明细' ELSE '' END) AS name, s_suppkey % 5 <> 0 AS active FROM supplier, n JOIN k ON k.i = s_suppkey % n.n),
h AS (SELECT client, target, name = anchor AS exact, row_number() OVER (PARTITION BY client ORDER BY name <> anchor, NOT active, target) AS rank FROM a JOIN c ON contains(name, anchor))
SELECT client, target, exact, CAST(rank AS INTEGER) AS rank FROM h WHERE rank <= 5""",
    "batch_upsert_fallback": """WITH h AS (SELECT CASE WHEN c_custkey % 3 <> 2 THEN c_custkey::VARCHAR ELSE '' END AS code, CASE WHEN c_custkey % 3 <> 1 THEN c_name ELSE '' END AS name, CASE WHEN c_custkey % 17 <> 0 THEN c_nationkey END AS t, true AS held FROM customer WHERE c_custkey % 5 <> 0),
g AS (SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey::VARCHAR ELSE '' END AS code, CASE WHEN c_custkey % 13 <> 0 THEN c_name ELSE '' END AS name, c_nationkey + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS target, c_custkey % 7 = 0 AS overwrite FROM customer),
m AS (SELECT g.*, CASE WHEN x.held THEN x.t WHEN y.held THEN y.t ELSE z.t END AS held_target, coalesce(x.held, y.held, z.held, false) AS met FROM g
  LEFT JOIN h x ON x.code = g.code AND x.name = g.name AND (g.code <> '' OR g.name <> '') LEFT JOIN h y ON y.code = g.code AND y.name = '' AND g.code <> '' LEFT JOIN h z ON z.code = '' AND z.name = g.name AND g.name <> '')
SELECT c_custkey, held_target, CASE WHEN code = '' AND name = '' THEN 'no_identifier' WHEN NOT met THEN 'created' WHEN held_target IS NOT DISTINCT FROM target THEN 'reused' WHEN overwrite THEN 'replaced' ELSE 'conflict' END AS action FROM m""",
}
