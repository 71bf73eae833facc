"""Headers, listings, merges, audits and scans over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import pii
from tallyweave.operators import audit, headers, hierarchy, views
from tallyweave.session import table


def asof_indent_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 7 % 4).cast("int").alias("indent"))
    return hierarchy.by_indent(events, "user_id", "event_id", "indent").select("event_id", "parent_row", "is_leaf")


def header_left_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    cells = turns.withColumn("cell", F.when(F.col("role") == "user", F.concat(F.lit(" "), F.col("role"), F.col("turn").cast("string"))).otherwise(F.lit("")))
    cells = cells.groupBy("conv_id", "turn").agg(F.max("cell").alias("cell"))
    return headers.left_filled(cells, ["conv_id"], "turn", "cell").select("conv_id", "turn", "filled")


def duplicate_header_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name")
    found = headers.describe_columns(parts, "p_brand", "p_partkey", "p_name")
    return found.select("p_partkey", F.substring("column_id", 1, 7).alias("column_id"), "occurrence", "total")


def duplicate_header_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with whole column ids, also from the thousandth column on."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name")
    found = headers.describe_columns(parts, "p_brand", "p_partkey", "p_name")
    return found.select("p_partkey", "column_id", "occurrence", "total")


def indent_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels by indent of each user's events; one user in seven has no indents at all."""
    indent = F.when(F.col("user_id") % 7 != 0, (F.col("event_id") * 7 % 4).cast("int"))
    events = table(spark, sf_dir, "events").select("user_id", "event_id", indent.alias("indent"))
    return hierarchy.by_indent(events, "user_id", "event_id", "indent").select("event_id", "parent_row", "level", "is_leaf")


def header_field_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of header texts, varied by part key, against the known ones."""
    words = ("科目编码", "科目 名称", "凭证日期", "Debit Amount", "贷方金额(元)", "摘要说明", "年", "xyz", "辅助核算类型名称", "Voucher  No")
    sheet = table(spark, sf_dir, "part").select((F.col("p_partkey") / 10).cast("long").alias("sheet"), (F.col("p_partkey") % 10).alias("index"), F.get(F.array(*map(F.lit, words)), (F.col("p_partkey") % 10).cast("int")).alias("header"))
    return headers.assign_fields(sheet, headers.match_headers(sheet)).select("sheet", "field", "index", "header", F.round("score", 4).alias("score"))


def sheet_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets built from orders: a title row, two header rows, then data; read back as typed columns."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") / 50).cast("long").alias("sheet"), (F.col("o_orderkey") % 50 + 3).cast("int").alias("row"), F.array((F.col("o_orderkey") + 1000).cast("string"), F.concat(F.lit("n"), "o_custkey"), F.col("o_totalprice").cast("decimal(20,2)").cast("string"), F.lit("")).alias("cells"))
    top = [(0, ["年度报表", "", "", ""]), (1, ["科目编码", "科目名称", "期末余额", ""]), (2, ["", "", "借方", "贷方"])]
    heads = spark.createDataFrame(top, "row int, cells array<string>")
    rows = orders.union(orders.select("sheet").distinct().join(F.broadcast(heads)).select("sheet", "row", "cells"))
    area = headers.header_area(rows)
    merged = headers.merged_headers(rows, area).groupBy("sheet").agg(F.array_join(F.array_sort(F.collect_list(F.struct("index", "header"))).getField("header"), "|").alias("headers"))
    counted = headers.data_rows(rows, area).groupBy("sheet").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.get("cells", F.lit(0))).alias("last_code"))
    return area.join(merged, "sheet").join(counted, "sheet").select("sheet", "header_row", "data_row", "headers", "n_rows", "last_code")


def cascade_delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    batch = (F.col("o_orderkey") % 100).alias("batch")
    tables = {"raw_rows": orders.select("o_orderkey", batch), "entries": lines.select("l_orderkey", (F.col("l_orderkey") % 100).alias("batch"))}
    return views.delete_batch(tables, "batch", 7)[1]


def batch_list_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    batches = views.filtered(customers, equal={"c_mktsegment": "MACHINERY"}, words={"c_name": "customer#0000000"}).select(F.col("c_custkey").alias("batch"), "c_name")
    return views.batches_with_counts(batches, orders.select(F.col("o_custkey").alias("batch"), "o_orderkey"), "batch", "o_orderkey")


def _batches(spark: SparkSession, sf_dir: str, **conditions) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    batches = views.filtered(customers, **conditions).select(F.col("c_custkey").alias("batch"), "c_name")
    return views.batches_with_counts(batches, orders.select(F.col("o_custkey").alias("batch"), "o_orderkey"), "batch", "o_orderkey")


def batch_list_all_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir)


def batch_list_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir, words={"c_mktsegment": "hold"})


def entries_filtered_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    kept = views.filtered(lines, equal={"l_returnflag": "R"}, between={"l_shipdate": ("1996-01-01", "1996-12-31")})
    return kept.select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate").orderBy("l_orderkey", "l_partkey", "l_linenumber")


def paged_list_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    rows, total = views.page(customers.select("c_custkey", "c_name"), [F.col("c_name").desc(), F.col("c_custkey")], 40, 20)
    return rows.withColumn("total", F.lit(total))


def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plain = {"email": pii.PATTERNS["email"], "long_digits": r"[0-9]{12,}"}
    found = docs.select("doc_id", F.inline(pii.matches(F.col("text"), plain)))
    return found.groupBy("doc_id", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    return audit.stratified_sample(docs, "source", "doc_id", 5).select("source", "doc_id", "sample_rank")


def extra_fields_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("kind"))
    packed = headers.pack_extras(events, ["event_id", "user_id"])
    return packed.select("event_id", "user_id", F.to_json("extra_fields").alias("extra_fields"))


def synthetic_group_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    name = F.concat_ws("_", F.lower("p_type"), F.translate("p_name", " ", "-"), "p_brand")
    path = views.synthetic_path(F.lpad(F.col("p_partkey").cast("string"), 14, "7"), name, F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).otherwise("x"), F.lit("0"))
    return parts.select("p_partkey", F.array_join(F.transform(path, lambda g: F.concat_ws(":", g["group_code"], g["group_name"])), "|").alias("groups"))


def option_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.year("o_orderdate").alias("fiscal_year")).distinct().orderBy(F.col("fiscal_year").desc())


_ALL = (
    asof_indent_parent, indent_levels, header_left_fill, duplicate_header_occurrence, duplicate_header_ids, header_field_match, sheet_parse, cascade_delete_counts, batch_list_with_counts, batch_list_all_counts, batch_list_word_counts,
    entries_filtered_sorted, paged_list_total, pii_scan, stratified_sample, extra_fields_pack, synthetic_group_path, option_lists,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "asof_indent_parent": """
WITH e AS (SELECT user_id, event_id, event_id * 7 % 4 AS ind FROM events), nx AS (SELECT *, lead(ind) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM e)
SELECT a.event_id, (SELECT max(b.event_id) FROM e b WHERE b.user_id = a.user_id AND b.event_id < a.event_id AND b.ind < a.ind) AS parent_row, coalesce(f <= ind, true) AS is_leaf FROM nx a""",
    "header_left_fill": """
WITH c AS (SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN role || turn ELSE '' END) AS cell FROM conversations GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(last_value(nullif(cell, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS filled FROM c""",
    "duplicate_header_occurrence": """
SELECT p_partkey, 'col_' || substr(lpad((p_partkey + 1)::VARCHAR, greatest(3, length((p_partkey + 1)::VARCHAR))::INT, '0'), 1, 3) AS column_id,
  CAST(row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS INTEGER) AS occurrence, count(*) OVER (PARTITION BY p_brand, p_name) AS total FROM part""",
    "duplicate_header_ids": """
SELECT p_partkey, 'col_' || lpad((p_partkey + 1)::VARCHAR, greatest(3, length((p_partkey + 1)::VARCHAR))::INT, '0') AS column_id,
  CAST(row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS INTEGER) AS occurrence, count(*) OVER (PARTITION BY p_brand, p_name) AS total FROM part""",
    "indent_levels": """
WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN user_id % 7 <> 0 THEN event_id * 7 % 4 END AS ind FROM events),
nx AS (SELECT *, lead(ind) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM e),
up AS (SELECT a.event_id, (SELECT max(b.event_id) FROM e b WHERE b.user_id = a.user_id AND b.event_id < a.event_id AND b.ind < a.ind) AS parent_row, coalesce(f <= ind, true) AS is_leaf FROM nx a),
deep AS (SELECT event_id, 1 AS level FROM up WHERE parent_row IS NULL UNION ALL SELECT up.event_id, level + 1 FROM up JOIN deep ON up.parent_row = deep.event_id)
SELECT event_id, parent_row, CAST(level AS INTEGER) AS level, is_leaf FROM up JOIN deep USING (event_id)""",
    "sheet_parse": """
SELECT o_orderkey // 50 AS sheet, 1 AS header_row, 3 AS data_row, '科目编码|科目名称|期末余额_借方|期末余额_贷方' AS headers, count(*) AS n_rows, max((o_orderkey + 1000)::VARCHAR) AS last_code FROM orders GROUP BY 1""",
    "cascade_delete_counts": "SELECT 'raw_rows' AS table_name, count(*) AS n_deleted FROM orders WHERE o_orderkey % 100 = 7 UNION ALL SELECT 'entries', count(*) FROM lineitem WHERE l_orderkey % 100 = 7",
    "batch_list_with_counts": """
SELECT c_custkey AS batch, c_name, count(o_orderkey) AS n_entries FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND c_name ILIKE '%customer#0000000%' GROUP BY 1, 2""",
    "batch_list_all_counts": "SELECT c_custkey AS batch, c_name, count(o_orderkey) AS n_entries FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2",
    "batch_list_word_counts": """
SELECT c_custkey AS batch, c_name, count(o_orderkey) AS n_entries FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment ILIKE '%hold%' GROUP BY 1, 2""",
    "entries_filtered_sorted": "SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate BETWEEN '1996-01-01' AND '1996-12-31' ORDER BY ALL",
    "paged_list_total": "SELECT c_custkey, c_name, CAST((SELECT count(*) FROM customer) AS INTEGER) AS total FROM customer ORDER BY c_name DESC, c_custkey LIMIT 20 OFFSET 40",
    "pii_scan": """
WITH m AS (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS value FROM documents
  UNION ALL SELECT doc_id, 'long_digits', unnest(regexp_extract_all(text, '[0-9]{12,}')) FROM documents)
SELECT doc_id, kind, value, count(*) AS n FROM m GROUP BY ALL""",
    "stratified_sample": "SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) AS INTEGER) AS sample_rank FROM documents QUALIFY sample_rank <= 5",
    "extra_fields_pack": """
SELECT event_id, user_id, '{"k":"' || (props->>'$.k') || '"' || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"kind":"' || event_type || '"' END || '}' AS extra_fields FROM events""",
    "synthetic_group_path": """
WITH a AS (SELECT p_partkey, lpad(p_partkey::VARCHAR, 14, '7') AS code, list_concat([lower(p_type)], list_concat(string_split(p_name, ' '), [p_brand])) AS parts FROM part),
b AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN parts[2:-2] ELSE parts[:-2] END AS g FROM a)
SELECT p_partkey, array_to_string([substr(code, 1, least(12, 4 + 2 * i)::INT) || ':' || array_to_string(g[1:i], '_') FOR i IN range(1, len(g) + 1)], '|') AS groups FROM b""",
    "option_lists": "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS fiscal_year FROM orders",
}
