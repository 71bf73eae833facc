"""Previews of uploads over sheets that orders and parts stand in for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.sources import previews
from tallyweave.session import table

HEADS, DOUBLE = ("科目编码", "科目名称", "金额", "金额"), 40


def order_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every forty orders a sheet; odd ones start with a title, and some rows are blank."""
    k = F.col("o_orderkey")
    sheet, place = F.floor(k / DOUBLE), (k % DOUBLE).cast("int")
    price = F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    filled = F.array((k + 1000).cast("string"), F.concat(F.lit(" n"), "o_custkey"), price, F.when(k % 3 == 0, "x").otherwise(""))
    cells = F.when(k % 7 == 2, F.array(F.lit(""), F.lit(" "))).otherwise(filled)
    orders = table(spark, sf_dir, "orders").select(sheet.alias("sheet"), (place + 1 + sheet % 2).cast("int").alias("row"), cells.alias("cells"))
    sheets = orders.select("sheet").distinct()
    head = sheets.select("sheet", (F.col("sheet") % 2).cast("int").alias("row"), F.array(*map(F.lit, HEADS)).alias("cells"))
    title = sheets.filter("sheet % 2 = 1").select("sheet", F.lit(0).alias("row"), F.array(F.lit("年度报表")).alias("cells"))
    return orders.unionByName(head).unionByName(title)


def upload_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = previews.file_info(order_sheets(spark, sf_dir))
    shown = F.array_join(F.transform("preview", lambda r: previews.joined(r)), ";")
    return found.select("sheet", previews.joined("headers").alias("headers"), "n_columns", "n_rows", shown.alias("preview"))


def _loaded(spark: SparkSession, sf_dir: str) -> previews.Loaded:
    """A third of the sheets with a stored configuration, of which some ask for a row that is not there."""
    sheets = order_sheets(spark, sf_dir)
    k = F.col("sheet")
    stored = sheets.select("sheet").distinct().filter("sheet % 3 = 0").select("sheet", F.when(k % 12 == 9, 999).otherwise(k % 2).cast("int").alias("header_row"), F.when(k % 2 == 0, 5).cast("int").alias("data_start_row"))
    return previews.load_rows(sheets, stored)


def stored_config_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).data.select("sheet", "row", previews.joined("cells").alias("cells"))


def column_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = _loaded(spark, sf_dir)
    found = previews.with_samples(loaded.columns, loaded.data)
    return found.select("sheet", "column_id", "header", F.col("total").cast("long").alias("total"), F.col("occurrence").cast("long").alias("occurrence"), previews.joined("samples").alias("samples"))


def upload_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = _loaded(spark, sf_dir)
    found = previews.first_rows(loaded.columns, loaded.data)
    shown = F.transform("sample_rows", lambda m: F.concat_ws("=", m["col_001"], m["col_004"]))
    return found.select("sheet", "total_rows", F.coalesce(F.array_join(shown, ";"), F.lit("")).alias("sample_rows"))


def chart_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thirty parts a sheet: columns in two orders, sheets with neither header, rows without codes or names."""
    k = F.col("p_partkey")
    sheet = F.floor(k / 30)
    code, name = F.when(k % 9 == 4, "").otherwise(F.concat(F.lit(" c"), k)), F.when(k % 27 == 4, " ").otherwise(F.col("p_name"))
    cells = F.when(sheet % 2 == 0, F.array(code, name, F.when(k % 2 == 0, "借"), F.lit("资产"))).otherwise(F.array(name, F.lit("?"), code))
    rows = table(spark, sf_dir, "part").select(sheet.alias("sheet"), (k % 30 + 1).cast("int").alias("row"), F.when(k % 11 == 5, F.array(F.lit(""))).otherwise(cells).alias("cells"))
    heads = F.when(F.col("sheet") % 7 == 3, F.array(F.lit("a"), F.lit("b"))).when(F.col("sheet") % 2 == 0, F.array(*map(F.lit, previews.CHART_HEADERS.values()))).otherwise(F.array(F.lit("科目名称"), F.lit("x"), F.lit("﻿科目代码 "), F.lit("科目名称")))
    top = rows.select("sheet").distinct().select("sheet", F.lit(0).alias("row"), heads.alias("cells"))
    return previews.scan_chart(rows.unionByName(top))


QUERIES = {f.__name__: f for f in (upload_info, stored_config_rows, column_samples, upload_first_rows, chart_upload)}

_SHEETS = f"""o AS (SELECT o_orderkey // {DOUBLE} AS sheet, (o_orderkey % {DOUBLE} + 1 + (o_orderkey // {DOUBLE}) % 2)::INT AS row, o_orderkey AS k, [(o_orderkey + 1000)::VARCHAR, ' n' || o_custkey, CAST(o_totalprice AS DECIMAL(20,2))::VARCHAR, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END] AS cells FROM orders),
d AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY row) AS place FROM o WHERE k % 7 <> 2), sh AS (SELECT DISTINCT sheet FROM o)"""
_LOADED = f"""{_SHEETS}, st AS (SELECT sheet, CASE WHEN sheet % 3 = 0 AND sheet % 2 = 0 THEN 5 WHEN sheet % 2 = 1 THEN 2 ELSE 1 END AS start FROM sh WHERE NOT (sheet % 3 = 0 AND sheet % 12 = 9)),
l AS (SELECT o.sheet, o.k, cells, row_number() OVER (PARTITION BY o.sheet ORDER BY row) AS place FROM o JOIN st USING (sheet) WHERE row >= start AND k % 7 <> 2)"""
_HEADS = ", ".join(f"({i}, '{h}', {HEADS.count(h)}, {HEADS[: i + 1].count(h)})" for i, h in enumerate(HEADS))
ORACLES = {
    "upload_info": f"""WITH {_SHEETS}
SELECT sheet, '{"|".join(HEADS)}' AS headers, 4 AS n_columns, coalesce(n, 0)::BIGINT AS n_rows, coalesce(p, '') AS preview FROM sh LEFT JOIN (SELECT sheet, count(*) AS n, string_agg(array_to_string(cells, '|'), ';' ORDER BY place) FILTER (place <= 5) AS p FROM d GROUP BY sheet) USING (sheet)""",
    "stored_config_rows": f"WITH {_LOADED} SELECT sheet, (place - 1)::INTEGER AS row, array_to_string(cells, '|') AS cells FROM l",
    "column_samples": f"""WITH {_LOADED}, h(i, header, total, occurrence) AS (VALUES {_HEADS})
SELECT st.sheet, 'col_00' || (i + 1) AS column_id, header, total::BIGINT AS total, occurrence::BIGINT AS occurrence, coalesce((SELECT string_agg(trim(cells[i + 1]), '|' ORDER BY place) FROM l WHERE l.sheet = st.sheet AND place <= 3), '') AS samples FROM st, h""",
    "upload_first_rows": f"""WITH {_LOADED}
SELECT st.sheet, count(l.k) AS total_rows, coalesce(string_agg(cells[1] || '=' || cells[4], ';' ORDER BY place) FILTER (place <= 10), '') AS sample_rows FROM st LEFT JOIN l USING (sheet) GROUP BY st.sheet""",
    "chart_upload": """WITH p AS (SELECT p_partkey // 30 AS sheet, p_partkey AS k, CASE WHEN p_partkey % 9 <> 4 THEN 'c' || p_partkey ELSE '' END AS code, CASE WHEN p_partkey % 27 = 4 THEN '' ELSE p_name END AS name FROM part),
q AS (SELECT *, (row_number() OVER (PARTITION BY sheet ORDER BY k) - 1)::INT AS row FROM p WHERE k % 11 <> 5)
SELECT sheet, row, code, name, CASE WHEN sheet % 2 = 0 AND k % 2 = 0 THEN '借' END AS direction, CASE WHEN sheet % 2 = 0 THEN '资产' END AS category, CASE WHEN code = '' THEN 'line ' || (row + 2) || ' has no code; its name is ' || name END AS error FROM q
WHERE sheet % 7 <> 3 AND (code <> '' OR name <> '') UNION ALL SELECT DISTINCT sheet, NULL, NULL, NULL, NULL, NULL, 'neither code nor name among the headers' FROM p WHERE sheet % 7 = 3""",
}
