"""Columns of uploads mapped to fields, over sheets whose headers part keys deal out from the known spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import vocabulary as V
from tallyweave.operators import columns, experience
from tallyweave.session import table

TYPE, WIDTH = "trial_balance", 12
#: Every spelling of every field, header texts that a veto keeps away, one of no field, and none.
SPELLED = tuple(w for words in columns.type_fields(TYPE).values() for w in words)
WORDS = (*SPELLED, *(w for words in V.VETO_WORDS.values() for w in words), "xyz", "")


def sheet_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    header = F.get(F.array(*map(F.lit, WORDS)), F.pmod(key * 7, F.lit(len(WORDS))).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.floor(key / WIDTH).alias("sheet"), (key % WIDTH).cast("int").alias("index"), header.alias("header"))
    return rows.withColumn("column_id", F.concat(F.lit("col_"), F.lpad((F.col("index") + 1).cast("string"), 3, "0")))


def auto_match_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = columns.auto_match(sheet_columns(spark, sf_dir), TYPE)
    said = F.array_join(F.array_sort(F.transform(F.map_entries("matched"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select("sheet", said.alias("matched"), F.array_join("unmatched", ";").alias("unmatched"), F.array_join("missing", ";").alias("missing"))


def column_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experience for some columns, keywords for the others."""
    cols = sheet_columns(spark, sf_dir)
    field = F.get(F.array(*map(F.lit, V.AMOUNT_FIELDS)), F.pmod("sheet", F.lit(len(V.AMOUNT_FIELDS))).cast("int"))
    learnt = cols.filter("(sheet + index) % 5 = 2").select("sheet", "column_id", field.alias("target_field"), F.lit("company_experience").alias("source"), F.lit(0.9).alias("confidence"))
    return columns.merged_suggestions(learnt, columns.keyword_suggestions(cols, TYPE))


def mapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ragged sheets by the mapping in force: ids for some sheets, headers for some, else automatic."""
    cols = sheet_columns(spark, sf_dir)
    field = F.get(F.array(*map(F.lit, V.AMOUNT_FIELDS)), F.pmod("index", F.lit(4)))
    by_id = columns.given_by_id(cols, cols.filter("sheet % 3 = 0 and index > 3").select("sheet", "column_id", field.alias("field")))
    wanted = cols.filter("sheet % 3 = 1 and index in (2, 5)").select("sheet", F.when(F.col("index") == 2, "summary").otherwise("voucher_no").alias("field"), F.when(F.col("sheet") % 2 == 0, F.col("header")).otherwise("not there").alias("header"))
    by_header = columns.given_by_header(cols, wanted)
    cells = F.transform(F.sequence(F.lit(0), F.pmod("p_size", F.lit(WIDTH)).cast("int")), lambda i: F.concat(F.col("p_size"), F.lit("."), i))
    rows = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / WIDTH).alias("sheet"), F.col("p_partkey").alias("row"), cells.alias("cells"))
    made = columns.projected(rows, columns.in_force(by_id, by_header, columns.auto_mapping(cols, TYPE)))
    return made.select("sheet", "row", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("fields"))


def field_experience_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders confirm fields for their customer's key one after the other."""
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    field = lambda n: F.get(F.array(*map(F.lit, V.AMOUNT_FIELDS[:3])), F.pmod(n, F.lit(3)).cast("int"))
    held = table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0").select(c.cast("string").alias("lookup_key"), field(c).alias("target_field"), F.lit(4).alias("use_count"), F.lit(3).alias("success_count"), F.lit(1).alias("conflict_count"), (c % 4 != 0).alias("active"))
    confirmed = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("lookup_key"), F.lit("h").alias("header"), field(F.floor(o / 2)).alias("target_field"), F.when(o % 7 == 0, "auto").otherwise("user_confirmed").alias("confirmation"), o.alias("place"))
    return experience.upsert_in_order(held, confirmed, list(V.AMOUNT_FIELDS), "place")


QUERIES = {f.__name__: f for f in (auto_match_sheets, column_suggestions, mapped_rows, field_experience_in_order)}

_LISTED = ", ".join(repr(w) for w in WORDS)
_SPELLED = ", ".join(f"({i}, '{f}', '{w}')" for i, (f, words) in enumerate(columns.type_fields(TYPE).items()) for w in words)
_AMOUNTS = ", ".join(repr(f) for f in V.AMOUNT_FIELDS)
_COLS = f"""c AS (SELECT p_partkey // {WIDTH} AS sheet, (p_partkey % {WIDTH})::INT AS i, [{_LISTED}][(p_partkey * 7) % {len(WORDS)} + 1] AS header FROM part),
s(o, field, word) AS (VALUES {_SPELLED}), known AS (SELECT lower(word) AS text, arg_min(field, o) AS field FROM s GROUP BY lower(word)),
m AS (SELECT c.*, 'col_' || lpad((i + 1)::VARCHAR, 3, '0') AS column_id, field FROM c LEFT JOIN known ON text = lower(header)),
w AS (SELECT *, field IS NOT NULL AND row_number() OVER (PARTITION BY sheet, field ORDER BY i) = 1 AS won FROM m)"""
_REQUIRED = ", ".join(repr(f) for f in V.REQUIRED_FIELDS[TYPE])
_FIELD = f"[{', '.join(repr(f) for f in V.AMOUNT_FIELDS[:3])}]"
ORACLES = {
    "field_experience_in_order": f"""WITH h AS (SELECT c_custkey AS k, {_FIELD}[c_custkey % 3 + 1] AS t, c_custkey % 4 <> 0 AS active FROM customer WHERE c_custkey % 5 <> 0),
s AS (SELECT o_custkey AS k, o_orderkey AS o, {_FIELD}[(o_orderkey // 2) % 3 + 1] AS t FROM orders WHERE o_orderkey % 7 <> 0),
b AS (SELECT s.*, coalesce(lag(s.t) OVER (PARTITION BY s.k ORDER BY o), h.t) AS was FROM s LEFT JOIN h ON h.k = s.k AND h.active),
r AS (SELECT *, sum((was IS DISTINCT FROM t)::INT) OVER (PARTITION BY k ORDER BY o) AS run FROM b),
g AS (SELECT k, run, any_value(t) AS t, count(*) AS n, max(run) OVER (PARTITION BY k) AS last FROM r GROUP BY k, run),
l AS (SELECT k, any_value(last) AS last, coalesce(sum(n) FILTER (run = 0), 0) AS n FROM g GROUP BY k),
x AS (SELECT h.k, h.t, coalesce(n, 0) AS n, coalesce(last, 0) > 0 AS ends, 4 AS u, 3 AS s, 1 AS c, true AS old FROM h LEFT JOIN l USING (k) WHERE active UNION ALL SELECT k, t, n, run < last, 0, 0, 0, false FROM g WHERE run > 0)
SELECT k::VARCHAR AS lookup_key, t AS target_field, (u + n + ends::INT)::BIGINT AS use_count, (s + n)::BIGINT AS success_count, (c + ends::INT)::BIGINT AS conflict_count, NOT ends AS active,
  CASE WHEN ends THEN 'retired' WHEN NOT old THEN 'created' WHEN n > 0 THEN 'reused' ELSE 'unchanged' END AS action FROM x UNION ALL SELECT k::VARCHAR, t, 4, 3, 1, false, 'unchanged' FROM h WHERE NOT active""",
    "auto_match_sheets": f"""WITH {_COLS}
SELECT sheet, coalesce(string_agg(field || '=' || header, ';' ORDER BY field || '=' || header) FILTER (won), '') AS matched, coalesce(string_agg(header, ';' ORDER BY i) FILTER (NOT won), '') AS unmatched,
  array_to_string(list_filter([{_REQUIRED}], lambda f: NOT list_contains(coalesce(list(field) FILTER (won), []), f)), ';') AS missing FROM w GROUP BY sheet""",
    "column_suggestions": f"""WITH {_COLS}
SELECT sheet, column_id, CASE WHEN (sheet + i) % 5 = 2 THEN [{_AMOUNTS}][sheet % 6 + 1] ELSE field END AS target_field, CASE WHEN (sheet + i) % 5 = 2 THEN 'company_experience' ELSE 'keyword_match' END AS source,
  CASE WHEN (sheet + i) % 5 = 2 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM m WHERE field IS NOT NULL OR (sheet + i) % 5 = 2""",
    "mapped_rows": f"""WITH {_COLS},
ids AS (SELECT sheet, [{_AMOUNTS}][i % 4 + 1] AS field, max(i) AS i FROM c WHERE sheet % 3 = 0 AND i > 3 GROUP BY 1, 2),
heads AS (SELECT a.sheet, CASE a.i WHEN 2 THEN 'summary' ELSE 'voucher_no' END AS field, (SELECT min(b.i) FROM c b WHERE b.sheet = a.sheet AND b.header = a.header) AS i FROM c a WHERE a.sheet % 3 = 1 AND a.sheet % 2 = 0 AND a.i IN (2, 5)),
g AS (SELECT * FROM ids UNION ALL SELECT * FROM heads UNION ALL SELECT sheet, field, i FROM w WHERE won AND sheet NOT IN (SELECT sheet FROM ids) AND sheet NOT IN (SELECT sheet FROM heads))
SELECT p_partkey // {WIDTH} AS sheet, p_partkey AS row, coalesce(string_agg(field || '=' || p_size || '.' || i, ';' ORDER BY field) FILTER (i <= p_size % {WIDTH}), '') AS fields
FROM part LEFT JOIN g ON g.sheet = p_partkey // {WIDTH} GROUP BY p_partkey""",
}
