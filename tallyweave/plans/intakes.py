"""Journals imported from sheets that order lines stand in for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import intake
from tallyweave.session import table

HEADS = ("凭证号", "凭证日期", "摘要", "科目编码", "科目名称", "借方金额", "贷方金额", "附件数", "会计年度", "会计期间")
SIZE = 20


def journal_sheets(spark: SparkSession, sf_dir: str) -> intake.Intake:
    """Every twenty orders a sheet; part keys spoil cells, odd sheets have no year and period, and a third is mapped by column id."""
    o, p, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    sheet = F.floor(o / SIZE)
    amount = F.col("l_extendedprice").cast("decimal(20,2)").cast("string")
    spoilt = F.when(p % 17 == 0, "n/a").otherwise(amount)
    day = F.when(p % 19 == 0, "soon").when(p % 19 == 1, "2024/3/7").otherwise("2024-03-08")
    base = [o.cast("string"), day, F.when(p % 23 == 0, " ").otherwise("goods"), p.cast("string"), F.lit("account"), F.when(n % 2 == 1, spoilt).otherwise(""), F.when(n % 2 == 0, spoilt).otherwise(""), F.when(p % 13 == 0, "two").otherwise("2")]
    when = [F.when(p % 29 == 0, "1999").otherwise("2023"), F.when(p % 31 == 0, "13").when(p % 31 == 1, "x").otherwise("6")]
    rows = table(spark, sf_dir, "lineitem").select(sheet.alias("sheet"), ((o % SIZE) * 8 + n).cast("int").alias("row"), F.when(sheet % 2 == 0, F.array(*base, *when)).otherwise(F.array(*base)).alias("cells"))
    heads = F.slice(F.array(*map(F.lit, HEADS)), F.lit(1), F.when(F.col("sheet") % 2 == 0, len(HEADS)).otherwise(len(HEADS) - 2))
    cols = rows.select("sheet").distinct().select("sheet", F.posexplode(heads).alias("index", "header")).withColumn("column_id", F.concat(F.lit("col_"), F.lpad((F.col("index") + 1).cast("string"), 3, "0")))
    names = ("voucher_no", "voucher_date", "summary", "account_code", "note", "debit_amount", "credit_amount", "account_name")
    by_id = cols.filter(f"sheet % 3 = 0 and index < {len(names)}").select("sheet", "column_id", F.get(F.array(*map(F.lit, names)), F.col("index")).alias("field"))
    return intake.intake(rows, cols, "journal", fiscal_year=2024, period=12, by_id=by_id)


def journal_intake_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = journal_sheets(spark, sf_dir).good
    return good.select("sheet", "row", "fiscal_year", "period", "voucher_no", "voucher_date", "account_name", "debit_amount", "credit_amount", "attachment_count", F.try_element_at("extra_fields", F.lit("note")).alias("note"))


def journal_intake_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal_sheets(spark, sf_dir).faults.select("sheet", "row", F.array_join("errors", "; ").alias("errors"))


def journal_intake_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal_sheets(spark, sf_dir).outcomes()


QUERIES = {f.__name__: f for f in (journal_intake_rows, journal_intake_faults, journal_intake_outcomes)}

# Sheets mapped by id (their numbers divide by 3) name the eighth column account_name, and have no attachments, year or period.
_ROWS = f"""x AS (SELECT l_orderkey // {SIZE} AS sheet, ((l_orderkey % {SIZE}) * 8 + l_linenumber)::INT AS row, l_orderkey, l_partkey AS p, l_linenumber % 2 = 1 AS dr, CAST(l_extendedprice AS DECIMAL(20,2)) AS a, (l_orderkey // {SIZE}) % 3 = 0 AS ided,
  (l_orderkey // {SIZE}) % 2 = 0 AND (l_orderkey // {SIZE}) % 3 <> 0 AS dated FROM lineitem),
e AS (SELECT *, concat_ws('; ', CASE WHEN p % 23 = 0 THEN 'summary: missing' END, CASE WHEN p % 17 = 0 AND dr THEN 'debit_amount: not a number' END, CASE WHEN p % 17 = 0 AND NOT dr THEN 'credit_amount: not a number' END,
  CASE WHEN dated AND p % 29 = 0 THEN 'fiscal_year: out of range' END, CASE WHEN dated AND p % 31 = 0 THEN 'period: out of range' WHEN dated AND p % 31 = 1 THEN 'period: not a whole number' END, CASE WHEN NOT ided AND p % 13 = 0 THEN 'attachment_count: not a whole number' END,
  CASE WHEN p % 19 = 0 THEN 'voucher_date: not a date' END) AS errors FROM x),
u AS (SELECT sheet, l_orderkey FROM e WHERE errors = '' GROUP BY ALL HAVING sum(CASE WHEN dr THEN a ELSE 0 END) > 0 AND sum(CASE WHEN dr THEN 0 ELSE a END) > 0 AND abs(sum(CASE WHEN dr THEN a ELSE -a END)) > 0.01)"""
ORACLES = {
    "journal_intake_rows": f"""WITH {_ROWS} SELECT sheet, row, CASE WHEN dated THEN 2023 ELSE 2024 END AS fiscal_year, CASE WHEN dated THEN 6 ELSE 12 END AS period, l_orderkey::VARCHAR AS voucher_no, CASE WHEN p % 19 = 1 THEN DATE '2024-03-07' ELSE DATE '2024-03-08' END AS voucher_date,
  CASE WHEN NOT ided THEN 'account' WHEN p % 13 = 0 THEN 'two' ELSE '2' END AS account_name, CAST(CASE WHEN dr THEN a ELSE 0 END AS DECIMAL(20,2)) AS debit_amount, CAST(CASE WHEN dr THEN 0 ELSE a END AS DECIMAL(20,2)) AS credit_amount, CASE WHEN NOT ided THEN 2 END AS attachment_count,
  CASE WHEN ided THEN 'account' END AS note FROM e WHERE errors = ''""",
    "journal_intake_faults": f"WITH {_ROWS} SELECT sheet, row, errors FROM e WHERE errors <> ''",
    "journal_intake_outcomes": f"""WITH {_ROWS}, n AS (SELECT sheet, count(*) AS u FROM u GROUP BY sheet)
SELECT sheet, count(*) AS total, count(*) FILTER (errors = '') AS success, count(*) FILTER (errors <> '') + coalesce(any_value(u), 0) AS n_errors FROM e LEFT JOIN n USING (sheet) GROUP BY sheet""",
}
