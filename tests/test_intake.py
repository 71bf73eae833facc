"""Intakes work each field out once and read the rows once; guards before casts change no result."""

from pyspark.sql import functions as F

from tallyweave.functions import parsing
from tallyweave.operators import intake

HEADS = ("凭证号", "凭证日期", "摘要", "科目编码", "科目名称", "借方金额", "贷方金额", "备注")
ROWS = (
    (1, 0, ["1", "2024-03-08", "a", "1001", "x", "5", "", "n"]), (1, 1, ["1", "2024-03-08", "a", "1001", "x", "", "4", ""]), (1, 2, ["2", "soon", "a", "1001", "x", "1", "", ""]),
    (1, 3, ["3", "20240308", "a", "1001", "x"]), (2, 0, ["1", "2024.3.8", "a", "1001", "x", "7", "", "n"]), (2, 1, ["1", "2024年3月8日", "a", "1001", "x", "", "7.00", "n"]),
)


def found(spark):
    rows = spark.createDataFrame(ROWS, "sheet long, row int, cells array<string>")
    cols = spark.createDataFrame([(s, i, h, f"col_{i + 1:03}") for s in (1, 2) for i, h in enumerate(HEADS)], "sheet long, index int, header string, column_id string")
    return intake.intake(rows, cols, "journal", fiscal_year=2024, period=12)


def test_outcomes_good_rows_and_faults(spark):
    got = found(spark)
    assert {tuple(r) for r in got.outcomes().select("sheet", "total", "success", "n_errors").collect()} == {(1, 4, 3, 2), (2, 2, 2, 0)}
    assert {(r["sheet"], r["row"]): r["errors"] for r in got.faults.collect()} == {(1, 2): ["voucher_date: not a date"]}
    good = {(r["sheet"], r["row"]): r for r in got.good.collect()}
    assert good.keys() == {(1, 0), (1, 1), (1, 3), (2, 0), (2, 1)} and good[1, 0]["debit_amount"] == 5 and good[1, 3]["debit_amount"] is None
    assert {r["fiscal_year"] for r in good.values()} == {2024} and len({r["voucher_date"] for r in good.values()}) == 1


def test_a_field_is_worked_out_once(spark):
    got = found(spark)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (got.good, got.faults, got.outcomes()):
        assert plan(df).count("cells#") < 60 and plan(df).count("array<string>") < 60
        assert plan(df).count("map_from_arrays") == 0
    assert plan(got.outcomes()).count("_at_voucher_no") <= plan(got.good).count("_at_voucher_no")


def test_guards_change_no_value(spark):
    texts = ("", " ", "n/a", "1,5", "１２", "1e3", "-3.5", ".5", "5.", "NaN", "Infinity", "two", "99999999999", "2024-3-8", "2024/03/08", "20240308", "2024年3月8日", "2024.3.8", "2024-3/8", "+20240308", "2024-13-1", "٣", None)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bare = F.translate(F.trim("t"), ",，", "")
    plain = (bare.try_cast("decimal(20,2)"), bare.try_cast("double").try_cast("int"), F.coalesce(*(F.try_to_date(F.trim("t"), p) for p in parsing.DATE_PATTERNS)))
    ours = (parsing.to_decimal(F.col("t")), parsing.to_int(F.col("t")), parsing.to_date(F.col("t")))
    for r in df.select("t", *(c.alias(f"p{i}") for i, c in enumerate(plain)), *(c.alias(f"o{i}") for i, c in enumerate(ours))).collect():
        assert [r[f"p{i}"] for i in range(3)] == [r[f"o{i}"] for i in range(3)], r["t"]
