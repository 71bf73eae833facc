"""Two tables that are written together, charts with bad rows, and the audit over files."""

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import audit, recommend
from tallyweave.sources import batches, previews


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "batch_id int, v string")


def _seen(spark, path):
    return [sorted(map(tuple, batches.read_import(spark, path, t).collect())) for t in batches.TABLES]


def test_both_tables_or_neither(spark, tmp_path):
    path = str(tmp_path / "store")
    assert batches.current(spark, path).count() == 0
    batches.write_import(_rows(spark, (1, "a"), (2, "b")), _rows(spark, (1, "e")), path)
    first = ([(1, "a"), (2, "b")], [(1, "e")])
    assert tuple(_seen(spark, path)) == first
    # the entries fail after the raw rows were staged
    broken = _rows(spark, (1, "x")).withColumn("v", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        batches.write_import(_rows(spark, (1, "new"), (3, "new")), broken, path)
    assert tuple(_seen(spark, path)) == first
    with pytest.raises(ValueError, match="without raw rows"):
        batches.write_import(_rows(spark, (3, "c")), _rows(spark, (9, "e")), path)
    assert tuple(_seen(spark, path)) == first
    batches.write_import(_rows(spark, (1, "c")), _rows(spark, (1, "f"), (1, "g")), path)
    assert _seen(spark, path) == [[(1, "c"), (2, "b")], [(1, "f"), (1, "g")]]
    batches.delete_import(_rows(spark, (1, "")), path)
    assert _seen(spark, path) == [[(2, "b")], []]
    batches.write_import(_rows(spark, (1, "d")), _rows(spark).filter("false"), path)
    assert _seen(spark, path) == [[(1, "d"), (2, "b")], []]


def test_chart_rows_and_errors(spark):
    rows = [(1, 0, ["科目名称", "科目代码", "余额方向"]), (1, 1, ["现金", "1001", "借"]), (1, 2, ["", ""]), (1, 3, ["银行", " "]), (1, 4, ["存款"]), (1, 5, ["", "1002"]), (2, 0, ["x"]), (2, 1, ["y"]), (3, 0, ["科目代码"])]
    good, bad = previews.accounts_and_errors(previews.scan_chart(spark.createDataFrame(rows, "sheet int, row int, cells array<string>")))
    assert sorted(map(tuple, good.collect())) == [(1, 0, "1001", "现金", "借", None), (1, 3, "1002", "", None, None)]
    assert sorted(((r["sheet"], r["row"]) for r in bad.collect()), key=str) == [(1, 1), (1, 2), (2, None)]


def test_audit_counts_accounts_once_and_mismatches_in_picks_only(spark):
    chart = spark.createDataFrame([("4101", "生产成本户", True), ("1602", "累计折旧", True), ("1001", "现金", True)], "code string, name string, active boolean")
    rows = spark.createDataFrame([("f", 1, "5001", "生产成本"), ("f", 2, "5001", "生产成本"), ("f", 3, "x", "固定资产"), ("f", 4, "y", "无"), ("g", 5, "z", "现金")], "file string, client int, code string, name string")
    rows = rows.withColumns({"full_path": F.lit(""), "participates": F.col("client") != 5})
    made = [(1, "4101", "company_history", 1.0, None, True, "compatible", True, 1), (3, "1602", "code_match", 0.72, "w", False, "conflict", False, 1), (3, "1001", "name_similarity", 0.8, "w", False, "unknown", False, 2), (2, "1001", "name_exact", 1.0, None, True, "compatible", True, 1)]
    candidates = spark.createDataFrame(made, "client int, target string, source string, score double, warning string, auto boolean, compatibility string, safe boolean, rank int")
    found = [r.asDict() for r in audit.audit_files(rows, candidates, chart).collect()]
    assert len(found) == 1 and {k: v for k, v in found[0].items() if v} == {"file": "f", "accounts": 3, "no_candidate": 1, "confirmed": 1, "manual": 1, "no_safe": 1, "with_conflict": 1, "with_unknown": 1, "by_company_history": 1, "n_mismatches": 1}
    assert set(audit.COUNTED) == set(recommend.STAGES)
