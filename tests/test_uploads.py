"""Columns of uploads, entries against rows, parents of either kind and the group tree, on rows made by hand."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import classification, columns, execution, grouptree, transform


def _sheet(spark, *headers, sheet=1):
    return spark.createDataFrame([(sheet, i, h, f"col_{i + 1:03}") for i, h in enumerate(headers)], "sheet int, index int, header string, column_id string")


def test_auto_match_lists_what_is_left_and_what_is_missing(spark):
    found = columns.auto_match(_sheet(spark, "科目编码", "科目名称", "期初余额（借）", "本期发生额_贷方_金额", "本币期间异动", "本年累计", "无关字段XYZ", "科目编码", None), "trial_balance").first()
    assert found["matched"] == {"account_code": "科目编码", "account_name": "科目名称", "opening_debit": "期初余额（借）", "current_credit": "本期发生额_贷方_金额"}
    assert found["unmatched"] == ["本币期间异动", "本年累计", "无关字段XYZ", "科目编码", None] and found["missing"] == ["fiscal_year", "period"]
    journal = columns.auto_match(_sheet(spark, "凭证号", "凭证日期", "摘要", "借方金额", "贷方金额"), "journal").first()
    assert set(journal["matched"]) == {"voucher_no", "voucher_date", "summary", "debit_amount", "credit_amount"}
    assert columns.auto_match(_sheet(spark).filter("false"), "subsidiary").count() == 0
    with pytest.raises(ValueError, match="unknown type"):
        columns.type_fields("ledger")


def test_given_mappings_and_ragged_rows(spark):
    cols = _sheet(spark, "a", "b", "a", "c")
    by_id = columns.given_by_id(cols, spark.createDataFrame([(1, "col_004", "x"), (1, "col_002", "x"), (1, "col_009", "y")], "sheet int, column_id string, field string"))
    by_header = columns.given_by_header(cols, spark.createDataFrame([(1, "p", "a"), (1, "q", "zz")], "sheet int, field string, header string"))
    assert [tuple(r) for r in by_id.collect()] == [(1, "x", 3)] and [tuple(r) for r in by_header.collect()] == [(1, "p", 0)]
    rows = spark.createDataFrame([(1, 0, ["1", "2", "3", "4"]), (1, 1, ["5"]), (2, 0, ["6"])], "sheet int, row int, cells array<string>")
    assert {(r["sheet"], r["row"]): r["fields"] for r in columns.projected(rows, columns.in_force(by_id, by_header)).collect()} == {(1, 0): {"x": "4"}, (1, 1): {}, (2, 0): {}}


def test_entries_that_do_not_reconcile_either_way(spark):
    rows = spark.createDataFrame([(b, c, t, False, Decimal(v)) for b, c, t, v in ((1, "eligible", "a", 5), (1, "ignored", None, 2), (2, "eligible", "a", 5), (3, "eligible", "a", 5), (5, "odd", "a", 1), (6, "zero_amount", None, 0))], "batch int, row_class string, target string, by_direction boolean, debit decimal(20,2)")
    entries = spark.createDataFrame([(1, Decimal(5)), (2, Decimal(5)), (2, Decimal(5)), (4, Decimal(3))], "batch int, debit decimal(20,2)")
    found = {r["batch"]: (r["difference"], r["reconciled"]) for r in execution.entry_reconciliation(rows, entries, ["debit"]).collect()}
    assert found == {1: (0, True), 2: (-5, False), 3: (5, False), 4: (-3, False), 5: (0, True), 6: (0, True)}
    chart = spark.createDataFrame([("a", True, "debit")], "target string, active boolean, direction string")
    gates = lambda r, e, c: {(x["batch"], x["gate"]) for x in execution.written_faults(r, e, c, ["debit"], classification.CLASSES).collect()}
    assert gates(rows, entries, chart) == {(2, "entries"), (2, "reconciliation of debit"), (3, "entries"), (3, "reconciliation of debit"), (4, "entries"), (4, "reconciliation of debit"), (5, "identity")}
    one, made = rows.filter("batch = 1"), entries.filter("batch = 1")
    assert gates(one, made, chart) == set()
    assert gates(one, made, chart.withColumn("active", F.lit(False))) == {(1, "target")} == gates(one, made, chart.filter("false"))
    assert gates(one.withColumn("by_direction", F.lit(True)), made, chart.withColumn("direction", F.lit(" "))) == {(1, "direction")}


def test_parents_by_code_and_by_indent_in_turn(spark):
    zero = [Decimal(0)] * 6
    amount = lambda n: [Decimal(n), *zero[1:]]
    rows = [
        (1, "11", None, "code_prefix", False, *amount(9)), (2, "1101", "11", "code_prefix", False, *amount(7)), (3, None, "2", "indent_suggested", False, *amount(7)), (4, None, "3", "indent_suggested", True, *amount(4)),
        (5, None, "3", "indent_suggested", True, *amount(3)), (6, "1102", "11", "code_prefix", True, *amount(1)), (7, None, "2x", "indent_suggested", True, *amount(8)), (8, "5", None, "code_prefix", True, *amount(2)), (9, None, "5", "indent_suggested", True, *amount(1)),
    ]
    df = spark.createDataFrame(rows, "row long, code string, parent_key string, level_source string, is_leaf boolean, " + ", ".join(f"{m} decimal(20,2)" for m in transform.MEASURES))
    parents = {r["row"]: r["parent_row"] for r in transform.resolved_parents(df, "row", "code").collect()}
    assert parents == {2: 1, 3: 2, 4: 3, 5: 3, 6: 1, 9: 8}  # "5" is a code, not the fifth row
    assert {(r["row"], r["measure"], r["difference"]) for r in transform.tree_differences(df, "row", "code").collect()} == {(1, "opening_net", 1), (8, "opening_net", 1)}
    assert {(r["row"], r["n_children"], r["n_mismatches"]) for r in transform.summary_reconciliation(df, "row", "code").collect()} == {(1, 2, 1), (2, 1, 0), (3, 2, 0), (8, 1, 1)}


def test_group_tree_with_shared_groups_and_a_circle(spark):
    accounts = spark.createDataFrame([("A", None, "1", "资产"), ("B", "A", "1002", "银行存款"), ("C", "A", "9", "空")], "account string, parent string, code string, name string")
    rows = spark.createDataFrame([(1, None, "r1", "top"), (2, 1, "r2", "mid"), (3, 2, "r3", "low"), (4, 5, "r4", "p"), (5, 4, "r5", "q"), (6, 6, "r6", "self"), (7, 99, "r7", "orphan")], "row int, parent_row int, code string, name string")
    entries = spark.createDataFrame(
        [(1, "B", 3, "x", "a_b"), (2, "B", 2, "x", "c"), (3, "B", 4, "x", "d"), (4, "B", None, "10020101", "银行存款_工行_甲"), (5, "B", 7, "10020102", "银行存款_工行_乙"), (6, "B", 6, None, "e"), (7, "Z", 1, "x", "lost")],
        "entry int, account string, row int, code string, name string",
    ).withColumn("amount", F.lit(1).cast("decimal(20,2)"))
    found = {r["node_id"]: (r["parent_id"], r["name"], int(r["amount"]), r["entry_count"]) for r in grouptree.group_tree(accounts, entries, rows, ["amount"]).collect()}
    assert found == {
        "account:A": (None, "资产", 6, 6), "account:B": ("account:A", "银行存款", 6, 6), "account:C": ("account:A", "空", 0, 0),
        "client_group:B:1": ("account:B", "top", 2, 2), "client_group:B:2": ("client_group:B:1", "mid", 2, 2), "client_group:B:5": ("account:B", "q", 1, 1),
        "entry:1": ("client_group:B:2", "b", 1, 1), "entry:2": ("client_group:B:1", "c", 1, 1), "entry:3": ("client_group:B:5", "d", 1, 1),
        "synth:B:100201": ("account:B", "工行", 2, 2), "entry:4": ("synth:B:100201", "甲", 1, 1), "entry:5": ("synth:B:100201", "乙", 1, 1), "entry:6": ("account:B", "e", 1, 1),
    }
    assert "account:C" not in {r["node_id"] for r in grouptree.group_tree(accounts, entries, rows, ["amount"], only_with_amounts=True).collect()}
    assert grouptree.group_tree(accounts.filter("false"), entries, rows, ["amount"]).count() == 0
