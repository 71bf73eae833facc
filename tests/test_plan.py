"""The unified mapping plan on a tree made by hand: every reason, ended branches, odd tables."""

from tallyweave.operators import plan

CHART = [
    ("1002", "银行存款", True, "asset"), ("1122", "应收账款", True, "asset"), ("2202", "应付账款", True, "liability"), ("1601", "固定资产", True, "asset"), ("1602", "累计折旧", True, "contra_asset"),
    ("6001", "主营业务收入", True, "revenue"), ("6401", "主营业务成本", True, "expense"), ("9999", "停用账户", False, "asset"),
]
NODE = "node long, parent long, level int, code string, name string, is_summary boolean, participates boolean, ignored boolean"


def _plan(spark, rows, history=(), said=(), offered=(), ignored=()):
    nodes = spark.createDataFrame([(n, p, lv, c, name, s, not s or lv == 1, False) for n, p, lv, c, name, s in rows], NODE)
    chart = spark.createDataFrame(CHART, "code string, name string, active boolean, category string")
    kept = spark.createDataFrame(list(history), "code string, name string, target string, active boolean")
    confirmed = spark.createDataFrame(list(said), "node long, target string, override boolean")
    given = spark.createDataFrame(list(offered), "node long, target string, safe boolean")
    out = spark.createDataFrame([(i,) for i in ignored], "node long")
    return plan.unified_plan(nodes, chart, kept, confirmed, lambda wanted: given, out)


def test_every_reason_breaks_inheritance(spark):
    under = {
        2: ("x1", "甲户"), 3: ("h1", "乙户"), 4: ("1002", "存款户"), 5: ("x2", "应付账款"), 6: ("x3", "累计折旧额"), 7: ("x4", "减值准备丙"), 8: ("x5", "设备资本化"), 9: ("x6", "应付丁公司"), 10: ("2202", "戊户"), 11: ("x7", "押金"),
    }
    rows = [(1, None, 1, "1122", "应收账款", True)] + [(n, 1, 2, *own, False) for n, own in under.items()] + [(20, None, 1, "6001", "主营业务收入", True), (21, 20, 2, "y", "物业成本", False)]
    found = _plan(spark, rows, [("h1", None, "1002", True), ("x1", None, "2202", False)], offered=[(1, "1122", True), (20, "6001", True), *((n, "1601", n % 2 == 0) for n in (3, 4, 5, 6))])
    got = {r["node"]: (r["role"], r["target"], r["reason"]) for r in found.plan.collect()}
    assert got == {
        1: ("anchor", "1122", None), 2: ("inherited", "1122", None), 3: ("breakpoint", "1601", "user_history_override"), 4: ("breakpoint", "1601", "exact_code_different_target"),
        5: ("breakpoint", "1601", "exact_name_different_target"), 6: ("breakpoint", "1601", "semantic_group_different_target"), 7: ("unresolved", None, "reserve_token_boundary"),
        8: ("unresolved", None, "rd_capitalization_boundary"), 9: ("unresolved", None, "direction_boundary"), 10: ("unresolved", None, "account_category_boundary"), 11: ("inherited", "1122", None),
        20: ("anchor", "6001", None), 21: ("unresolved", None, "profit_loss_boundary"),
    }
    modes = {r["node"]: (r["mode"], r["requires_confirmation"], r["anchor"]) for r in found.plan.collect()}
    assert modes[3] == ("direct_confirmed", True, None) and modes[4] == ("direct_auto", False, None) and modes[2] == ("inherited_ancestor", False, 1) and modes[7] == ("none", True, None)
    assert {r["node"]: r["resolved"] for r in found.leaves.collect()} == {n: got[n][1] is not None for n in got if n not in (1, 20)}
    counts = found.summary().first()
    assert (counts["total_nodes"], counts["n_anchor"], counts["n_breakpoint"], counts["n_inherited"], counts["n_unresolved"]) == (13, 2, 4, 2, 5)


def test_overrides_headings_and_ended_branches(spark):
    rows = [
        (1, None, 1, "1", "资产类", True), (2, 1, 2, "a", "甲", True), (3, 2, 3, "b", "乙", False), (4, 2, 3, "c", "丙", False), (5, 4, 4, "d", "丁", False), (6, 2, 3, "e", "戊", False), (7, 6, 4, "f", "己", False),
        (8, 2, 3, "g", "庚", True), (9, 8, 4, "h", "辛", False), (10, None, 1, "i", "", False), (11, None, 1, "j", "壬", False),
    ]
    rows = [(n, p, lv, c, name, s and n != 2 and n != 8) for n, p, lv, c, name, s in rows]
    found = _plan(spark, rows, said=[(2, "1002", False), (4, "1122", True), (6, "none", True), (11, "none", False)], offered=[(11, "1601", True), (3, "1601", True)], ignored=[8])
    got = {r["node"]: (r["role"], r["target"], r["mode"], r["requires_confirmation"]) for r in found.plan.collect()}
    assert got == {
        1: ("structural_summary", None, "none", False), 2: ("anchor", "1002", "direct_confirmed", True), 3: ("inherited", "1002", "inherited_ancestor", False), 4: ("explicit_override", "1122", "override_confirmed", False),
        5: ("inherited", "1122", "inherited_ancestor", False), 6: ("unresolved", None, "none", True), 7: ("unresolved", None, "none", False), 8: ("ignored", None, "none", False), 9: ("unresolved", None, "none", False),
        10: ("structural_summary", None, "none", False), 11: ("unresolved", None, "none", True),
    }
    assert {r["node"] for r in found.leaves.filter("not resolved").collect()} == {6, 7, 9, 11}


def test_roles_by_children_and_an_empty_tree(spark):
    rows = [(1, None, 1, "a", "杂项", True), (2, 1, 2, "b", "现金甲", False), (3, 1, 2, "c", "借款乙", False), (4, None, 1, "d", "其他", True), (5, 4, 2, "e", "现金丙", False), (6, 4, 2, "f", "存款丁", False)]
    found = _plan(spark, rows).nodes
    assert {r["node"]: r["semantic"] for r in found.collect()} == {1: "structural_summary", 2: "ordinary_detail", 3: "ordinary_detail", 4: "ordinary_detail", 5: "ordinary_detail", 6: "ordinary_detail"}
    empty = _plan(spark, [])
    assert empty.plan.count() == 0 and empty.leaves.count() == 0 and empty.summary().first()["total_nodes"] == 0
