"""What grows with the input is not sent through the driver, and long expressions are worked out once."""

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import analyze, audit, matching, recommend, transform, views
from tallyweave.plans import advice, mapping


def sent(df):
    """The parts of the physical plan below each broadcast."""
    lines = df._jdf.queryExecution().sparkPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found = []
    for i, line in enumerate(lines):
        if "BroadcastHashJoin" not in line:
            continue
        below = []
        for later in lines[i + 1 :]:
            if depth(later) <= depth(line):
                break
            below.append(later)
        top = min(map(depth, below))
        starts = [j for j, x in enumerate(below) if depth(x) == top]
        found.append("\n".join(below[starts[1] :] if "BuildRight" in line else below[starts[0] : starts[1]]))
    return found


def test_clients_are_not_broadcast(spark, tmp_path):
    # an estimate from files says little of what clients grow to once their codes are cut into prefixes
    names = F.concat(F.lit("累计折旧"), F.col("id") % 5)
    spark.range(200).select(F.col("id").alias("client"), F.concat(F.lit("1602"), "id").alias("code"), names.alias("name"), F.concat(F.lit("16"), "id").alias("parent_code")).write.parquet(f"{tmp_path}/clients")
    chart = spark.createDataFrame([("1602", "累计折旧", True), ("1601", "固定资产", True)], "code string, name string, active boolean")
    clients = spark.read.parquet(f"{tmp_path}/clients")
    df = recommend.recommend(clients, chart, least_similarity=None, keep=lambda d: d)
    below = sent(df)
    assert below and not [b for b in below if "clients" in b or "parent_code" in b]
    assert df.count() > 0


def test_a_path_is_worked_out_once(spark):
    df = spark.createDataFrame([("80000000000001", "a_b_研发-x/y", "a"), ("80000000000001", "研发支出_资本化支出_z", "q"), ("8", None, "q"), ("", "a_b", "q"), ("81", "研发支出_费用化支出", "q"), ("82", "x_y", "x")], "code string, name string, std string")
    made = df.select(views.synthetic_path(F.col("code"), F.col("name"), F.col("std"), F.lit("0")).alias("path"))
    assert [[tuple(g) for g in r["path"]] for r in made.collect()] == [
        [("800000", "b"), ("80000000", "b_研发"), ("8000000000", "b_研发_x")], [("800000", "研发支出_资本化支出")], [], [], [("81", "研发支出_费用化支出")], [],
    ]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2


def test_groups_are_worked_out_for_distinct_names(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("client"), F.when(F.col("id") % 2 == 0, "预付账款").otherwise("其他").alias("name")).write.parquet(f"{tmp_path}/clients")
    chart = spark.createDataFrame([("112401", "预付款项", True)], "code string, name string, active boolean")
    found = matching.alias_matches(spark.read.parquet(f"{tmp_path}/clients"), chart)
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [x for x in lines if "Filter" in x] and not [x for x in lines if "Filter" in x and "CASE WHEN" in x]
    assert found.count() == 50


def leaves_below(rows, parents):
    """Sums of leaves over every chain of parents, by hand: a row is entered once and is not below itself."""
    sums = {}
    for row, _, is_leaf, amount in rows:
        seen, at = {row}, parents.get(row)
        while is_leaf and at is not None and at not in seen:
            sums[at] = sums.get(at, 0) + amount
            seen.add(at)
            at = parents.get(at)
    return {(r, a - sums[r]) for r, _, _, a in rows if r in sums and a != sums[r]}


def balances(spark, tmp_path, rows, parents):
    df = spark.createDataFrame([(*r, None if parents.get(r[0]) is None else str(parents[r[0]])) for r in rows], "row long, code string, is_leaf boolean, amount int, parent_key string").repartition(3)
    df = df.withColumns({m: F.when(F.lit(m == "current_debit"), F.col("amount")).otherwise(0).cast("decimal(20,2)") for m in transform.MEASURES} | {"level_source": F.lit("indent_suggested")})
    df.write.parquet(f"{tmp_path}/balances")
    return spark.read.parquet(f"{tmp_path}/balances")


def differences(df):
    assert "FileScan" not in df._jdf.queryExecution().sparkPlan().toString()  # the rows are written once, not placed again for each join
    return {(r["row"], int(r["difference"])) for r in df.collect()}


def test_sums_climb_a_tree_beside_a_circle(spark, tmp_path):
    parents = {i: i // 3 for i in range(3, 60)} | {60: 61, 61: 62, 62: 60, 63: 60, 64: 63, 65: 63, 66: 66, 67: 66}
    rows = [(i, None, i % 7 == 0 or i >= 20 and i != 63, i * i) for i in range(1, 69)]
    found = transform.tree_differences(balances(spark, tmp_path, rows, parents), "row", "code", max_depth=6)
    want = leaves_below(rows, {r: p for r, p in parents.items() if r != p})
    assert differences(found) == want and {r for r, _ in want} >= {60, 61, 62, 63, 66, 1}


def test_a_chain_too_deep_is_an_error(spark, tmp_path):
    rows = [(i, None, i == 9, i) for i in range(1, 10)]
    with pytest.raises(ValueError, match="deeper"):
        transform.tree_differences(balances(spark, tmp_path, rows, {i: i - 1 for i in range(2, 10)}), "row", "code", max_depth=6)


def test_leaves_are_summed_below_their_codes(spark, tmp_path):
    codes = ["1", "10", "100", "1001", "10010", "2", "2", "21", "210", "3", "", None, "31x", "31x9", "5"]
    rows = [(i, c, i % 2 == 1 or i > 10, 3 * i + 1) for i, c in enumerate(codes)]
    found = transform.parent_differences(balances(spark, tmp_path, rows, {}), "row", "code")
    want = set()
    for i, c, _, amount in rows:
        below = [a for _, d, is_leaf, a in rows if c and d and is_leaf and d != c and d.startswith(c)]
        if below and sum(below) != amount:
            want.add((i, amount - sum(below)))
    assert differences(found) == want and len(want) > 5


def test_anchors_meet_distinct_names_and_their_first_accounts(spark):
    names = ["银行存款", "银行存款明细", "减：银行存款", "存款", "应收账款", ""]
    accounts = {(f"{i % 97:03}", names[i * i % 6], i % 5 != 0) for i in range(400)}
    chart = spark.createDataFrame([*accounts, *list(accounts)[:50]], "code string, name string, active boolean").repartition(3)
    anchors = [(1, "银行存款"), (2, "存款"), (3, " 银行 存款"), (4, "款"), (5, None), (6, ""), (7, "现金")]
    found = matching.anchor_matches(spark.createDataFrame(anchors, "client int, anchor string"), chart)
    want = set()
    for client, anchor in anchors:
        key, hits = (anchor or "").replace(" ", ""), {}
        for code, name, active in accounts:
            if key and key in (bare := name.removeprefix("减：")):
                hits[code, active] = hits.get((code, active), False) or bare == key
        want |= {(client, code, exact, n + 1) for n, (exact, active, code) in enumerate(sorted(((e, a, c) for (c, a), e in hits.items()), key=lambda h: (not h[0], not h[1], h[2]))[:5])}
    assert {tuple(r) for r in found.collect()} == want and len(want) == 20
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    cut = [i for i, x in enumerate(lines) if "Generate explode(sequence(1, length(" in x]
    # substrings are cut of distinct names: an aggregate lies below
    assert cut and all(any("Aggregate [canonical" in y for y in lines[i + 1 : i + 4] if depth(y) > depth(lines[i])) for i in cut[1:])


def test_a_code_is_folded_once_for_all_classes(spark):
    codes = ["1001", "10 02.01", "112", "1121.0", "+1221", "99", None, "６００１"]
    anchors = matching.code_class_anchors(spark.createDataFrame(list(enumerate(codes)), "client int, code string"))
    assert {tuple(r) for r in anchors.collect()} == {(0, "库存现金"), (1, "银行存款"), (3, "应收票据"), (4, "其他应收款"), (7, "主营业务收入")}
    assert "startswith(" not in anchors._jdf.queryExecution().analyzed().toString().lower()


def test_names_are_matched_once_for_all_clients(spark):
    chart = spark.createDataFrame([("1", "应付账款", True), ("2", "应付", True), ("3", "甲公司", False), ("3", "甲公司", False), ("4", "减：应付账款", True)], "code string, name string, active boolean")
    clients = spark.createDataFrame([(i, ("应付账款_甲公司", "应付 账款", None, "")[i % 4]) for i in range(8)], "client int, name string")
    found = matching.name_matches(clients, chart)
    first = [("1", "name_prefix", 1), ("4", "name_prefix", 2), ("3", "name_prefix", 3), ("2", "name_prefix", 4)]
    second = [("1", "name_exact", 1), ("4", "name_exact", 2), ("2", "name_prefix", 1)]
    assert sorted(map(tuple, found.collect())) == sorted([(i, *h) for i in (0, 4) for h in first] + [(i, *h) for i in (1, 5) for h in second])
    windows = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x]
    assert windows and not [x for x in windows if "client" in x]


def test_tasks_that_rank_hold_so_many_lines_at_most(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mapping, "LINES_A_TASK", 50)
    spark.range(500).select((F.col("id") % 40).alias("l_partkey"), (F.col("id") % 7).alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    for query, rows in ((mapping.candidate_rank_safe_first, 40 * 7), (mapping.auto_confirm_status, 40)):
        df = query(spark, str(tmp_path))
        shuffles = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
        assert len(shuffles) == 1 and ", 10), REPARTITION_BY_NUM" in shuffles[0]
        assert df.count() == rows


def test_old_mappings_of_a_name_do_not_multiply_with_its_clients(spark, monkeypatch):
    made = [(f"h{i}", "银行存款" if i % 3 else "银行 存款", ("1001", "1002", "zz", "1122")[i % 4], i % 50, f"{i % 7}", i % 10 != 9) for i in range(400)]
    kept_old = "code string, name string, target string, used int, last_used string, active boolean"
    chart = spark.createDataFrame([("1001", "银行存款", True), ("1002", "减：坏账准备", True), ("1122", "应收账款", False)], "code string, name string, active boolean")
    clients = spark.createDataFrame([(i, f"h{i}", "银行存款") for i in range(60)], "client int, code string, name string")
    sizes = []

    def keep(df):
        df = df.checkpoint()
        sizes.append(df.count())
        return df

    want = {}
    for client in range(60):
        old = {(code != f"h{client}", -used, tuple(-ord(c) for c in last), target, name) for code, name, target, used, last, on in made if on}
        once = [o for o in old if not (o[0] and (False, *o[1:]) in old)]
        # safe ones first; of the others, those that contradict the name, then those whose account is gone or not active
        kind = lambda o: {"1001": 0, "zz": 1, "1122": 1}.get(o[3], 2)
        want[client] = [o[3] for o in sorted(once, key=lambda o: (kind(o), *o))][:10]
    for sent in (recommend.SENT_HITS, 0):
        monkeypatch.setattr(recommend, "SENT_HITS", sent)
        found = {}
        for r in recommend.recommend(clients, chart, spark.createDataFrame(made, kept_old), least_similarity=None, keep=keep).orderBy("client", "rank").collect():
            found.setdefault(r["client"], []).append(r["target"])
        assert found == want
    assert max(sizes) <= 60


def copies(spark, tmp_path):
    """Forty parts of one context, as far as names, codes and parents go, and two brands."""
    made = spark.range(40).select((F.col("id") * 9240).alias("p_partkey"), F.lit("red ring").alias("p_name"), F.concat(F.lit("B"), F.col("id") % 2).alias("p_brand"))
    made.write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def counted(monkeypatch, module, name):
    """How many rows each call of a function is given."""
    rows, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda df: (rows.append(df.count()), real(df))[1])
    return rows


def test_decisions_are_made_once_a_context(spark, tmp_path, monkeypatch):
    rows = counted(monkeypatch, matching, "decide")
    found = advice.recommend_decisions(spark, copies(spark, tmp_path)).collect()
    assert len(found) == 40 and len({tuple(r)[1:] for r in found}) == 1
    assert rows == [found[0]["n_candidates"]]


def test_files_are_audited_from_picks_of_contexts(spark, tmp_path, monkeypatch):
    rows = counted(monkeypatch, audit, "picks")
    found = advice.audit_over_files(spark, copies(spark, tmp_path)).collect()
    assert {r["file"]: r["accounts"] for r in found} == {"B0": 1, "B1": 1} and len({tuple(r)[1:] for r in found}) == 1
    assert rows and max(rows) <= 10


def test_names_of_ancestors_are_folded_once_and_sums_wait_until_asked_for(spark, monkeypatch):
    made = [(1, "办公费", "管理费用", "资产\\固定资产", ["其他", "累计折旧_房屋", "应付账款"]), (2, "a", None, None, None), (3, "b", "", "", ["x", None])]
    views = spark.createDataFrame(made, "view int, name string, parent_name string, full_path string, ancestor_names array<string>").repartition(2)
    facts = recommend.view_facts(views)
    assert {r["view"]: (r["a_group"], r["a_any"]) for r in facts.collect()} == {1: ("accumulated_depreciation", True), 2: (None, False), 3: (None, True)}
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 12
    monkeypatch.setattr(transform, "tree_differences", lambda *_: pytest.fail("nobody asked"))
    rows = spark.createDataFrame([(i, c, "银行存款", "0") for i, c in ((1, "1002"), (2, "100201"))], "row int, code string, name string, ending_debit string").withColumns({m: F.lit("0") for m in transform.MEASURES[:-2] + transform.MEASURES[-1:]})
    chart = spark.createDataFrame([("1002", "银行存款", True, "asset", "debit")], "code string, name string, active boolean, category string, direction string")
    assert {r["row"]: r["parent_row"] for r in analyze.analyze(rows.withColumn("indent", F.lit(None).cast("int")), chart).rows.collect()} == {1: None, 2: 1}
