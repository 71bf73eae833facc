"""The unified mapping plan over the geography tree, named in the words of a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import vocabulary as V
from tallyweave.operators import analyze, plan, transform
from tallyweave.plans.books import pick
from tallyweave.session import table

CHART = (
    ("1002", "银行存款", True, "asset"), ("1122", "应收账款", True, "asset"), ("1231", "坏账准备", True, "contra_asset"), ("2202", "应付账款", True, "liability"),
    ("2203", "预收账款", True, "liability"), ("1601", "固定资产", True, "asset"), ("1602", "累计折旧", True, "contra_asset"), ("6602", "管理费用", True, "expense"),
    ("6001", "主营业务收入", True, "revenue"), ("6401", "主营业务成本", False, "expense"), ("170401", "研发支出资本化", True, "asset"), ("660201", "研发费用", True, "expense"),
)
CODES = tuple(c for c, *_ in CHART)
NAMES = (
    "应收账款", "应付账款", "坏账准备", "研发支出资本化支出", "主营业务收入", "预收客户款", "办公费", "固定资产", "累计折旧", "无形资产减值准备",
    "设备资本化", "应付材料款", "华东收入", "银行存款", "资产", "其他费用化支出", "", "应收员工款", "物业成本",
)


def account_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as a sheet: their keys deal out names, codes and what takes part."""
    level = lambda name, key, parent, n, start: table(spark, sf_dir, name).select((F.col(key) + start).cast("long").alias("node"), parent.cast("long").alias("parent"), F.lit(n).alias("level"), F.col(key).cast("long").alias("k"))
    rows = level("region", "r_regionkey", F.lit(None), 1, 0).union(level("nation", "n_nationkey", F.col("n_regionkey"), 2, 100)).union(level("customer", "c_custkey", F.col("c_nationkey") + 100, 3, 1000))
    k = F.col("k")
    code = F.when(k % 5 == 0, pick(CODES, F.floor(k / 5))).otherwise(F.concat(F.lit("9"), k))
    return rows.select("node", "parent", "level", "k", code.alias("code"), pick(NAMES, k).alias("name"), (F.col("level") < 3).alias("is_summary"), (k % 4 != 0).alias("participates"), (k % 50 == 49).alias("ignored"))


def unified(spark: SparkSession, sf_dir: str) -> plan.Plan:
    rows = account_nodes(spark, sf_dir)
    k = F.col("k")
    chart = spark.createDataFrame(CHART, "code string, name string, active boolean, category string")
    history = rows.filter("k % 13 = 6").select(F.when(k % 2 == 0, F.col("code")).alias("code"), F.when(k % 39 == 6, "物业成本").alias("name"), pick(CODES, F.floor(k / 13)).alias("target"), (k % 26 != 19).alias("active"))
    said = rows.filter("k % 17 = 3").select("node", F.when(k % 34 == 3, pick(CODES, k)).otherwise("none").alias("target"), (k % 3 == 0).alias("override"))
    offered = lambda wanted: wanted.join(rows.select("node", "k"), "node").filter("k % 4 <> 1").select("node", pick(CODES, k + 3).alias("target"), (k % 3 == 0).alias("safe"))
    return plan.unified_plan(rows.drop("k"), chart, history, said, offered, rows.filter("k % 60 = 58").select("node"))


def unified_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified(spark, sf_dir).plan


def unified_plan_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(c, ",").alias(c)
    return unified(spark, sf_dir).nodes.select("node", joined("by_history"), "by_code", joined("by_name"), joined("by_group"), "semantic", "signal", "found")


def unified_plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified(spark, sf_dir).summary()


def upload_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as one upload without a tree: codes and indents place them, and all candidate sources run."""
    rows = account_nodes(spark, sf_dir)
    k = F.col("k")
    amounts = {m: F.lit("0") for m in transform.MEASURES} | {"ending_debit": (k % 97).cast("string"), "current_credit": F.when(k % 7 == 0, "1,000.50").otherwise("")}
    named = rows.select(F.col("node").alias("row"), F.when(k % 9 != 4, F.col("code")).alias("code"), F.when(k % 9 == 4, F.concat(F.lit("客户："), k)).otherwise(F.col("name")).alias("name"), F.when(k % 9 == 4, k % 3).cast("int").alias("indent"), *(v.alias(m) for m, v in amounts.items()))
    chart = spark.createDataFrame([(*c, "debit") for c in CHART], "code string, name string, active boolean, category string, direction string")
    history = rows.filter("k % 13 = 6").select("code", "name", pick(CODES, F.floor(k / 13)).alias("target"), F.lit(1).alias("used"), F.lit("2024").alias("last_used"), (k % 26 != 19).alias("active"))
    found = analyze.analyze(named, chart, history=history, ignored=rows.filter("k % 60 = 58").select("node"))
    return found.rows.select("row", "level", "parent_row", "is_leaf", "row_class", "role", "target", "reason", "requires_confirmation")


QUERIES = {f.__name__: f for f in (unified_plan, unified_plan_signals, unified_plan_summary, upload_analysis)}


def _pick(words: tuple, n: str) -> str:
    return f"[{', '.join(repr(w) for w in words)}][(({n}) % {len(words)}) + 1]"


def _has(text: str, words: tuple) -> str:
    return "(" + " OR ".join(f"contains(coalesce({text}, ''), '{w}')" for w in words) + ")"


def _opposed(pairs: tuple) -> str:
    return "(" + " OR ".join(f"({_has('name', (a,))} AND {_has('aname', (b,))}) OR ({_has('name', (b,))} AND {_has('aname', (a,))})" for a, b in pairs) + ")"


_CATEGORY = "CASE " + " ".join(f"WHEN {_has('name', words)} THEN '{c}'" for c, words in V.CATEGORY_WORDS) + " END"
_GROUPS = ", ".join(f"('{w}', '{c}')" for w, g in V.SIGNAL_WORDS.items() for c in V.SIGNAL_CODES[g])
_WORD = "CASE " + " ".join(f"WHEN contains(name, '{w}') THEN '{w}'" for w in V.SIGNAL_WORDS) + " END"
_NODES = f"""chart(code, name, active, category) AS (VALUES {", ".join(f"('{c}', '{n}', {str(a).lower()}, '{g}')" for c, n, a, g in CHART)}),
b AS (SELECT r_regionkey::BIGINT AS node, NULL::BIGINT AS parent, 1 AS level, r_regionkey::BIGINT AS k FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey, 2, n_nationkey FROM nation
  UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, 3, c_custkey FROM customer),
n AS (SELECT *, CASE WHEN k % 5 = 0 THEN {_pick(CODES, "k // 5")} ELSE '9' || k END AS code, {_pick(NAMES, "k")} AS name, level < 3 AS is_summary, k % 4 <> 0 AND k % 60 <> 58 AS participates,
  k % 50 = 49 OR k % 60 = 58 AS ignored FROM b),
kept AS (SELECT CASE WHEN k % 2 = 0 THEN code END AS code, CASE WHEN k % 39 = 6 THEN '物业成本' END AS name, {_pick(CODES, "k // 13")} AS target FROM n WHERE k % 13 = 6 AND k % 26 <> 19),
past AS (SELECT node, target, min(tier) AS tier FROM (SELECT n.node, target, 0 AS tier FROM n JOIN kept ON n.code = kept.code UNION ALL SELECT n.node, target, 1 FROM n JOIN kept ON n.name = kept.name) GROUP BY ALL),
old AS (SELECT node, list(target ORDER BY tier, target) AS by_history FROM past GROUP BY node),
grp(word, of) AS (VALUES {_GROUPS}),
sig AS (SELECT n.*, CASE WHEN NOT ignored THEN coalesce(by_history, []) ELSE [] END AS by_history, CASE WHEN NOT ignored THEN (SELECT c.code FROM chart c WHERE c.active AND c.code = n.code) END AS by_code,
  CASE WHEN NOT ignored THEN coalesce((SELECT list(c.code ORDER BY c.code) FROM chart c WHERE c.active AND c.name = n.name), []) ELSE [] END AS by_name,
  CASE WHEN NOT ignored THEN coalesce((SELECT list(c.code ORDER BY c.code) FROM chart c JOIN grp ON grp.of = c.code WHERE c.active AND grp.word = {_WORD.replace("(name", "(n.name")}), []) ELSE [] END AS by_group
  FROM n LEFT JOIN old USING (node)),
kids AS (SELECT parent AS node, count(DISTINCT {_CATEGORY}) AS cats FROM n WHERE parent IS NOT NULL GROUP BY parent),
m AS (SELECT sig.*, coalesce(by_code, by_name[1], by_history[1]) AS signal, CASE WHEN ignored THEN NULL WHEN name = '' OR name IN {V.STRUCTURAL_NAMES} THEN 'structural_summary'
  WHEN len(by_history) > 0 OR by_code IS NOT NULL OR len(by_name) > 0 OR {_has("name", V.ACCOUNT_ANCHORS)} THEN 'account_anchor_candidate'
  WHEN is_summary AND (coalesce(cats, 0) >= 2 OR NOT participates) THEN 'structural_summary' ELSE 'ordinary_detail' END AS semantic FROM sig LEFT JOIN kids USING (node))"""
_PLAN = f"""{_NODES},
g AS (SELECT m.*, own.name AS oname, own.category AS ocat, CASE WHEN k % 17 = 3 THEN CASE WHEN k % 34 = 3 THEN {_pick(CODES, "k")} ELSE 'none' END END AS said,
  CASE WHEN k % 17 = 3 THEN CASE WHEN k % 34 = 3 THEN {_pick(CODES, "k")} END WHEN k % 4 <> 1 AND NOT ignored AND semantic <> 'structural_summary' THEN {_pick(CODES, "k + 3")} END AS own, k % 17 = 3 AND k % 3 = 0 AS over,
  k % 17 <> 3 AND k % 3 = 0 AS safe FROM m LEFT JOIN chart own ON own.code = coalesce(by_code, by_name[1])),
w AS (SELECT NULL::BIGINT AS node, 0 AS level, NULL::VARCHAR AS reason, NULL::VARCHAR AS role, NULL::VARCHAR AS target, true AS opens
  UNION ALL
  SELECT node, level, reason, role, CASE WHEN role IN ('anchor', 'breakpoint', 'explicit_override') THEN own WHEN role = 'inherited' THEN inherited END, opened AND NOT ignored AND NOT (over AND role = 'unresolved')
  FROM (SELECT *, CASE WHEN ignored THEN 'ignored' WHEN NOT opened THEN 'unresolved' WHEN semantic = 'structural_summary' THEN 'structural_summary' WHEN over THEN CASE WHEN own IS NOT NULL THEN 'explicit_override' ELSE 'unresolved' END
      WHEN inherited IS NULL THEN CASE WHEN own IS NOT NULL THEN 'anchor' ELSE 'unresolved' END WHEN reason IS NULL THEN 'inherited' WHEN own IS NOT NULL THEN 'breakpoint' ELSE 'unresolved' END AS role
    FROM (SELECT x.*, CASE WHEN inherited IS NULL THEN NULL WHEN len(list_filter(by_history, lambda t: t <> inherited)) > 0 THEN 'user_history_override'
        WHEN by_code <> inherited AND name <> '' AND len(list_intersect(string_split(name, ''), string_split(oname, ''))) > 0 THEN 'exact_code_different_target'
        WHEN len(list_filter(by_name, lambda t: t <> inherited)) > 0 THEN 'exact_name_different_target' WHEN len(list_filter(by_group, lambda t: t <> inherited)) > 0 THEN 'semantic_group_different_target'
        WHEN {_has("name", V.RESERVE_TOKENS)} AND NOT {_has("aname", V.RESERVE_TOKENS)} THEN 'reserve_token_boundary'
        WHEN ({_has("name", ("资本化",))} AND NOT {_has("aname", ("资本化",))}) OR ({_has("name", ("费用化",))} AND NOT {_has("aname", ("费用化",))}) THEN 'rd_capitalization_boundary'
        WHEN {_opposed(V.DIRECTION_OPPOSITES)} AND name NOT IN {V.NEUTRAL_NAMES} THEN 'direction_boundary' WHEN {_opposed(V.PROFIT_LOSS_OPPOSITES)} THEN 'profit_loss_boundary'
        WHEN ocat <> acat THEN 'account_category_boundary' END AS reason
      FROM (SELECT g.*, w.opens AS opened, w.target AS inherited, a.name AS aname, a.category AS acat FROM w JOIN g ON g.parent IS NOT DISTINCT FROM w.node AND g.level = w.level + 1 LEFT JOIN chart a ON a.code = w.target) x))),
r AS (SELECT g.*, w.role, w.target, w.reason, p.opened FROM w JOIN g USING (node)
  LEFT JOIN (SELECT node AS parent, opens AS opened FROM w) p ON p.parent IS NOT DISTINCT FROM g.parent),
first AS (SELECT target, min(node) AS anchor FROM r WHERE role IN ('anchor', 'breakpoint', 'explicit_override') GROUP BY target),
plan AS (SELECT node, role, CASE role WHEN 'explicit_override' THEN 'override_confirmed' WHEN 'inherited' THEN 'inherited_ancestor' WHEN 'anchor' THEN CASE WHEN safe THEN 'direct_auto' ELSE 'direct_confirmed' END
    WHEN 'breakpoint' THEN CASE WHEN safe THEN 'direct_auto' ELSE 'direct_confirmed' END ELSE 'none' END AS mode, target, CASE WHEN role = 'inherited' THEN anchor END AS anchor,
  CASE WHEN role IN ('breakpoint', 'unresolved') AND opened AND NOT over THEN reason END AS reason,
  CASE role WHEN 'unresolved' THEN opened WHEN 'anchor' THEN NOT safe WHEN 'breakpoint' THEN NOT safe ELSE false END AS requires_confirmation FROM r LEFT JOIN first USING (target))"""
# Discovery as it walks down: an empty text stands for an anchor without a signal of its own.
_FOUND = f"""named AS (SELECT signal, arg_min(name, node) AS aname FROM m WHERE signal IS NOT NULL GROUP BY signal),
d AS (SELECT NULL::BIGINT AS node, 0 AS level, true AS reached, NULL::VARCHAR AS passes, NULL::VARCHAR AS found
  UNION ALL
  SELECT node, level, here, CASE WHEN NOT free OR opposed THEN NULL WHEN above IS NULL OR turned THEN coalesce(signal, '') ELSE above END,
    CASE WHEN ignored THEN 'ignored' WHEN semantic = 'structural_summary' THEN 'structural' WHEN turned OR opposed THEN 'breakpoint' WHEN (free AND above IS NULL) OR semantic = 'account_anchor_candidate' THEN 'anchor' ELSE 'inherited' END
  FROM (SELECT *, coalesce(free AND above <> '' AND signal <> above, false) AS turned, coalesce(free AND above <> '' AND signal IS NULL AND {_opposed(V.DIRECTION_OPPOSITES)}, false) AS opposed
    FROM (SELECT x.*, here AND semantic <> 'structural_summary' AS free FROM (SELECT m.*, d.reached AND NOT m.ignored AS here, d.passes AS above, named.aname
      FROM d JOIN m ON m.parent IS NOT DISTINCT FROM d.node AND m.level = d.level + 1 LEFT JOIN named ON named.signal = d.passes) x)))"""
_COUNTS = ", ".join(f"count(*) FILTER (role = '{r}') AS n_{r}" for r in ("structural_summary", "anchor", "inherited", "breakpoint", "explicit_override", "unresolved"))

ORACLES = {
    "unified_plan": f"WITH RECURSIVE {_PLAN} SELECT * FROM plan",
    "unified_plan_signals": f"""WITH RECURSIVE {_NODES}, {_FOUND}
SELECT m.node, array_to_string(by_history, ',') AS by_history, by_code, array_to_string(by_name, ',') AS by_name, array_to_string(by_group, ',') AS by_group, semantic, signal, found FROM m JOIN d USING (node)""",
    "unified_plan_summary": f"""WITH RECURSIVE {_PLAN}, {_FOUND}
SELECT * FROM (SELECT count(*) AS total_nodes, {_COUNTS}, count(*) FILTER (requires_confirmation) AS n_questions FROM plan),
  (SELECT count(*) AS n_leaves, count(*) FILTER (role IN ('anchor', 'breakpoint', 'inherited', 'explicit_override') AND target IS NOT NULL) AS n_resolved_leaves FROM plan JOIN m USING (node)
    WHERE NOT ignored AND NOT is_summary AND participates AND role <> 'structural_summary'),
  (SELECT count(*) FILTER (found IN ('anchor', 'breakpoint')) AS n_recommended FROM d WHERE node IS NOT NULL), (SELECT count(*) FILTER (NOT ignored AND semantic = 'structural_summary') AS n_headings FROM m)""",
}
