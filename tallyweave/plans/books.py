"""Transforming, planning and executing an import over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import balance, execution, experience, inheritance, transform
from tallyweave.plans import mapping
from tallyweave.plans.mapping import inheritance_nodes, inheritance_plan
from tallyweave.plans.trees import classified
from tallyweave.session import table

DIRECTIONS = ("借", "credit", "平", "?")
STANDARD = ("debit", "credit", None, "up")
CONFIGS = {
    "opening": {"mode": "two_column", "debit": "opening_dr", "credit": "opening_cr"},
    "current": {"mode": "single_by_source_direction", "amount": "moved", "direction": "side"},
    "ending": {"mode": "single_by_direction", "amount": "ending"},
}
# Names that meet in the boundary rules, and what nodes of a chart are called.
NODE_NAMES = ("应收账款", "应付账款", "坏账准备", "研发支出资本化", "营业收入", "银行存款应付", "预收账款", "办公费", "合计", "")
TARGET_NAMES = ("应付账款", "应收账款", "营业成本", "研发费用", "预付账款", "坏账准备", "应收资本化")
FIELDS = ("account_code", "account_name", "debit_amount")


def pick(words: tuple, n: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), F.pmod(n, F.lit(len(words))).cast("int"))


def uploaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as an upload: a sheet a customer, codes or indents, and amounts in three layouts."""
    key, price = F.col("o_orderkey"), balance.money("o_totalprice")
    text = price.cast("string")
    moved = F.when(key % 10 == 0, " ").when(key % 13 == 0, "n/a").when(key % 7 == 0, F.concat(F.lit("-"), text)).otherwise(F.concat(F.lit(" "), text))
    return table(spark, sf_dir, "orders").select(
        key.alias("row"), F.when(key % 6 != 0, key.cast("string")).alias("code"), F.col("o_custkey").alias("sheet"), F.when(key % 4 != 0, key % 3).alias("indent"),
        F.when(F.col("o_orderstatus") == "F", text).alias("opening_dr"), F.when(F.col("o_orderstatus") != "F", text).alias("opening_cr"),
        moved.alias("moved"), pick(DIRECTIONS, F.col("o_custkey")).alias("side"), text.alias("ending"), pick(STANDARD, key).alias("standard"),
    )


def transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.transform_rows(uploaded(spark, sf_dir), "row", "code", CONFIGS, "standard", "sheet", "indent")


def trial_balance_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transformed(spark, sf_dir)
    return rows.select("row", "level", "parent_key", "is_leaf", "level_source", *transform.MEASURES, F.size("warnings").alias("n_warnings"), F.size("errors").alias("n_errors"))


def trial_balance_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.parent_differences(transformed(spark, sf_dir), "row", "code")


def import_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``orders`` as batches, and the classified lines as their rows."""
    key = F.col("o_orderkey")
    batches = table(spark, sf_dir, "orders").select(
        key.alias("batch"), F.when(key % 9 == 0, "imported").otherwise(pick(execution.OPEN_STATES, key)).alias("state"), F.year("o_orderdate").alias("fiscal_year"),
        F.when(key % 11 != 0, F.month("o_orderdate")).alias("period"), (key % 2 == 0).alias("confirmed"),
    )
    part = F.col("l_partkey")
    rows = classified(spark, sf_dir).select(
        F.col("l_orderkey").alias("batch"), "row_class", F.when(part % 41 != 0, part).alias("target"), F.when(part % 97 == 0, 1).otherwise(0).alias("n_errors"),
        F.when(part % 53 == 0, 1).otherwise(0).alias("n_warnings"), "debit", "credit", part.alias("l_partkey"), "l_linenumber",
    )
    return batches, rows


def import_gate_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execution.gate_faults(*import_batches(spark, sf_dir), ["debit", "credit"])


def import_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches, rows = import_batches(spark, sf_dir)
    found = execution.entries(rows, execution.gate_faults(batches, rows, ["debit", "credit"]))
    return found.select("batch", "l_linenumber", "target", F.col("debit").cast("decimal(30,2)").alias("debit"))


def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches, rows = import_batches(spark, sf_dir)
    return execution.outcomes(batches, rows, execution.gate_faults(batches, rows, ["debit", "credit"]))


def confirm_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches, rows = import_batches(spark, sf_dir)
    status = F.when(F.col("row_class") == "ignored", "ignored").when(F.col("target").isNotNull(), "mapped").otherwise("unmapped")
    met = rows.withColumn("mapping_status", status).join(batches.select("batch", "confirmed"), "batch")
    return execution.confirm_statistics(met.withColumn("warned", (F.col("n_warnings") > 0) & ~F.col("confirmed")), ["batch"])


def journal_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 5 != 0, F.year("o_orderdate")).alias("year"), F.when(key % 3 != 0, F.when(key % 7 == 0, " ").otherwise("p")).alias("period"))
    return execution.journal_split(rows, [F.col("year"), F.col("period")], ["fiscal_year", "period"]).select("o_orderkey", "missing")


def signal_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geography tree with names, roles and signals."""
    n = F.coalesce(F.substring("node", 2, 12).cast("long"), F.lit(0))
    rows = inheritance_nodes(spark, sf_dir)
    signal = F.when(n % 3 == 0, F.concat(F.lit("T"), n % 4))
    role = F.when(F.col("structural"), "structural_summary").when(n % 8 == 5, "account_anchor_candidate").otherwise("ordinary_detail")
    return rows.select("node", "parent", "level", pick(NODE_NAMES, n).alias("name"), "ignored", role.alias("role"), signal.alias("signal"))


def anchor_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inheritance.discover_anchors(signal_nodes(spark, sf_dir), keep=lambda df: df)


def plan_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inheritance_nodes(spark, sf_dir).select("node", "ignored", (F.col("level") < 3).alias("is_summary"), (F.substring("node", 2, 12).cast("long") % 4 != 0).alias("participates"))
    return inheritance.plan_leaves(inheritance_plan(spark, sf_dir), rows)


def boundary_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys pick a name, a target and where the node's own signal comes from."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", pick(NODE_NAMES, key).alias("name"), pick(TARGET_NAMES, F.floor(key / 3)).alias("target_name"), F.when(key % 19 != 0, F.concat(F.lit("T"), F.col("o_custkey") % 3)).alias("target"),
        F.when(key % 5 != 0, F.concat(F.lit("T"), key % 3)).alias("own_target"), pick(("history", "code", "name", "group", None), F.floor(key / 7)).alias("own_kind"),
        pick(("应付", "费", "收入"), F.floor(key / 2)).alias("own_name"), pick(("asset", "liability"), key).alias("own_category"), pick(("asset", "liability", "asset"), key).alias("category"),
    )
    reason = inheritance.boundary(*map(F.col, ("name", "own_target", "own_kind", "own_name", "own_category", "target", "target_name", "category")))
    return rows.select("o_orderkey", reason.alias("reason"))


def node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    code, name = F.when(key % 3 != 0, key.cast("string")), F.when(key % 4 != 0, pick(NODE_NAMES, key))
    return table(spark, sf_dir, "orders").select("o_orderkey", inheritance.node_type(code, name, key % 5 == 0).alias("node_type"))


def field_experience_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders")
    held = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("lookup_key"), pick(FIELDS, F.col("c_custkey")).alias("target_field"), F.lit(3).alias("use_count"), F.lit(2).alias("success_count"), F.lit(1).alias("conflict_count"), (F.col("c_custkey") % 7 != 0).alias("active"))
    target = pick((*FIELDS, "ignore", "", "no_field"), key)
    confirmed = orders.select((cust + 5).cast("string").alias("lookup_key"), F.when(key % 6 != 0, "h").alias("header"), target.alias("target_field"), pick(("user_confirmed", "auto", "user_corrected"), F.floor(key / 2)).alias("confirmation"))
    return experience.upsert_field_experience(held, confirmed.filter(cust % 3 != 0), list(FIELDS))


_ALL = (
    trial_balance_transform, trial_balance_parents, import_gate_faults, import_entries, import_outcomes, confirm_statistics, journal_required,
    anchor_discovery, plan_validation, boundary_rules, node_types, field_experience_upsert,
)
QUERIES = {f.__name__: f for f in _ALL}


def _pick(words: tuple, n: str) -> str:
    listed = ", ".join("NULL" if w is None else f"'{w}'" for w in words)
    return f"[{listed}][(({n}) % {len(words)}) + 1]"


def _has(text: str, *words: str) -> str:
    return "(" + " OR ".join(f"coalesce({text}, '') LIKE '%{w}%'" for w in words) + ")"


_ROWS = f"""o AS (SELECT o_orderkey AS row, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey::VARCHAR END AS code, o_custkey AS sheet, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 3 END AS indent,
  CAST(o_totalprice AS DECIMAL(20,2)) AS p, o_orderstatus = 'F' AS f, {_pick(DIRECTIONS, "o_custkey")} AS side, {_pick(STANDARD, "o_orderkey")} AS std,
  CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 13 = 0 THEN 0 WHEN o_orderkey % 7 = 0 THEN -CAST(o_totalprice AS DECIMAL(20,2)) ELSE CAST(o_totalprice AS DECIMAL(20,2)) END AS m FROM orders),
e AS (SELECT row, code, unnest(range(1, length(code))) AS n FROM o WHERE code IS NOT NULL),
up AS (SELECT e.row, b.code AS anc FROM e JOIN o b ON b.code = substr(e.code, 1, e.n::INT)),
pa AS (SELECT row, arg_max(anc, length(anc)) AS parent, count(*) AS n FROM up GROUP BY row),
ip AS (SELECT a.row, a.indent, (SELECT max(b.row) FROM o b WHERE b.sheet = a.sheet AND b.row < a.row AND b.indent < a.indent) AS prow FROM o a WHERE a.indent IS NOT NULL AND a.code IS NULL),
ih AS (SELECT a.row, a.prow, 1 + (a.prow IS NOT NULL)::INT + (SELECT count(*) FROM o q WHERE q.row = a.prow AND EXISTS (SELECT 1 FROM o z WHERE z.sheet = q.sheet AND z.row < q.row AND z.indent < q.indent)) AS level FROM ip a),
lf AS (SELECT row, coalesce(lead(indent) OVER (PARTITION BY sheet ORDER BY row) <= indent, true) AS leaf FROM o),
t AS (SELECT o.*, CASE WHEN o.code IS NOT NULL THEN coalesce(pa.n, 0) + 1 WHEN o.indent IS NOT NULL THEN ih.level ELSE 1 END AS level,
  CASE WHEN o.code IS NOT NULL THEN pa.parent WHEN o.indent IS NOT NULL THEN ih.prow::VARCHAR END AS parent_key,
  CASE WHEN o.code IS NOT NULL THEN o.code NOT IN (SELECT anc FROM up) WHEN o.indent IS NOT NULL THEN lf.leaf ELSE true END AS is_leaf,
  CASE WHEN o.code IS NOT NULL THEN 'code_prefix' WHEN o.indent IS NOT NULL THEN 'indent_suggested' ELSE 'flat' END AS level_source,
  CASE WHEN f THEN p ELSE 0 END AS opening_debit, CASE WHEN f THEN 0 ELSE p END AS opening_credit,
  CASE side WHEN '借' THEN greatest(m, 0) WHEN 'credit' THEN greatest(-m, 0) WHEN '平' THEN m ELSE 0 END AS current_debit, CASE side WHEN '借' THEN greatest(-m, 0) WHEN 'credit' THEN greatest(m, 0) ELSE 0 END AS current_credit,
  CASE std WHEN 'debit' THEN p ELSE 0 END AS ending_debit, CASE std WHEN 'credit' THEN p ELSE 0 END AS ending_credit,
  (CASE WHEN o.row % 10 = 0 THEN 0 WHEN o.row % 13 = 0 OR side = '平' THEN 1 ELSE 0 END) AS n_warnings, (CASE WHEN m <> 0 AND side = '?' THEN 1 ELSE 0 END) + (CASE WHEN std IS NULL OR std = 'up' THEN 1 ELSE 0 END) AS n_errors
  FROM o LEFT JOIN pa USING (row) LEFT JOIN ih USING (row) JOIN lf USING (row))"""
_BATCH = """b AS (SELECT o_orderkey AS batch, o_orderkey % 9 = 0 AS shut, o_orderkey % 11 = 0 AS no_period, o_orderkey % 2 = 0 AS confirmed FROM orders),
r AS (SELECT l_orderkey AS batch, l_linenumber, CASE WHEN l_partkey % 41 <> 0 THEN l_partkey END AS target, l_partkey % 97 = 0 AS err, l_partkey % 53 = 0 AS warn, CAST(CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice END AS DECIMAL(20,2)) AS debit,
  CASE WHEN l_suppkey % 10 = 0 THEN 'ignored' WHEN l_linenumber = 7 OR (l_linenumber = 6 AND l_returnflag = 'R') OR (l_linenumber = 5 AND l_returnflag = 'A') THEN 'summary'
   WHEN l_discount = 0 OR abs(l_extendedprice) <= 0.01 THEN 'zero' ELSE 'eligible' END AS kind FROM lineitem),
s AS (SELECT batch, count(*) FILTER (err) AS errors, count(*) FILTER (warn) AS warnings, count(*) FILTER (kind = 'eligible' AND target IS NULL) AS unresolved, count(*) FILTER (kind = 'eligible' AND target IS NOT NULL) AS entries,
  coalesce(sum(debit) FILTER (kind = 'eligible' AND target IS NULL), 0) AS gap FROM r GROUP BY batch),
g AS (SELECT b.*, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(unresolved, 0) AS unresolved, coalesce(entries, 0) AS entries, coalesce(gap, 0) AS gap FROM b LEFT JOIN s USING (batch)),
f AS (SELECT batch, 'state' AS gate, 1::BIGINT AS n_faults FROM g WHERE shut UNION ALL SELECT batch, 'period', 1 FROM g WHERE no_period UNION ALL SELECT batch, 'errors', errors FROM g WHERE errors > 0
  UNION ALL SELECT batch, 'warnings', warnings FROM g WHERE warnings > 0 AND NOT confirmed UNION ALL SELECT batch, 'unresolved', unresolved FROM g WHERE unresolved > 0
  UNION ALL SELECT batch, 'empty', 1 FROM g WHERE entries = 0 UNION ALL SELECT batch, 'reconciliation of debit', 1 FROM g WHERE abs(gap) > 0.01)"""
_TREE = f"""n AS (SELECT *, {_pick(NODE_NAMES, "k")} AS name, CASE WHEN k % 3 = 0 THEN 'T' || (k % 4) END AS signal, k % 8 = 5 AS candidate FROM (
  SELECT 'R' || r_regionkey AS node, NULL::VARCHAR AS parent, 1 AS level, r_regionkey AS k, false AS ignored, r_regionkey = 4 AS structural FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 2, n_nationkey, n_nationkey % 9 = 8, n_nationkey % 7 = 3 FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 3, c_custkey, c_custkey % 50 = 49, false FROM customer)),
tn AS (SELECT signal AS above, arg_min(name, node) AS target_name FROM n WHERE signal IS NOT NULL GROUP BY signal)"""
_OPPOSED = " OR ".join(f"({_has('name', a)} AND {_has('target_name', b)})" for a, b in (("应收", "应付"), ("应付", "应收"), ("预付", "预收"), ("预收", "预付"), ("预付", "合同负债"), ("合同负债", "预付")))


def _walk(k: int) -> str:
    above = "SELECT *, true AS open, NULL::VARCHAR AS above FROM n WHERE level = 1" if k == 1 else f"SELECT n.*, a.reached AS open, a.passes AS above FROM n JOIN w{k - 1} a ON a.node = n.parent WHERE n.level = {k}"
    return f"""a{k} AS ({above}), c{k} AS (SELECT x.*, target_name, open AND NOT ignored AS reached, open AND NOT ignored AND NOT structural AS free FROM a{k} x LEFT JOIN tn USING (above)),
d{k} AS (SELECT *, free AND above IS NULL AS first, free AND coalesce(above, '') <> '' AND signal IS NOT NULL AND signal <> above AS turned, free AND coalesce(above, '') <> '' AND signal IS NULL AND ({_OPPOSED}) AS opposed FROM c{k}),
w{k} AS (SELECT node, reached, CASE WHEN NOT free OR opposed THEN NULL WHEN first OR turned THEN coalesce(signal, '') ELSE above END AS passes,
  CASE WHEN ignored THEN 'ignored' WHEN structural THEN 'structural' WHEN turned OR opposed THEN 'breakpoint' WHEN first OR candidate THEN 'anchor' ELSE 'inherited' END AS found FROM d{k})"""


def _differences() -> str:
    measures = {"opening_net": "opening_debit - opening_credit", "current_debit": "current_debit", "current_credit": "current_credit", "ending_net": "ending_debit - ending_credit"}
    one = "SELECT row, '{m}' AS measure, CAST({m} AS DECIMAL(30,2)) AS parent_amount, CAST(l_{m} AS DECIMAL(30,2)) AS leaf_amount, CAST({m} - l_{m} AS DECIMAL(30,2)) AS difference FROM d WHERE abs({m} - l_{m}) > 0.01"
    return f"""WITH {_ROWS}, v AS (SELECT row, code, is_leaf, {", ".join(f"{e} AS {m}" for m, e in measures.items())} FROM t),
l AS (SELECT up.anc AS code, {", ".join(f"sum({m}) AS l_{m}" for m in measures)} FROM up JOIN v USING (row) WHERE is_leaf GROUP BY up.anc), d AS (SELECT * FROM v JOIN l USING (code))
""" + " UNION ALL ".join(one.format(m=m) for m in measures)


ORACLES = {
    "trial_balance_transform": f"WITH {_ROWS} SELECT row, CAST(level AS INTEGER) AS level, parent_key, is_leaf, level_source, " + ", ".join(f"CAST({m} AS DECIMAL(20,2)) AS {m}" for m in transform.MEASURES) + ", CAST(n_warnings AS INTEGER) AS n_warnings, CAST(n_errors AS INTEGER) AS n_errors FROM t",
    "trial_balance_parents": _differences(),
    "import_gate_faults": f"WITH {_BATCH} SELECT * FROM f",
    "import_entries": f"WITH {_BATCH} SELECT batch, l_linenumber, target, CAST(debit AS DECIMAL(30,2)) AS debit FROM r WHERE kind = 'eligible' AND target IS NOT NULL AND batch NOT IN (SELECT batch FROM f)",
    "import_outcomes": f"""WITH {_BATCH}, q AS (SELECT batch, count(*) AS n FROM f GROUP BY batch)
SELECT batch, CASE WHEN q.n IS NULL THEN 'imported' ELSE 'blocked' END AS outcome, coalesce(q.n, 0)::BIGINT AS n_gates, CASE WHEN q.n IS NULL THEN entries ELSE 0 END::BIGINT AS n_entries FROM g LEFT JOIN q USING (batch)""",
    "confirm_statistics": f"""WITH {_BATCH}, z AS (SELECT batch, count(*) AS total, count(*) FILTER (kind <> 'ignored' AND target IS NOT NULL) AS mapped, count(*) FILTER (kind = 'ignored') AS ignored,
  count(*) FILTER (kind <> 'ignored' AND target IS NULL) AS unmapped, count(*) FILTER (kind <> 'ignored' AND target IS NULL) AS unresolved, count(*) FILTER (err) AS errors, count(*) FILTER (warn AND NOT confirmed) AS open_warnings
  FROM r JOIN b USING (batch) GROUP BY batch)
SELECT *, unresolved = 0 AND errors = 0 AS can_confirm, unresolved = 0 AND errors = 0 AND open_warnings = 0 AS can_execute FROM z""",
    "journal_required": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 7 = 0) THEN 'fiscal_year,period' WHEN o_orderkey % 5 = 0 THEN 'fiscal_year' WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN 'period' ELSE '' END AS missing FROM orders",
    "anchor_discovery": f"WITH {_TREE}, {_walk(1)}, {_walk(2)}, {_walk(3)} SELECT node, found FROM w1 UNION ALL SELECT node, found FROM w2 UNION ALL SELECT node, found FROM w3",
    "plan_validation": f"""WITH p AS ({mapping.ORACLES["inheritance_plan"]}), m AS (SELECT 'C' || c_custkey AS node FROM customer WHERE c_custkey % 50 <> 49 AND c_custkey % 4 <> 0),
q AS (SELECT node, target, role IN ('anchor', 'breakpoint', 'inherited', 'explicit_override') AND target IS NOT NULL AS resolved FROM p JOIN m USING (node) WHERE role <> 'structural_summary')
SELECT node, CASE WHEN resolved THEN target END AS target, resolved FROM q""",
    "boundary_rules": f"""WITH x AS (SELECT o_orderkey, {_pick(NODE_NAMES, "o_orderkey")} AS name, {_pick(TARGET_NAMES, "o_orderkey // 3")} AS target_name, CASE WHEN o_orderkey % 19 <> 0 THEN 'T' || (o_custkey % 3) END AS target,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'T' || (o_orderkey % 3) END AS own, {_pick(("history", "code", "name", "group", None), "o_orderkey // 7")} AS kind, {_pick(("应付", "费", "收入"), "o_orderkey // 2")} AS own_name,
  {_pick(("asset", "liability"), "o_orderkey")} AS own_category, {_pick(("asset", "liability", "asset"), "o_orderkey")} AS category FROM orders),
y AS (SELECT *, coalesce(own <> target, false) AS differs, len(list_intersect(string_split(name, ''), string_split(own_name, ''))) > 0 AS shares FROM x)
SELECT o_orderkey, CASE WHEN target IS NULL THEN NULL WHEN differs AND kind = 'history' THEN 'user_history_override' WHEN differs AND kind = 'code' AND shares THEN 'exact_code_different_target' WHEN differs AND kind = 'name' THEN 'exact_name_different_target'
  WHEN differs AND kind = 'group' THEN 'semantic_group_different_target' WHEN {_has("name", "坏账准备")} AND NOT {_has("target_name", "坏账准备")} THEN 'reserve_token_boundary'
  WHEN {_has("name", "资本化")} AND NOT {_has("target_name", "资本化")} THEN 'rd_capitalization_boundary' WHEN {_OPPOSED} THEN 'direction_boundary'
  WHEN {_has("name", "收入")} AND {_has("target_name", "成本", "费用")} THEN 'profit_loss_boundary' WHEN kind IN ('code', 'name') AND own_category <> category THEN 'account_category_boundary' END AS reason FROM y""",
    "node_types": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND (o_orderkey % 4 = 0 OR {_pick(NODE_NAMES, "o_orderkey")} = '' OR o_orderkey % 5 = 0) THEN 'summary' WHEN o_orderkey % 3 = 0 THEN 'auxiliary' ELSE 'account' END AS node_type FROM orders""",
    "field_experience_upsert": f"""WITH h AS (SELECT c_custkey::VARCHAR AS lookup_key, {_pick(FIELDS, "c_custkey")} AS target_field, c_custkey % 7 <> 0 AS active FROM customer),
c AS (SELECT (o_custkey + 5)::VARCHAR AS lookup_key, min({_pick((*FIELDS, "ignore", "", "no_field"), "o_orderkey")}) AS new FROM orders
  WHERE o_custkey % 3 <> 0 AND o_orderkey % 6 < 3 AND o_orderkey % 6 <> 0 AND (o_orderkey // 2) % 3 <> 1 GROUP BY 1),
j AS (SELECT coalesce(h.lookup_key, c.lookup_key) AS lookup_key, target_field AS old, new, CASE WHEN new IS NULL THEN 'unchanged' WHEN target_field IS NULL THEN 'created' WHEN target_field = new THEN 'reused' ELSE 'replaced' END AS action
  FROM (SELECT * FROM h WHERE active) h FULL JOIN c ON h.lookup_key = c.lookup_key)
SELECT lookup_key, old AS target_field, CASE action WHEN 'unchanged' THEN 3 ELSE 4 END::BIGINT AS use_count, CASE action WHEN 'reused' THEN 3 ELSE 2 END::BIGINT AS success_count, CASE action WHEN 'replaced' THEN 2 ELSE 1 END::BIGINT AS conflict_count,
  action <> 'replaced' AS active, CASE action WHEN 'replaced' THEN 'retired' ELSE action END AS action FROM j WHERE action <> 'created'
UNION ALL SELECT lookup_key, new, 1, 1, 0, true, action FROM j WHERE action IN ('created', 'replaced')
UNION ALL SELECT lookup_key, target_field, 3, 2, 1, false, 'unchanged' FROM h WHERE NOT active""",
}
