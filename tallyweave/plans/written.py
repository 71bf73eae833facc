"""What was written against what was to be written, parents of either kind, and the tree of a stored batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import balance, classification, execution, grouptree, transform
from tallyweave.plans.books import _ROWS, import_batches, transformed
from tallyweave.session import table

AMOUNTS = ["debit", "credit"]


def written(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the batches and their entries, of which keys lose, double or change some."""
    _, rows = import_batches(spark, sf_dir)
    part = F.col("l_partkey")
    rows = rows.withColumns({"row_class": F.when(part % 211 == 3, None).otherwise(F.col("row_class")), "by_direction": part % 5 == 0})
    copies = F.when(part % 101 == 0, 0).when(part % 103 == 0, 2).otherwise(1)
    made = rows.filter((F.col("row_class") == "eligible") | ((F.col("row_class") == "ignored") & (part % 109 == 0))).withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return rows, made.select("batch", F.when(part % 107 == 0, F.col("debit") + 1).otherwise(F.col("debit")).alias("debit"), "credit")


def entry_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execution.entry_reconciliation(*written(spark, sf_dir), AMOUNTS)


def written_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, entries = written(spark, sf_dir)
    key = F.col("p_partkey")
    chart = table(spark, sf_dir, "part").filter("p_partkey % 83 <> 5").select(key.alias("target"), (key % 47 != 0).alias("active"), F.when(key % 3 != 0, "debit").alias("direction"))
    return execution.written_faults(rows, entries, chart, AMOUNTS, classification.CLASSES)


def trial_balance_all_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.tree_differences(transformed(spark, sf_dir), "row", "code")


def summary_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.summary_reconciliation(transformed(spark, sf_dir), "row", "code")


def tree_with_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as accounts, customers as the client's rows (two of them above each other), orders as entries."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    chart = table(spark, sf_dir, "region").select((-1 - F.col("r_regionkey")).cast("long").alias("account"), F.lit(None).cast("long").alias("parent"), F.concat(F.lit("R"), "r_regionkey").alias("code"), F.col("r_name").alias("name"))
    chart = chart.union(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"), (-1 - F.col("n_regionkey")).cast("long"), F.concat(F.lit("N"), "n_nationkey"), F.lit("Sales")))
    rows = table(spark, sf_dir, "customer").select(k.cast("long").alias("row"), F.when(k == 7, 70).when(k >= 10, F.floor(k / 10)).cast("long").alias("parent_row"), k.cast("string").alias("code"), F.concat(F.lit("row "), k).alias("name"))
    said = F.when(o % 3 == 0, F.concat(F.lit("Sales_North-"), F.col("o_orderpriority"), F.lit("/"), o)).when(o % 3 == 1, F.concat(F.lit("West_"), o % 7, F.lit("_"), o)).otherwise(F.concat(F.lit("plain "), o))
    amount = balance.money("o_totalprice")
    entries = table(spark, sf_dir, "orders").select(
        o.cast("long").alias("entry"), F.pmod(F.col("o_custkey"), F.lit(27)).cast("long").alias("account"), F.when(o % 4 != 0, F.col("o_custkey")).cast("long").alias("row"),
        F.when(o % 13 != 0, F.concat(F.lit("8"), F.lpad(o.cast("string"), 11, "3"))).alias("code"), F.when(o % 17 != 0, said).alias("name"),
        F.when(F.col("o_orderstatus") == "F", amount).otherwise(0).cast(balance.MONEY).alias("ending_debit"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(amount).cast(balance.MONEY).alias("ending_credit"),
    )
    return grouptree.group_tree(chart, entries, rows, ["ending_debit", "ending_credit"], only_with_amounts=True)


_ALL = (entry_reconciliation, written_faults, trial_balance_all_parents, summary_reconciliation, tree_with_groups)
QUERIES = {f.__name__: f for f in _ALL}

_WRITTEN = """x AS (SELECT l_orderkey AS batch, l_partkey AS part, CASE WHEN l_partkey % 41 <> 0 THEN l_partkey END AS target, CAST(CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice END AS DECIMAL(20,2)) AS debit,
  CASE WHEN l_suppkey % 10 = 0 THEN 'ignored' WHEN l_linenumber = 7 OR (l_linenumber = 6 AND l_returnflag = 'R') OR (l_linenumber = 5 AND l_returnflag = 'A') THEN 'summary'
   WHEN l_discount = 0 OR abs(l_extendedprice) <= 0.01 THEN 'zero' ELSE 'eligible' END AS class FROM lineitem),
y AS (SELECT *, CASE WHEN part % 211 <> 3 THEN class END AS kind FROM x),
z AS (SELECT batch, CASE WHEN part % 107 = 0 THEN debit + 1 ELSE debit END AS debit, unnest(range(0, CASE WHEN part % 101 = 0 THEN 0 WHEN part % 103 = 0 THEN 2 ELSE 1 END)) AS copy FROM y WHERE kind = 'eligible' OR (kind = 'ignored' AND part % 109 = 0)),
said AS (SELECT batch, coalesce(sum(debit) FILTER (kind IN ('eligible', 'ignored')), 0) AS business, coalesce(sum(debit) FILTER (kind = 'ignored'), 0) AS ignored, coalesce(sum(debit) FILTER (kind = 'zero'), 0) AS zero FROM y GROUP BY batch),
wrote AS (SELECT batch, sum(debit) AS entries, count(*) AS n FROM z GROUP BY batch),
met AS (SELECT batch, coalesce(business, 0) AS business, coalesce(entries, 0) AS entries, coalesce(ignored, 0) AS ignored, coalesce(zero, 0) AS zero FROM said FULL JOIN wrote USING (batch)),
rec AS (SELECT batch, 'debit' AS measure, business, entries, ignored, zero, business - entries - ignored AS difference FROM met UNION ALL SELECT batch, 'credit', 0, 0, 0, 0, 0 FROM met)"""
_MEASURES = {"opening_net": "opening_debit - opening_credit", "current_debit": "current_debit", "current_credit": "current_credit", "ending_net": "ending_debit - ending_credit"}
_EDGES = f"""{_ROWS}, by_code AS (SELECT code AS parent_key, min(row) AS coded FROM o WHERE code IS NOT NULL GROUP BY code),
ed AS (SELECT row, CASE WHEN coded IS NOT NULL THEN coded WHEN level_source = 'indent_suggested' THEN TRY_CAST(parent_key AS BIGINT) END AS up FROM t LEFT JOIN by_code USING (parent_key) WHERE parent_key IS NOT NULL),
eg AS (SELECT * FROM ed WHERE up IS NOT NULL AND up <> row)"""


def _differences() -> str:
    one = "SELECT row, '{m}' AS measure, CAST({m} AS DECIMAL(30,2)) AS parent_amount, CAST(l_{m} AS DECIMAL(30,2)) AS leaf_amount, CAST({m} - l_{m} AS DECIMAL(30,2)) AS difference FROM d WHERE abs({m} - l_{m}) > 0.01"
    return f"""WITH RECURSIVE {_EDGES}, cl AS (SELECT row, up FROM eg UNION ALL SELECT cl.row, eg.up FROM cl JOIN eg ON eg.row = cl.up),
v AS (SELECT row, is_leaf, {", ".join(f"{e} AS {m}" for m, e in _MEASURES.items())} FROM t),
l AS (SELECT cl.up AS row, {", ".join(f"sum({m}) AS l_{m}" for m in _MEASURES)} FROM cl JOIN v USING (row) WHERE is_leaf GROUP BY cl.up), d AS (SELECT * FROM v JOIN l USING (row))
""" + " UNION ALL ".join(one.format(m=m) for m in _MEASURES)


_MISSES = " + ".join(f"(abs({m} - s_{m}) > 0.01)::INT" for m in transform.MEASURES)
_CG = "'client_group:' || g.account || ':' || g.row"
_TREE = r"""WITH RECURSIVE a AS (SELECT (-1 - r_regionkey)::BIGINT AS account, NULL::BIGINT AS parent, 'R' || r_regionkey AS code, r_name AS name FROM region UNION ALL SELECT n_nationkey, -1 - n_regionkey, 'N' || n_nationkey, 'Sales' FROM nation),
w AS (SELECT c_custkey::BIGINT AS row, CASE WHEN c_custkey = 7 THEN 70 WHEN c_custkey >= 10 THEN c_custkey // 10 END::BIGINT AS up, c_custkey::VARCHAR AS code, 'row ' || c_custkey AS name FROM customer),
p AS (SELECT w.row, b.row AS up FROM w JOIN w b ON b.row = w.up AND b.row <> w.row),
cl AS (SELECT row, row AS anc, [row] AS seen FROM w UNION ALL SELECT cl.row, p.up, list_append(seen, p.up) FROM cl JOIN p ON p.row = cl.anc WHERE NOT list_contains(seen, p.up)),
e0 AS (SELECT o_orderkey::BIGINT AS entry, (o_custkey % 27)::BIGINT AS account, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END::BIGINT AS row, CASE WHEN o_orderkey % 13 <> 0 THEN '8' || lpad(o_orderkey::VARCHAR, 11, '3') END AS code,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'Sales_North-' || o_orderpriority || '/' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'West_' || (o_orderkey % 7) || '_' || o_orderkey ELSE 'plain ' || o_orderkey END AS name,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(20,2)) ELSE 0 END AS dr, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE CAST(o_totalprice AS DECIMAL(20,2)) END AS cr FROM orders),
e1 AS (SELECT e0.*, a.code AS acode, a.name AS aname, p.up AS above, list_filter(regexp_split_to_array(e0.name, '[_\-/\\]'), lambda s: trim(s) <> '') AS parts FROM e0 JOIN a USING (account) LEFT JOIN p ON p.row = e0.row),
e AS (SELECT *, CASE WHEN above IS NOT NULL OR code IS NULL OR name IS NULL OR len(parts) <= 1 THEN [] WHEN parts[1] = aname THEN parts[2:len(parts) - 1] ELSE parts[1:len(parts) - 1] END AS path FROM e1),
own AS (SELECT account, row, sum(dr) AS dr, sum(cr) AS cr, count(*) AS n FROM e WHERE row IS NOT NULL GROUP BY account, row),
grp AS (SELECT DISTINCT e.account, cl.anc AS row FROM e JOIN cl ON cl.row = e.row AND cl.anc <> cl.row WHERE above IS NOT NULL),
gs AS (SELECT g.account, g.row, sum(dr) AS dr, sum(cr) AS cr, sum(n) AS n FROM grp g JOIN cl ON cl.anc = g.row JOIN own ON own.account = g.account AND own.row = cl.row GROUP BY g.account, g.row),
sy AS (SELECT account, dr, cr, name, substr(code, 1, least(12, 4 + 2 * i)::INT) AS gcode, array_to_string(path[1:i], '_') AS gname, CASE WHEN i > 1 THEN substr(code, 1, least(12, 2 + 2 * i)::INT) END AS outer_code
  FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM e)),
sg AS (SELECT account, gcode, sum(dr) AS dr, sum(cr) AS cr, count(*) AS n, min({'k': outer_code IS NOT NULL, 'n': gname, 'o': outer_code}) AS f FROM sy GROUP BY account, gcode),
ac AS (SELECT account, account AS anc FROM a UNION ALL SELECT ac.account, a.parent FROM ac JOIN a ON a.account = ac.anc WHERE a.parent IS NOT NULL),
top AS (SELECT ac.anc AS account, sum(dr) AS dr, sum(cr) AS cr, count(*) AS n FROM ac JOIN e USING (account) GROUP BY ac.anc),
nodes AS (
  SELECT 'account:' || account AS node_id, 'account' AS node_type, 'account:' || parent AS parent_id, account, a.code, a.name, dr, cr, n FROM a JOIN top USING (account)
  UNION ALL SELECT 'client_group:' || g.account || ':' || g.row, 'client_group', CASE WHEN p.up IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.row = p.up AND cl.anc = g.row) THEN 'client_group:' || g.account || ':' || p.up ELSE 'account:' || g.account END,
    g.account, w.code, w.name, g.dr, g.cr, g.n FROM gs g JOIN w ON w.row = g.row LEFT JOIN p ON p.row = g.row
  UNION ALL SELECT 'synth:' || account || ':' || gcode, 'client_group', CASE WHEN f.o <> gcode THEN 'synth:' || account || ':' || f.o ELSE 'account:' || account END, account, gcode, f.n, dr, cr, n FROM sg
  UNION ALL SELECT 'entry:' || entry, 'entry', CASE WHEN above IS NOT NULL THEN 'client_group:' || account || ':' || above WHEN len(path) > 0 THEN 'synth:' || account || ':' || substr(code, 1, least(12, 4 + 2 * len(path))::INT) ELSE 'account:' || account END,
    account, coalesce(code, acode), coalesce(CASE WHEN above IS NOT NULL OR len(path) > 0 THEN parts[len(parts)] ELSE name END, CASE WHEN above IS NOT NULL OR len(path) > 0 THEN '' ELSE aname END), dr, cr, 1 FROM e)
SELECT node_id, node_type, parent_id, account::VARCHAR AS account, code, name, CAST(dr AS DECIMAL(30,2)) AS ending_debit, CAST(cr AS DECIMAL(30,2)) AS ending_credit, n::BIGINT AS entry_count FROM nodes"""
ORACLES = {
    "entry_reconciliation": f"""WITH {_WRITTEN} SELECT batch, measure, {", ".join(f"CAST({c} AS DECIMAL(30,2)) AS {c}" for c in ("business", "entries", "ignored", "zero", "difference"))}, abs(difference) <= 0.01 AS reconciled FROM rec""",
    "written_faults": f"""WITH {_WRITTEN}, c AS (SELECT p_partkey AS target, p_partkey % 47 <> 0 AS active, p_partkey % 3 <> 0 AS sided FROM part WHERE p_partkey % 83 <> 5),
n AS (SELECT batch, count(*) FILTER (kind = 'eligible' AND y.target IS NOT NULL AND NOT coalesce(active, false)) AS target, count(*) FILTER (kind = 'eligible' AND y.target IS NOT NULL AND active IS NOT NULL AND part % 5 = 0 AND NOT sided) AS direction,
  count(*) FILTER (kind IS NULL) AS identity, count(*) FILTER (kind = 'eligible') AS eligible FROM y LEFT JOIN c USING (target) GROUP BY batch),
m AS (SELECT batch, coalesce(target, 0) AS target, coalesce(direction, 0) AS direction, coalesce(identity, 0) AS identity, abs(coalesce(eligible, 0) - coalesce(wrote.n, 0)) AS entries FROM n FULL JOIN wrote USING (batch))
SELECT batch, gate, n_faults::BIGINT AS n_faults FROM (UNPIVOT m ON target, direction, identity, entries INTO NAME gate VALUE n_faults) WHERE n_faults > 0
UNION ALL SELECT batch, 'reconciliation of ' || measure, 1 FROM rec WHERE abs(difference) > 0.01""",
    "trial_balance_all_parents": _differences(),
    "summary_reconciliation": f"""WITH {_EDGES}, s AS (SELECT up AS row, count(*) AS n_children, {", ".join(f"sum({m}) AS s_{m}" for m in transform.MEASURES)} FROM eg JOIN t USING (row) GROUP BY up)
SELECT row, n_children, CAST({_MISSES} AS INTEGER) AS n_mismatches, CASE WHEN {_MISSES} > 0 THEN 'summary_amount_mismatch' END AS warning FROM t JOIN s USING (row)""",
    "tree_with_groups": _TREE,
}
