"""Matching, ranking, inheritance and experience over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import keys, names
from tallyweave.operators import audit, experience, hierarchy, inheritance, matching, nodes, recommend
from tallyweave.session import table


def chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words and names of parts as a chart of accounts."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    return words.select(F.concat(F.lit("W"), F.substring(F.md5("name"), 1, 6)).alias("code"), "name", (F.length("name") % 5 != 0).alias("active"))


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("client"), F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"))


def normalized_code_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    left = customers.select(F.col("c_custkey").alias("client"), F.concat(F.lit(" "), F.substring("c_name", 10, 9), F.lit(".0")).alias("code"))
    accounts = customers.filter("c_custkey % 3 = 0").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("code"), (F.col("c_custkey") % 2 == 0).alias("active"))
    return matching.code_matches(left, accounts)


def name_exact_prefix_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.name_matches(clients(spark, sf_dir), chart(spark, sf_dir))


def name_similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.similar_names(clients(spark, sf_dir), chart(spark, sf_dir))


def name_distance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance between distinct part names and chart words of equal first letter."""
    left = table(spark, sf_dir, "part").select("p_name", F.substring("p_name", 1, 1).alias("letter")).distinct()
    right = chart(spark, sf_dir).select("name", F.substring("name", 1, 1).alias("letter"))
    found = left.join(right, "letter").withColumn("distance", F.levenshtein("p_name", "name"))
    return matching.ranked(found, ["p_name"], [F.col("distance"), F.col("name")], 3).select("p_name", "name", "distance", "rank")


def name_distance_all_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance between distinct part names and all chart words."""
    found = matching.nearest_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), chart(spark, sf_dir))
    return found.select(F.col("name").alias("p_name"), F.col("standard").alias("name"), "distance", "rank")


def longest_code_prefix_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("code"))
    accounts = orders.filter("o_orderkey % 7 = 0").select(F.col("code").alias("account"))
    found = hierarchy.longest_prefix_match(orders, "o_orderkey", "code", accounts, "account", least=1)
    return found.select("o_orderkey", F.col("prefix").alias("account"), "rank")


#: Part names and types in the words of a ledger, so that the Chinese vocabulary is exercised.
CLIENT_WORDS = ("预付账款", "备用金", "研发支出_费用化支出", "固定资产_房屋", "累计折旧", "主营业务收入", "其他", "应付账款_甲公司", "无形资产减值准备", "周转材料__包装物")
ACCOUNT_NAMES = (("112401", "预付款项"), ("122101", "其他应收款"), ("170402", "研发支出-费用化支出"), ("170401", "研发支出-资本化支出"), ("160101", "固定资产-原值"), ("1602", "减：固定资产-累计折旧"), ("6001", "主营业务收入"), ("2202", "应付账款"), ("1703", "减：无形资产-减值准备"), ("141101", "包装物"))


def _said(key: str, words: tuple[str, ...]):
    return F.get(F.array(*map(F.lit, words)), (F.col(key) % len(words)).cast("int"))


def ledger_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("client"), _said("p_partkey", CLIENT_WORDS).alias("name"), F.col("p_size"))


def ledger_chart(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n, True) for c, n in ACCOUNT_NAMES], "code string, name string, active boolean")


def semantic_alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.alias_matches(ledger_clients(spark, sf_dir), ledger_chart(spark))


def compatibility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger_clients(spark, sf_dir).withColumns({"standard": _said("p_size", tuple(n for _, n in ACCOUNT_NAMES)), "target": _said("p_size", tuple(c for c, _ in ACCOUNT_NAMES))})
    pairs = matching.with_standard_facts(matching.with_name_facts(rows, "name", "c"))
    return matching.with_compatibility(pairs, into="compatibility").select("client", "target", "compatibility")


#: Lines that one task makes distinct and ranks: its memory is the same whatever the table's size.
LINES_A_TASK = 100_000


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part and supplier pairs of ``lineitem`` as candidates of several sources, all of a client in one task."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    lines = lines.repartition(max(1, -(-lines.count() // LINES_A_TASK)), "l_partkey").distinct()
    both = F.col("l_partkey") + F.col("l_suppkey")
    source = F.get(F.array(*map(F.lit, ("company_history", "name_exact", "code_match", "name_similarity", "code_match_conflict"))), (both % 5).cast("int"))
    compat = F.get(F.array(*map(F.lit, ("compatible", "compatible", "unknown", "conflict"))), (F.col("l_suppkey") % 4).cast("int"))
    return lines.select(
        F.col("l_partkey").alias("client"), F.col("l_suppkey").cast("string").alias("target"), source.alias("source"),
        (F.lit(0.6) + (both % 9) / 20).cast("double").alias("score"), F.when(both % 7 == 0, "inactive").alias("warning"), (both % 3 != 0).alias("auto"), compat.alias("compatibility"),
    )


def candidate_rank_safe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.rank_candidates(candidates(spark, sf_dir)).select("client", "target", "source", "safe", "rank")


def auto_confirm_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.decide(matching.rank_candidates(candidates(spark, sf_dir))).select("client", "n_safe", "status", "confirmed")


def recommend_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger_clients(spark, sf_dir).withColumn("code", F.concat(F.lit("1602"), F.col("client").cast("string")))
    return recommend.recommend(rows.select("client", "code", "name"), ledger_chart(spark)).select("client", "target", "source", "score", "compatibility", "safe", "rank")


def inheritance_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation and customer as a tree with signals from their keys."""
    regions, nations, customers = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    no = F.lit(None).cast("string")
    flag = F.lit(False)
    top = regions.select(F.concat(F.lit("R"), "r_regionkey").alias("node"), no.alias("parent"), F.lit(1).alias("level"), flag.alias("ignored"), (F.col("r_regionkey") == 4).alias("structural"), no.alias("override"), F.concat(F.lit("T"), "r_regionkey").alias("own"), flag.alias("confirmed"))
    k = F.col("n_nationkey")
    mid = nations.select(F.concat(F.lit("N"), k), F.concat(F.lit("R"), "n_regionkey"), F.lit(2), k % 9 == 8, k % 7 == 3, F.when(k % 5 == 2, F.concat(F.lit("O"), k)), F.when(k % 3 == 0, F.concat(F.lit("T"), k)), k % 2 == 0)
    c = F.col("c_custkey")
    low = customers.select(F.concat(F.lit("C"), c), F.concat(F.lit("N"), "c_nationkey"), F.lit(3), c % 50 == 49, F.lit(False), F.when(c % 40 == 1, F.concat(F.lit("O"), c)), F.when(c % 11 == 0, F.concat(F.lit("T"), c)), F.lit(True))
    return top.union(mid).union(low)


def inheritance_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inheritance.mapping_plan(inheritance_nodes(spark, sf_dir), keep=lambda df: df)


def confirmed_descendant_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inheritance_nodes(spark, sf_dir)
    up = hierarchy.closure(rows, "node", "parent", 4)
    confirmed = rows.filter("level < 3 and confirmed or level = 1").select("node", F.concat(F.lit("T"), "node").alias("target"))
    return inheritance.propagate_confirmed(confirmed, up, rows.filter("override is not null").select("node"))


def unique_node_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.unique_nodes(keyed_parts(spark, sf_dir), "node_key", "p_partkey", ["p_brand", "p_type"])


def keyed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = keys.node_key(F.col("p_brand"), F.concat(F.lit(" "), F.col("p_name")), F.col("p_type"))
    return table(spark, sf_dir, "part").withColumn("node_key", key)


def node_compression_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.compression(keyed_parts(spark, sf_dir), "node_key")


def node_selection_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes.conflicting_targets(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")
    return found.select("l_partkey", "n_targets", F.array_join(F.transform("targets", lambda t: t.cast("string")), ",").alias("targets"))


def propagate_first_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("paid", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    filled = nodes.fill_forward(events, "user_id", ["ts", "event_id"], "paid", "last_paid")
    return nodes.first_resolved(filled, "user_id", "event_id", "paid", "first_paid").select("event_id", "last_paid", "first_paid")


def field_experience_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    known = events.select(
        F.col("event_type").alias("header"), (F.col("user_id") % 4).cast("string").alias("context"), F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 3).alias("company"),
        F.concat(F.lit("f"), F.col("user_id") % 5).alias("target_field"), F.col("value").alias("successes"), F.col("ts").alias("updated"), F.col("event_id").alias("experience_id"),
    )
    wanted = events.select(F.col("event_type").alias("header")).distinct().withColumns({"context": F.lit("3"), "column_id": F.concat(F.lit("col_"), F.col("header"))})
    return experience.best_experience(wanted, known, F.lit(1))


def context_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role")
    signature = keys.context_signature(F.lag("role").over(order), F.col("role"), F.lead("role").over(order))
    return turns.select("conv_id", "turn", "role", signature.alias("signature"))


def upsert_mapping_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    held = orders.filter("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("target"), F.lit(1).alias("uses"), F.lit(0.9).cast("double").alias("confidence"), (F.col("o_orderkey") % 10 != 0).alias("active"))
    incoming = orders.filter("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("target"), F.lit(0.95).cast("double").alias("confidence"))
    return experience.upsert_mappings(held, incoming, "o_orderkey", "target", overwrite=True)


def full_sync_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    held = parts.filter("p_partkey % 4 <> 0").select("p_partkey", "p_brand", "p_size", (F.col("p_partkey") % 6 != 1).alias("active"))
    incoming = parts.filter("p_partkey % 5 <> 0").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 7 == 0, -1).otherwise(F.col("p_size")).alias("p_size"))
    return experience.full_sync(held, incoming, "p_partkey", ["p_brand", "p_size"])


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    before = parts.filter("p_partkey % 4 <> 0").select("p_partkey", "p_size")
    after = parts.filter("p_partkey % 5 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, -1).otherwise(F.col("p_size")).alias("p_size"))
    return experience.snapshot_changes(before, after, "p_partkey", ["p_size"])


def major_mismatch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger_clients(spark, sf_dir).withColumns({"standard": _said("p_size", tuple(n for _, n in ACCOUNT_NAMES)), "target": _said("p_size", tuple(c for c, _ in ACCOUNT_NAMES))})
    found = audit.mismatches(F.lit(""), F.col("name"), F.lit(""), F.col("target"), F.col("standard"))
    return rows.select("client", "target", F.explode(found).alias("mismatch"))


def account_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 7000).cast("string").alias("code"))
    return lines.select("p_partkey", names.category_of_code(F.col("code")).alias("category"))


_ALL = (
    normalized_code_match, name_exact_prefix_rank, name_similarity_topk, name_distance_topk, name_distance_all_topk, longest_code_prefix_topk, semantic_alias_match, compatibility_rules,
    candidate_rank_safe_first, auto_confirm_status, recommend_accounts, inheritance_plan, confirmed_descendant_propagation, unique_node_dedup, node_compression_stats,
    node_selection_conflicts, propagate_first_resolved, field_experience_best, context_signature, upsert_mapping_experience, full_sync_merge, snapshot_changes,
    major_mismatch_audit, account_categories,
)
QUERIES = {f.__name__: f for f in _ALL}

_CHART = "WITH c AS (SELECT DISTINCT name FROM (SELECT unnest(string_split(p_name, ' ')) AS name FROM part)), chart AS (SELECT 'W' || substr(md5(name), 1, 6) AS code, name, length(name) % 5 <> 0 AS active FROM c)"
_CAND = """WITH l AS (SELECT DISTINCT l_partkey, l_suppkey, l_partkey + l_suppkey AS b FROM lineitem),
c AS (SELECT l_partkey AS client, l_suppkey::VARCHAR AS target, ['company_history','name_exact','code_match','name_similarity','code_match_conflict'][(b % 5 + 1)::INT] AS source,
   [0, 1, 5, 9, 12][(b % 5 + 1)::INT] AS place, 0.6::DOUBLE + (b % 9)::DOUBLE / 20 AS score, b % 7 = 0 AS warned, b % 3 <> 0 AS auto, ['compatible','compatible','unknown','conflict'][(l_suppkey % 4 + 1)::INT] AS compat FROM l),
s AS (SELECT *, NOT warned AND auto AND compat = 'compatible' AND score >= 0.9 AS safe FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY safe DESC, CASE WHEN safe OR auto THEN 0 ELSE 1 END, place,
   CASE WHEN safe THEN 0 ELSE CASE compat WHEN 'compatible' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END END, score DESC, target, source) AS rank FROM s QUALIFY rank <= 10)"""
_TREE = """n(node, parent, level, ignored, structural, override, own, confirmed) AS (
  SELECT 'R' || r_regionkey, NULL, 1, false, r_regionkey = 4, NULL, 'T' || r_regionkey, false FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 2, n_nationkey % 9 = 8, n_nationkey % 7 = 3, CASE WHEN n_nationkey % 5 = 2 THEN 'O' || n_nationkey END, CASE WHEN n_nationkey % 3 = 0 THEN 'T' || n_nationkey END, n_nationkey % 2 = 0 FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 3, c_custkey % 50 = 49, false, CASE WHEN c_custkey % 40 = 1 THEN 'O' || c_custkey END, CASE WHEN c_custkey % 11 = 0 THEN 'T' || c_custkey END, true FROM customer)"""


def _level(k: int) -> str:
    above = "SELECT *, NULL::VARCHAR AS inh FROM n WHERE level = 1" if k == 1 else f"SELECT n.*, passes AS inh FROM n LEFT JOIN l{k - 1} a ON a.node = n.parent WHERE n.level = {k}"
    return f"""i{k} AS ({above}), r{k} AS (SELECT *, CASE WHEN ignored THEN 'ignored' WHEN override IS NOT NULL THEN 'explicit_override' WHEN structural THEN 'structural_summary'
   WHEN inh IS NOT NULL AND own IS NOT NULL AND own <> inh THEN 'breakpoint' WHEN inh IS NOT NULL THEN 'inherited' WHEN own IS NOT NULL THEN 'anchor' ELSE 'unresolved' END AS role FROM i{k}),
l{k} AS (SELECT *, CASE role WHEN 'explicit_override' THEN override WHEN 'breakpoint' THEN own WHEN 'anchor' THEN own WHEN 'inherited' THEN inh END AS target, CASE WHEN ignored THEN inh WHEN role = 'explicit_override' THEN override WHEN role IN ('breakpoint', 'anchor') THEN own WHEN role = 'inherited' THEN inh END AS passes FROM r{k})"""


ORACLES = {
    "normalized_code_match": """
WITH a AS (SELECT c_custkey AS client FROM customer), b AS (SELECT lpad(c_custkey::VARCHAR, 9, '0') AS target, c_custkey AS k FROM customer WHERE c_custkey % 3 = 0)
SELECT client, target, 1 AS rank FROM a JOIN b ON client = k""",
    "name_exact_prefix_rank": f"""{_CHART},
cl AS (SELECT p_partkey AS client, replace(p_name, ' ', '') AS folded, string_split(p_name, ' ') AS parts FROM part),
h AS (SELECT client, code AS target, active, length(name) AS size, CASE WHEN folded = name THEN 'name_exact' ELSE 'name_prefix' END AS how FROM cl JOIN chart ON folded = name OR (length(name) >= 2 AND (starts_with(folded, name) OR list_contains(parts, name))))
SELECT client, target, how, row_number() OVER (PARTITION BY client, how ORDER BY size DESC, active DESC, target) AS rank FROM h QUALIFY rank <= 5""",
    "name_distance_topk": f"""{_CHART},
p AS (SELECT DISTINCT p_name FROM part), d AS (SELECT p_name, name, CAST(levenshtein(p_name, name) AS INTEGER) AS distance FROM p JOIN chart ON substr(p_name, 1, 1) = substr(name, 1, 1))
SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY distance, name) AS rank FROM d QUALIFY rank <= 3""",
    "name_distance_all_topk": f"""{_CHART},
p AS (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL), d AS (SELECT p_name, name, CAST(levenshtein(p_name, name) AS INTEGER) AS distance FROM p CROSS JOIN chart)
SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY distance, name) AS rank FROM d QUALIFY rank <= 3""",
    "longest_code_prefix_topk": """
WITH o AS (SELECT o_orderkey, o_orderkey::VARCHAR AS code FROM orders), e AS (SELECT o_orderkey, code, unnest(range(1, length(code))) AS n FROM o),
h AS (SELECT e.o_orderkey, b.code AS account FROM e JOIN o b ON b.code = substr(e.code, 1, e.n::INT) AND b.o_orderkey % 7 = 0)
SELECT o_orderkey, account, row_number() OVER (PARTITION BY o_orderkey ORDER BY length(account) DESC) AS rank FROM h QUALIFY rank <= 3""",
    "semantic_alias_match": """
SELECT p_partkey AS client, t.target, t.g AS group_key, 1 AS rank FROM part JOIN (VALUES (0, '112401', 'prepayments'), (1, '122101', 'other_receivables'), (2, '170402', 'rd_expensed_development'),
  (3, '160101', 'fixed_assets'), (4, '1602', 'accumulated_depreciation')) t(k, target, g) ON p_partkey % 10 = t.k""",
    "candidate_rank_safe_first": f"{_CAND} SELECT client, target, source, safe, rank FROM r",
    "auto_confirm_status": f"""{_CAND}
SELECT client, count(DISTINCT target) FILTER (safe) AS n_safe, CASE count(DISTINCT target) FILTER (safe) WHEN 0 THEN 'none' WHEN 1 THEN 'unique_safe' ELSE 'ambiguous' END AS status,
  CASE WHEN count(DISTINCT target) FILTER (safe) = 1 THEN arg_min(target, rank) END AS confirmed FROM r GROUP BY client""",
    "inheritance_plan": f"""WITH {_TREE}, {_level(1)}, {_level(2)}, {_level(3)}
SELECT node, role, CASE WHEN role = 'explicit_override' THEN 'override_confirmed' WHEN role = 'inherited' THEN 'inherited_ancestor' WHEN role IN ('anchor', 'breakpoint') THEN CASE WHEN confirmed THEN 'direct_confirmed' ELSE 'direct_auto' END ELSE 'none' END AS mode,
  target, CASE WHEN role = 'breakpoint' THEN 'own_target' END AS reason FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)""",
    "confirmed_descendant_propagation": f"""WITH RECURSIVE {_TREE},
t AS (SELECT node, node AS anc, 0 AS d FROM n UNION ALL SELECT t.node, n.parent, d + 1 FROM t JOIN n ON n.node = t.anc WHERE n.parent IS NOT NULL),
m AS (SELECT node AS anc, 'T' || node AS target, 1 AS o FROM n WHERE level < 3 AND confirmed OR level = 1 UNION ALL SELECT node, NULL, 0 FROM n WHERE override IS NOT NULL),
h AS (SELECT node, anc, target, o, d, row_number() OVER (PARTITION BY node ORDER BY d, o) AS k FROM t JOIN m USING (anc))
SELECT node, target, anc AS source_node FROM h WHERE k = 1 AND o = 1 AND d > 0""",
    "unique_node_dedup": """
WITH k AS (SELECT *, 'uak:v2:' || sha256('|' || upper(trim(p_brand)) || '|' || upper(trim(p_name)) || '|' || upper(trim(p_type))) AS node_key FROM part)
SELECT node_key, count(*) AS n_rows, min(p_partkey) AS representative, arg_min(p_brand, p_partkey) AS p_brand, arg_min(p_type, p_partkey) AS p_type FROM k GROUP BY node_key""",
    "node_compression_stats": """
SELECT count(*) AS n_rows, count(DISTINCT (p_brand, p_name, p_type)) AS n_nodes, count(*) - count(DISTINCT (p_brand, p_name, p_type)) AS duplicates, round(count(*)::DOUBLE / count(DISTINCT (p_brand, p_name, p_type)), 2) AS ratio FROM part""",
    "node_selection_conflicts": """
SELECT l_partkey, count(DISTINCT l_suppkey) AS n_targets, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS targets FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1""",
    "propagate_first_resolved": """
WITH e AS (SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS paid FROM events)
SELECT event_id, last_value(paid IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_paid,
  min(paid) OVER (PARTITION BY user_id) AS first_paid FROM e""",
    "field_experience_best": """
WITH k AS (SELECT event_type AS header, (user_id % 4) AS ctx, CASE WHEN user_id % 3 <> 0 THEN user_id % 3 END AS company, 'f' || (user_id % 5) AS target_field, value, ts, event_id FROM events),
t AS (SELECT *, CASE WHEN company IS NOT NULL AND ctx = 3 THEN 1 WHEN ctx = 3 THEN 2 WHEN company IS NOT NULL THEN 3 ELSE 4 END AS tier FROM k WHERE company IS NULL OR company = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY header ORDER BY tier, value DESC, ts DESC, event_id) AS p FROM t)
SELECT 'col_' || header AS column_id, target_field, CASE WHEN tier IN (1, 3) THEN 'company_experience' ELSE 'global_experience' END AS source, [1.0, 0.9, 0.85, 0.75][tier]::DOUBLE AS confidence FROM r WHERE p = 1""",
    "context_signature": """
WITH t AS (SELECT DISTINCT conv_id, turn, role FROM conversations)
SELECT conv_id, turn, role, sha256(coalesce(lag(role) OVER w, '') || '|' || role || '|' || coalesce(lead(role) OVER w, '')) AS signature FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)""",
    "upsert_mapping_experience": """
WITH held AS (SELECT o_orderkey, o_orderstatus AS target, o_orderkey % 10 <> 0 AS active FROM orders WHERE o_orderkey % 3 <> 0),
inc AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS target FROM orders WHERE o_orderkey % 2 = 0),
j AS (SELECT coalesce(h.o_orderkey, i.o_orderkey) AS o_orderkey, h.target AS ot, i.target AS nt, CASE WHEN i.target IS NULL THEN 'unchanged' WHEN h.target IS NULL THEN 'inserted' WHEN h.target = i.target THEN 'reused' ELSE 'replaced' END AS action
  FROM (SELECT * FROM held WHERE active) h FULL JOIN inc i ON h.o_orderkey = i.o_orderkey)
SELECT o_orderkey, CASE action WHEN 'unchanged' THEN ot ELSE nt END AS target, (CASE action WHEN 'reused' THEN 2 ELSE 1 END)::BIGINT AS uses, CASE action WHEN 'unchanged' THEN 0.9::DOUBLE ELSE 0.95::DOUBLE END AS confidence, true AS active, action FROM j
UNION ALL SELECT o_orderkey, ot, 1, 0.9::DOUBLE, false, 'retired' FROM j WHERE action = 'replaced'
UNION ALL SELECT o_orderkey, target, 1, 0.9::DOUBLE, false, 'retired' FROM held WHERE NOT active""",
    "full_sync_merge": """
WITH a AS (SELECT *, p_partkey % 4 <> 0 AS h, p_partkey % 5 <> 0 AS g, p_partkey % 6 <> 1 AS was, CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE p_size END AS s FROM part),
c AS (SELECT *, CASE WHEN NOT h THEN 'created' WHEN NOT g THEN CASE WHEN was THEN 'deactivated' ELSE 'kept' END WHEN NOT was THEN 'reactivated' WHEN s <> p_size THEN 'updated' ELSE 'unchanged' END AS action FROM a WHERE h OR g)
SELECT p_partkey, p_brand, CASE WHEN g THEN s ELSE p_size END AS p_size, g AS active, action FROM c""",
    "snapshot_changes": """
WITH a AS (SELECT *, p_partkey % 4 <> 0 AS h, p_partkey % 5 <> 0 AS g, CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE p_size END AS s FROM part)
SELECT p_partkey, CASE WHEN NOT h THEN 'added' WHEN NOT g THEN 'removed' ELSE 'changed' END AS change FROM a WHERE (h OR g) AND (NOT h OR NOT g OR s <> p_size)""",
    "account_categories": """
WITH a AS (SELECT p_partkey, (p_partkey % 7000)::VARCHAR AS c FROM part),
contra AS (SELECT unnest(string_split('1407 1471 1602 1603 1622 1623 1632 1633 1634 1642 1643 1702 1703 2314 4201 5402', ' ')) AS c)
SELECT p_partkey, CASE WHEN c IN (SELECT c FROM contra) THEN CASE substr(c, 1, 1) WHEN '2' THEN 'contra_liability' WHEN '4' THEN 'contra_equity' ELSE 'contra_asset' END
  WHEN substr(c, 1, 4) IN ('6001','6051','6101','6103','6111','6115','6117','6301','6701','6702','6901','6902') THEN 'revenue'
  WHEN substr(c, 1, 4) IN ('6401','6402','6403','6601','6602','6603','6711','6801') THEN 'expense'
  ELSE CASE substr(c, 1, 1) WHEN '1' THEN 'asset' WHEN '2' THEN 'liability' WHEN '3' THEN 'equity' WHEN '4' THEN 'equity' WHEN '5' THEN 'cost' WHEN '6' THEN 'revenue_or_expense' ELSE 'unknown' END END AS category FROM a""",
}
