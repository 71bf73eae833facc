"""Recommendations in context: part names as client accounts, their words as the chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import audit, matching, recommend
from tallyweave.plans.mapping import chart
from tallyweave.session import table


def _coded(number: Column) -> Column:
    """The code of a word of the chart by its place among all."""
    return F.get(F.col("codes"), F.pmod(number, F.size("codes")).cast("int"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with codes and parents that their keys deal out from the chart."""
    codes = chart(spark, sf_dir).agg(F.array_sort(F.collect_list("code")).alias("codes"))
    words = F.split("p_name", " ")
    k = F.col("k")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), "p_name", "p_brand", words.alias("words")).join(F.broadcast(codes), F.lit(True))
    code = F.when(k % 3 == 0, _coded(k)).when(k % 3 == 1, F.concat(_coded(k), F.lit("01"))).otherwise(F.concat(F.lit("x"), k))
    above = F.floor(k / 2)
    parent = F.when(k % 5 == 0, F.concat(_coded(above), F.lit("9"))).when(k % 5 == 1, F.concat(F.lit("x"), k, F.lit(".1")))
    name = F.when(k % 11 == 0, "").when(k % 7 == 0, F.get("words", F.lit(1))).otherwise(F.col("p_name"))
    return rows.select("k", "p_name", "p_brand", "words", "codes", code.alias("code"), name.alias("name"), parent.alias("parent_code"), F.when(k % 10 == 0, F.get("words", F.lit(0))).alias("parent_name"))


def advised(spark: SparkSession, sf_dir: str) -> recommend.Advice:
    rows, accounts = contexts(spark, sf_dir), chart(spark, sf_dir)
    k = F.col("k")
    kept = lambda name, target: (name.alias("name"), target.alias("target"), (k % 5).cast("int").alias("used"), F.lit("2024").alias("last_used"), (k % 4 != 3).alias("active"))
    history = rows.filter("k % 97 = 0").select(F.concat(F.lit("x"), k).alias("code"), *kept(F.col("p_name"), _coded(k)))
    shared = rows.filter("k % 89 = 1").select(F.lit(None).cast("string").alias("code"), *kept(F.get("words", F.lit(1)), _coded(k)))
    walk = rows.filter("k between 1 and 40").select(F.concat(F.lit("x"), k).alias("old"), _coded(k * 7).alias("target"))
    clients = rows.select(k.alias("client"), "code", "name", "parent_code", "parent_name")
    return recommend.advise(clients, accounts, history, walk, shared=shared, least_similarity=None)


def recommend_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    advice = advised(spark, sf_dir)
    return advice.each(advice.best.select("client", "target", "source", "score", "compatibility", "safe", "rank"))


def recommend_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be confirmed without a person."""
    advice = advised(spark, sf_dir)
    return advice.each(matching.decide(advice.best).select("client", "n_candidates", "n_safe", "status", "confirmed"))


def audit_over_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand is a file; some rows take no part."""
    k = F.col("k")
    rows = contexts(spark, sf_dir).select(k.alias("client"), "code", "name", F.lit(None).cast("string").alias("full_path"), F.col("p_brand").alias("file"), (k % 19 != 4).alias("participates"))
    advice = advised(spark, sf_dir)
    return audit.audit_picks(rows, advice.each(audit.picks(advice.best)), chart(spark, sf_dir))


QUERIES = {f.__name__: f for f in (recommend_in_context, recommend_decisions, audit_over_files)}

_WORDS = "string_split(p_name, ' ')"
_FITS = "(replace({n}, ' ', '') = s.name OR list_contains(string_split({n}, ' '), s.name) OR starts_with(replace({n}, ' ', ''), s.name))"
_COMPAT = "CASE WHEN coalesce({n}, '') = '' THEN 'unknown' WHEN " + _FITS + " THEN 'compatible' ELSE 'unknown' END"


def _compat(name: str) -> str:
    return _COMPAT.replace("{n}", name)


_ADVICE = f"""WITH s AS (SELECT 'W' || substr(md5(name), 1, 6) AS code, name, length(name) % 5 <> 0 AS active FROM (SELECT DISTINCT unnest({_WORDS}) AS name FROM part)),
l AS (SELECT list(code ORDER BY code) AS codes FROM s),
c AS (SELECT p_partkey AS k, p_name, {_WORDS} AS w, codes, CASE p_partkey % 3 WHEN 0 THEN codes[p_partkey % len(codes) + 1] WHEN 1 THEN codes[p_partkey % len(codes) + 1] || '01' ELSE 'x' || p_partkey END AS code,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN {_WORDS}[2] ELSE p_name END AS name,
  CASE p_partkey % 5 WHEN 0 THEN codes[(p_partkey // 2) % len(codes) + 1] || '9' WHEN 1 THEN 'x' || p_partkey || '.1' END AS pcode, CASE WHEN p_partkey % 10 = 0 THEN {_WORDS}[1] END AS pname FROM part, l),
hist AS (SELECT 'x' || k AS code, p_name AS name, codes[k % len(codes) + 1] AS target, k % 5 AS used FROM c WHERE k % 97 = 0 AND k % 4 <> 3),
shar AS (SELECT w[2] AS name, codes[k % len(codes) + 1] AS target, k % 5 AS used FROM c WHERE k % 89 = 1 AND k % 4 <> 3),
walk AS (SELECT 'x' || k AS old, codes[(k * 7) % len(codes) + 1] AS target FROM c WHERE k BETWEEN 1 AND 40),
hh AS (SELECT k, target, old_name, used, min(tier) AS tier FROM (SELECT c.k, target, hist.name AS old_name, used, 0 AS tier FROM c JOIN hist ON hist.code = c.code UNION ALL SELECT c.k, target, hist.name, used, 1 FROM c JOIN hist ON hist.name = c.name) GROUP BY ALL),
xw AS (SELECT k, pcode, code, (SELECT arg_max(target, length(old)) FROM walk WHERE starts_with(c.code, old)) AS own, (SELECT arg_max(target, length(old)) FROM walk WHERE starts_with(c.pcode, old)) AS above FROM c),
led AS (SELECT c.k, arg_max(s.code, length(s.code)) AS above FROM c JOIN s ON starts_with(c.pcode, s.code) AND s.code <> c.pcode GROUP BY c.k),
raw(k, target, source, stage, place, score, warned, auto, compat) AS (
  SELECT k, target, 'company_history', 0, row_number() OVER (PARTITION BY k ORDER BY tier, used DESC, target, old_name), 1.0::DOUBLE, NOT active, active, CASE WHEN active THEN 'compatible' ELSE 'conflict' END FROM hh JOIN s ON s.code = target
  UNION ALL SELECT k, target, 'global_history', 1, row_number() OVER (PARTITION BY k ORDER BY used DESC, target, old_name), CASE WHEN NOT active OR s.name = old_name THEN 0.9::DOUBLE ELSE 0.82::DOUBLE END, NOT active OR s.name <> old_name, active AND s.name = old_name,
    CASE WHEN NOT active THEN 'conflict' WHEN s.name = old_name THEN 'compatible' ELSE 'unknown' END FROM (SELECT DISTINCT c.k, target, shar.name AS old_name, used FROM c JOIN shar ON shar.name = c.name) JOIN s ON s.code = target
  UNION ALL SELECT k, code, CASE WHEN demoted THEN 'code_match_conflict' ELSE 'code_match' END, 2, 1, CASE WHEN demoted THEN 0.75::DOUBLE WHEN fit = 'compatible' AND active THEN 0.92::DOUBLE ELSE 0.82::DOUBLE END, demoted OR fit <> 'compatible' OR NOT active,
    NOT demoted AND fit = 'compatible' AND active, CASE WHEN demoted OR (fit = 'compatible' AND NOT active) THEN 'conflict' ELSE fit END
    FROM (SELECT c.k, s.code, s.active, {_compat("c.name")} AS fit, c.name <> '' AND NOT contains(s.name, replace(c.name, ' ', '')) AND NOT contains(replace(c.name, ' ', ''), s.name) AND len(list_filter(string_split(c.name, ' '), lambda t: contains(s.name, t))) = 0
      AND contains(c.name, ' ') AS demoted FROM c JOIN s ON s.code = c.code)
  UNION ALL SELECT c.k, s.code, 'name_exact', 3, 1, CASE WHEN active THEN 0.98::DOUBLE ELSE 0.82::DOUBLE END, NOT active, active, CASE WHEN active THEN 'compatible' ELSE 'conflict' END FROM c JOIN s ON s.name = c.name
  UNION ALL SELECT k, target, 'old_code_crosswalk', 5, 1, CASE WHEN fit = 'compatible' THEN 0.91::DOUBLE ELSE 0.82::DOUBLE END, fit <> 'compatible', fit = 'compatible', fit FROM (SELECT c.k, xw.own AS target, {_compat("c.name")} AS fit FROM c JOIN xw USING (k) JOIN s ON s.code = xw.own AND s.active)
  UNION ALL SELECT k, target, 'parent_inherited_crosswalk', 6, 1, CASE WHEN fit = 'compatible' THEN 0.95::DOUBLE ELSE 0.82::DOUBLE END, fit <> 'compatible', fit = 'compatible', fit
    FROM (SELECT c.k, s.code AS target, {_compat("coalesce(nullif(c.pname, ''), c.name)")} AS fit FROM c JOIN xw USING (k) LEFT JOIN led USING (k) JOIN s ON s.code = coalesce(xw.above, led.above) AND s.active)
  UNION ALL SELECT k, code, 'code_prefix_parent', 8, 1, CASE WHEN safe THEN 0.92::DOUBLE ELSE 0.85::DOUBLE END, NOT safe, safe, CASE WHEN safe THEN 'compatible' ELSE 'unknown' END
    FROM (SELECT c.k, s.code, s.active AND c.name <> '' AND {_FITS.replace("{n}", "c.name")} AS safe FROM c JOIN s ON starts_with(c.code, s.code) AND s.code <> c.code)
  UNION ALL SELECT k, code, 'name_prefix', 11, 1, 0.94::DOUBLE, false, true, 'compatible' FROM (SELECT c.k, s.code FROM c JOIN s ON s.active AND replace(c.name, ' ', '') <> s.name AND {_FITS.replace("{n}", "c.name")}
    QUALIFY row_number() OVER (PARTITION BY c.k ORDER BY length(s.name) DESC, s.code) = 1)),
k1 AS (SELECT * FROM raw QUALIFY stage >= 5 OR stage = 0 OR (stage * 1000 + place) = min(CASE WHEN stage < 5 THEN stage * 1000 + place END) OVER (PARTITION BY k, target)),
k2 AS (SELECT * FROM k1 QUALIFY stage <> 5 OR NOT coalesce(bool_or(stage < 5) OVER (PARTITION BY k), false)),
k3 AS (SELECT * FROM k2 QUALIFY stage <> 6 OR NOT coalesce(bool_or(stage < 6 AND NOT warned AND score >= 0.9) OVER (PARTITION BY k), false)),
k4 AS (SELECT * FROM k3 QUALIFY stage <> 8 OR (NOT bool_or(stage < 7) OVER (PARTITION BY k, target) AND NOT bool_or(source = 'code_match') OVER (PARTITION BY k))),
k5 AS (SELECT * FROM k4 QUALIFY stage <> 11 OR (bool_or(source = 'code_match_conflict') OVER (PARTITION BY k) AND NOT bool_or(source IN ('code_match', 'name_exact')) OVER (PARTITION BY k)
  AND NOT bool_or(source IN ('code_match_conflict', 'company_history', 'global_history', 'name_exact')) OVER (PARTITION BY k, target))),
z AS (SELECT *, NOT warned AND auto AND compat = 'compatible' AND score >= 0.9 AS safe, CASE source WHEN 'company_history' THEN 0 WHEN 'name_exact' THEN 1 WHEN 'name_prefix' THEN 3 WHEN 'global_history' THEN 4 WHEN 'code_match' THEN 5
  WHEN 'old_code_crosswalk' THEN 6 WHEN 'parent_inherited_crosswalk' THEN 7 WHEN 'code_prefix_parent' THEN 10 ELSE 12 END AS p FROM k5),
r AS (SELECT k AS client, target, source, score, compat AS compatibility, safe, row_number() OVER (PARTITION BY k ORDER BY safe DESC, CASE WHEN safe OR auto THEN 0 ELSE 1 END, p,
  CASE WHEN safe THEN 0 WHEN compat = 'compatible' THEN 0 WHEN compat = 'unknown' THEN 1 ELSE 2 END, score DESC, stage, place, target) AS rank FROM z QUALIFY rank <= 10)"""

_BY = ", ".join(f"count(*) FILTER (picked = '{s}') AS by_{s}" for s in audit.COUNTED)
ORACLES = {
    "audit_over_files": f"""{_ADVICE}, f AS (SELECT p_brand AS file, code, trim(c.name) AS name, min(k) AS client FROM c JOIN part ON p_partkey = k WHERE k % 19 <> 4 GROUP BY ALL),
d AS (SELECT client, count(*) AS n, count(DISTINCT target) FILTER (safe) AS safe, bool_or(compatibility = 'conflict') AS con, bool_or(compatibility = 'unknown') AS unk, arg_min(source, rank) FILTER (safe) AS source FROM r GROUP BY client),
u AS (SELECT f.*, n, coalesce(safe, 0) AS safe, con, unk, CASE WHEN safe = 1 THEN source END AS picked FROM f LEFT JOIN d USING (client))
SELECT file, count(*) AS accounts, count(*) FILTER (n IS NULL) AS no_candidate, count(*) FILTER (picked IS NOT NULL) AS confirmed, count(*) FILTER (n IS NOT NULL AND picked IS NULL) AS manual, count(*) FILTER (n IS NOT NULL AND safe = 0) AS no_safe, count(*) FILTER (safe > 1) AS ambiguous,
  count(*) FILTER (con) AS with_conflict, count(*) FILTER (unk) AS with_unknown, {_BY}, 0::BIGINT AS warned_picks, 0::BIGINT AS inactive_picks, 0::BIGINT AS n_mismatches FROM u GROUP BY file""",
    "recommend_in_context": f"{_ADVICE} SELECT * FROM r",
    "recommend_decisions": f"""{_ADVICE} SELECT client, count(*) AS n_candidates, count(DISTINCT target) FILTER (safe) AS n_safe, CASE count(DISTINCT target) FILTER (safe) WHEN 0 THEN 'none' WHEN 1 THEN 'unique_safe' ELSE 'ambiguous' END AS status,
  CASE WHEN count(DISTINCT target) FILTER (safe) = 1 THEN arg_min(target, rank) END AS confirmed FROM r GROUP BY client""",
}
