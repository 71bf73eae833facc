"""Audits of confirmed mappings: mismatch classes, category pairs and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import vocabulary as V
from tallyweave.functions.names import contains_any


def starts_with_any(code: Column, prefixes: tuple[str, ...]) -> Column:
    return F.coalesce(code.rlike(f"^({'|'.join(prefixes)})"), F.lit(False))


def is_cost_term(name: Column) -> Column:
    """Production or operating cost, not the cost of measurement terms."""
    return contains_any(name, V.COST_WORDS) | F.array_contains(F.split(F.coalesce(name, F.lit("")), r"[_\-/\\\s()\[\]【】（）,，:：;；]+"), "成本")


def mismatches(code: Column, name: Column, path: Column, standard_code: Column, standard_name: Column) -> Column:
    """The array of mismatch classes between a client account and the account it was mapped to."""
    text = F.concat_ws(" ", name, path)
    has = lambda c, *w: contains_any(c, w)
    payable = has(text, "应付") | code.startswith("2")
    receivable = (has(name, "应收") & ~has(name, "应付")) | code.startswith("1")
    reserve, standard_reserve = contains_any(text, V.AUDIT_RESERVES), contains_any(standard_name, V.AUDIT_RESERVES)
    expensing, capitalizing = has(text, "费用化", "研发费用"), has(text, "资本化")
    checks = (
        ("cost_to_equity", (is_cost_term(name) | is_cost_term(path)) & starts_with_any(standard_code, V.EQUITY_CODES)),
        ("liability_to_asset", payable & ~receivable & standard_code.startswith("1") & has(standard_name, "应收")),
        ("asset_to_liability", receivable & ~payable & standard_code.startswith("2") & has(standard_name, "应付")),
        ("gross_to_contra", standard_reserve & ~reserve & contains_any(text, V.GROSS_CLIENT_WORDS)),
        ("contra_to_gross", reserve & ~standard_reserve & contains_any(standard_name, V.GROSS_STANDARD_WORDS)),
        ("expensed_to_capitalised", expensing & starts_with_any(standard_code, ("170401",))),
        ("capitalised_to_expensed", capitalizing & starts_with_any(standard_code, ("660201", "170402"))),
        ("revenue_to_cost", has(name, "收入") & starts_with_any(standard_code, V.COST_EXPENSE_CODES)),
        ("cost_to_revenue", is_cost_term(name) & starts_with_any(standard_code, V.REVENUE_CODES)),
    )
    return F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(kind)) for kind, test in checks)), lambda k: k.isNotNull())


def category_conflicts(pairs: DataFrame, source: str, target: str, allowed: DataFrame) -> DataFrame:
    """Pairs whose (source, target) categories the matrix does not allow."""
    return pairs.join(allowed.select(F.col("source").alias(source), F.col("target").alias(target)), [source, target], "left_anti")


def stratified_sample(rows: DataFrame, stratum: str, key: str, each: int, seed: str = "42") -> DataFrame:
    """``each`` rows of every stratum, the first by hash of seed and key; the same on every run."""
    place = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    order = Window.partitionBy(stratum).orderBy(place, key)
    return rows.withColumn("sample_rank", F.row_number().over(order)).filter(F.col("sample_rank") <= each)


#: Sources that are counted one by one among confirmed picks.
COUNTED = ("company_history", "global_history", "name_exact", "semantic_alias", "code_match", "old_code_crosswalk", "parent_inherited_crosswalk", "name_prefix", "code_prefix_parent", "code_category_anchor", "name_anchor", "name_similarity")


def picks(candidates: DataFrame) -> DataFrame:
    """Per client: n_candidates, n_safe (targets), conflict and unknown (whether any candidate is), and the one safe pick, if there is one.

    ``candidates``: client, target, source, score, warning, auto, compatibility, safe, rank.
    """
    safe = F.struct("target", "source", "warning", "compatibility")
    per = candidates.groupBy("client").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_distinct(F.when(F.col("safe"), F.col("target"))).alias("n_safe"), F.bool_or(F.col("compatibility") == "conflict").alias("conflict"),
        F.bool_or(F.col("compatibility") == "unknown").alias("unknown"), F.min_by(F.when(F.col("safe"), safe), F.struct(~F.col("safe"), "rank")).alias("pick"),
    )
    return per.withColumn("pick", F.when(F.col("n_safe") == 1, F.col("pick")))


def audit_files(rows: DataFrame, candidates: DataFrame, chart: DataFrame) -> DataFrame:
    """One row per file: how many of its distinct accounts are confirmed by rule, how many ask a person and why, by which source, and what must never happen.

    ``rows``: file, client, code, name, full_path, participates; ``chart``: code, name, active. Rows that take part count once for
    each (code, name, path) of a file, by their first client. Mismatch classes are looked for in confirmed
    picks only. ``confirmed`` and ``manual`` add up to ``accounts`` less those without any candidate.
    """
    return audit_picks(rows, picks(candidates), chart)


def audit_picks(rows: DataFrame, picked: DataFrame, chart: DataFrame) -> DataFrame:
    """``audit_files`` of clients whose ``picks`` are known."""
    text = lambda c: F.trim(F.coalesce(c, F.lit(""))).alias(c)
    unique = rows.filter(F.coalesce("participates", F.lit(True))).select("file", "client", *map(text, ("code", "name", "full_path"))).groupBy("file", "code", "name", "full_path").agg(F.min("client").alias("client"))
    accounts = chart.select(F.col("code").alias("_code"), F.col("name").alias("_name"), F.col("active").alias("_active"))
    met = unique.join(picked.hint("merge"), "client", "left").join(accounts, F.col("pick.target") == F.col("_code"), "left")
    has_pick = F.col("pick").isNotNull()
    found = mismatches(F.col("code"), F.col("name"), F.col("full_path"), F.col("pick.target"), F.col("_name"))
    met = met.withColumns({"picked": has_pick, "mismatches": F.when(has_pick, F.size(found)).otherwise(0), "n_safe": F.coalesce("n_safe", F.lit(0))})
    known = F.coalesce(F.col("n_candidates") > 0, F.lit(False))
    on = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return met.groupBy("file").agg(
        F.count(F.lit(1)).alias("accounts"), on(~known, "no_candidate"), on(F.col("picked"), "confirmed"), on(known & ~F.col("picked"), "manual"), on(known & (F.col("n_safe") == 0), "no_safe"), on(F.col("n_safe") > 1, "ambiguous"),
        on(F.col("conflict"), "with_conflict"), on(F.col("unknown"), "with_unknown"), *(on(F.col("pick.source") == s, f"by_{s}") for s in COUNTED),
        on(F.col("pick.warning").isNotNull(), "warned_picks"), on(F.col("picked") & ~F.coalesce("_active", F.lit(False)), "inactive_picks"), F.sum("mismatches").cast("long").alias("n_mismatches"),
    )
