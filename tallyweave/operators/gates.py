"""What an import checks and reports before it writes: row sets, states, messages and lookups that must be unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_lookup(rows: DataFrame, reference: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of the reference row of the same key; keys that occur more than once there give null."""
    single = reference.filter(F.col(key).isNotNull()).groupBy(key).agg(F.any_value(value).alias(value), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    return rows.join(single, key, "left")


def with_direction(rows: DataFrame, known: DataFrame, row: str, code: str, name: str, direction: str) -> DataFrame:
    """``rows`` with the direction known for the row, else for its code and name, else for its code.

    Several for one code (and name) count as the one of the smallest row.
    """
    given = known.filter(F.col(direction).isNotNull())
    first = lambda keys, into: given.groupBy(*keys).agg(F.min_by(direction, row).alias(into))
    found = rows.join(first([row], "_row"), row, "left").join(first([code, name], "_pair"), [code, name], "left").join(first([code], "_code"), code, "left")
    return found.withColumn(direction, F.coalesce("_row", "_pair", "_code")).drop("_row", "_pair", "_code")


def ignored_row_faults(ignored: DataFrame, leaves: DataFrame, row: str) -> DataFrame:
    """(row, fault) for rows asked to be ignored that are negative, named twice or no base leaf."""
    counted = ignored.groupBy(row).agg(F.count(F.lit(1)).alias("n")).join(leaves.select(row).distinct().withColumn("leaf", F.lit(True)), row, "left")
    faults = F.array(
        F.when(F.col(row) < 0, F.lit("negative")),
        F.when(F.col("n") > 1, F.lit("repeated")),
        F.when(F.col("leaf").isNull(), F.lit("not a base leaf")),
    )
    return counted.select(row, F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("fault"))


def leaf_sets(base: DataFrame, structural: DataFrame, ignored: DataFrame, row: str) -> DataFrame:
    """(row, leaf_set): base rows that are no structure, as ``business``, and those of them asked to be ignored, as ``ignored``."""
    business = base.select(row).distinct().join(structural.select(row), row, "left_anti")
    both = business.join(ignored.select(row), row, "left_semi")
    return business.withColumn("leaf_set", F.lit("business")).unionByName(both.withColumn("leaf_set", F.lit("ignored")))


def mapping_status(skipped: Column, target: Column, role: Column, code: Column, name: Column) -> Column:
    """ignored, mapped or unmapped: a skip comes first, then a target, then rows that take no part."""
    given = F.coalesce(code, F.lit("")) != ""
    named = F.coalesce(name, F.lit("")) != ""
    return (
        F.when(F.coalesce(skipped, F.lit(False)), "ignored")
        .when(target.isNotNull(), "mapped")
        .when(role.isin("structural_summary", "ignored"), "ignored")
        .when(given | named, "unmapped")
        .otherwise("ignored")
    )


def _first_word(message: Column, words: tuple[tuple[str, str], ...], other: str) -> Column:
    found = F.lit(other)
    for word, category in reversed(words):
        found = F.when(F.contains(message, F.lit(word)), category).otherwise(found)
    return found


# Words by which messages are told apart, the first that fits.
WARNING_WORDS = (("不一致", "parent_amount_mismatch"), ("负数", "negative_amount"), ("缩进", "indent_suggested"))
ERROR_WORDS = (("方向缺失", "no_direction"), ("无法按标准方向", "no_direction"))


def warning_category(message: Column) -> Column:
    return _first_word(message, WARNING_WORDS, "other")


def error_category(message: Column) -> Column:
    return _first_word(message, ERROR_WORDS, "missing_amount")


def message_row(message: Column) -> Column:
    """The row number at the start of a message, or null."""
    return F.regexp_extract(message, r"^行 (\d+):", 1).try_cast("long")


def open_warnings(warnings: DataFrame, message: str, skipped: DataFrame, row: str) -> DataFrame:
    """``warnings`` with ``row`` and ``category``, without those about skipped rows."""
    read = warnings.withColumns({row: message_row(F.col(message)), "category": warning_category(F.col(message))})
    return read.join(skipped.select(row).distinct(), row, "left_anti")


def response_mode(requested: Column, rows: Column, nodes: Column, duplicates: Column) -> Column:
    """The mode asked for; else node for large and repetitive uploads, hybrid for the others."""
    repetitive = (rows >= 5000) & (nodes > 0) & ((rows / nodes >= 10) | (duplicates >= 1000))
    return F.when(requested.isin("legacy", "node", "hybrid"), requested).when(repetitive, "node").otherwise("hybrid")
