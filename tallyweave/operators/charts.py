"""Charts of accounts as uploaded: rejecting repeated codes, and the hierarchy with its business exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.vocabulary import ROOT_CODES
from tallyweave.operators.hierarchy import ancestors

# What separates the parts of an account code.
CODE_SEPARATORS = ("-", ".", "_")


def repeated_codes(rows: DataFrame, key: str, row: str) -> DataFrame:
    """(row, key, first_row) of every row whose key an earlier row has. One grouping, then an equi-join."""
    several = rows.groupBy(key).agg(F.min(row).alias("first_row"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.select(row, key).join(several, key).filter(F.col(row) > F.col("first_row")).select(row, key, "first_row")


def accept_unique(rows: DataFrame, key: str, row: str) -> tuple[DataFrame, DataFrame]:
    """All rows, or none of them if any key repeats; and the repeated rows."""
    errors = repeated_codes(rows, key, row)
    return rows.filter(F.lit(errors.isEmpty())), errors


def separated_level(code: Column) -> Column:
    """One more than the count of the separator that occurs most."""
    counts = [F.length(code) - F.length(F.replace(code, F.lit(s), F.lit(""))) for s in CODE_SEPARATORS]
    return F.greatest(*counts) + 1


def chart_hierarchy(chart: DataFrame, code: str, roots: tuple[str, ...] = ROOT_CODES) -> DataFrame:
    """``chart`` with ``parent_code`` (the longest other code that is a prefix), ``level`` and ``is_leaf``.

    Codes in ``roots`` stand on the first level without a parent, whatever prefixes say; leaves
    are the codes that are no one's parent after that.
    """
    up = ancestors(chart, code, code).groupBy(code).agg(F.max_by("ancestor", F.length("ancestor")).alias("parent_code"))
    is_root = F.col(code).isin(*roots)
    placed = chart.join(up, code, "left").withColumns({"parent_code": F.when(~is_root, F.col("parent_code")), "level": F.when(is_root, 1).otherwise(separated_level(F.col(code)))})
    parents = placed.filter("parent_code is not null").select(F.col("parent_code").alias(code)).distinct().withColumn("_held", F.lit(True))
    return placed.join(parents, code, "left").withColumn("is_leaf", F.col("_held").isNull()).drop("_held")


def descendant_leaves(rows: DataFrame, key: str, code: str) -> DataFrame:
    """(code, n_leaves) of every code: 1 for a leaf, else the leaves below it."""
    up = ancestors(rows, key, code)
    parents = up.select(F.col("ancestor").alias(code)).distinct()
    leaves = rows.join(parents, code, "left_anti").select(code)
    below = up.join(leaves, code).groupBy(F.col("ancestor").alias(code)).agg(F.count(F.lit(1)).alias("n_leaves"))
    return leaves.withColumn("n_leaves", F.lit(1).cast("long")).unionByName(below)
