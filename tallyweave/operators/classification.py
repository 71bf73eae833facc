"""Row classes of an import and the reconciliations over them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import vocabulary as V
from tallyweave.functions.names import contains_any

CLASSES = ("ignored", "summary_total", "zero_amount", "duplicate_aggregate", "eligible")
MONEY, TOTAL = "decimal(20,2)", "decimal(30,2)"


def has_summary_word(code: Column, name: Column) -> Column:
    return contains_any(F.concat_ws(" ", code, name), V.SUMMARY_WORDS)


def is_footer_or_config(code: Column, name: Column) -> Column:
    return contains_any(code, V.FOOTER_WORDS) | contains_any(name, V.CONFIG_WORDS)


def all_zero(amounts: list[Column], tolerance: str = "0.01") -> Column:
    limit = F.lit(tolerance).cast(MONEY)
    return reduce(and_, (F.coalesce(F.abs(a) <= limit, F.lit(True)) for a in amounts))


def row_class(ignored: Column, summary: Column, zero: Column, duplicate: Column | None = None) -> Column:
    """One exclusive class per business leaf; nulls count as false."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    found = F.when(sure(ignored), "ignored").when(sure(summary), "summary_total").when(sure(zero), "zero_amount")
    return (found.when(sure(duplicate), "duplicate_aggregate") if duplicate is not None else found).otherwise("eligible")


def class_identity(rows: DataFrame, into: str = "row_class") -> DataFrame:
    """Counts per class beside the total; the classes are exclusive, so they add up to it."""
    counts = [F.count_if(F.col(into) == c).alias(c) for c in CLASSES]
    return rows.agg(F.count(F.lit(1)).alias("total"), *counts).withColumn("identity_holds", F.col("total") == sum((F.col(c) for c in CLASSES), F.lit(0)))


def business_reconciliation(rows: DataFrame, measures: list[str], into: str = "row_class", tolerance: str = "0.01") -> DataFrame:
    """Per measure: business total, entries, ignored and what is left between them."""
    side = lambda m, c: F.coalesce(F.sum(F.when(F.col(into).isin(*c), F.col(m))), F.lit(0)).cast(TOTAL)
    parts = [F.struct(F.lit(m).alias("measure"), side(m, ["eligible", "ignored"]).alias("business"), side(m, ["eligible"]).alias("entries"), side(m, ["ignored"]).alias("ignored"), side(m, ["zero_amount"]).alias("zero")) for m in measures]
    flat = rows.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))
    gap = (F.col("business") - F.col("entries") - F.col("ignored")).cast(TOTAL)
    return flat.withColumn("difference", gap).withColumn("reconciled", F.abs("difference") <= F.lit(tolerance).cast(MONEY))


def legacy_reconciliation(rows: DataFrame, measures: list[str], into: str = "row_class") -> DataFrame:
    """Per measure: source (all rows but summaries), entry, ignored, zero_skip and what is left between them."""
    side = lambda m, c: F.coalesce(F.sum(F.when(F.col(into).isin(*c), F.col(m))), F.lit(0)).cast(TOTAL)
    parts = [F.struct(F.lit(m).alias("measure"), side(m, ["eligible", "ignored", "zero_amount"]).alias("source"), side(m, ["eligible"]).alias("entry"), side(m, ["ignored"]).alias("ignored"), side(m, ["zero_amount"]).alias("zero_skip")) for m in measures]
    flat = rows.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))
    return flat.withColumn("difference", (F.col("source") - F.col("entry") - F.col("ignored") - F.col("zero_skip")).cast(TOTAL))


def duplicate_aggregates(parents: DataFrame, children: DataFrame, key: str, measures: list[str], tolerance: str = "0.01") -> DataFrame:
    """Parents that equal the sum of their direct leaf children in every measure, one of them not zero."""
    sums = children.groupBy(key).agg(*(F.coalesce(F.sum(m), F.lit(0)).cast(TOTAL).alias(f"sum_{m}") for m in measures), F.count(F.lit(1)).alias("n_children"))
    joined = parents.join(sums, key)
    limit = F.lit(tolerance).cast(MONEY)
    same = reduce(and_, (F.abs(F.col(m) - F.col(f"sum_{m}")) <= limit for m in measures))
    some = reduce(lambda a, b: a | b, ((F.col(m) != 0) | (F.col(f"sum_{m}") != 0) for m in measures))
    return joined.withColumn("is_duplicate", same & some)
