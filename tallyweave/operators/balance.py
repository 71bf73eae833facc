"""Balance checks over journals and trial balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = "0.01"
MONEY = "decimal(20,2)"
TOTAL = "decimal(30,2)"


def money(col: Column | str) -> Column:
    """A double or numeric column as two-decimal money."""
    return (F.col(col) if isinstance(col, str) else col).cast(MONEY)


def side_totals(debit: str, credit: str) -> tuple[Column, Column]:
    return tuple(F.coalesce(F.sum(c), F.lit(0)).cast(TOTAL).alias(name) for c, name in ((debit, "debit_total"), (credit, "credit_total")))


def out_of_balance(one_sided: bool = False) -> Column:
    """Whether ``debit_total`` and ``credit_total`` differ by more than the tolerance; with one side only they do not, unless ``one_sided``."""
    apart = F.abs(F.col("debit_total") - F.col("credit_total")) > F.lit(TOLERANCE).cast(MONEY)
    return apart if one_sided else apart & (F.col("debit_total") > 0) & (F.col("credit_total") > 0)


def unbalanced_groups(rows: DataFrame, keys: list[str], debit: str, credit: str, one_sided: bool = False) -> DataFrame:
    """Groups whose debit and credit totals differ by more than the tolerance.

    A group with only one side is not flagged unless ``one_sided``. Null amounts count as
    zero; a null key forms a group of its own. One shuffle on the keys, with partial sums
    before it, so a hot key costs one row per task.
    """
    sums = rows.groupBy(*keys).agg(*side_totals(debit, credit), F.count(F.lit(1)).alias("n_lines"))
    return sums.filter(out_of_balance(one_sided)).withColumn("difference", (F.col("debit_total") - F.col("credit_total")).cast(TOTAL))
