"""Listings and the roll-up tree over stored batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def containing(columns: list[str], word: str) -> Column:
    """Case-blind containment in any of the columns; % and _ in the word are plain characters."""
    low = word.lower()
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False)) for c in columns))


def filtered(rows: DataFrame, equal: dict[str, object] | None = None, between: dict[str, tuple] | None = None, words: dict[str, str] | None = None, among: dict[str, list] | None = None) -> DataFrame:
    """Rows that meet all conditions given; values of None are no condition."""
    for column, value in (equal or {}).items():
        rows = rows if value is None else rows.filter(F.col(column) == value)
    for column, values in (among or {}).items():
        rows = rows if values is None else rows.filter(F.col(column).isin(*values))
    for column, (low, high) in (between or {}).items():
        rows = rows if low is None else rows.filter(F.col(column) >= low)
        rows = rows if high is None else rows.filter(F.col(column) <= high)
    for column, word in (words or {}).items():
        rows = rows if not word else rows.filter(containing([column], word))
    return rows


def batches_with_counts(batches: DataFrame, entries: DataFrame, batch: str, entry: str) -> DataFrame:
    """Each batch with its number of entries, 0 included. Entries are counted before the join."""
    counts = entries.groupBy(batch).agg(F.count(entry).alias("n_entries"))
    return batches.join(counts, batch, "left").withColumn("n_entries", F.coalesce("n_entries", F.lit(0)))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> tuple[DataFrame, int]:
    """One page in a total order, and the number of all rows."""
    return rows.orderBy(*order).offset(offset).limit(limit), rows.count()


def tree_nodes(accounts: DataFrame, sums: DataFrame, up: DataFrame, only_with_amounts: bool = False) -> DataFrame:
    """Flat tree nodes: account, parent, depth and the rolled-up measures (null: nothing below).

    ``sums`` has (ancestor, measures..., entry_count) as from ``roll_up``.
    """
    depth = up.groupBy("node").agg((F.max("distance") + 1).alias("depth"))
    found = accounts.join(depth, "node", "left").join(sums.withColumnRenamed("ancestor", "node"), "node", "left")
    found = found.withColumn("entry_count", F.coalesce("entry_count", F.lit(0)))
    return found.filter("entry_count > 0") if only_with_amounts else found


def _named(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` asks for it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def synthetic_path(code: Column, name: Column, standard_name: Column, standard_code: Column) -> Column:
    """The client groups between an account and an entry, from the parts of the entry's name.

    An array of (group_code, group_name), outermost first, without the last part, which is the
    entry. A first part equal to the account is left out; the research pair is one group.
    """
    own = F.regexp_replace(F.coalesce(standard_name, F.lit("")), "减：|加：|其中：", "")
    width = lambda i: F.least(F.lit(12), F.lit(6) + i * 2)
    empty = F.array().cast("array<struct<group_code:string,group_name:string>>")

    def grouped(merged: Column) -> Column:
        return F.transform(merged, lambda s, i: F.struct(F.substring(code, F.lit(1), width(i)).alias("group_code"), F.array_join(F.slice(merged, 1, i + 1), "_").alias("group_name")))

    def without_entry(rest: Column) -> Column:
        pair = (F.get(rest, F.lit(0)) == "研发支出") & F.get(rest, F.lit(1)).isin("费用化支出", "资本化支出")
        joined = F.concat(F.array(F.concat_ws("_", F.get(rest, F.lit(0)), F.get(rest, F.lit(1)))), F.slice(rest, 3, F.greatest(F.size(rest), F.lit(0))))
        # the entry itself may be the second half of the pair; then the pair is still the group
        inner = F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0)))
        return F.when(pair & (F.size(rest) == 2), F.slice(joined, 1, 1)).when(pair, F.slice(joined, 1, F.greatest(F.size(joined) - 1, F.lit(0)))).otherwise(inner)

    def groups(parts: Column) -> Column:
        skip = F.when((F.get(parts, F.lit(0)) == own) | (F.get(parts, F.lit(0)) == standard_code), 1).otherwise(0)
        rest = F.slice(parts, skip + 1, F.greatest(F.size(parts) - skip, F.lit(0)))
        return F.when(F.size(parts) <= 1, empty).otherwise(_named(rest, lambda r: _named(without_entry(r), grouped)))

    parts = F.filter(F.split(F.coalesce(name, F.lit("")), r"[_\-－—/\\]"), lambda s: F.trim(s) != "")
    return F.when(code.isNull() | name.isNull() | (code == ""), empty).otherwise(_named(parts, groups))


def delete_batch(tables: dict[str, DataFrame], batch: str, value: object) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without the batch, and the number of rows that leave each of them."""
    rest = {name: df.filter(~F.col(batch).eqNullSafe(F.lit(value))) for name, df in tables.items()}
    counts = [df.filter(F.col(batch) == value).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_deleted")) for name, df in tables.items()]
    return rest, reduce(DataFrame.union, counts)
