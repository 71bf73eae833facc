"""Trial balances out of the tables of accounting systems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.amounts import MONEY, net_sides


def from_balances(balances: DataFrame, accounts: DataFrame, labels: DataFrame, year: int, period: int, locale: int) -> DataFrame:
    """Balance rows with account code and localised name, opening and ending split by sign.

    ``balances``: account_id, year, period, currency_id, detail_id, opening, debit, credit,
    ending; only rows in base currency (0) without detail (0). ``accounts``: account_id, code.
    ``labels``: account_id, locale_id, name; the code stands in for a missing name.
    """
    wanted = balances.filter((F.col("year") == year) & (F.col("period") == period) & (F.col("currency_id") == 0) & (F.col("detail_id") == 0))
    named = wanted.join(accounts, "account_id").join(labels.filter(F.col("locale_id") == locale).drop("locale_id"), "account_id", "left")
    return sides(named.withColumn("name", F.coalesce("name", "code")), "opening", "ending")


def sides(rows: DataFrame, opening: str, ending: str) -> DataFrame:
    od, oc = net_sides(F.coalesce(F.col(opening), F.lit(0)))
    ed, ec = net_sides(F.coalesce(F.col(ending), F.lit(0)))
    current = lambda c: F.coalesce(F.col(c), F.lit(0)).cast(MONEY).alias(f"current_{c}")
    return rows.select("code", "name", od.alias("opening_debit"), oc.alias("opening_credit"), current("debit"), current("credit"), ed.alias("ending_debit"), ec.alias("ending_credit"))


def from_details(details: DataFrame, names: DataFrame, opening_period: str = "00") -> DataFrame:
    """Ledger detail summed per code: the opening period nets, the others add up by side.

    ``details``: code, account_id, period, debit, credit. ``names``: account_id, display,
    name. Blank codes are left out.
    """
    amount = lambda c: F.coalesce(F.col(c), F.lit(0)).cast(MONEY)
    opens = F.col("period") == opening_period
    coded = details.filter(F.trim(F.coalesce("code", F.lit(""))) != "")
    sums = coded.join(names, "account_id", "left").groupBy("code").agg(
        F.max(F.coalesce("display", F.lit(""))).alias("display"),
        F.max(F.coalesce("name", F.lit(""))).alias("fallback"),
        F.sum(F.when(opens, amount("debit") - amount("credit")).otherwise(0)).alias("opening"),
        F.sum(F.when(opens, F.lit(0)).otherwise(amount("debit"))).alias("debit"),
        F.sum(F.when(opens, F.lit(0)).otherwise(amount("credit"))).alias("credit"),
    )
    named = sums.withColumn("name", display_name(F.col("display"), F.col("fallback")))
    return sides(named.withColumn("ending", F.col("opening") + F.col("debit") - F.col("credit")), "opening", "ending")


def display_name(display, fallback):
    """A path without its first part, joined by _; the fallback where there is none."""
    parts = F.split(display, r"[\\/]")
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "_")
    return F.when(F.size(parts) > 1, rest).when(display != "", display).otherwise(fallback)
