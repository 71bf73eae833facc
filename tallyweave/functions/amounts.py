"""Splitting amounts into debit and credit sides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.vocabulary import CREDIT_TEXTS, DEBIT_TEXTS, FLAT_TEXTS

MONEY = "decimal(20,2)"


def net_sides(net: Column) -> tuple[Column, Column]:
    """A signed balance as (debit, credit)."""
    zero = F.lit(0).cast(MONEY)
    return F.greatest(net.cast(MONEY), zero), F.greatest((-net).cast(MONEY), zero)


def _sides(debit: Column, credit: Column, warning: Column | None = None, error: Column | None = None) -> Column:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(debit.cast(MONEY).alias("debit"), credit.cast(MONEY).alias("credit"), text(warning).alias("warning"), text(error).alias("error"))


def split_amount(amount: Column, mode: str, direction: Column | None = None) -> Column:
    """A struct (debit, credit, warning, error) for one amount column.

    ``direction`` is the standard account's side for ``single_by_direction`` and the source's
    text for ``single_by_source_direction``. A negative amount goes to the other side. Null
    and zero amounts give zero on both sides.
    """
    value = F.coalesce(amount.cast(MONEY), F.lit(0).cast(MONEY))
    zero = F.lit(0).cast(MONEY)
    up, down = net_sides(value)
    as_debit, as_credit = _sides(up, down), _sides(down, up)
    nothing = _sides(zero, zero)
    if mode == "single_as_debit":
        return as_debit
    if mode == "single_as_credit":
        return as_credit
    if mode == "single_by_direction":
        missing = _sides(zero, zero, error=F.lit("direction missing"))
        invalid = _sides(zero, zero, error=F.lit("direction invalid"))
        return F.when(value == 0, nothing).when(direction.isNull(), missing).when(direction == "debit", as_debit).when(direction == "credit", as_credit).otherwise(invalid)
    if mode == "single_by_source_direction":
        side = F.lower(F.trim(F.coalesce(direction, F.lit(""))))
        flat = _sides(value, zero, warning=F.lit("flat with an amount, taken as debit"))
        unknown = _sides(zero, zero, error=F.lit("direction unknown"))
        return F.when(value == 0, nothing).when(side.isin(*DEBIT_TEXTS), as_debit).when(side.isin(*CREDIT_TEXTS), as_credit).when(side.isin(*FLAT_TEXTS), flat).otherwise(unknown)
    raise ValueError(f"no single-column split mode: {mode}")


def transform_period(period: str, mode: str, debit: Column | None = None, credit: Column | None = None, amount: Column | None = None, direction: Column | None = None) -> dict[str, Column]:
    """Columns ``<period>_debit``, ``<period>_credit`` and ``<period>_issue`` of one period."""
    if mode == "two_column":
        side = lambda c: F.coalesce(c.cast(MONEY), F.lit(0).cast(MONEY))
        return {f"{period}_debit": side(debit), f"{period}_credit": side(credit), f"{period}_issue": F.lit(None).cast("string")}
    parts = split_amount(amount, mode, direction)
    return {f"{period}_debit": parts["debit"], f"{period}_credit": parts["credit"], f"{period}_issue": F.coalesce(parts["error"], parts["warning"])}
