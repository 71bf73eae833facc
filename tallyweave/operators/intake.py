"""Importing sheets as typed rows: mapped, enriched, checked, split into good rows and faults, vouchers balanced.

Everything up to the two small reports is one pass over the rows without a shuffle but the join with each sheet's mapping.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import parsing
from tallyweave.functions import vocabulary as V
from tallyweave.operators import balance, columns, validation

WHOLE = ("fiscal_year", "period", "attachment_count", "account_level")
AMOUNTS = (*V.AMOUNT_FIELDS, "debit_amount", "credit_amount")


class Intake(NamedTuple):
    """``good``: sheet, row, the type's fields typed, extra_fields; ``faults``: (sheet, row, errors); ``unbalanced``: vouchers, (sheet, voucher_no, debit_total, credit_total, ...); ``marked``: every row with ``ok`` and, of a journal's good ones, voucher and amounts."""

    good: DataFrame
    faults: DataFrame
    unbalanced: DataFrame
    marked: DataFrame

    def outcomes(self) -> DataFrame:
        """Per sheet: total, success and n_errors (rows in error and vouchers that do not balance, which count as errors beside the rows).

        Rows are read once: summed by voucher, then by sheet.
        """
        per = self.marked.groupBy("sheet", "voucher_no").agg(*balance.side_totals("debit_amount", "credit_amount"), F.count(F.lit(1)).alias("total"), F.sum("ok").alias("success"))
        apart = F.when(balance.out_of_balance(), 1).otherwise(0)
        return per.groupBy("sheet").agg(F.sum("total").alias("total"), F.sum("success").alias("success"), F.sum(F.col("total") - F.col("success") + apart).alias("n_errors"))


def parsed(field: str, text: Column) -> Column | None:
    """A field's number or date, null where its text is none; None for fields that are texts."""
    if field in WHOLE:
        return parsing.to_int(text)
    if field in AMOUNTS:
        return parsing.to_decimal(text)
    return parsing.to_date(text) if field == "voucher_date" else None


def _worked_out(rows: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """``rows`` with columns that are worked out once: a filter on them is not pushed below, where each would be written out again."""
    return rows.select(*keep, F.inline(F.array(F.struct(*(c.alias(k) for k, c in made.items())))))


def intake(rows: DataFrame, cols: DataFrame, data_type: str, fiscal_year: int | None = None, period: int | None = None, by_id: DataFrame | None = None, by_header: DataFrame | None = None) -> Intake:
    """``rows``: sheet, row, cells; ``cols``: sheet, index, header, column_id; given mappings as in ``columns``.

    A given year or period fills sheets that map none. What is mapped to a field that the type does not have
    goes to ``extra_fields`` unless it is empty. A row with any error is a fault, with all its errors in order.
    """
    fields = V.TYPE_FIELDS[data_type]
    given = [m for m, of in ((columns.given_by_id, by_id), (columns.given_by_header, by_header)) if of is not None]
    maps = [m(cols, of) for m, of in zip(given, [x for x in (by_id, by_header) if x is not None], strict=True)]
    met, cells, there = columns.spread(rows, columns.in_force(*maps, columns.auto_mapping(cols, data_type)), fields)
    fills = {"fiscal_year": fiscal_year, "period": period}
    text = cells | {f: F.when(~there[f], F.lit(str(v))).otherwise(cells[f]) for f, v in fills.items() if v is not None}
    flat = _worked_out(met, ["sheet", "row", "extra_fields"], **text)
    text = {f: F.col(f) for f in fields}
    values = {f: v for f in fields if (v := parsed(f, text[f])) is not None}
    read = flat.withColumns({f"_{f}": v for f, v in values.items()})
    values = {f: F.col(f"_{f}") for f in values}
    checks = F.filter(F.array(*validation.standard_checks(data_type, text, values)), lambda e: e.isNotNull())
    checked = _worked_out(read, read.columns, errors=checks)
    zero = F.lit(0).cast(parsing.MONEY)
    typed = values | {f: F.when(text[f].isNotNull(), F.coalesce(v, zero)) for f, v in values.items() if f in AMOUNTS}
    valid, bad = validation.split_valid(checked)
    good = valid.select("sheet", "row", *(typed.get(f, text[f]).alias(f) for f in fields), "extra_fields")
    ok = F.size("errors") == 0
    if data_type == "journal":
        apart = balance.unbalanced_groups(good, ["sheet", "voucher_no"], "debit_amount", "credit_amount")
        sides = {f: F.when(ok, typed.get(f, text[f])) for f in ("voucher_no", "debit_amount", "credit_amount")}
    else:
        apart = good.filter("false").select("sheet", F.lit("").alias("voucher_no"))
        sides = {"voucher_no": F.lit(None).cast("string")} | {f: F.lit(None).cast(parsing.MONEY) for f in ("debit_amount", "credit_amount")}
    marked = checked.select("sheet", F.when(ok, 1).otherwise(0).alias("ok"), *(c.alias(f) for f, c in sides.items()))
    return Intake(good, bad.select("sheet", "row", "errors"), apart, marked)
