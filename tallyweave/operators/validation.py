"""Row validation: every row gets the list of what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import parsing


def required(field: str, text: Column) -> Column:
    return F.when(F.coalesce(F.trim(text.cast("string")), F.lit("")) == "", F.lit(f"{field}: missing"))


def numeric(field: str, text: Column, value: Column | None = None) -> Column:
    given = F.coalesce(F.trim(text.cast("string")), F.lit("")) != ""
    return F.when(given & (parsing.to_decimal(text) if value is None else value).isNull(), F.lit(f"{field}: not a number"))


def whole_between(field: str, text: Column, low: int, high: int, value: Column | None = None) -> Column:
    given = F.coalesce(F.trim(text.cast("string")), F.lit("")) != ""
    number = parsing.to_int(text) if value is None else value
    return F.when(given & number.isNull(), F.lit(f"{field}: not a whole number")).when(given & ~number.between(low, high), F.lit(f"{field}: out of range"))


def whole(field: str, text: Column, value: Column | None = None) -> Column:
    given = F.coalesce(F.trim(text.cast("string")), F.lit("")) != ""
    return F.when(given & (parsing.to_int(text) if value is None else value).isNull(), F.lit(f"{field}: not a whole number"))


def dated(field: str, text: Column, value: Column | None = None) -> Column:
    given = F.coalesce(F.trim(text.cast("string")), F.lit("")) != ""
    return F.when(given & (parsing.to_date(text) if value is None else value).isNull(), F.lit(f"{field}: not a date"))


def row_errors(rows: DataFrame, checks: list[Column], into: str = "errors") -> DataFrame:
    """``rows`` with the array of failed checks, in the order given. No shuffle."""
    return rows.withColumn(into, F.filter(F.array(*checks), lambda e: e.isNotNull()))


def split_valid(rows: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """Valid rows (without the error column) and rows in error."""
    return rows.filter(F.size(errors) == 0).drop(errors), rows.filter(F.size(errors) > 0)


def standard_checks(data_type: str, columns: dict[str, Column], values: dict[str, Column] | None = None) -> list[Column]:
    """The checks of an upload type over its mapped columns; ``values``: what is parsed already."""
    from tallyweave.functions.vocabulary import AMOUNT_FIELDS, REQUIRED_FIELDS

    absent, values = F.lit(None).cast("string"), values or {}
    checks = [required(f, columns.get(f, absent)) for f in REQUIRED_FIELDS[data_type]]
    checks += [numeric(f, columns[f], values.get(f)) for f in (*AMOUNT_FIELDS, "debit_amount", "credit_amount") if f in columns]
    for field, low, high in (("fiscal_year", 2000, 2100), ("period", 1, 12)):
        if field in columns:
            checks.append(whole_between(field, columns[field], low, high, values.get(field)))
    checks += [whole(f, columns[f], values.get(f)) for f in ("attachment_count", "account_level") if f in columns]
    if "voucher_date" in columns:
        checks.append(dated("voucher_date", columns["voucher_date"], values.get("voucher_date")))
    return checks


def missing_references(rows: DataFrame, reference: DataFrame, key: str, reference_key: str) -> DataFrame:
    """Rows whose key the reference lacks; null keys count as missing."""
    return rows.join(reference.select(F.col(reference_key).alias(key)).distinct(), key, "left_anti")
