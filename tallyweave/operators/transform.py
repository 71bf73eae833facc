"""Uploaded balance rows as six amounts with a place in the hierarchy, and parents against the leaves below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.amounts import MONEY, split_amount
from tallyweave.functions.parsing import decimal_or_zero, to_decimal
from tallyweave.operators import hierarchy
from tallyweave.session import checkpointed

PERIODS = ("opening", "current", "ending")
MEASURES = tuple(f"{p}_{side}" for p in PERIODS for side in ("debit", "credit"))
TOTAL = "decimal(30,2)"


def _period(name: str, config: dict[str, str], standard_direction: str | None) -> tuple[dict[str, Column], Column, Column]:
    """The two amounts of a period, its warning and its error."""
    none, zero = F.lit(None).cast("string"), F.lit(0).cast(MONEY)
    if config["mode"] == "two_column":
        side = lambda k: F.coalesce(to_decimal(F.col(config[k])), zero)
        return {f"{name}_debit": side("debit"), f"{name}_credit": side("credit")}, none, none
    text = F.trim(F.coalesce(F.col(config["amount"]).cast("string"), F.lit("")))
    value = to_decimal(F.col(config["amount"]))
    direction = config.get("direction") if config["mode"] == "single_by_source_direction" else standard_direction
    parts = split_amount(value, config["mode"], F.col(direction) if direction else None)
    unread = (text != "") & value.isNull()
    said = lambda c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c))
    warning = F.when(unread, f"{name}: no number").otherwise(said(parts["warning"]))
    return {f"{name}_debit": parts["debit"], f"{name}_credit": parts["credit"]}, warning, said(parts["error"])


def six_amounts(rows: DataFrame, configs: dict[str, dict[str, str]], standard_direction: str | None = None) -> DataFrame:
    """``rows`` with debit and credit of the three periods, ``warnings`` and ``errors`` (arrays of text).

    ``configs`` gives each period a mode and the columns it reads: ``debit`` and ``credit`` for
    two_column, else ``amount`` (and ``direction``). Periods without one are zero. Without any
    config the rows hold the six columns already, as text or numbers. Blank amounts are zero;
    what is no number is zero with a warning.
    """
    if not configs:
        empty = F.array().cast("array<string>")
        return rows.withColumns({m: decimal_or_zero(F.col(m)) for m in MEASURES} | {"warnings": empty, "errors": empty})
    amounts, warnings, errors = {m: F.lit(0).cast(MONEY) for m in MEASURES}, [], []
    for name, config in configs.items():
        made, warning, error = _period(name, config, standard_direction)
        amounts |= made
        warnings.append(warning)
        errors.append(error)
    kept = lambda found: F.array_compact(F.array(*found))
    return rows.withColumns(amounts | {"warnings": kept(warnings), "errors": kept(errors)})


def placed_rows(rows: DataFrame, row: str, code: str, sheet: str | None = None, indent: str | None = None, mode: str = "auto") -> DataFrame:
    """``rows`` with ``level``, ``parent_key``, ``is_leaf``, ``is_summary`` and ``level_source``.

    ``auto`` takes the code's prefixes where a row has a code, else its indent, else a flat
    place; ``code``, ``indent`` and ``flat`` take that one alone. ``parent_key`` is a code, or
    the parent's row as text. Nulls and blanks are no code.
    """
    spot = lambda level, parent, leaf, source: F.struct(level.cast("int").alias("level"), parent.cast("string").alias("parent_key"), leaf.alias("is_leaf"), (~leaf).alias("is_summary"), F.lit(source).alias("level_source"))
    flat = spot(F.lit(1), F.lit(None), F.lit(True), "flat")
    known, choices = rows.columns, []
    if mode in ("auto", "code"):
        rows = hierarchy.by_code(rows, row, code).drop("path", "is_summary").withColumnsRenamed({"level": "_code_level", "is_leaf": "_code_leaf", "parent_code": "_code_parent"})
        choices.append((F.trim(F.coalesce(code, F.lit(""))) != "", spot(F.col("_code_level"), F.col("_code_parent"), F.col("_code_leaf"), "code_prefix")))
    if mode in ("auto", "indent") and sheet and indent:  # last, so that the walk in Python is not repeated by the joins above
        rows = hierarchy.by_indent(rows, sheet, row, indent)
        choices.append((F.col(indent).isNotNull(), spot(F.col("level"), F.col("parent_row"), F.col("is_leaf"), "indent_suggested")))
    found = rows.select(*known, (hierarchy.merged(flat, *choices) if choices else flat).alias("_spot"))
    return found.select(*known, "_spot.*")


def transform_rows(rows: DataFrame, row: str, code: str, configs: dict[str, dict[str, str]], standard_direction: str | None = None, sheet: str | None = None, indent: str | None = None, mode: str = "auto") -> DataFrame:
    """``placed_rows`` and ``six_amounts`` in one plan; amounts are worked out last, on rows that move no more."""
    return six_amounts(placed_rows(rows, row, code, sheet, indent, mode), configs, standard_direction)


def leaf_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("is_leaf and not is_summary")


def summary_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("is_summary")


def blocking_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("errors") > 0)


def parent_differences(rows: DataFrame, row: str, code: str, tolerance: str = "0.01") -> DataFrame:
    """(row, measure, parent_amount, leaf_amount, difference) of rows that differ from the leaves at any depth below their code.

    The current period counts by side; opening and ending count as debit less credit, since a
    balance may lie on either side. Leaves lie in the order of their codes, so that a task sums nearly all of what
    is below a prefix before anything is shuffled.
    """
    valued, measures = _measured(rows, row, code)
    ordered = valued.filter("is_leaf").filter(F.length("code") > 1).repartitionByRange("code")
    above = ordered.select(F.explode(F.sequence(F.lit(1), F.length("code") - 1)).alias("n"), F.col("code").alias("below"), *measures)
    sums = above.groupBy(F.substring("below", F.lit(1), F.col("n")).alias("code")).agg(*(F.sum(m).cast(TOTAL).alias(f"_{m}") for m in measures))
    return _apart(valued.join(sums, "code"), row, measures, tolerance)


def resolved_parents(rows: DataFrame, row: str, code: str) -> DataFrame:
    """(row, parent_row) for rows with a ``parent_key``: the first row of that code or, for places by indent, the row so numbered.

    A key that is some row's code is that code, however much it looks like a row number.
    """
    coded = rows.filter(F.trim(F.coalesce(code, F.lit(""))) != "").groupBy(F.trim(code).alias("parent_key")).agg(F.min(row).alias("_coded"))
    met = rows.select(row, F.trim("parent_key").alias("parent_key"), "level_source").filter("parent_key is not null").join(coded, "parent_key", "left")
    numbered = F.when(F.col("level_source") == "indent_suggested", F.expr("try_cast(parent_key as bigint)"))
    return met.select(row, F.coalesce(F.col("_coded").cast("long"), numbered).alias("parent_row")).filter(F.col("parent_row") != F.col(row))


def _measured(rows: DataFrame, row: str, code: str, *more: str) -> tuple[DataFrame, list[str]]:
    """(row, code, is_leaf, ``more``, four measures) of each row, written once, and the names of the measures."""
    net = lambda p: F.col(f"{p}_debit") - F.col(f"{p}_credit")
    measures = {"opening_net": net("opening"), "current_debit": F.col("current_debit"), "current_credit": F.col("current_credit"), "ending_net": net("ending")}
    found = rows.select(F.col(row).alias("row"), F.col(code).alias("code"), "is_leaf", *more, *(v.cast(TOTAL).alias(k) for k, v in measures.items()))
    return checkpointed(found), list(measures)


def _apart(met: DataFrame, row: str, measures: list[str], tolerance: str) -> DataFrame:
    """Each measure that differs from its sum over leaves, which has ``_`` before the name."""
    parts = [F.struct(F.lit(m).alias("measure"), F.col(m).alias("parent_amount"), F.col(f"_{m}").alias("leaf_amount"), (F.col(m) - F.col(f"_{m}")).cast(TOTAL).alias("difference")) for m in measures]
    found = met.select("row", F.inline(F.array(*parts))).filter(F.abs("difference") > F.lit(tolerance).cast(MONEY))
    return found.withColumnRenamed("row", row)


def tree_differences(rows: DataFrame, row: str, code: str, max_depth: int = 30, tolerance: str = "0.01") -> DataFrame:
    """(row, measure, parent_amount, leaf_amount, difference) of rows that differ from all leaves below them, placed by code, indent or both in turn.

    As ``parent_differences``, but over the tree of ``resolved_parents``, which the sums of leaves climb level by level.
    """
    valued, measures = _measured(rows, row, code, "parent_key", "level_source")
    edges = checkpointed(resolved_parents(valued, "row", "code"))
    sums = hierarchy.sums_below(valued.filter("is_leaf").select("row", *measures), edges, "row", "parent_row", measures, max_depth)
    below = sums.select("row", *(F.col(m).cast(TOTAL).alias(f"_{m}") for m in measures))
    return _apart(valued.join(below, "row"), row, measures, tolerance)


def summary_reconciliation(rows: DataFrame, row: str, code: str, tolerance: str = "0.01") -> DataFrame:
    """(row, n_children, n_mismatches, warning) of rows that have children: their six amounts against the sums of their direct children.

    A measure counts as a mismatch where it differs by more than the tolerance. It only warns, since summaries make no entries.
    """
    amounts = rows.select(F.col(row).alias("row"), *(F.col(m).cast(TOTAL).alias(m) for m in MEASURES))
    edges = resolved_parents(rows, row, code).withColumnRenamed(row, "row")
    below = amounts.join(edges, "row").groupBy(F.col("parent_row").alias("row")).agg(F.count(F.lit(1)).alias("n_children"), *(F.sum(m).cast(TOTAL).alias(f"_{m}") for m in MEASURES))
    apart = sum((F.when(F.abs(F.col(m) - F.col(f"_{m}")) > F.lit(tolerance).cast(MONEY), 1).otherwise(0) for m in MEASURES), F.lit(0))
    met = amounts.join(below, "row").select(F.col("row").alias(row), "n_children", apart.alias("n_mismatches"))
    return met.withColumn("warning", F.when(F.col("n_mismatches") > 0, "summary_amount_mismatch"))
