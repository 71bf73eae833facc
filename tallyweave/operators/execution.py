"""Writing imports: what holds a batch back, the entries of batches that pass, and their outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY, TOTAL = "decimal(20,2)", "decimal(30,2)"
# States from which a batch may be executed.
OPEN_STATES = ("previewed", "analyzed", "blocked")


def gate_faults(batches: DataFrame, rows: DataFrame, measures: list[str], tolerance: str = "0.01") -> DataFrame:
    """(batch, gate, n_faults) of every gate that a batch fails.

    ``batches``: batch, state, fiscal_year, period, confirmed (its warnings). ``rows``: batch,
    row_class, target, n_errors, n_warnings and the measures. Gates, in order: state, period,
    errors, warnings (unless confirmed), unresolved (eligible rows without a target), empty (no
    entry at all) and one for each measure whose business total is not what entries and ignored
    rows hold. All from one grouping of the rows by batch, with partial sums.
    """
    eligible, resolved = F.col("row_class") == "eligible", F.col("target").isNotNull()
    business = F.col("row_class").isin("eligible", "ignored")
    entry = eligible & resolved
    total = lambda when, m: F.coalesce(F.sum(F.when(when, F.col(m))), F.lit(0)).cast(TOTAL)
    gaps = [F.abs(total(business, m) - total(entry, m) - total(F.col("row_class") == "ignored", m)).alias(f"gap_{m}") for m in measures]
    counts = rows.groupBy("batch").agg(
        F.count_if(F.col("n_errors") > 0).alias("errors"), F.count_if(F.col("n_warnings") > 0).alias("warnings"), F.count_if(eligible & ~resolved).alias("unresolved"), F.count_if(entry).alias("entries"), *gaps
    )
    known = batches.join(counts, "batch", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    flag = lambda c: F.when(F.coalesce(c, F.lit(True)), 1).otherwise(0)
    gate = lambda name, n: F.struct(F.lit(name).alias("gate"), number(n).alias("n_faults"))
    found = [
        gate("state", flag(~F.col("state").isin(*OPEN_STATES))),
        gate("period", flag(F.col("fiscal_year").isNull() | F.col("period").isNull())),
        gate("errors", F.col("errors")),
        gate("warnings", F.when(~F.coalesce("confirmed", F.lit(False)), F.col("warnings"))),
        gate("unresolved", F.col("unresolved")),
        gate("empty", flag(F.coalesce("entries", F.lit(0)) == 0)),
        *(gate(f"reconciliation of {m}", F.when(F.col(f"gap_{m}") > F.lit(tolerance).cast(MONEY), 1)) for m in measures),
    ]
    return known.select("batch", F.inline(F.array(*found))).filter("n_faults > 0")


def entries(rows: DataFrame, faults: DataFrame) -> DataFrame:
    """The eligible rows with a target, of batches without a fault."""
    ready = rows.filter((F.col("row_class") == "eligible") & F.col("target").isNotNull())
    return ready.join(faults.select("batch").distinct(), "batch", "left_anti")


def outcomes(batches: DataFrame, rows: DataFrame, faults: DataFrame) -> DataFrame:
    """(batch, outcome, n_gates, n_entries): imported, or blocked by so many gates and without entries."""
    failed = faults.groupBy("batch").agg(F.count(F.lit(1)).alias("n_gates"))
    made = entries(rows, faults).groupBy("batch").agg(F.count(F.lit(1)).alias("n_entries"))
    met = batches.select("batch").join(failed, "batch", "left").join(made, "batch", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return met.select("batch", F.when(F.col("n_gates").isNull(), "imported").otherwise("blocked").alias("outcome"), zero("n_gates"), zero("n_entries"))


def confirm_statistics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group: rows by mapping state, unresolved ones, and whether all may be confirmed and executed.

    ``rows`` have mapping_status, target, n_errors and warned (an unconfirmed warning).
    """
    state = lambda s: F.count_if(F.col("mapping_status") == s).alias(s)
    unresolved = F.count_if((F.col("mapping_status") != "ignored") & F.col("target").isNull())
    found = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), state("mapped"), state("ignored"), state("unmapped"), unresolved.alias("unresolved"), F.count_if(F.col("n_errors") > 0).alias("errors"), F.count_if("warned").alias("open_warnings")
    )
    ready = (F.col("unresolved") == 0) & (F.col("errors") == 0)
    return found.withColumns({"can_confirm": ready, "can_execute": ready & (F.col("open_warnings") == 0)})


def journal_split(rows: DataFrame, required: list[Column], names: list[str]) -> DataFrame:
    """``rows`` with ``missing``: the names, comma-joined, of required values that are null or blank; empty means valid."""
    blank = [F.when(F.trim(F.coalesce(c.cast("string"), F.lit(""))) == "", n) for c, n in zip(required, names, strict=True)]
    return rows.withColumn("missing", F.array_join(F.array_compact(F.array(*blank)), ","))


def entry_reconciliation(rows: DataFrame, entries: DataFrame, measures: list[str], by: str = "batch", tolerance: str = "0.01") -> DataFrame:
    """Per batch and measure, what the rows say against what was written: business, entries, ignored, zero, difference, reconciled.

    ``rows`` have row_class and the measures, ``entries`` (the rows written) the measures; either
    side is summed by itself, so a lost, doubled or changed entry shows. Business is eligible and ignored rows;
    difference is business less entries less ignored. Batches that only one side has are compared with nothing.
    """
    side = lambda c, m: F.coalesce(F.sum(F.when(F.col("row_class") == c, F.col(m))), F.lit(0)).cast(TOTAL)
    said = rows.groupBy(by).agg(*(side(c, m).alias(f"{c}_{m}") for m in measures for c in ("eligible", "ignored", "zero_amount")))
    written = entries.groupBy(by).agg(*(F.sum(m).cast(TOTAL).alias(f"written_{m}") for m in measures))
    met = said.join(written, by, "full")
    amount = lambda c: F.coalesce(c, F.lit(0).cast(TOTAL))
    business = lambda m: (amount(f"eligible_{m}") + amount(f"ignored_{m}")).cast(TOTAL)
    part = lambda m: F.struct(F.lit(m).alias("measure"), business(m).alias("business"), amount(f"written_{m}").alias("entries"), amount(f"ignored_{m}").alias("ignored"), amount(f"zero_amount_{m}").alias("zero"))
    flat = met.select(by, F.inline(F.array(*map(part, measures))))
    flat = flat.withColumn("difference", (F.col("business") - F.col("entries") - F.col("ignored")).cast(TOTAL))
    return flat.withColumn("reconciled", F.abs("difference") <= F.lit(tolerance).cast(MONEY))


def written_faults(rows: DataFrame, entries: DataFrame, chart: DataFrame, measures: list[str], classes: tuple[str, ...]) -> DataFrame:
    """(batch, gate, n_faults) of the gates over targets and over what was written, beside those of ``gate_faults``.

    ``rows``: batch, row_class, target, by_direction (an amount of it is split by the account's side)
    and the measures; ``entries``: batch and the measures; ``chart``: target, active, direction. Gates: ``target``
    (eligible rows mapped to an account that is unknown or not active), ``direction`` (split by the side of an account
    that has none), ``identity`` (leaves of no known class), ``entries`` (eligible rows and entries differ in number)
    and one for each measure that does not reconcile.
    """
    known = chart.select("target", "active", "direction", F.lit(True).alias("known"))
    eligible, mapped = F.col("row_class") == "eligible", F.col("target").isNotNull()
    usable = F.coalesce(F.col("known") & F.col("active"), F.lit(False))
    sided = F.trim(F.coalesce("direction", F.lit(""))) != ""
    counts = rows.join(known, "target", "left").groupBy("batch").agg(
        F.count_if(eligible & mapped & ~usable).alias("target"),
        F.count_if(eligible & mapped & F.coalesce("known", F.lit(False)) & F.coalesce("by_direction", F.lit(False)) & ~sided).alias("direction"),
        F.count_if(~F.coalesce(F.col("row_class").isin(*classes), F.lit(False))).alias("identity"),
        F.count_if(eligible).alias("_eligible"),
    )
    written = entries.groupBy("batch").agg(F.count(F.lit(1)).alias("_written"))
    met = counts.join(written, "batch", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    gate = lambda name, n: F.struct(F.lit(name).alias("gate"), zero(n).cast("long").alias("n_faults"))
    found = met.select("batch", F.inline(F.array(gate("target", F.col("target")), gate("direction", F.col("direction")), gate("identity", F.col("identity")), gate("entries", F.abs(zero("_eligible") - zero("_written"))))))
    gaps = entry_reconciliation(rows, entries, measures).filter("not reconciled").select("batch", F.concat(F.lit("reconciliation of "), "measure").alias("gate"), F.lit(1).cast("long").alias("n_faults"))
    return found.filter("n_faults > 0").unionByName(gaps)
