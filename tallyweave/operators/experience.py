"""Mapping experience: picking the best, and merge-style writes as new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.vocabulary import AMBIGUOUS_HEADERS


def best_experience(wanted: DataFrame, known: DataFrame, company: Column) -> DataFrame:
    """(column_id, target_field, source, confidence) of the best experience for each column.

    ``wanted``: column_id, header, context. ``known``: header, context, company (null: global),
    target_field, successes, updated, experience_id. Context beats header, the company's own
    beats global ones; ambiguous headers need the context.
    """
    joined = wanted.join(known.withColumnRenamed("context", "known_context"), "header").filter(F.col("company").isNull() | (F.col("company") == company))
    same = F.col("context") == F.col("known_context")
    own = F.col("company").isNotNull()
    tier = F.when(own & same, 1).when(same, 2).when(own, 3).otherwise(4)
    usable = joined.withColumn("tier", tier).filter((F.col("tier") <= 2) | ~F.col("header").isin(*AMBIGUOUS_HEADERS))
    order = Window.partitionBy("column_id").orderBy("tier", F.col("successes").desc(), F.col("updated").desc(), "experience_id")
    best = usable.withColumn("place", F.row_number().over(order)).filter("place = 1")
    confidence = F.element_at(F.array(*map(F.lit, (1.0, 0.9, 0.85, 0.75))), F.col("tier"))
    source = F.when(F.col("tier").isin(1, 3), "company_experience").otherwise("global_experience")
    return best.select("column_id", "target_field", source.alias("source"), confidence.alias("confidence"))


def upsert_mappings(held: DataFrame, incoming: DataFrame, key: str, target: str, overwrite: bool = False) -> DataFrame:
    """The new snapshot: (key, target, uses, confidence, active, action).

    An equal target counts one use more and keeps the higher confidence. A different one is a
    conflict that leaves the old, or with ``overwrite`` retires the old row and adds a new one.
    Repeated incoming rows of a key count as one, the smallest target first.
    """
    new = incoming.groupBy(key).agg(F.min_by(F.struct(target, "confidence"), F.struct(target, "confidence")).alias("new"))
    both = held.filter("active").withColumn("_held", F.lit(True)).join(new, key, "full_outer")
    old_rows = held.filter("not active").select(key, target, "uses", "confidence", "active", F.lit("retired").alias("action"))
    same = F.col(target).eqNullSafe(F.col(f"new.{target}"))
    kind = F.when(F.col("new").isNull(), "unchanged").when(F.col("_held").isNull(), "inserted").when(same, "reused").otherwise("replaced" if overwrite else "conflict")
    acted = both.withColumn("action", kind)
    fresh = F.struct(F.col(f"new.{target}").alias(target), F.lit(1).cast("long").alias("uses"), F.col("new.confidence").alias("confidence"), F.lit(True).alias("active"), F.col("action").alias("action"))
    kept = F.struct(F.col(target), F.col("uses").cast("long").alias("uses"), F.col("confidence"), F.lit(True).alias("active"), F.col("action").alias("action"))
    more = F.struct(F.col(target), (F.col("uses") + 1).cast("long").alias("uses"), F.greatest("confidence", "new.confidence").alias("confidence"), F.lit(True).alias("active"), F.col("action").alias("action"))
    gone = F.struct(F.col(target), F.col("uses").cast("long").alias("uses"), F.col("confidence"), F.lit(False).alias("active"), F.lit("retired").alias("action"))
    rows = F.when(F.col("action") == "inserted", F.array(fresh)).when(F.col("action") == "reused", F.array(more)).when(F.col("action") == "replaced", F.array(gone, fresh)).otherwise(F.array(kept))
    return acted.select(key, F.inline(rows)).unionByName(old_rows)


def batch_upsert(held: DataFrame, incoming: DataFrame, target: str) -> DataFrame:
    """``incoming`` (code, name, target, overwrite) with the held row it meets, as ``held_target``, and ``action``.

    A held row is met by code and name, else by code alone (its name empty), else by name alone
    (its code empty). ``action``: no_identifier, created, reused, conflict or replaced. Three
    equi-joins; held keys are unique after trimming, the smallest target first.
    """
    trimmed = lambda c: F.coalesce(F.trim(c), F.lit(""))
    old = held.select(trimmed("code").alias("_c"), trimmed("name").alias("_n"), F.col(target).alias("_t")).groupBy("_c", "_n").agg(F.min("_t").alias("_t"))
    found = incoming.withColumns({"_code": trimmed("code"), "_name": trimmed("name")})
    met = []
    for i, (code, name) in enumerate(((F.col("_code"), F.col("_name")), (F.col("_code"), F.lit("")), (F.lit(""), F.col("_name")))):
        side = old.select(F.col("_c").alias(f"_c{i}"), F.col("_n").alias(f"_n{i}"), F.struct(F.col("_t").alias("target")).alias(f"_met{i}"))
        found = found.join(side, (code == F.col(f"_c{i}")) & (name == F.col(f"_n{i}")) & ((code != "") | (name != "")), "left").drop(f"_c{i}", f"_n{i}")
        met.append(f"_met{i}")
    hit = F.coalesce(*met)
    action = (
        F.when((F.col("_code") == "") & (F.col("_name") == ""), "no_identifier")
        .when(hit.isNull(), "created")
        .when(hit["target"].eqNullSafe(F.col(target)), "reused")
        .when(F.col("overwrite"), "replaced")
        .otherwise("conflict")
    )
    return found.withColumns({"held_target": hit["target"], "action": action}).drop("_code", "_name", *met)


# Targets that name no field, and the confirmations that count.
NO_FIELD = ("ignore", "__ignore__", "")
CONFIRMED = ("user_confirmed", "user_corrected")


def upsert_field_experience(held: DataFrame, confirmed: DataFrame, fields: list[str]) -> DataFrame:
    """The new snapshot: (lookup_key, target_field, use_count, success_count, conflict_count, active, action).

    ``confirmed``: lookup_key, header, target_field, confirmation. Only what a person confirmed
    or corrected, for one of ``fields`` and with a header, counts. The same target adds a use
    and a success to the active row; another one adds a use and a conflict, retires it and puts
    a new row beside it. Several confirmations of a key count as one, the smallest target.
    """
    usable = ~F.col("target_field").isin(*NO_FIELD) & F.col("target_field").isin(*fields) & F.col("confirmation").isin(*CONFIRMED) & (F.coalesce("header", F.lit("")) != "")
    new = confirmed.filter(usable).groupBy("lookup_key").agg(F.min("target_field").alias("_new"))
    counts = ("use_count", "success_count", "conflict_count")
    shown = ("lookup_key", "target_field", *counts, "active")
    old = held.filter("active").withColumn("_held", F.lit(True)).join(new, "lookup_key", "full_outer")
    kind = F.when(F.col("_new").isNull(), "unchanged").when(F.col("_held").isNull(), "created").when(F.col("target_field") == F.col("_new"), "reused").otherwise("replaced")
    acted = old.withColumn("_kind", kind)

    def row(target: Column, add: tuple[int, int, int] | None, active: bool, action: Column | str) -> Column:
        number = (lambda c, n: F.col(c) + n) if add is not None else (lambda c, n: F.lit(n))
        values = [number(c, n).cast("long").alias(c) for c, n in zip(counts, add or (1, 1, 0), strict=True)]
        said = action if isinstance(action, Column) else F.lit(action)
        return F.struct(target.alias("target_field"), *values, F.lit(active).alias("active"), said.alias("action"))

    same, given = F.col("target_field"), F.col("_new")
    made = (
        F.when(F.col("_kind") == "unchanged", F.array(row(same, (0, 0, 0), True, "unchanged")))
        .when(F.col("_kind") == "reused", F.array(row(same, (1, 1, 0), True, "reused")))
        .when(F.col("_kind") == "created", F.array(row(given, None, True, "created")))
        .otherwise(F.array(row(same, (1, 0, 1), False, "retired"), row(given, None, True, "replaced")))
    )
    rest = held.filter("not active").select(*shown[:2], *(F.col(c).cast("long").alias(c) for c in counts), "active", F.lit("unchanged").alias("action"))
    return acted.select("lookup_key", F.inline(made)).unionByName(rest)


def upsert_in_order(held: DataFrame, confirmed: DataFrame, fields: list[str], order: str) -> DataFrame:
    """As ``upsert_field_experience``, but the confirmations of a key are worked off one after the other by ``order``, a column without ties.

    Equal targets in a row are one run: each adds a use and a success to it. A run ends where another target
    comes, which adds a use and a conflict and retires it; the first run goes on from the active row of the key, if it has the
    same target, and the last run is the active row afterwards. ``action``: unchanged, reused, retired or created.
    """
    usable = ~F.col("target_field").isin(*NO_FIELD) & F.col("target_field").isin(*fields) & F.col("confirmation").isin(*CONFIRMED) & (F.coalesce("header", F.lit("")) != "")
    counts = ("use_count", "success_count", "conflict_count")
    base = held.filter("active").select("lookup_key", F.col("target_field").alias("_held"), *(F.col(c).cast("long").alias(f"_{c}") for c in counts))
    by_key = Window.partitionBy("lookup_key").orderBy(order)
    steps = confirmed.filter(usable).select("lookup_key", "target_field", order).join(base.select("lookup_key", "_held"), "lookup_key", "left")
    before = F.coalesce(F.lag("target_field").over(by_key), F.col("_held"))
    steps = steps.withColumn("_new", F.when(F.col("target_field") == before, 0).otherwise(1))
    runs = steps.withColumn("run", F.sum("_new").over(by_key)).groupBy("lookup_key", "run").agg(F.first("target_field").alias("target_field"), F.count(F.lit(1)).alias("n"))
    last = runs.groupBy("lookup_key").agg(F.max("run").alias("last"))
    # run 0 is that of the row held before, whether or not anything was added to it
    kept = base.join(runs.filter("run = 0").select("lookup_key", "n"), "lookup_key", "left").join(last, "lookup_key", "left")
    n, ends = F.coalesce("n", F.lit(0)), F.coalesce(F.col("last") > 0, F.lit(False))
    more = F.when(ends, 1).otherwise(0)
    action = F.when(ends, "retired").when(n > 0, "reused").otherwise("unchanged")
    first = kept.select("lookup_key", F.col("_held").alias("target_field"), (F.col("_use_count") + n + more).alias("use_count"), (F.col("_success_count") + n).alias("success_count"), (F.col("_conflict_count") + more).alias("conflict_count"), (~ends).alias("active"), action.alias("action"))
    made = runs.filter("run > 0").join(last, "lookup_key").withColumn("ends", F.col("run") < F.col("last"))
    over = F.when(F.col("ends"), 1).otherwise(0)
    later = made.select("lookup_key", "target_field", (F.col("n") + over).alias("use_count"), F.col("n").alias("success_count"), over.cast("long").alias("conflict_count"), (~F.col("ends")).alias("active"), F.when(F.col("ends"), "retired").otherwise("created").alias("action"))
    rest = held.filter("not active").select("lookup_key", "target_field", *(F.col(c).cast("long").alias(c) for c in counts), "active", F.lit("unchanged").alias("action"))
    return first.unionByName(later).unionByName(rest)


def full_sync(held: DataFrame, incoming: DataFrame, key: str, columns: list[str], deactivate: bool = True) -> DataFrame:
    """The new snapshot with ``active`` and ``action``: created, updated, unchanged, reactivated, deactivated or kept."""
    old = held.select(key, *(F.col(c).alias(f"old_{c}") for c in columns), F.col("active").alias("was_active"), F.lit(True).alias("held"))
    new = incoming.select(key, *columns, F.lit(True).alias("given"))
    both = old.join(new, key, "full_outer")
    changed = ~F.lit(True)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    action = (
        F.when(F.col("held").isNull(), "created")
        .when(F.col("given").isNull(), F.when(F.col("was_active") & F.lit(deactivate), "deactivated").otherwise("kept"))
        .when(~F.col("was_active"), "reactivated")
        .when(changed, "updated")
        .otherwise("unchanged")
    )
    active = F.when(F.col("given").isNotNull(), True).otherwise(F.col("was_active") & (action != "deactivated"))
    shown = [F.when(F.col("given").isNotNull(), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in columns]
    return both.select(key, *shown, active.alias("active"), action.alias("action"))


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): added, removed or changed."""
    a = before.select(key, F.struct(*columns).alias("before"))
    b = after.select(key, F.struct(*columns).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change is not null")
