"""Mixing sources to target weights with DataFrame functions only.

One pass adds up each source's size. The targets are a share of a total, in proportion to
weights but at most ``max_repeats`` times the source's size; what a full source leaves is
shared among the others. That is one level L with target = min(cap, L * weight), found from
running sums over the sources ordered by cap/weight. A document of a source with rate
target/size is then taken floor(rate) times, and once more if a hash of its id and a seed
falls below the fraction.

Sizes of nulls and empty texts are 0. A null source is a source of its own; a source of size
0 gets target 0 and its documents are taken 0 times. Rows that repeat an id are taken or left
together. Only the per-source table (one row a source) is gathered in one task; documents are
not shuffled while that table has at most MAX_BROADCAST_SOURCES rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import checkpointed, uniform

WORD = r"[^\x20\x09-\x0D]+"
#: Up to this many sources the table of targets is broadcast; beyond, Spark joins by shuffle and splits hot sources.
MAX_BROADCAST_SOURCES = 100_000
#: Weights of the sources in order of their names, repeating.
CYCLE = (5, 2, 1)


def word_count(text: Column) -> Column:
    """The number of runs of anything but blank, tab, line feed, vertical tab, form feed and return."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weights(sources: DataFrame, source: str, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """One row per source with ``weight``: the cycle dealt out in code point order, null last."""
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    deal = F.array(*(F.lit(float(w)) for w in cycle))
    return sources.withColumn("weight", F.get(deal, place % len(cycle)))


def targets(sources: DataFrame, share: float, max_repeats: float) -> DataFrame:
    """``sources`` (with ``source_size`` and ``weight``) with ``target``."""
    everything = Window.partitionBy()
    order = Window.orderBy("fill", "source_size", "weight").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(float(max_repeats))
    filled = sources.withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(order), F.lit(0.0))
    weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    level = filled.withColumn("level", left / weight)
    # the sources below the level are full; levels fall from the first that is not, so its level is the largest
    fixed = level.withColumn("level", F.max(F.when(F.col("fill") >= F.col("level"), F.col("level"))).over(everything))
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return fixed.withColumn("target", target.cast("double")).drop("cap", "fill", "level")


def mix(docs: DataFrame, size: str = "size", source: str = "source", doc_id: str = "doc_id", share: float = 1.5, max_repeats: float = 2.0, seed: str = "mix", cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """``docs``, which has a column of sizes, with ``source_size``, ``target`` and ``copies``.

    Input columns with the three new names are replaced.
    """
    docs = docs.drop("source_size", "target", "copies")
    totals = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("source_size"))
    aims = checkpointed(targets(cycle_weights(totals, "_source", cycle), share, max_repeats).drop("weight"))
    if aims.count() <= MAX_BROADCAST_SOURCES:
        aims = F.broadcast(aims)
    joined = docs.join(aims, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (uniform(seed, F.col(doc_id)) < rate - F.floor(rate)).cast("int")
    return joined.withColumn("copies", (F.floor(rate) + extra).cast("int"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document ``copies`` times, without the helper columns."""
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("_copy", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, text: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with exactly the columns of ``docs``."""
    made = ("source_size", "target", "copies")
    kept = docs.select("*", F.struct(*docs.columns).alias("_row"), word_count(F.col(text)).alias("_size")).drop(*made)
    return repeated(mix(kept, size="_size", **options)).select("_row.*")
