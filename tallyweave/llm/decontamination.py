"""Benchmark decontamination with DataFrame functions only.

Every test item is cut into windows of ``WINDOW`` consecutive normalised words (an item with
fewer words is one window). The windows, each with the items that hold it, form a hash set
keyed by xxhash64; it is broadcast while it has at most MAX_BROADCAST_WINDOWS rows and is
joined by shuffle beyond. A document is exploded into its positions, each position's window is
hashed and looked up, and a hit counts once its words equal the window's. A document's first
position always survives the lookup and carries its word count, so one pass gives the facts of
every document and only light rows are shuffled.

A null or wordless document has 0 words and no hits; items without words are ignored. Items
that repeat share their windows. Rows that repeat id and text come back as often as they were
there. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import checkpointed, lower_ascii

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: About 100 bytes a row: some 100 MB.
MAX_BROADCAST_WINDOWS = 1_000_000
#: Two numbers a row: some 50 MB. Beyond, the anti join shuffles.
MAX_BROADCAST_LEAKS = 1_000_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _gram(words: str, at: str, size: str) -> Column:
    return F.expr(f"slice({words}, {at} + 1, {size})")


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per distinct window: its hash ``gram_hash``, its words ``gram``, ``gram_size`` and the ``items`` with it."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
    sized = items.filter(F.size("words") > 0).withColumn("gram_size", F.least(F.lit(window), F.size("words")))
    at = sized.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("gram_size"))))
    grams = at.select("item", "gram_size", _gram("words", "at", "gram_size").alias("gram"))
    found = grams.groupBy("gram_size", "gram").agg(F.collect_set("item").alias("items"))
    return found.withColumn("gram_hash", F.xxhash64("gram"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: its id, ``n_words``, ``hits`` (array of position and size) and ``items`` (sorted)."""
    grams = checkpointed(benchmark_windows(benchmark, window=window))
    sizes = [r[0] for r in grams.select("gram_size").distinct().orderBy("gram_size").collect()]  # at most ``window`` numbers
    small = grams.count() <= MAX_BROADCAST_WINDOWS
    worded = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_text"), words_of(F.col(text)).alias("words"))
    if not small:
        worded = worded.repartition("_id", "_text")
    spots = worded.select("_id", "_text", "words", F.posexplode_outer("words").alias("at", "word"))
    spots = spots.withColumn("at", F.coalesce("at", F.lit(0))).withColumn("n_words", F.size("words"))
    lookups = []
    for size in sizes or [window]:
        here = spots.withColumns({"size": F.lit(size), "here": _gram("words", "at", str(size))})
        lookups.append(here.withColumn("here_hash", F.xxhash64("here")).withColumn("first", (F.col("at") == 0) & F.lit(size == (sizes or [window])[0])))
    rows = lookups[0]
    for more in lookups[1:]:
        rows = rows.unionByName(more)
    side = F.broadcast(grams) if small else grams
    same = (F.col("here_hash") == F.col("gram_hash")) & (F.col("here") == F.col("gram"))
    looked = rows.join(side, same, "left").filter(F.col("first") | F.col("gram_hash").isNotNull())
    hit = F.when(F.col("gram_hash").isNotNull(), F.struct("at", "size"))
    facts = looked.select("_id", "_text", F.when(F.col("first"), F.col("n_words")).alias("n_words"), F.col("first").cast("int").alias("first"), hit.alias("hit"), "items")
    per = facts.groupBy("_id", "_text").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum("first").alias("rows"),
        F.array_sort(F.collect_set("hit")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return per.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select(F.col("_id").alias(doc_id), "_text", "n_words", "hits", "items")


def covered(hits: Column) -> Column:
    """The number of word positions inside any hit."""
    spots = F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1)))
    return F.size(F.array_distinct(spots)).cast("long")


def leak_report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_leaks(docs, benchmark, doc_id, text)
    return found.select(
        doc_id,
        "n_words",
        covered(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that hold any window of the benchmark; other columns pass through."""
    leaks = find_leaks(docs, benchmark, doc_id, text).filter(F.size("hits") > 0).select(F.col(doc_id).alias("_leak_id"), F.col("_text").alias("_leak_text")).distinct()
    leaks = checkpointed(leaks)
    if leaks.count() <= MAX_BROADCAST_LEAKS:
        leaks = F.broadcast(leaks)
    same = F.col(doc_id).eqNullSafe(F.col("_leak_id")) & (F.xxhash64(text) == F.col("_leak_text"))
    return docs.join(leaks, same, "left_anti")
