"""Account hierarchies: from code prefixes, indents or parent references, and sums over them.

Prefix relations are equi-joins on exploded prefixes, so they cost rows times code length
instead of rows squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import checkpointed


def prefixes(rows: DataFrame, key: str, code: str, least: int = 1) -> DataFrame:
    """(key, code, prefix) for every proper prefix of at least ``least`` characters."""
    known = rows.filter(F.length(code) > least)
    return known.select(key, code, F.explode(F.sequence(F.lit(least), F.length(code) - 1)).alias("n")).select(key, code, F.substring(F.col(code), F.lit(1), F.col("n")).alias("prefix"))


def ancestors(rows: DataFrame, key: str, code: str, least: int = 1) -> DataFrame:
    """(key, ancestor) for every other code that is a proper prefix."""
    codes = rows.select(F.col(code).alias("prefix")).distinct()
    return prefixes(rows, key, code, least).join(codes, "prefix").select(key, code, F.col("prefix").alias("ancestor"))


def by_code(rows: DataFrame, key: str, code: str, least: int = 1) -> DataFrame:
    """``rows`` with ``parent_code``, ``level``, ``is_leaf``, ``is_summary`` and ``path`` (ancestors, outermost first)."""
    up = ancestors(rows, key, code, least)
    chain = up.groupBy(key).agg(F.array_sort(F.collect_set("ancestor")).alias("path"))
    parents = up.select(F.col("ancestor").alias(code)).distinct().withColumn("is_summary", F.lit(True))
    found = rows.join(chain, key, "left").join(parents, code, "left")
    path = F.coalesce("path", F.array().cast("array<string>"))
    summary = F.coalesce("is_summary", F.lit(False))
    return found.withColumns(
        {"path": path, "parent_code": F.try_element_at(path, F.lit(-1)), "level": F.size(path) + 1, "is_summary": summary, "is_leaf": ~summary}
    )


def by_indent(rows: DataFrame, sheet: str, row: str, indent: str) -> DataFrame:
    """``rows`` with ``parent_row``, ``level`` and ``is_leaf`` from indents within each sheet.

    The parent is the last earlier row with a smaller indent; ``level`` is 1 for rows without
    one and the parent's level plus 1 otherwise. The open rows of a sheet form a stack of
    strictly growing indents, which is all that is kept while its rows pass in order: time is
    linear, and memory is the stack and one batch. Rows without an indent have no parent and
    are no one's; of equal row numbers the smaller indent comes first.
    """
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    kind = rows.schema[row].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, stack = object(), []
        for batch in batches:
            parents, levels = [], []
            for s, r, i in zip(*(batch.column(k).to_pylist() for k in (sheet, row, indent)), strict=True):
                if s != here:
                    here, stack = s, []
                while i is not None and stack and stack[-1][0] >= i:
                    stack.pop()
                parents.append(stack[-1][1] if stack and i is not None else None)
                levels.append(len(stack) + 1 if i is not None else 1)
                if i is not None:
                    stack.append((i, r))
            made = [pa.array(parents, batch.schema.field(row).type), pa.array(levels, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "parent_row", "level"])

    order = Window.partitionBy(sheet).orderBy(row, indent)
    following = F.lead(indent).over(order)
    marked = rows.withColumn("is_leaf", F.coalesce(following <= F.col(indent), F.lit(True)))
    placed = marked.repartition(sheet).sortWithinPartitions(sheet, row, indent)
    return placed.mapInArrow(walk, ", ".join([*names, "is_leaf boolean", f"parent_row {kind}", "level int"]))


def merged(levels: Column, *choices: tuple[Column, Column]) -> Column:
    """The first struct whose condition holds, in order of precedence."""
    found = None
    for condition, value in choices:
        found = F.when(condition, value) if found is None else found.when(condition, value)
    return found.otherwise(levels)


def closure(edges: DataFrame, child: str, parent: str, max_depth: int = 12) -> DataFrame:
    """(node, ancestor, distance) for every node and each of its ancestors, itself included.

    One join a level; a node is never entered twice, so cycles end. ``max_depth`` bounds the
    levels and deeper chains raise an error rather than being cut. Each level is written once,
    so that neither the next one nor the test for its end works it out again.
    """
    step = edges.select(F.col(child).alias("node"), F.col(parent).alias("up")).filter("up is not null")
    nodes = edges.select(F.col(child).alias("node")).union(step.select("up")).distinct()
    now = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"), F.array("node").alias("seen"))
    out = now
    for depth in range(1, max_depth + 1):
        now = now.join(step.withColumnRenamed("node", "ancestor"), "ancestor").filter(~F.array_contains("seen", F.col("up")))
        now = now.select("node", F.col("up").alias("ancestor"), F.lit(depth).alias("distance"), F.array_append("seen", F.col("up")).alias("seen"))
        now = checkpointed(now)
        if now.isEmpty():
            break
        out = out.union(now)
    else:
        raise ValueError(f"the hierarchy is deeper than {max_depth}")
    return out.drop("seen")


def sums_below(leaves: DataFrame, edges: DataFrame, row: str, parent: str, measures: list[str], max_depth: int = 30) -> DataFrame:
    """(row, measures...): for every row, the sums over the ``leaves`` at any depth below it, itself left out.

    Sums climb one level at a time, so that a level holds a row for each ancestor and not for each pair, and shrinks as it
    rises. Where sums still climb after ``max_depth`` levels, there is a circle or a chain too deep: what is below it, and that
    alone, goes through ``closure``, which enters no row twice and raises an error for the second. ``edges`` are read often.
    """
    edges = edges.filter(F.col(parent).isNotNull())
    held = edges.select(F.col(parent).alias(row)).distinct()
    links = checkpointed(edges.join(held, row, "left_semi"))
    up = lambda df: df.groupBy(F.col(parent).alias(row)).agg(*(F.sum(m).alias(m) for m in measures))
    out = now = checkpointed(up(leaves.join(edges, row)))
    for _ in range(max_depth):
        now = checkpointed(up(now.join(links, row)))
        if now.isEmpty():
            return out.groupBy(row).agg(*(F.sum(m).alias(m) for m in measures))
        out = out.union(now)
    odd = level = now.select(row)
    while not level.isEmpty():
        below = edges.join(level.withColumnRenamed(row, parent), parent, "left_semi").select(row).distinct()
        level = checkpointed(below.join(odd, row, "left_anti"))
        odd = odd.union(level)
    pairs = closure(edges.join(odd, row, "left_semi"), row, parent, max_depth).filter("distance > 0")
    found = up(leaves.join(pairs.select(F.col("node").alias(row), F.col("ancestor").alias(parent)), row))
    return found.union(sums_below(leaves, checkpointed(edges.join(odd, row, "left_anti")), row, parent, measures, max_depth))


def roll_up(entries: DataFrame, key: str, measures: list[str], up: DataFrame) -> DataFrame:
    """Sums of the measures and the entry count for every ancestor. Partial sums come before the shuffle."""
    own = entries.groupBy(key).agg(*(F.sum(m).alias(m) for m in measures), F.count(F.lit(1)).alias("entry_count"))
    joined = own.join(up, own[key] == up["node"])
    return joined.groupBy("ancestor").agg(*(F.sum(m).alias(m) for m in measures), F.sum("entry_count").alias("entry_count"))


def reconcile(parents: DataFrame, leaves: DataFrame, key: str, measures: list[str], tolerance: str = "0.01") -> DataFrame:
    """(key, measure, parent_amount, leaf_amount, difference) where a parent differs from its leaves."""
    cut = lambda df, name: df.groupBy(key).agg(*(F.sum(m).alias(m) for m in measures)).unpivot([key], measures, "measure", name)
    both = cut(parents, "parent_amount").join(cut(leaves, "leaf_amount"), [key, "measure"])
    apart = (F.col("parent_amount") - F.col("leaf_amount")).cast("decimal(30,2)")
    return both.withColumn("difference", apart).filter(F.abs("difference") > F.lit(tolerance).cast("decimal(20,2)"))


def longest_prefix_match(rows: DataFrame, key: str, code: str, chart: DataFrame, chart_code: str, least: int = 4, top: int = 3) -> DataFrame:
    """The ``top`` longest chart codes that are proper prefixes of each code, with ``rank``."""
    hits = prefixes(rows, key, code, least).join(chart.withColumnRenamed(chart_code, "prefix"), "prefix")
    order = Window.partitionBy(key).orderBy(F.length("prefix").desc(), "prefix")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
