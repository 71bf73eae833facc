"""Finding, merging and matching the headers of uploaded sheets.

A sheet is (sheet, row, cells), cells an array of strings, so that rows of unequal width survive.
Only the first ``MAX_SCAN`` rows of a sheet matter for its header.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import names as N
from tallyweave.functions import vocabulary as V
from tallyweave.functions.parsing import clean_header

MAX_SCAN = 15
# How far a header text may be from a known one.
THRESHOLD, CONTAINED = 0.6, 0.85


def cell_score(cell: Column) -> Column:
    text = F.trim(F.coalesce(cell, F.lit("")))
    return F.when(N.contains_any(text, V.HEADER_ANCHORS), 5).when(N.contains_any(text, V.HEADER_WORDS), 4).otherwise(0)


def looks_like_data(cells: Column) -> Column:
    """Whether a row holds a code, a bracketed detail or an indented company name."""
    suffix = "|".join(V.COMPANY_SUFFIXES)
    number = r"^[\s　]*\d+([.\-]?\d+)*[\s]*$"
    return F.coalesce(F.exists(cells, lambda c: c.rlike(number) | F.trim(c).startswith("[") | c.rlike(rf"^[ 　].*(\[|{suffix})")), F.lit(False))


def is_blank(cells: Column) -> Column:
    return ~F.coalesce(F.exists(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""), F.lit(False))


def header_area(rows: DataFrame) -> DataFrame:
    """(sheet, header_row, data_row): the best-scoring row, one with an anchor word first, and the first data row after it."""
    early = rows.filter(F.col("row") < MAX_SCAN)
    scored = early.select("sheet", "row", F.exists("cells", lambda c: N.contains_any(c, V.HEADER_ANCHORS)).alias("anchored"), F.aggregate("cells", F.lit(0), lambda s, c: s + cell_score(c)).alias("score"))
    main = scored.groupBy("sheet").agg(F.max_by("row", F.struct(F.coalesce("anchored", F.lit(False)), "score", -F.col("row"))).alias("header_row"))
    after = rows.join(main, "sheet").filter(F.col("row") > F.col("header_row"))
    data = after.filter(looks_like_data(F.col("cells"))).groupBy("sheet").agg(F.min("row").alias("data_row"))
    return main.join(data, "sheet", "left")


def densest_row(rows: DataFrame, scan: int = 5) -> DataFrame:
    """(sheet, header_row): the first row, unless another of the first ones has over 1.5 times its filled cells."""
    filled = rows.filter(F.col("row") < scan).select("sheet", "row", F.size(F.filter("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")).alias("n"))
    best = filled.groupBy("sheet").agg(F.max_by("row", F.struct("n", -F.col("row"))).alias("best"), F.max("n").alias("most"), F.max(F.when(F.col("row") == 0, F.col("n"))).alias("first"))
    return best.select("sheet", F.when(F.col("most") > 1.5 * F.coalesce("first", F.lit(0)), F.col("best")).otherwise(0).alias("header_row"))


def left_filled(cells: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Cells (one row each) with ``filled``: the last non-blank header to the left, or ''."""
    window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    bare = clean_header(F.col(value))
    return cells.withColumn("filled", F.coalesce(F.last(F.when(bare != "", bare), ignorenulls=True).over(window), F.lit("")))


def merged_headers(rows: DataFrame, area: DataFrame) -> DataFrame:
    """(sheet, index, header): the header rows of each column, left-filled and joined by _ without repeats."""
    inside = rows.join(area, "sheet").filter((F.col("row") >= F.col("header_row")) & (F.col("row") < F.coalesce("data_row", F.col("row") + 1)) & ~is_blank(F.col("cells")))
    cells = inside.select("sheet", "row", F.posexplode("cells").alias("index", "cell"))
    filled = left_filled(cells, ["sheet", "row"], "index", "cell").filter("filled <> ''")
    parts = filled.groupBy("sheet", "index").agg(F.array_sort(F.collect_list(F.struct("row", "filled"))).alias("parts"))
    return parts.select("sheet", "index", F.array_join(F.array_distinct(F.transform("parts", lambda p: p["filled"])), "_").alias("header"))


def describe_columns(headers: DataFrame, group: str, index: str, header: str) -> DataFrame:
    """Headers with column_id, occurrence and total among equal headers of the group."""
    same = Window.partitionBy(group, "normalized_header")
    named = headers.withColumn("normalized_header", F.trim(F.coalesce(header, F.lit(""))))
    marked = named.withColumns({"total": F.count(F.lit(1)).over(same), "occurrence": F.row_number().over(same.orderBy(index))})
    place = (F.col(index) + 1).cast("string")
    return marked.withColumn("column_id", F.concat(F.lit("col_"), F.when(F.length(place) < 3, F.lpad(place, 3, "0")).otherwise(place)))


def match_headers(headers: DataFrame, fields: dict[str, tuple[str, ...]] = V.FIELD_WORDS, veto: dict[str, tuple[str, ...]] = V.VETO_WORDS) -> DataFrame:
    """(header, field, score) of the best field of each distinct header; spellings are compared inside the workers."""

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for header in batch["header"]:
                text, best = header.strip().lower(), (0.0, None)
                for field, words in fields.items():
                    if any(v in text for v in veto.get(field, ())):
                        continue
                    for word in words:
                        score = N.ratio(text, word.lower())
                        if text and (word.lower() in text or text in word.lower()):
                            score = max(score, CONTAINED)
                        if score > best[0]:
                            best = (score, field)
                if best[0] >= THRESHOLD:
                    found.append((header, best[1], best[0]))
            yield pd.DataFrame(found, columns=["header", "field", "score"])

    return headers.select("header").filter("header is not null").distinct().mapInPandas(match, "header string, field string, score double")


def assign_fields(headers: DataFrame, matches: DataFrame) -> DataFrame:
    """One column per field: (sheet, field, index, header, score); the leftmost of several wins."""
    joined = headers.join(matches, "header")
    first = Window.partitionBy("sheet", "field").orderBy("index")
    return joined.withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place")


def data_rows(rows: DataFrame, area: DataFrame) -> DataFrame:
    """Rows after the header that are not blank, with ``row`` counted anew and null cells as ''."""
    kept = rows.join(area, "sheet").filter((F.col("row") >= F.col("data_row")) & ~is_blank(F.col("cells")))
    order = Window.partitionBy("sheet").orderBy("row")
    cells = F.transform("cells", lambda c: F.coalesce(c, F.lit("")))
    return kept.select("sheet", (F.row_number().over(order) - 1).alias("row"), cells.alias("cells"))


def project(rows: DataFrame, fields: dict[str, int]) -> DataFrame:
    """Columns by position; a row too short for one gives null."""
    return rows.select("sheet", "row", *(F.get("cells", F.lit(i)).alias(f) for f, i in fields.items()))


def pack_extras(rows: DataFrame, known: list[str], into: str = "extra_fields") -> DataFrame:
    """Unknown columns with a value as a map, the known ones as they are."""
    extras = [c for c in rows.columns if c not in known]
    pairs = F.map_from_arrays(F.array(*map(F.lit, extras)), F.array(*(F.col(c).cast("string") for c in extras))) if extras else F.create_map().cast("map<string,string>")
    return rows.select(*(c for c in rows.columns if c in known), F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != "")).alias(into))
