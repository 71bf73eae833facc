"""What a person sees of an upload before it is imported: facts, columns with samples, first rows, and rows with faults.

Sheets are (sheet, row, cells) from any reader; the rows of a hundred uploads are one DataFrame. The first rows of each
sheet are taken with a limit inside every partition, so that only they are shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.parsing import clean_header
from tallyweave.operators import headers

PREVIEW_ROWS, SAMPLE_ROWS, FIRST_ROWS = 5, 3, 10
# The headers of a chart upload.
CHART_HEADERS = {"code": "科目代码", "name": "科目名称", "direction": "余额方向", "category": "科目类别"}


def _first(rows: DataFrame, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("sheet").orderBy("row"))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def _filled(rows: DataFrame) -> DataFrame:
    return rows.filter(~headers.is_blank(F.col("cells"))).withColumn("cells", F.transform("cells", lambda c: F.coalesce(c, F.lit(""))))


def file_info(rows: DataFrame) -> DataFrame:
    """Per sheet: ``headers``, ``n_columns``, ``n_rows`` and the first PREVIEW_ROWS rows as ``preview``.

    The header is the first row unless another of the first ones is much fuller; blank rows do not count. A sheet of one row has no rows.
    """
    at = headers.densest_row(rows)
    met = rows.join(at, "sheet")
    named = met.filter("row = header_row").select("sheet", F.transform("cells", clean_header).alias("headers"))
    below = _filled(met.filter("row > header_row"))
    counts = below.groupBy("sheet").agg(F.count(F.lit(1)).alias("n_rows"))
    shown = _first(below, PREVIEW_ROWS).groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("place", "cells")))["cells"].alias("preview"))
    none = F.array().cast("array<array<string>>")
    found = named.join(counts, "sheet", "left").join(shown, "sheet", "left")
    return found.select("sheet", "headers", F.size("headers").alias("n_columns"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("preview", none).alias("preview"))


class Loaded(NamedTuple):
    """``area``: (sheet, header_row, data_row, stored, fault); ``columns``: (sheet, index, header); ``data``: (sheet, row, cells) numbered anew."""

    area: DataFrame
    columns: DataFrame
    data: DataFrame


def load_rows(rows: DataFrame, stored: DataFrame | None = None) -> Loaded:
    """The headers and data of each sheet, by its stored configuration (sheet, header_row, data_start_row) or as found.

    A stored header row that the sheet does not have is a ``fault``, and the sheet has no data. Without a stored start the
    data begin below the stored header row, with neither where ``header_area`` finds them.
    """
    found = headers.header_area(rows)
    size = rows.groupBy("sheet").agg(F.max("row").alias("last"))
    area = size.join(found, "sheet", "left")
    if stored is not None:
        told = stored.select("sheet", F.col("header_row").alias("told_header"), F.col("data_start_row").alias("told_data"), F.lit(True).alias("stored"))
        area = area.join(told, "sheet", "left")
    else:
        area = area.withColumns({"told_header": F.lit(None).cast("int"), "told_data": F.lit(None).cast("int"), "stored": F.lit(None).cast("boolean")})
    head = F.coalesce("told_header", "header_row", F.lit(0)).cast("int")
    start = F.coalesce("told_data", F.when(F.col("told_header").isNotNull(), F.col("told_header") + 1), "data_row", head + 1)
    fault = F.when(F.col("told_header") > F.col("last"), F.concat(F.lit("the sheet has no row "), "told_header"))
    area = area.select("sheet", head.alias("header_row"), F.greatest(start, head + 1).cast("int").alias("data_row"), F.coalesce("stored", F.lit(False)).alias("stored"), fault.alias("fault"))
    good = area.filter("fault is null")
    # stored: that one row; found: all header rows up to the data, merged
    one = rows.join(good.filter("stored"), "sheet").filter("row = header_row").select("sheet", F.posexplode(F.transform("cells", clean_header)).alias("index", "header"))
    merged = headers.merged_headers(rows, good.filter("not stored").select("sheet", "header_row", "data_row"))
    return Loaded(area, one.unionByName(merged), headers.data_rows(rows, good.select("sheet", "header_row", "data_row")))


def with_samples(columns: DataFrame, data: DataFrame) -> DataFrame:
    """Columns described (column_id, occurrence and total among equal headers) with ``samples``: their cells in the first SAMPLE_ROWS rows."""
    described = headers.describe_columns(columns, "sheet", "index", "header")
    early = _first(data, SAMPLE_ROWS).groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("place", "cells")))["cells"].alias("early"))
    none = F.array().cast("array<array<string>>")
    sampled = F.transform(F.coalesce("early", none), lambda cells: F.coalesce(F.trim(F.get(cells, F.col("index"))), F.lit("")))
    return described.join(early, "sheet", "left").withColumn("samples", sampled).drop("early")


def first_rows(columns: DataFrame, data: DataFrame, n: int = FIRST_ROWS) -> DataFrame:
    """(sheet, total_rows, sample_rows): the first rows as maps from column id to cell."""
    ids = F.transform("cells", lambda _, i: F.concat(F.lit("col_"), F.lpad((i + 1).cast("string"), 3, "0")))
    shown = _first(data, n).select("sheet", "place", F.map_from_arrays(ids, F.col("cells")).alias("cells"))
    lists = shown.groupBy("sheet").agg(F.sort_array(F.collect_list("place")).alias("places"), F.collect_list(F.struct("place", "cells")).alias("found"))
    ordered = F.transform("places", lambda p: F.get(F.filter("found", lambda f: f["place"] == p), F.lit(0))["cells"])
    counts = data.groupBy("sheet").agg(F.count(F.lit(1)).alias("total_rows"))
    return columns.select("sheet").distinct().join(counts, "sheet", "left").join(lists.select("sheet", ordered.alias("sample_rows")), "sheet", "left").withColumn("total_rows", F.coalesce("total_rows", F.lit(0)))


def scan_chart(rows: DataFrame) -> DataFrame:
    """A chart upload: (sheet, row, code, name, direction, category, error), good rows and bad ones in one.

    The first row of a sheet is its header, columns in any order, the leftmost of equal ones; ``row`` counts the other rows that are
    not blank from 0. A row without a code is an error, one without a code and name is skipped; a sheet
    that names neither column is one error with a null row.
    """
    head = rows.filter("row = 0").select("sheet", F.transform("cells", clean_header).alias("heads"))
    spot = lambda h: F.when(F.array_position("heads", h) > 0, F.array_position("heads", h) - 1).cast("int")
    at = head.select("sheet", *(spot(h).alias(f"at_{k}") for k, h in CHART_HEADERS.items()))
    lacking = F.col("at_code").isNull() & F.col("at_name").isNull()
    place = F.row_number().over(Window.partitionBy("sheet").orderBy("row")) - 1
    cell = lambda k: F.coalesce(F.trim(F.get("cells", F.col(f"at_{k}"))), F.lit(""))
    body = _filled(rows.filter("row > 0")).withColumn("row", place).join(at.filter(~lacking), "sheet").withColumns({k: cell(k) for k in CHART_HEADERS})
    body = body.filter("code <> '' or name <> ''")
    error = F.when(F.col("code") == "", F.concat(F.lit("line "), F.col("row") + 2, F.lit(" has no code; its name is "), F.col("name")))
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    good = body.select("sheet", "row", "code", "name", blank("direction"), blank("category"), error.alias("error"))
    empty = lambda c: F.lit(None).cast("string").alias(c)
    bad = at.filter(lacking).select("sheet", F.lit(None).cast("int").alias("row"), *map(empty, CHART_HEADERS), F.lit("neither code nor name among the headers").alias("error"))
    return good.unionByName(bad)


def accounts_and_errors(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    return scanned.filter("error is null").drop("error"), scanned.filter("error is not null").select("sheet", "row", "error")


def joined(cells: Column | str, by: str = "|") -> Column:
    return F.array_join(cells, by)
