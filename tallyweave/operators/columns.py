"""Which column of an upload holds which field: automatic, suggested, learnt or given, and rows projected by it.

Columns are (sheet, index, header) and, where ids matter, column_id; a mapping is (sheet, field, index).
Headers are matched once for each distinct text; a sheet's columns are few and meet by grouping.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import vocabulary as V
from tallyweave.operators import headers


def type_fields(data_type: str) -> dict[str, tuple[str, ...]]:
    """The fields of an upload type in order, each with its header texts; a field without any is its own."""
    if data_type not in V.TYPE_FIELDS:
        raise ValueError(f"unknown type {data_type}; one of {', '.join(V.TYPE_FIELDS)}")
    return {f: V.FIELD_WORDS.get(f, (f,)) for f in V.TYPE_FIELDS[data_type]}


def auto_mapping(columns: DataFrame, data_type: str) -> DataFrame:
    """(sheet, field, index, header, score): the leftmost column that matches a field has it."""
    return headers.assign_fields(columns, headers.match_headers(columns, type_fields(data_type)))


def auto_match(columns: DataFrame, data_type: str) -> DataFrame:
    """Per sheet: ``matched`` (field to header), ``unmatched`` headers from left to right, ``missing`` required fields in order."""
    won = auto_mapping(columns, data_type).select("sheet", "index", "field")
    met = columns.join(won, ["sheet", "index"], "left")
    pairs = F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("index", "field", "header"))))
    rest = F.array_sort(F.collect_list(F.when(F.col("field").isNull(), F.struct("index", "header"))))
    per = met.groupBy("sheet").agg(pairs.alias("pairs"), rest.alias("rest"))
    required = F.array(*map(F.lit, V.REQUIRED_FIELDS[data_type]))
    return per.select("sheet", F.map_from_arrays("pairs.field", "pairs.header").alias("matched"), F.col("rest.header").alias("unmatched"), F.array_except(required, F.col("pairs.field")).alias("missing"))


def given_by_header(columns: DataFrame, given: DataFrame) -> DataFrame:
    """(sheet, field, index) of a mapping (sheet, field, header): headers that the sheet does not have are dropped, of equal ones the first counts."""
    first = columns.groupBy("sheet", "header").agg(F.min("index").alias("index"))
    return given.join(first, ["sheet", "header"]).select("sheet", "field", "index").dropDuplicates(["sheet", "field"])


def given_by_id(columns: DataFrame, given: DataFrame) -> DataFrame:
    """(sheet, field, index) of a mapping (sheet, column_id, field); of several columns for a field the last counts."""
    met = given.join(columns.select("sheet", "column_id", "index"), ["sheet", "column_id"])
    return met.groupBy("sheet", "field").agg(F.max("index").alias("index"))


def in_force(*mappings: DataFrame) -> DataFrame:
    """The first of the mappings that names a column of a sheet holds for the whole sheet: ids, then headers, then the automatic one."""
    ranked = [m.select("sheet", "field", "index", F.lit(i).alias("tier")) for i, m in enumerate(mappings)]
    every = reduce(DataFrame.unionByName, ranked)
    return every.withColumn("best", F.min("tier").over(Window.partitionBy("sheet"))).filter("tier = best").select("sheet", "field", "index")


def projected(rows: DataFrame, mapping: DataFrame, into: str = "fields") -> DataFrame:
    """Rows (sheet, row, cells) as (sheet, row, a map from field to cell); what a row is too short for is left out."""
    pairs = F.array_sort(F.collect_list(F.struct("field", "index")))
    per = mapping.groupBy("sheet").agg(pairs.alias("pairs"))
    met = rows.join(per, "sheet", "left")
    there = F.filter(F.coalesce("pairs", F.array().cast("array<struct<field:string,index:int>>")), lambda p: p["index"] < F.size("cells"))
    cut = met.withColumn("pairs", there)
    return cut.select("sheet", "row", F.map_from_arrays("pairs.field", F.transform("pairs", lambda p: F.get("cells", p["index"]))).alias(into))


def spread(rows: DataFrame, mapping: DataFrame, fields: Iterable[str], extra: str = "extra_fields") -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """Rows with their sheet's mapping beside the cells; each field's text and whether it is there; other fields as a map ``extra``.

    A field is a cell at its own column of places, so that what asks for one field many times, or is
    pushed below by the optimizer, never builds a map again. Blank cells are left out of ``extra``.
    """
    fields = list(fields)
    at = {f: f"_at_{f}" for f in fields}
    rest = F.array_sort(F.collect_list(F.when(~F.col("field").isin(*fields), F.struct("field", "index"))))
    per = mapping.groupBy("sheet").agg(*(F.max(F.when(F.col("field") == f, F.col("index"))).alias(a) for f, a in at.items()), rest.alias("_rest"))
    met = rows.join(per, "sheet", "left")
    others = F.filter("_rest", lambda p: (p["index"] < F.size("cells")) & (F.coalesce(F.get("cells", p["index"]), F.lit("")) != ""))
    pairs = F.transform(others, lambda p: F.struct(p["field"].alias("key"), F.get("cells", p["index"]).alias("value")))
    made = F.map_from_entries(F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>"))).alias(extra)
    there = {f: F.coalesce(F.col(a) < F.size("cells"), F.lit(False)) for f, a in at.items()}
    return met.withColumn(extra, made), {f: F.get("cells", F.col(a)) for f, a in at.items()}, there


def keyword_suggestions(columns: DataFrame, data_type: str) -> DataFrame:
    """(sheet, column_id, target_field, source, confidence): what each column's header suggests, several columns the same field if need be."""
    matches = headers.match_headers(columns.filter(F.coalesce("header", F.lit("")) != ""), type_fields(data_type))
    return columns.join(matches, "header").select("sheet", "column_id", F.col("field").alias("target_field"), F.lit("keyword_match").alias("source"), F.round("score", 2).alias("confidence"))


def merged_suggestions(*sources: DataFrame) -> DataFrame:
    """One suggestion a column, from the first source that has one: experience before keywords."""
    tiers = reduce(DataFrame.unionByName, (s.select("sheet", "column_id", "target_field", "source", F.col("confidence").cast("double").alias("confidence"), F.lit(i).alias("tier")) for i, s in enumerate(sources)))
    order = Window.partitionBy("sheet", "column_id").orderBy("tier", F.desc("confidence"), "target_field")
    return tiers.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place", "tier")
