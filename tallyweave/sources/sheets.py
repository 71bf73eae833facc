"""Uploaded sheets as rows of cells: (file, row_index, cells).

Every file is one row of Spark's binaryFile reader and is decoded by the task that has it, so
a folder with any number of uploads is read in parallel. A single csv file too large for one
task goes through ``large_csv``, where Spark splits it.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Encodings in the order in which they are tried; the last never fails.
ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "gb2312", "gb18030", "latin-1")
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Number formats of dates that workbooks need not define.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def decode(data: bytes, encoding: str | None = None) -> str:
    for name in (encoding, *ENCODINGS) if encoding else ENCODINGS:
        try:
            return data.decode(name).removeprefix("﻿")
        except (UnicodeDecodeError, LookupError):
            continue
    raise ValueError("no encoding fits")


def csv_cells(data: bytes, encoding: str | None = None) -> list[list[str]]:
    return [[c.strip() for c in row] for row in csv.reader(io.StringIO(decode(data, encoding), newline=""))]


def _number(text: str, is_date: bool) -> str:
    value = float(text)
    if is_date:
        day = datetime(1899, 12, 30) + timedelta(days=value)
        return day.strftime("%Y-%m-%d" if value == int(value) else "%Y-%m-%d %H:%M:%S")
    return str(int(value)) if value == int(value) else repr(value)


def _text(node: ElementTree.Element) -> str:
    """The text of all runs, without phonetic guides."""
    runs = [t.text or "" for t in node.findall(f"{MAIN}t")]
    return "".join(runs + [t.text or "" for r in node.findall(f"{MAIN}r") for t in r.findall(f"{MAIN}t")])


def _active_sheet(book: zipfile.ZipFile, parts: set[str]) -> str:
    """The part of the sheet that is shown on opening; where the workbook does not say, that of the lowest number."""
    numbered = sorted((p for p in parts if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", p)), key=lambda p: int(re.findall(r"\d+", p)[-1]))
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= parts:
        workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        view = next(workbook.iter(f"{MAIN}workbookView"), None)
        listed = [next((v for k, v in s.attrib.items() if k.endswith("}id")), None) for s in workbook.iter(f"{MAIN}sheet")]
        at = int(view.get("activeTab", 0)) if view is not None else 0
        target = targets.get(listed[at]) if at < len(listed) else None
        part = target.lstrip("/") if target and target.startswith("/") else f"xl/{target}"
        if part in parts:
            return part
    return numbered[0]


def xlsx_cells(data: bytes) -> list[list[str]]:
    """The active sheet's values; rows and cells that a workbook leaves out are filled with ''."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        parts = set(book.namelist())
        tree = lambda name: ElementTree.fromstring(book.read(name))
        shared = [_text(s) for s in tree("xl/sharedStrings.xml").findall(f"{MAIN}si")] if "xl/sharedStrings.xml" in parts else []
        dates: list[bool] = []
        if "xl/styles.xml" in parts:
            style = tree("xl/styles.xml")
            own = {int(f.get("numFmtId", 0)): re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")) for f in style.iter(f"{MAIN}numFmt")}
            used = [int(x.get("numFmtId", 0)) for xs in style.findall(f"{MAIN}cellXfs") for x in xs]
            dates = [i in DATE_FORMATS or bool(re.search("[yYdD]", own.get(i, ""))) for i in used]
        first = _active_sheet(book, parts)
        rows: list[list[str]] = []
        for row in tree(first).iter(f"{MAIN}row"):
            cells: list[str] = []
            for cell in row.findall(f"{MAIN}c"):
                letters = re.match("[A-Z]*", cell.get("r", ""))[0]
                at = 0
                for c in letters:
                    at = at * 26 + ord(c) - 64
                cells += [""] * (at - 1 - len(cells))
                value, kind = cell.findtext(f"{MAIN}v"), cell.get("t", "n")
                if kind == "inlineStr":
                    cells.append(_text(cell.find(f"{MAIN}is")))
                elif value is None or kind == "e":
                    cells.append("")
                elif kind == "s":
                    cells.append(shared[int(value)])
                elif kind == "b":
                    cells.append(str(value == "1"))
                else:
                    style_at = int(cell.get("s", 0))
                    cells.append(_number(value, style_at < len(dates) and dates[style_at]) if kind == "n" else value)
            rows += [[] for _ in range(int(row.get("r", len(rows) + 1)) - 1 - len(rows))]
            rows.append([c.strip() for c in cells])
    return rows


def cells_of(path: str, data: bytes, encoding: str | None = None) -> list[list[str]]:
    """By extension and content; blank rows are dropped."""
    if path.lower().endswith(".csv"):
        rows = csv_cells(data, encoding)
    elif path.lower().endswith(".xlsx") or data[:2] == b"PK":
        rows = xlsx_cells(data)
    else:
        raise ValueError(f"unsupported file type: {path}")
    return [r for r in rows if any(r)]


def read_sheets(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(file, row_index, cells) of every csv and xlsx file below ``path``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                rows = cells_of(file, bytes(data), encoding)
                yield pd.DataFrame({"file": file, "row_index": range(len(rows)), "cells": rows})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, row_index int, cells array<string>")


def large_csv(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(file, row_index, cells) of csv files that Spark splits; ``row_index`` follows the file.

    Every line is split by itself, so rows may differ in their number of cells (a title line
    above the table, say). Line breaks inside quotes cannot be told from row ends where files
    are split; such files go through ``read_sheets``.
    """
    lines = spark.read.option("encoding", encoding).text(path).select("value", F.col("_metadata.file_path").alias("file"))

    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = ([c.strip() for c in next(csv.reader([line.removeprefix("﻿")]), [])] for line in batch)
            yield pd.Series(list(rows), dtype=object)

    cells = F.pandas_udf(split, "array<string>")("value")
    placed = lines.select("file", F.monotonically_increasing_id().alias("_at"), cells.alias("cells"))
    kept = placed.filter(F.exists("cells", lambda c: c != ""))
    # places grow inside a partition and over partitions; counting needs each partition's start only
    part = F.shiftright("_at", 33)
    starts = kept.groupBy("file", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.withColumn("_before", before).withColumnRenamed("file", "_file")
    inside = Window.partitionBy("file", "_part").orderBy("_at")
    numbered = kept.withColumn("_part", part).withColumn("_nth", F.row_number().over(inside))
    joined = numbered.join(F.broadcast(starts.withColumnRenamed("_part", "_p")), (F.col("file") == F.col("_file")) & (F.col("_part") == F.col("_p")))
    return joined.select("file", (F.col("_before") + F.col("_nth") - 1).cast("long").alias("row_index"), "cells")


def write_batches(rows: DataFrame, path: str, by: str = "batch_id") -> None:
    """Replaces the batches that ``rows`` holds and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Files with a header that starts with a byte order mark, as spreadsheets expect it."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, f"\ufeff{first}").write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(path)
