"""Tolerant parsing of cells: numbers, dates and header texts that may be anything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.vocabulary import BLANK_AMOUNTS

MONEY = "decimal(20,2)"
# Accepted date patterns.
DATE_PATTERNS = ("yyyy-M-d", "yyyy/M/d", "yyyyMMdd", "yyyy年M月d日", "yyyy.M.d")
# What a text must hold for its pattern to fit at all: a failed parse costs an exception, a look at the text does not.
DATE_SIGNS = ("-", "/", r"^[+-]?\d+$", "年", r"\.")


def _digits(text: Column) -> Column:
    """Text as a number's text without separators, null where it has no digit: such a cast would throw inside, row by row."""
    bare = F.translate(F.trim(text.cast("string")), ",，", "")
    return F.when(bare.rlike(r"\p{Nd}"), bare)


def to_decimal(text: Column) -> Column:
    """Text as money; thousands separators go, and what is no number is null."""
    return _digits(text).try_cast(MONEY)


def decimal_or_zero(text: Column) -> Column:
    """As ``to_decimal``, but blanks, dashes and what is no number count as zero."""
    bare = F.trim(text.cast("string"))
    return F.when(bare.isin(*BLANK_AMOUNTS), F.lit(0).cast(MONEY)).otherwise(F.coalesce(to_decimal(text), F.lit(0).cast(MONEY)))


def to_int(text: Column) -> Column:
    """Text as a whole number, cut towards zero; null where it is no number or out of range."""
    return _digits(text).try_cast("double").try_cast("int")


def to_date(text: Column) -> Column:
    """The first date pattern that fits, else null."""
    bare = F.trim(text.cast("string"))
    return F.coalesce(*(F.when(bare.rlike(s), F.try_to_date(bare, p)) for p, s in zip(DATE_PATTERNS, DATE_SIGNS, strict=True)))


def clean_header(text: Column) -> Column:
    """A header without byte-order marks, zero-width blanks, outer white space and quotes; null is ''."""
    bare = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[﻿​]", "")
    return F.regexp_replace(F.btrim(bare), "^[\"']+|[\"']+$", "")
