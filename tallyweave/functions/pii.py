"""Patterns for personal and confidential data in text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds and their patterns (Java syntax).
PATTERNS = {
    "id_card": r"(?<![A-Za-z0-9_-])\d{17}[\dXx](?![A-Za-z0-9_:-])",
    "mobile": r"(?<![A-Za-z0-9_-])1[3-9]\d{9}(?![A-Za-z0-9_:.])",
    "long_digits": r"(?<![A-Za-z0-9_-])\d{12,}(?![A-Za-z0-9_:-])",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "property_certificate": r"(?:不动产权|房产证|土地证)[^，。；;\n]{0,20}[A-Za-z0-9第\-]{6,}号?",
    "bank_branch": r"[一-鿿]{2,12}(?:银行|农商行|信用社|商业银行)[一-鿿A-Za-z0-9_]{0,20}(?:支行|分行|营业部)",
}
TAX_CONTEXT = "统一社会信用代码|纳税人识别号|税号"
TAX_ID = r"(?<![A-Za-z0-9])[A-Z0-9]{15,20}(?![A-Za-z0-9])"
# Signs of a text that lost its characters.
GARBLED = r"^[\s?？□◇◆○●]+$"


def _named(kind: str):
    return lambda value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def matches(text: Column, patterns: dict[str, str] = PATTERNS) -> Column:
    """An array of (kind, value) for every match; null text gives an empty array."""
    body = F.coalesce(text, F.lit(""))
    found = [F.transform(F.regexp_extract_all(body, F.lit(p), F.lit(0)), _named(k)) for k, p in patterns.items()]
    tax = F.when(body.rlike(TAX_CONTEXT), F.regexp_extract_all(body, F.lit(TAX_ID), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found.append(F.transform(tax, lambda v: F.struct(F.lit("tax_id").alias("kind"), v.alias("value"))))
    return F.flatten(F.array(*found))


def scan(rows: DataFrame, key: str, text: str, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """One row per match: key, kind, value. No shuffle."""
    return rows.select(key, F.inline(matches(F.col(text), patterns)))


def is_garbled(text: Column) -> Column:
    return F.coalesce(text.rlike(GARBLED), F.lit(False))
