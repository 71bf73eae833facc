"""Deterministic keys of nodes, contexts and lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.names import node_text


def node_key(code: Column, name: Column, parent_path: Column, customer: Column | None = None) -> Column:
    """Equal for rows with equal customer, code, name and parent path after folding."""
    parts = [customer if customer is not None else F.lit(""), code, name, parent_path]
    return F.concat(F.lit("uak:v2:"), F.sha2(F.concat_ws("|", *map(node_text, parts)), 256))


def context_signature(previous: Column, current: Column, following: Column) -> Column:
    """The digest of a header and its neighbours; null neighbours are ''."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (previous, current, following))), 256)


def lookup_key(company: Column, data_type: Column, software: Column, layout: Column, header: Column, context: Column) -> Column:
    parts = [F.coalesce(company, F.lit("_global")), data_type, *(F.coalesce(c, F.lit("")) for c in (software, layout)), header, context]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 40)


def row_key(*parts: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
    return F.concat(F.lit("sha256:"), F.substring(digest, 1, 32))
