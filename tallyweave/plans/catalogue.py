"""The query catalogue: each name maps to a Spark query and, where SQL can say it, an oracle."""

from __future__ import annotations

from tallyweave.plans import accounts, advice, books, imports, intakes, ledger, mapping, previews, sheets, streams, trees, uploads, written

MODULES = (ledger, trees, mapping, sheets, streams, imports, books, accounts, advice, written, uploads, previews, intakes)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
