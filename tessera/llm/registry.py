"""The queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

import importlib

#: One module for each operator; each has QUERIES and ORACLES.
MODULES = ("jaccard_join", "chaining", "langid", "bwt_dedup", "quality", "decontam", "toxicity", "toolcalls", "warc", "mixing")


def _all(field: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"tessera.llm.{name}"), field)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
