"""Every registered query of the library, with the SQL that checks it."""

from __future__ import annotations

import importlib

FLAGSHIP = "k14_study_next"
#: Modules with QUERIES (name to callable) and ORACLE (name to SQL).
MODULES = ["text", "tables", "units", "concepts", "srs", "knowledge", "search", "context", "streams", "layout"]


def _all(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"quirelight.plans.{name}"), attribute)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")
