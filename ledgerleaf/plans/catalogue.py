"""All queries over the library's own operators, with their SQL."""

from __future__ import annotations

import importlib

#: Modules of this package that register queries.
MODULES = ("literature", "syncing", "ruling", "scheduling", "records", "matching", "storing")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"{__package__}.{name}"), what))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
