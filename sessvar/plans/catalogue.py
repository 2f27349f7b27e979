"""All queries over the domain operators, by name, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
import pkgutil

from . import registry


def _load() -> None:
    for module in pkgutil.iter_modules(importlib.import_module(__package__).__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__package__}.{module.name}")


def queries() -> dict:
    _load()
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return registry.SQL
