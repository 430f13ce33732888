"""All queries of the engine's core, by name, with their SQL equivalents."""

from __future__ import annotations

import importlib

_MODULES = ("text_queries", "quality_queries", "catalog_queries", "retrieval_queries", "reference_queries", "record_queries")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in _MODULES:
    _module = importlib.import_module(f"leafmill.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
