"""Queries over the driver tables, one module for each part of the inventory."""

from __future__ import annotations

import importlib

MODULES = ("graph_queries", "audit_queries", "text_queries", "entity_queries", "claim_queries")


def load() -> None:
    """Registers the queries of all modules in the catalogue."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
