"""Registered queries: every operator applied to the driver tables."""

from importlib import import_module

MODULES = ["filters", "columns", "lookups", "keyed", "verdict", "rollups", "sources", "models", "streams", "snapshot", "stored"]


def load() -> None:
    """Import the modules that register queries."""
    for name in MODULES:
        import_module(f"msgsieve.catalog.{name}_queries")
