"""Registered queries over the test tables, each with the SQL it is compared with where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("pages", "findings", "joins", "ordered", "graph", "rewrites", "sources", "streams")


def load_all() -> None:
    """Import the query modules, which registers their queries."""
    for name in MODULES:
        import_module(f"folioscan.plans.{name}")
