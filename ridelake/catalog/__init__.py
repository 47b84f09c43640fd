"""Registered queries over the sample tables, each with the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

_MODULES = [
    "text_queries",
    "demand_queries",
    "panel_queries",
    "calendar_queries",
    "backtest_queries",
    "drift_queries",
    "scenario_queries",
    "source_queries",
    "model_queries",
]


def load_queries():
    """All registered queries by name."""
    for module in _MODULES:
        import_module(f"ridelake.catalog.{module}")
    from ridelake.catalog.registry import QUERIES

    return QUERIES
