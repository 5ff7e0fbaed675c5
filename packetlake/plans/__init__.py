"""Named queries over the canonical views."""

from __future__ import annotations

from importlib import import_module

MODULES = ("store_queries", "report_queries", "rule_queries", "alert_queries", "flow_queries", "correlation_queries", "stream_queries", "wire_queries")


def all_queries() -> tuple[dict, dict]:
    """(queries, SQL) of all modules, by name."""
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    from .catalog import ORACLES, QUERIES

    return QUERIES, ORACLES
