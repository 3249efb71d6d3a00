"""Operators composed into whole jobs, and their bindings to test tables."""

from importlib import import_module

_BINDINGS = ("queries_compare", "queries_graph", "queries_findings", "queries_imports", "queries_sources", "queries_prompts", "queries_report")


def load_queries():
    """All registered queries and their SQL."""
    for name in _BINDINGS:
        import_module(f"{__name__}.{name}")
    from .registry import ORACLES, QUERIES
    return QUERIES, ORACLES
