"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from . import queries_corpus, queries_tables, queries_texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
