"""All queries of the core operators by name, with their SQL."""

from __future__ import annotations

from . import aggregates, complete, domain, graphs, languages, lookups, more, parsing, ranks, rules, scalars, streams, vectors  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
