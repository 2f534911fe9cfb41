"""All queries of the engine."""

from __future__ import annotations

from . import log, store, text, values  # noqa: F401  each enters its queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
