"""Queries over the canonical views, with their SQL."""

from __future__ import annotations

from . import tables  # noqa: F401  (registers its queries)
from .oracle import ORACLE_SQL
from .queries import QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
