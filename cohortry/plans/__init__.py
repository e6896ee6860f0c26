"""Registered queries."""

from . import cohorts, descriptive, medication  # noqa: F401  (registration)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
