"""Registered queries over the given tables, each with the SQL it is checked against."""

from . import daily, deciding, paged, portals, reading, texts, tracking  # noqa: F401
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
