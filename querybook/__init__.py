"""Runnable examples of every operator over the test tables, each with the SQL it should equal."""

from __future__ import annotations

from querybook import cleaning, filters, groups, numbers, shape, sources, steps, totals, windows
from querybook.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
