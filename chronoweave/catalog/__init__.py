"""Registered queries over the driver's tables, with the SQL that gives the same rows."""

from . import aggregates, rollups, storage, stored, transforms  # noqa: F401  they register themselves
from .base import ORACLES, QUERIES, Run, add

__all__ = ["ORACLES", "QUERIES", "Run", "add"]
