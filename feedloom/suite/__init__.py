"""Registered queries over the given tables, each with its SQL equivalent."""

from feedloom.suite import catalog, cleaning, filtering, joining, lifecycle, profiling, quality, retrieval, routing  # noqa: F401
from feedloom.suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
