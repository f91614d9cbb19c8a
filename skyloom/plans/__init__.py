"""Queries over the given tables and multi-step jobs."""

from . import catalogue_queries, io_queries, learning_queries, series_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
