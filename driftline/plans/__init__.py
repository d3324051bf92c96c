"""Queries over the tables, registered by name."""

from driftline.plans import business, changes, expressions, reports, signals, storefronts, streams, upkeep  # noqa: F401
from driftline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
