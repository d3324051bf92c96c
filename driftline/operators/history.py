"""Histories that hold a row only where something changed, and the state at any time.

A row is an interval: the state of a key from ``valid_from`` until ``valid_to``, which
is null while it lasts. Open intervals, one for each key, are kept apart from closed
ones, so that a crawl rewrites no more than the keys that it changes and appends to the rest.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = ("valid_from", "valid_to")


class History(NamedTuple):
    open: DataFrame
    closed: DataFrame


def begun(states: DataFrame, now: Column) -> History:
    """A history that begins now."""
    first = states.select("*", now.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return History(first, first.limit(0))


def advanced(history: History, states: DataFrame, changed: str, keys: list[str], now: Column) -> tuple[History, DataFrame]:
    """The history after a crawl, and the intervals that it closed, which is all that is appended to the closed ones.

    ``states`` has the columns of the history without its interval, and a boolean ``changed``: rows of
    which it isn't true add nothing, whatever they hold; neither do keys without a row. A key that the history lacks
    opens an interval. A second change at the time at which an interval began replaces it.
    """
    columns = [c for c in history.open.columns if c not in SPAN]
    values = [c for c in columns if c not in keys]
    new = states.where(F.coalesce(F.col(changed), F.lit(False))).select(*keys, F.lit(True).alias("__new"), *[F.col(c).alias(f"__n_{c}") for c in values])
    both = history.open.join(new, keys, "full_outer")
    fresh = F.col("__new").isNotNull()
    value = lambda c: F.when(fresh, F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c)
    still = both.select(*[F.col(c) if c in keys else value(c) for c in columns], F.when(fresh, now).otherwise(F.col("valid_from")).alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    ended = both.where(fresh & (F.col("valid_from") < now)).select(*columns, "valid_from", now.alias("valid_to"))
    return History(still, history.closed.unionByName(ended)), ended


def as_of(history: History, at: Column) -> DataFrame:
    """The state of each key at a time: that of the interval which holds it. The end of an interval belongs to the next."""
    rows = history.open.where(F.col("valid_from") <= at).unionByName(history.closed.where((F.col("valid_from") <= at) & (F.col("valid_to") > at)))
    return rows.drop(*SPAN)
