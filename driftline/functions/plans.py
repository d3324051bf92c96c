"""Plans: limits, the next plan, the end of a trial. A null limit is no limit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.config import PLAN_LIMITS, PLANS, TRIAL_DAYS


def plan_limit(plan: Column, what: str) -> Column:
    """The limit ``what`` (analyses, slots) of a plan; an unknown plan has that of the first."""
    table = F.create_map(*[x for p in PLANS for x in (F.lit(p), F.lit(PLAN_LIMITS[p][what]).cast("int"))])
    return F.coalesce(F.element_at(table, plan), F.lit(PLAN_LIMITS[PLANS[0]][what]).cast("int"))


def under_limit(count: Column, limit: Column) -> Column:
    return limit.isNull() | (count < limit)


def next_plan_up(plan: Column) -> Column:
    """The plan that an upgrade leads to; from the highest it stays."""
    out = F.lit(PLANS[-1])
    for p, q in zip(PLANS[:-1], PLANS[1:], strict=True):
        out = F.when(plan == p, q).otherwise(out)
    return out


def trial_end(period_end: Column, created_at: Column) -> Column:
    """The end of the running trial or, without one, TRIAL_DAYS after the account was made."""
    return F.coalesce(period_end, created_at + F.make_dt_interval(F.lit(TRIAL_DAYS)))
