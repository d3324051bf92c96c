"""Days, windows and cadences; all times are UTC and the present is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hours to the next visit by tier; DISABLED is never visited.
CRAWL_HOURS = {"HOT": 8, "WARM": 24, "COOL": 168, "COLD": 720, "DORMANT": 2160}
MARKETING_HOURS = {"HOT": 24, "WARM": 72, "COOL": 168, "COLD": 720, "DORMANT": 2160}
WINDOW_DAYS = {"1d": 1, "7d": 7, "30d": 30, "90d": 90}


def day_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def hour_floor(ts: Column) -> Column:
    """The end of a metric window, so that recomputing within the hour changes nothing."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def day_floor(ts: Column) -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def month_floor(ts: Column) -> Column:
    return F.date_trunc("month", ts).cast("timestamp_ntz")


def in_window(ts: Column, start: Column, end: Column) -> Column:
    """start <= ts < end."""
    return (ts >= start) & (ts < end)


def days_remaining(until: Column, now: Column) -> Column:
    """Whole days left, a begun day counted."""
    return F.greatest(F.lit(0), F.ceil((F.unix_micros(until.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 86_400_000_000)).cast("long")


def after_hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours.cast("int"))


def next_after_success(now: Column, tier: Column, cadence: dict[str, int] = CRAWL_HOURS) -> Column:
    """Null for a tier that is never visited."""
    return after_hours(now, F.create_map(*[F.lit(x) for pair in cadence.items() for x in pair])[tier])


def next_after_failure(now: Column, streak: Column) -> Column:
    """1, 2, 4 hours and so on, 48 at most."""
    return after_hours(now, F.least(F.lit(48), F.pow(F.lit(2.0), F.greatest(F.lit(0), F.least(streak, F.lit(10)) - 1))))


def relative_time(then: Column, now: Column) -> Column:
    """``2 hours ago``, ``in 3 days``; null is ``never``."""
    ms = F.unix_millis(then.cast("timestamp")) - F.unix_millis(now.cast("timestamp"))
    size, future = F.abs(ms), ms > 0

    def said(length: int, unit: str) -> Column:
        n = F.floor(size / length + 0.5).cast("long")
        text = F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))
        return F.when(future, F.concat(F.lit("in "), text)).otherwise(F.concat(text, F.lit(" ago")))

    return (
        F.when(then.isNull(), "never")
        .when(size < 60_000, F.when(future, "in a moment").otherwise("just now"))
        .when(size < 3_600_000, said(60_000, "minute"))
        .when(size < 86_400_000, said(3_600_000, "hour"))
        .otherwise(said(86_400_000, "day"))
    )
