"""Metric snapshots: long rows (key, dimension, window_start, window_end, value, computed_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["metric_key", "dimension", "window_start", "window_end"]


def long_rows(wide: DataFrame, metrics: dict[str, Column], dimension: Column, start: Column, end: Column, computed_at: Column, suffix: str = "") -> DataFrame:
    """Unpivot columns into metric rows; a missing ratio is stored as 0."""
    each = F.array(*[F.struct(F.lit(k + suffix).alias("metric_key"), F.coalesce(c.cast("double"), F.lit(0.0)).alias("value")) for k, c in metrics.items()])
    return wide.select(dimension.cast("string").alias("dimension"), start.alias("window_start"), end.alias("window_end"), computed_at.alias("computed_at"), F.inline(each)).select(*KEYS, "value", "computed_at")


def upserted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Of equal keys the row that was computed last."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("computed_at"), F.desc("value"))
    return stored.unionByName(new).withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def pruned(stored: DataFrame) -> DataFrame:
    """Of rolled-up metrics (``:1d`` and so on) only the newest window of each key and dimension stays."""
    newest = F.max("window_end").over(Window.partitionBy("metric_key", "dimension"))
    rolled = F.col("metric_key").rlike(r":(1|7|30|90)d$")
    return stored.withColumn("__newest", newest).where(~rolled | (F.col("window_end") == F.col("__newest"))).drop("__newest")


def due_by(stored: DataFrame, keys: list[str], now: Column, minutes: int = 55) -> DataFrame:
    """Per key (or in all) whether the last computation is long enough ago; where nothing was computed it is due."""
    last = F.max("computed_at")
    return stored.groupBy(*keys).agg(F.coalesce(last <= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)), F.lit(True)).alias("due"))


def latest_per_dimension(stored: DataFrame, metric_key: str) -> DataFrame:
    w = Window.partitionBy("dimension").orderBy(F.desc("window_end"), F.desc("computed_at"))
    return stored.where(F.col("metric_key") == metric_key).withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def retention_cohorts(stored: DataFrame) -> DataFrame:
    """Cohort metrics side by side, 0 by default."""
    names = {"retention.cohort_size": "cohort_size", "retention.ever_paid": "ever_paid", "retention.currently_paid": "currently_paid"}
    some = stored.where(F.col("metric_key").isin(*names))
    wide = some.groupBy("dimension").pivot("metric_key", list(names)).agg(F.max_by("value", "computed_at")).na.fill(0.0)
    return wide.select(F.col("dimension").alias("cohort"), *[F.col(f"`{k}`").alias(n) for k, n in names.items()])


def dashboard(stored: DataFrame) -> DataFrame:
    """The newest value of every metric and dimension, in one pass."""
    newest = stored.groupBy("metric_key", "dimension").agg(F.max_by("value", F.struct("window_end", "computed_at")).alias("value"), F.max("window_end").alias("window_end"))
    return newest
