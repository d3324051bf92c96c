"""The shape of change events and what holds for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.config import BASE_SCORES
from driftline.functions import scoring

COLUMNS = ("store_id", "entity_type", "entity_key", "event_type", "old_value", "new_value", "headline", "significance", "backfilled", "occurred_at", "dedupe_key", "seq")


def draft(
    event_type: str,
    *,
    seq: int,
    entity_type: str,
    entity_key: Column,
    key_in_dedupe: Column | None = None,
    old: Column,
    new: Column,
    headline: Column,
    magnitude: Column,
    discriminator: Column,
    store_id: Column,
    relevance: Column | None = None,
    rarity: Column | None = None,
    cross: Column | None = None,
) -> Column:
    """One event as a struct. ``old`` and ``new`` are JSON texts or null."""
    one = F.lit(1.0)
    name = F.lit(event_type)
    score = scoring.significance(F.lit(float(BASE_SCORES[event_type])), magnitude, one if relevance is None else relevance, one if rarity is None else rarity, one if cross is None else cross)
    key = entity_key if key_in_dedupe is None else key_in_dedupe
    return F.struct(
        F.lit(entity_type).alias("entity_type"),
        entity_key.cast("string").alias("entity_key"),
        name.alias("event_type"),
        old.cast("string").alias("old_value"),
        new.cast("string").alias("new_value"),
        headline.alias("headline"),
        score.alias("significance"),
        scoring.dedupe_key(store_id, key, name, discriminator).alias("dedupe_key"),
        F.lit(seq).alias("seq"),
    )


def emitted(rows: DataFrame, drafts: list[Column], occurred_at: Column) -> DataFrame:
    """One row per event of ``rows``; a draft that is null is none."""
    some = rows.select("store_id", occurred_at.alias("occurred_at"), F.filter(F.array(*drafts), lambda e: e.isNotNull()).alias("events"))
    each = some.select("store_id", "occurred_at", F.inline("events")).withColumn("backfilled", F.lit(False))
    return each.select(*COLUMNS)


def capped(events: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most significant events of each store, ties by place, and how many were suppressed."""
    order = Window.partitionBy("store_id").orderBy(F.desc("significance"), "seq", "entity_key", "event_type")
    ranked = events.withColumn("place", F.row_number().over(order)).withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy("store_id")))
    kept = ranked.where(F.col("place") <= limit)
    return kept.withColumn("suppressed", F.greatest(F.lit(0), F.col("__all") - limit)).drop("__all", "place")


def appended(log: DataFrame, new: DataFrame) -> DataFrame:
    """The events of ``new`` whose key the log doesn't hold yet, once each."""
    return new.dropDuplicates(["dedupe_key"]).join(log.select("dedupe_key"), "dedupe_key", "left_anti").select(*new.columns)


def json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
