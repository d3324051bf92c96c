"""Significance of an event and the key that keeps it from being told twice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.config import BASE_SCORES, PRICE_EVENTS, SATURATION


def base_score(event_type: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in BASE_SCORES.items() for x in pair])[event_type]


def relevance(rank: Column, price_cents: Column) -> Column:
    by_rank = F.when(rank.isNull(), 0.7).when(rank < 5, 1.6).when(rank < 15, 1.35).when(rank < 40, 1.15).when(rank < 100, 0.95).otherwise(0.8)
    return by_rank * F.when(price_cents > 15_000, 1.1).otherwise(1.0)


def rarity(event_type: Column, price_changes: Column, products_added: Column, crawls: Column) -> Column:
    """Rare moves of a store weigh more; 1 without five crawls of history."""
    moves = F.when(event_type.isin(*PRICE_EVENTS), price_changes).when(event_type.isin("PRODUCT_ADDED", "PRODUCT_REMOVED"), products_added)
    rate = F.try_divide(moves, crawls)
    known = F.when(rate <= 0.2, 1.4).when(rate <= 1, 1.15).when(rate <= 5, 0.9).otherwise(0.6)
    return F.when((crawls >= 5) & moves.isNotNull(), known).otherwise(1.0)


def cross_store(stores: Column) -> Column:
    return F.when(stores.isNull() | (stores < 2), 1.0).when(stores < 4, 1.25).when(stores < 8, 1.5).otherwise(1.75)


def significance(base: Column, magnitude: Column, relevance_: Column, rarity_: Column, cross: Column) -> Column:
    raw = base * (F.lit(0.6) + F.lit(0.8) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), magnitude))) * relevance_ * rarity_ * cross
    return F.floor(F.lit(100.0) * (F.lit(1.0) - F.exp(-raw / F.lit(SATURATION))) + F.lit(0.5)).cast("int")


def price_magnitude(pct: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(pct) / 0.5)


def rank_magnitude(places: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(places) / 20.0)


def dedupe_key(store_id: Column, entity_key: Column, event_type: Column, discriminator: Column) -> Column:
    parts = [c.cast("string") for c in (store_id, entity_key, event_type, discriminator)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 40)
