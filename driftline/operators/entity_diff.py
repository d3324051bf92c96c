"""Sets of named things (apps, pixels, payment providers, collections) against what was known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.config import ENTITY_MAGNITUDES, DiffConfig
from driftline.functions import scoring
from driftline.functions.time import day_bucket
from driftline.operators.events import draft, emitted

TECH_KINDS = ("APP", "PIXEL", "PAYMENT_PROVIDER")


def observed_entities(snapshots: DataFrame) -> DataFrame:
    """(store_id, kind, key, meta) from ``store_id``, ``tech`` (see functions.fingerprint) and ``collection_handles``."""
    named = lambda names, kind: F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"), F.lit(None).cast("string").alias("meta")))
    pixels = F.transform(F.map_entries(F.coalesce("tech.pixels", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lit("PIXEL").alias("kind"), e["key"].alias("key"), F.to_json(F.struct(e["value"].alias("id"))).alias("meta")))
    every = F.concat(named(F.col("tech.apps"), "APP"), pixels, named(F.col("tech.payment_providers"), "PAYMENT_PROVIDER"), named(F.col("collection_handles"), "COLLECTION"))
    return snapshots.select("store_id", F.inline(every))


def observed_kinds(headers: DataFrame) -> DataFrame:
    """(store_id, kind) of the kinds whose data was fetched at all."""
    tech = F.when(F.col("has_tech_data"), F.array(*[F.lit(k) for k in TECH_KINDS])).otherwise(F.array().cast("array<string>"))
    sets = F.when(F.col("has_collection_data"), F.array(F.lit("COLLECTION"))).otherwise(F.array().cast("array<string>"))
    return headers.select("store_id", F.explode(F.concat(tech, sets)).alias("kind"))


def _matched(observed: DataFrame, kinds: DataFrame, previous: DataFrame, stores: DataFrame) -> DataFrame:
    keys = ["store_id", "kind", "key"]
    now = observed.dropDuplicates(keys).select(*keys, F.col("meta").alias("o_meta"), F.lit(True).alias("here"))
    gate = kinds.select("store_id", "kind", F.lit(True).alias("fetched"))
    return previous.join(now, keys, "full_outer").join(gate, ["store_id", "kind"], "left").join(stores.select("store_id", "baselined"), "store_id")


def _missing(config: DiffConfig) -> tuple[Column, Column]:
    """Whether a known entity is missing now, and whether that confirms its removal."""
    gone = F.col("here").isNull() & (F.col("status") != "REMOVED") & F.col("fetched").isNotNull()
    return gone, gone & (F.col("missing_streak") + 1 >= config.removal_confirmations)


def entity_events(observed: DataFrame, kinds: DataFrame, previous: DataFrame, stores: DataFrame, now: Column, config: DiffConfig = DiffConfig()) -> DataFrame:
    """Added and removed entities of stores that have a baseline.

    What comes back is told only after a confirmed removal; a kind that wasn't
    fetched is left alone.
    """
    rows = _matched(observed, kinds, previous, stores.where("baselined"))
    kind, key, day = F.col("kind"), F.col("key"), day_bucket(now)
    known = F.col("status").isNotNull()
    added = F.col("here").isNotNull() & (~known | (F.col("status") == "REMOVED"))
    removed = _missing(config)[1]
    none = F.lit(None).cast("string")
    key_json = F.to_json(F.struct(key.alias("key")))
    merged = F.when(F.col("o_meta").isNull(), key_json).otherwise(F.to_json(F.map_concat(F.create_map(F.lit("key"), key), F.from_json("o_meta", "map<string,string>"))))
    # Headlines around the key.
    said = {
        "COLLECTION": ("New collection: ", "", "Collection removed: ", ""),
        "APP": ("Installed ", "", "Removed ", ""),
        "PIXEL": ("Added ", " pixel — likely opening a new ad channel", "Removed ", " pixel"),
        "PAYMENT_PROVIDER": ("Added ", " at checkout", "Removed ", " from checkout"),
    }
    drafts = []
    for name, (a, b, c, d) in said.items():
        for is_added in (True, False):
            made = draft(
                f"{name}_{'ADDED' if is_added else 'REMOVED'}",
                seq=7,
                entity_type="COLLECTION" if name == "COLLECTION" else "TECH",
                entity_key=F.concat(F.lit("pixel:"), key) if name == "PIXEL" else key,
                key_in_dedupe=key,
                old=none if is_added else key_json,
                new=merged if is_added else none,
                headline=F.concat(F.lit(a if is_added else c), key, F.lit(b if is_added else d)),
                magnitude=F.lit(ENTITY_MAGNITUDES[name]),
                discriminator=F.concat(key, F.when(F.lit(not is_added), ":removed").when(known, F.concat(F.lit(":added:"), day)).otherwise(":added")),
                store_id=F.col("store_id"),
                relevance=scoring.relevance(F.lit(None).cast("int"), F.lit(None).cast("int")),
            )
            drafts.append(F.when((kind == name) & (added if is_added else removed), made))
    return emitted(rows, drafts, now)


def next_entities(observed: DataFrame, kinds: DataFrame, previous: DataFrame, stores: DataFrame, now: Column, config: DiffConfig = DiffConfig()) -> DataFrame:
    """The known entities after the crawl; the last meta of an entity that isn't seen is kept."""
    rows = _matched(observed, kinds, previous, stores)
    here, (gone, confirmed) = F.col("here").isNotNull(), _missing(config)
    return rows.select(
        "store_id",
        "kind",
        "key",
        F.when(here, F.col("o_meta")).otherwise(F.col("meta")).alias("meta"),
        F.when(here, "ACTIVE").when(confirmed, "REMOVED").when(gone, "MISSING").otherwise(F.col("status")).alias("status"),
        F.when(here, F.lit(0)).when(gone, F.col("missing_streak") + 1).otherwise(F.col("missing_streak")).alias("missing_streak"),
        F.when(here, F.lit(None)).when(gone, F.coalesce("missing_since", now)).otherwise(F.col("missing_since")).alias("missing_since"),
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(here, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )
