"""Ads seen now against the ads that were known, matched to products by URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.config import DiffConfig
from driftline.functions import scoring
from driftline.functions.text import normalized_url, product_url
from driftline.functions.time import day_bucket
from driftline.operators.events import draft, emitted
from driftline.operators.state import last_of

FIELDS = ("destination_url", "advertiser_external_id", "advertiser_name", "format")
MATCH = ("matched_product_id", "match_method", "match_confidence")


def match_products(ads: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """Add the match columns: the product whose page is the ad's destination, or nulls.

    ``products``: store_id, external_id, handle and perhaps position, its place in the
    catalog; ``stores``: store_id, domain. Of products with the same page the last
    counts: by position, then by id.
    """
    place = F.col("position") if "position" in products.columns else F.lit(0)
    pages = products.join(stores.select("store_id", "domain"), "store_id").select("store_id", normalized_url(product_url(F.col("domain"), F.col("handle"))).alias("page"), "external_id", place.alias("position"))
    index = pages.where(F.col("page").isNotNull()).groupBy("store_id", "page").agg(F.max_by("external_id", F.struct("position", "external_id")).alias("matched_product_id"))
    found = ads.drop(*MATCH).withColumn("page", normalized_url(F.col("destination_url"))).join(index, ["store_id", "page"], "left")
    hit = F.col("matched_product_id").isNotNull()
    return found.withColumns({"match_method": F.when(hit, "EXACT_PRODUCT_URL"), "match_confidence": F.when(hit, "HIGH")}).drop("page")


def _matched(observed: DataFrame, previous: DataFrame) -> DataFrame:
    keys = ["store_id", "platform", "external_ad_id"]
    now = last_of(observed, keys).select(*keys, F.lit(True).alias("here"), *[F.col(c).alias(f"o_{c}") for c in (*FIELDS, "source_metadata", *MATCH)])
    return previous.join(now, keys, "full_outer")


def _snapshot(prefix: str) -> Column:
    names = ("destinationUrl", "advertiserExternalId", "advertiserName", "format")
    return F.to_json(F.struct(*[F.col(prefix + c).alias(n) for c, n in zip(FIELDS, names, strict=True)]), {"ignoreNullFields": "false"})


def ad_events(observed: DataFrame, previous: DataFrame, now: Column, config: DiffConfig = DiffConfig()) -> DataFrame:
    """AD_DETECTED, AD_CHANGED, AD_REMOVED and PRODUCT_AD_MATCHED. Leave out stores whose first collection this is."""
    rows = _matched(observed, previous)
    ad, day = F.col("external_ad_id"), day_bucket(now)
    here, known = F.col("here").isNotNull(), F.col("status").isNotNull()
    old = known & (F.col("status") == "HISTORICAL")
    changed = F.lit(False)
    for c in FIELDS:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"o_{c}"))
    gone = known & ~old & ~here & (F.col("missing_streak") + 1 >= config.removal_confirmations)
    product = F.col("o_matched_product_id")
    matched = here & product.isNotNull() & (~known | ~product.eqNullSafe(F.col("matched_product_id")))
    none = F.lit(None).cast("string")
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    url = F.col("o_destination_url")

    def event(kind: str, when: Column, seq: int, discriminator: Column, old_value: Column, new_value: Column, headline: Column) -> Column:
        made = draft(
            kind,
            seq=seq,
            entity_type="AD",
            entity_key=F.concat(F.lower("platform"), F.lit(":"), ad),
            old=old_value,
            new=new_value,
            headline=headline,
            magnitude=F.lit(0.5),
            discriminator=discriminator,
            store_id=F.col("store_id"),
            relevance=scoring.relevance(F.lit(None).cast("int"), F.lit(None).cast("int")),
        )
        return F.when(when, made)

    return emitted(
        rows,
        [
            event("AD_DETECTED", here & (~known | old), 0, F.concat(ad, F.when(old, F.concat(F.lit(":detected:"), day)).otherwise(":detected")), none, _snapshot("o_"), F.lit("New ad detected")),
            event("AD_CHANGED", here & known & ~old & changed, 0, F.concat(ad, F.lit(":changed:"), word("o_destination_url"), F.lit("|"), word("o_advertiser_external_id"), F.lit("|"), word("o_format")), _snapshot(""), _snapshot("o_"), F.when(url.isNull(), "Ad changed").otherwise(F.concat(F.lit("Ad changed: now points to "), url))),
            event("PRODUCT_AD_MATCHED", matched, 1, F.concat(ad, F.lit(":matched:"), product.cast("string")), none, F.to_json(F.struct(product.alias("productId"))), F.lit("Ad matched to a product in your catalog")),
            event("AD_REMOVED", gone, 2, F.concat(ad, F.lit(":removed")), _snapshot(""), none, F.lit("Ad no longer running")),
        ],
        now,
    )


def next_ads(observed: DataFrame, previous: DataFrame, now: Column, config: DiffConfig = DiffConfig()) -> DataFrame:
    """The known ads after a collection; metadata that isn't reported again is kept."""
    rows = _matched(observed, previous)
    here = F.col("here").isNotNull()
    gone = ~here & (F.col("status") != "HISTORICAL")
    streak = F.col("missing_streak") + 1
    return rows.select(
        "store_id",
        "platform",
        "external_ad_id",
        *[F.when(here, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in (*FIELDS, *MATCH)],
        F.coalesce("o_source_metadata", "source_metadata").alias("source_metadata"),
        F.when(here, "ACTIVE_EVIDENCE").when(gone & (streak >= config.removal_confirmations), "HISTORICAL").otherwise(F.col("status")).alias("status"),
        F.when(here, F.lit(0)).when(gone, streak).otherwise(F.col("missing_streak")).alias("missing_streak"),
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(here, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )
