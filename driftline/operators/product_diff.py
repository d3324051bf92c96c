"""Catalog snapshots against the known state: one full outer join, then expressions.

Frames (a row per store or product):

* ``stores``: store_id, currency, baselined (boolean), price_changes,
  products_added, crawls (of the last 30 days, or null);
* ``headers``: store_id, has_rank_data, partial;
* ``current``: store_id, external_id, title, handle, price_min_cents,
  price_max_cents, compare_at_max_cents, variant_count, available_variants,
  bestseller_rank;
* ``previous``: the same and status, missing_streak, missing_since, first_seen_at,
  last_seen_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.config import DiffConfig
from driftline.functions import scoring
from driftline.functions.money import format_cents, half_up, pct_change
from driftline.functions.time import day_bucket
from driftline.operators.events import capped, draft, emitted, json

#: Changed stores whose numbers are broadcast at most (16 bytes each), so that the partitions of others are left unread.
BROADCAST_STORES = 1_000_000

STATE = ("price_min_cents", "price_max_cents", "compare_at_max_cents", "variant_count", "available_variants", "bestseller_rank")


def shrink_check(current: DataFrame, previous: DataFrame, config: DiffConfig = DiffConfig()) -> DataFrame:
    """Per store the numbers of products now and before (removed ones aside) and whether the catalog collapsed."""
    now = current.groupBy("store_id").agg(F.count(F.lit(1)).alias("n_current"))
    was = previous.where(F.col("status") != "REMOVED").groupBy("store_id").agg(F.count(F.lit(1)).alias("n_previous"))
    both = was.join(now, "store_id", "full_outer").na.fill(0, ["n_current", "n_previous"])
    fell = F.col("n_current") / F.col("n_previous") < 1 - config.max_catalog_shrink
    return both.withColumn("aborted", F.when(F.col("n_previous") >= config.min_products_for_shrink, fell).otherwise(F.lit(False)))


def changed_stores(before: DataFrame, now: DataFrame) -> DataFrame:
    """``store_id`` of stores whose content isn't that of the crawl before; only these need a diff.

    ``before`` and ``now``: store_id and any number of hashes (catalog, ranking,
    technology). All of them have to be equal; a store without hashes before, or with
    a null one on either side, has changed.
    """
    names = [c for c in now.columns if c != "store_id"]
    both = now.join(before.select("store_id", *[F.col(c).alias(f"__{c}") for c in names]), "store_id", "left")
    differs = F.lit(False)
    for c in names:  # a missing hash is like no other; a comparison of columns is what partitions can be pruned by
        differs = differs | (F.coalesce(F.col(c), F.lit("none now")) != F.coalesce(F.col(f"__{c}"), F.lit("none before")))
    return both.where(differs).select("store_id")


def matched(stores: DataFrame, headers: DataFrame, current: DataFrame, previous: DataFrame, config: DiffConfig = DiffConfig()) -> DataFrame:
    """Full outer join of state (p_) and snapshot (c_) for the stores whose diff isn't aborted."""
    c = current.select("store_id", "external_id", F.lit(True).alias("c_here"), *[F.col(x).alias(f"c_{x}") for x in ("title", "handle", *STATE)])
    p = previous.select("store_id", "external_id", *[F.col(x).alias(f"p_{x}") for x in ("title", "handle", "status", "missing_streak", "missing_since", "first_seen_at", "last_seen_at", *STATE)])
    bad = shrink_check(current, previous, config).where("aborted").select("store_id")
    info = stores.join(headers, "store_id").join(bad, "store_id", "left_anti")
    return p.join(c, ["store_id", "external_id"], "full_outer").join(info, "store_id")


def _drafts(now: Column, config: DiffConfig, crosses: bool = False) -> list[Column]:
    c, p = (lambda x: F.col(f"c_{x}")), (lambda x: F.col(f"p_{x}"))
    store, key, day = F.col("store_id"), F.col("external_id"), day_bucket(now)
    both = c("here").isNotNull() & p("status").isNotNull()
    price, old_price = c("price_min_cents"), p("price_min_cents")
    money = lambda x: format_cents(x, F.col("currency"))
    text = lambda *xs: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in xs])
    history = (F.col("price_changes"), F.col("products_added"), F.col("crawls"))

    def event(kind: str, when: Column, seq: int, magnitude, discriminator: Column, headline: Column, old: Column, new: Column, rank: Column = c("bestseller_rank"), cents: Column = price, crossing: bool = False) -> Column:
        magnitude = magnitude if isinstance(magnitude, Column) else F.lit(magnitude)
        made = draft(
            kind,
            seq=seq,
            entity_type="PRODUCT",
            entity_key=key,
            old=old,
            new=new,
            headline=headline,
            magnitude=magnitude,
            discriminator=discriminator,
            store_id=store,
            relevance=scoring.relevance(rank, cents),
            rarity=scoring.rarity(F.lit(kind), *history),
            cross=scoring.cross_store(F.col("cross_stores")) if crossing and crosses else None,
        )
        return F.when(when, made)

    none = F.lit(None).cast("string")
    had, has = F.coalesce(p("compare_at_max_cents"), F.lit(0)) > 0, F.coalesce(c("compare_at_max_cents"), F.lit(0)) > 0
    delta, pct = price - old_price, pct_change(old_price, price)
    sale_on = both & ~had & has & (delta < 0)
    sale_off = both & had & ~has & (delta > 0)
    moved = both & ~sale_on & ~sale_off & (delta != 0) & pct.isNotNull() & ((F.abs(pct) >= config.min_price_change_pct) | (F.abs(delta) >= config.min_price_change_cents))
    discount = F.coalesce(pct_change(c("compare_at_max_cents"), price), F.lit(0.0))
    percent = F.concat(F.when(pct > 0, "+").otherwise(""), half_up(pct * 100).cast("string"))
    change = text(c("title"), " ", money(old_price), " → ", money(price), " (", percent, "%)")
    at_price = text(key, ":", price)
    prices = (json(priceCents=old_price), json(priceCents=price))

    stock, old_stock = c("available_variants"), p("available_variants")
    gone, back = both & (old_stock > 0) & (stock == 0), both & (old_stock == 0) & (stock > 0)
    fewer = both & ~gone & ~back & (stock < old_stock) & (c("variant_count") > 1)
    stocks = (json(availableVariants=old_stock), json(availableVariants=stock))
    lost = old_stock - stock

    rank, old_rank, top = c("bestseller_rank"), p("bestseller_rank"), config.bestseller_window
    ranked = both & F.col("has_rank_data")
    ranks = (json(rank=old_rank), json(rank=rank))
    removed = c("here").isNull() & (p("status") != "REMOVED") & ~F.col("partial") & (p("missing_streak") + 1 >= config.removal_confirmations)
    today = text(key, ":", day)
    return [
        event("PRODUCT_ADDED", p("status").isNull(), 0, 0.6, key, text("New product: ", c("title"), " at ", money(price)), none, json(title=c("title"), priceCents=price, handle=c("handle")), crossing=True),
        event("PRODUCT_RESTORED", both & (p("status") != "ACTIVE"), 1, 0.5, today, text(c("title"), " is back in the catalog"), json(status=p("status")), json(status=F.lit("ACTIVE"), priceCents=price)),
        event("SALE_STARTED", sale_on, 2, scoring.price_magnitude(discount), at_price, text(c("title"), " on sale: ", money(price), " (", half_up(F.abs(discount) * 100), "% off)"), prices[0], json(priceCents=price, compareAtCents=c("compare_at_max_cents")), crossing=True),
        event("SALE_ENDED", sale_off, 2, 0.4, at_price, text(c("title"), " back to ", money(price)), *prices),
        event("PRICE_DROP", moved & (delta < 0), 2, scoring.price_magnitude(pct), at_price, change, *prices, crossing=True),
        event("PRICE_INCREASE", moved & (delta > 0), 2, scoring.price_magnitude(pct), at_price, change, *prices, crossing=True),
        event("PRODUCT_SOLD_OUT", gone, 3, 0.8, today, text(c("title"), " sold out"), *stocks),
        event("PRODUCT_RESTOCKED", back, 3, 0.6, today, text(c("title"), " restocked"), *stocks),
        event("VARIANT_SOLD_OUT", fewer, 3, lost / F.greatest(F.lit(1), c("variant_count")), text(key, ":", stock, ":", day), text(c("title"), ": ", lost, " of ", c("variant_count"), " variants sold out"), *stocks),
        event("BESTSELLER_DROPPED", ranked & rank.isNull() & (old_rank < top), 4, 0.5, today, text(c("title"), f" fell out of the top {top}"), *ranks, rank=old_rank),
        event("BESTSELLER_ENTERED", ranked & old_rank.isNull() & (rank < top), 4, 1 - rank / top, today, text(c("title"), " entered the bestsellers at #", rank + 1), *ranks),
        event("BESTSELLER_CLIMBED", ranked & (rank < top) & (old_rank - rank >= config.min_rank_improvement), 4, scoring.rank_magnitude(old_rank - rank), text(key, ":", rank, ":", day), text(c("title"), " climbed #", old_rank + 1, " → #", rank + 1), *ranks),
        event("PRODUCT_REMOVED", removed, 5, 0.6, key, text(p("title"), " discontinued"), json(title=p("title"), priceCents=old_price), none, rank=old_rank, cents=old_price),
    ]


def product_events(stores: DataFrame, headers: DataFrame, current: DataFrame, previous: DataFrame, now: Column, config: DiffConfig = DiffConfig(), cap: bool = True, cross_stores: DataFrame | None = None, hashes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Events of the stores that have a baseline; a single shuffle by (store, product), then the cap by store.

    ``cross_stores`` (store_id, external_id, cross_stores) may tell how many stores make the same move.
    ``hashes``: those of the crawl before and of this one, see ``changed_stores``. Stores
    whose content is the same are left out of the catalog and of the state before anything is
    joined; where these lie partitioned by store, their files aren't read.
    """
    if hashes is not None:
        to_do = changed_stores(*hashes)
        if to_do.count() <= BROADCAST_STORES:
            to_do = F.broadcast(to_do)
        stores, current, previous = (x.join(to_do, "store_id", "left_semi") for x in (stores, current, previous))
    rows = matched(stores.where("baselined"), headers, current, previous, config)
    if cross_stores is not None:
        rows = rows.join(cross_stores, ["store_id", "external_id"], "left")
    events = emitted(rows, _drafts(now, config, cross_stores is not None), now)
    return capped(events, config.max_events) if cap else events


def baseline_events(stores: DataFrame, current: DataFrame, now: Column) -> DataFrame:
    """Of stores without a baseline: one event for the store and, for charts only, a backfilled one per product with a known launch."""
    fresh = stores.where(~F.col("baselined")).select("store_id")
    n = current.groupBy("store_id").agg(F.count(F.lit(1)).alias("products"))
    day = day_bucket(now)
    store = fresh.join(n, "store_id", "left").select(
        "store_id",
        F.lit("STORE").alias("entity_type"),
        F.col("store_id").cast("string").alias("entity_key"),
        F.lit("STORE_BASELINED").alias("event_type"),
        F.lit(None).cast("string").alias("old_value"),
        json(products=F.coalesce("products", F.lit(0))).alias("new_value"),
        F.concat(F.lit("Tracking began with "), F.coalesce("products", F.lit(0)).cast("string"), F.lit(" products")).alias("headline"),
        F.lit(5).alias("significance"),
        F.lit(False).alias("backfilled"),
        now.alias("occurred_at"),
        scoring.dedupe_key(F.col("store_id"), F.col("store_id"), F.lit("STORE_BASELINED"), day).alias("dedupe_key"),
        F.lit(0).alias("seq"),
    )
    launched = current.join(fresh, "store_id", "left_semi").where(F.col("source_created_at").isNotNull())
    iso = F.date_format("source_created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    products = launched.select(
        "store_id",
        F.lit("PRODUCT").alias("entity_type"),
        F.col("external_id").cast("string").alias("entity_key"),
        F.lit("PRODUCT_ADDED").alias("event_type"),
        F.lit(None).cast("string").alias("old_value"),
        json(title=F.col("title"), priceCents=F.col("price_min_cents"), handle=F.col("handle")).alias("new_value"),
        F.concat(F.lit("Launched: "), F.col("title")).alias("headline"),
        F.lit(20).alias("significance"),
        F.lit(True).alias("backfilled"),
        F.col("source_created_at").alias("occurred_at"),
        scoring.dedupe_key(F.col("store_id"), F.col("external_id"), F.lit("PRODUCT_ADDED"), iso).alias("dedupe_key"),
        F.lit(1).alias("seq"),
    )
    return store.unionByName(products)


def theme_events(stores: DataFrame, tech: DataFrame, now: Column) -> DataFrame:
    """THEME_CHANGED where both themes are known and differ. ``stores`` and ``tech``: store_id, theme_name, theme_version."""
    was = stores.select("store_id", F.col("theme_name").alias("old_name"), F.col("theme_version").alias("old_version"))
    rows = was.join(tech.select("store_id", "theme_name", "theme_version"), "store_id")
    new = F.col("theme_name")
    made = draft(
        "THEME_CHANGED",
        seq=6,
        entity_type="TECH",
        entity_key=F.lit("theme"),
        old=json(name=F.col("old_name"), version=F.col("old_version")),
        new=json(name=new, version=F.col("theme_version")),
        headline=F.concat(F.lit("Rebuilt storefront: "), F.col("old_name"), F.lit(" → "), new),
        magnitude=F.lit(0.9),
        discriminator=new,
        store_id=F.col("store_id"),
        relevance=scoring.relevance(F.lit(None).cast("int"), F.lit(None).cast("int")),
    )
    return emitted(rows, [F.when((new != "") & (F.col("old_name") != "") & (new != F.col("old_name")), made)], now)


def next_state(stores: DataFrame, headers: DataFrame, current: DataFrame, previous: DataFrame, now: Column, config: DiffConfig = DiffConfig()) -> DataFrame:
    """The state after the crawl: what the upserts of the diff leave, with ``state_changed``.

    First sightings stay, last sightings move only for what was seen, a product
    that is missing loses its stock and rank and is removed after enough crawls; a
    partial crawl or an aborted diff leaves what it didn't see as it was.
    """
    info = headers.select("store_id", "partial", "has_rank_data")
    bad = shrink_check(current, previous, config).where("aborted").select("store_id", F.lit(True).alias("aborted"))
    c = current.select("store_id", "external_id", F.lit(True).alias("here"), *[F.col(x).alias(f"c_{x}") for x in ("title", "handle", *STATE)])
    rows = previous.join(c, ["store_id", "external_id"], "full_outer").join(info, "store_id").join(bad, "store_id", "left")
    live = F.coalesce(~F.col("aborted"), F.lit(True))
    seen, known = F.col("here").isNotNull() & live, F.col("status").isNotNull()
    missing = live & F.col("here").isNull() & (F.col("status") != "REMOVED") & ~F.col("partial")
    streak = F.col("missing_streak") + 1
    take = lambda x: F.when(seen, F.col(f"c_{x}")).otherwise(F.col(x))
    differs = F.lit(False)
    for x in STATE[:-1]:
        differs = differs | ~F.col(x).eqNullSafe(F.col(f"c_{x}"))
    differs = differs | (F.col("status") != "ACTIVE") | (F.col("has_rank_data") & ~F.col("bestseller_rank").eqNullSafe(F.col("c_bestseller_rank")))
    return rows.where(known | live).select(
        "store_id",
        "external_id",
        take("title").alias("title"),
        take("handle").alias("handle"),
        *[take(x).alias(x) for x in STATE[:-2]],
        F.when(missing, F.lit(0)).otherwise(take("available_variants")).alias("available_variants"),
        F.when(missing, F.lit(None)).otherwise(take("bestseller_rank")).alias("bestseller_rank"),
        F.when(seen, "ACTIVE").when(missing, F.when(streak >= config.removal_confirmations, "REMOVED").otherwise("MISSING")).otherwise(F.col("status")).alias("status"),
        F.when(seen, F.lit(0)).when(missing, streak).otherwise(F.col("missing_streak")).alias("missing_streak"),
        F.when(seen, F.lit(None)).when(missing, F.coalesce("missing_since", now)).otherwise(F.col("missing_since")).alias("missing_since"),
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(seen, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(seen, ~known | differs).otherwise(missing).alias("state_changed"),
    )
