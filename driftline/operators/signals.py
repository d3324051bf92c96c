"""Signals over time: catalog size, rank moves, persistence, prices, reviews, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.config import MARKETING_EVENTS, PRICE_EVENTS
from driftline.functions.money import half_up


def sampled_evenly(rows: DataFrame, keys: list[str], order: str, points: int = 12) -> DataFrame:
    """At most ``points`` rows of each key, evenly spaced by place, the first and last among them."""
    w = Window.partitionBy(*keys)
    placed = rows.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    step = (F.col("__n") - 1) / F.lit(float(points - 1))
    k = half_up(F.col("__i") / step)
    near = F.exists(F.array(k - 1, k, k + 1), lambda j: (j >= 0) & (j < points) & (half_up(j * step) == F.col("__i")))
    return placed.where((F.col("__n") <= points) | near).drop("__i", "__n")


def evenly_spaced(start: Column, end: Column, points: int = 12) -> Column:
    """``points`` times from start to end, to the millisecond."""
    a, b = F.unix_millis(start.cast("timestamp")), F.unix_millis(end.cast("timestamp"))
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.timestamp_millis((a + F.floor((b - a) * i / F.lit(float(points - 1)))).cast("long")).cast("timestamp_ntz"))


def catalog_sizes(products: DataFrame, samples: DataFrame) -> DataFrame:
    """Products at each sample (store_id, at): launched by then and not missing yet.

    A launch counts +1 and a loss -1 from its time on, so that one running sum over
    the store's times gives all samples without joining samples with products.
    """
    born = F.coalesce("source_created_at", "first_seen_at")
    up = products.select("store_id", born.alias("at"), F.lit(1).cast("long").alias("step"))
    down = products.where(F.col("missing_since").isNotNull()).select("store_id", F.greatest(F.col("missing_since"), born).alias("at"), F.lit(-1).cast("long").alias("step"))
    steps = up.union(down).groupBy("store_id", "at").agg(F.sum("step").alias("step")).withColumn("sample", F.lit(0))
    asked = samples.select("store_id", "at").distinct().withColumn("step", F.lit(0).cast("long")).withColumn("sample", F.lit(1))
    running = F.sum("step").over(Window.partitionBy("store_id").orderBy("at", "sample").rowsBetween(Window.unboundedPreceding, 0))
    return steps.unionByName(asked).withColumn("products", running).where("sample = 1").select("store_id", "at", "products")


def catalog_trend(crawls: DataFrame, products: DataFrame, most: int = 180, least: int = 3, points: int = 12) -> DataFrame:
    """How the catalog of each store grew: a row for each of at most ``points`` times, with ``products`` at that time.

    ``crawls``: store_id, finished_at (of real ones); ``products``: store_id, first_seen_at, missing_since,
    source_created_at. The times are those of the last ``most`` crawls, evenly
    sampled. A store with fewer than ``least`` of them has its past ``reconstructed`` from
    its products' launches, at even times from the first of these to the last crawl. Where there is no
    launch either, or no crawl, one row without a time says INSUFFICIENT_HISTORY. ``crawls`` is their number.
    """
    place = F.row_number().over(Window.partitionBy("store_id").orderBy(F.desc("finished_at")))
    recent = crawls.where(F.col("finished_at").isNotNull()).select("store_id", "finished_at").withColumn("__place", place).where(F.col("__place") <= most).drop("__place")
    heads = recent.groupBy("store_id").agg(F.count(F.lit(1)).alias("crawls"), F.max("finished_at").alias("__last"))
    launched = products.groupBy("store_id").agg(F.min("source_created_at").alias("__first"))
    told = heads.join(launched, "store_id", "full_outer").withColumn("crawls", F.coalesce("crawls", F.lit(0)))
    enough, rebuilt = F.col("crawls") >= least, F.col("__first").isNotNull() & F.col("__last").isNotNull()
    told = told.withColumns({"status": F.when(enough | rebuilt, "OBSERVED").otherwise("INSUFFICIENT_HISTORY"), "reconstructed": ~enough & rebuilt})
    seen = sampled_evenly(recent.join(told.where(enough).select("store_id"), "store_id", "left_semi"), ["store_id"], "finished_at", points).withColumnRenamed("finished_at", "at")
    made = told.where(F.col("reconstructed")).select("store_id", F.explode(evenly_spaced(F.col("__first"), F.col("__last"), points)).alias("at")).distinct()
    sizes = catalog_sizes(products, seen.unionByName(made))
    return told.select("store_id", "status", "crawls", "reconstructed").join(sizes, "store_id", "left")


def rank_signals(observations: DataFrame, last: int = 20) -> DataFrame:
    """Per product: its last ranks, the move since the rank differed, and the momentum.

    ``observations``: store_id, external_id, crawl_id, captured_at, rank.
    """
    keys = ["store_id", "external_id"]
    w = Window.partitionBy(*keys)
    recent = observations.withColumn("__place", F.row_number().over(w.orderBy(F.desc("captured_at"), F.desc("crawl_id")))).where(F.col("__place") <= last)
    known = recent.where(F.col("rank").isNotNull())
    path = known.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("captured_at", "crawl_id", "rank"))).alias("__path"))  # ``last`` entries at most
    out = path.withColumns({"trajectory": F.col("__path.rank"), "observations": F.size("__path").cast("long"), "crawls": F.size(F.array_distinct(F.array_compact("__path.crawl_id"))).cast("long")})
    out = out.withColumn("current_rank", F.element_at("trajectory", -1))
    others = F.filter("trajectory", lambda r: r != F.col("current_rank"))
    moves = F.zip_with(F.slice("trajectory", 2, F.size("trajectory")), F.slice("trajectory", 1, F.size("trajectory") - 1), lambda now, before: F.signum(now - before))
    out = out.withColumns({"previous_rank": F.get(others, F.size(others) - 1), "__moves": moves})
    out = out.withColumns({"__up": F.array_contains("__moves", -1.0), "__down": F.array_contains("__moves", 1.0)})
    enough = (F.col("observations") >= 4) & (F.col("crawls") >= 3)
    momentum = F.when(enough & F.col("__up") & ~F.col("__down"), "IMPROVING").when(enough & F.col("__down") & ~F.col("__up"), "DECLINING").when(enough & ~F.col("__up") & ~F.col("__down"), "STABLE")
    return out.select(
        *keys,
        "trajectory",
        "current_rank",
        "previous_rank",
        (F.col("previous_rank") - F.col("current_rank")).alias("delta"),
        "observations",
        "crawls",
        momentum.alias("momentum"),
    )


def persistence(crawls: DataFrame, products: DataFrame, transitions: DataFrame, last: int = 20, least: int = 3) -> DataFrame:
    """In how many of the store's last crawls each product was in the catalog.

    ``crawls``: store_id, finished_at; ``products``: store_id, external_id,
    first_seen_at, status, missing_since; ``transitions``: store_id, external_id,
    type (PRODUCT_ADDED, _REMOVED or _RESTORED), occurred_at. Crawls before the first
    sighting don't count. The latest transition at or before a crawl decides; before
    any the product is there; a gap that goes on overrides from its beginning.
    """
    recent = crawls.withColumn("__place", F.row_number().over(Window.partitionBy("store_id").orderBy(F.desc("finished_at")))).where(F.col("__place") <= last)
    keys = ["store_id", "external_id"]
    seen = recent.select("store_id", F.col("finished_at").alias("at")).join(products, "store_id").where(F.col("at") >= F.col("first_seen_at"))
    asked = seen.select(*keys, "at", F.lit(None).cast("string").alias("type"), F.lit(1).alias("ask"), "status", "missing_since")
    told = transitions.select(*keys, F.col("occurred_at").alias("at"), "type", F.lit(0).alias("ask"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("timestamp_ntz").alias("missing_since"))
    so_far = Window.partitionBy(*keys).orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    states = asked.unionByName(told).withColumn("state", F.last("type", ignorenulls=True).over(so_far)).where("ask = 1")
    lost = (F.col("status") != "ACTIVE") & (F.col("at") >= F.col("missing_since"))
    here = ~F.coalesce(lost, F.lit(False)) & (F.coalesce("state", F.lit("PRODUCT_ADDED")) != "PRODUCT_REMOVED")
    out = states.groupBy(*keys).agg(F.count(F.lit(1)).alias("crawls"), F.count_if(here).alias("present"))
    return out.withColumn("ratio", F.when(F.col("crawls") >= least, F.col("present") / F.col("crawls")))


def freshness(status: Column, ratio: Column, store_crawls: Column, least: int = 3) -> Column:
    """What a product's persistence says: a ratio is known after enough crawls of its own; before that it is new if the store has had enough."""
    return F.when(status != "ACTIVE", "RECENTLY_MISSING").when(ratio.isNotNull(), "ESTABLISHED").when(store_crawls >= least, "NEW").otherwise("INSUFFICIENT_HISTORY")


def price_spread(products: DataFrame, keys: list[str], price: str = "price_min_cents") -> DataFrame:
    """min, p25, median, p75, max per key; the p-th of n sorted prices is that at place floor(p * n), n - 1 at most."""
    w = Window.partitionBy(*keys)
    placed = products.where(F.col(price).isNotNull()).select(*keys, F.col(price).alias("x"))
    placed = placed.withColumn("i", F.row_number().over(w.orderBy("x")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    at = lambda p: F.max(F.when(F.col("i") == F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n"))), F.col("x")))
    return placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("products"), F.min("x").alias("min_cents"), at(0.25).alias("p25_cents"), at(0.5).alias("median_cents"), at(0.75).alias("p75_cents"), F.max("x").alias("max_cents"))


def discount_depth(products: DataFrame, keys: list[str]) -> DataFrame:
    """Products on sale and their mean discount in whole percent."""
    on_sale = F.col("compare_at_max_cents") > F.col("price_min_cents")
    depth = (F.col("compare_at_max_cents") - F.col("price_min_cents")) / F.col("compare_at_max_cents")
    return products.groupBy(*keys).agg(F.count_if(on_sale).alias("on_sale"), half_up(F.avg(F.when(on_sale, depth)) * 100).alias("mean_discount_pct"))


def mix(products: DataFrame, keys: list[str], label: str, top: int = 8) -> DataFrame:
    """The most frequent labels of each key, ties by name."""
    counts = products.where(F.coalesce(F.col(label), F.lit("")) != "").groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), label))
    return counts.withColumn("place", place).where(F.col("place") <= top)


def store_activity(events: DataFrame, sizes: DataFrame, crawls: DataFrame, start: Column, end: Column) -> DataFrame:
    """Counts of a window per store in one pass, and how the catalog changed.

    ``sizes``: store_id, products; ``crawls``: store_id, crawls (real ones).
    """
    inside = events.where((F.col("occurred_at") >= start) & (F.col("occurred_at") < end))
    kind = F.col("event_type")
    counted = inside.groupBy("store_id").agg(
        F.count_if((kind == "PRODUCT_ADDED") & ~F.col("backfilled")).alias("added"),
        F.count_if(kind == "PRODUCT_REMOVED").alias("removed"),
        F.count_if(kind == "PRODUCT_RESTORED").alias("restored"),
        F.count_if(kind.isin(*PRICE_EVENTS)).alias("price_changes"),
        *[F.count_if(kind == k).alias(k.lower()) for k in MARKETING_EVENTS],
    )
    rows = sizes.join(counted, "store_id", "left").join(crawls, "store_id", "left").na.fill(0)
    ago = F.col("products") - F.col("added") + F.col("removed")
    known = F.col("crawls") >= 2
    rows = rows.withColumn("window_ago", F.when(known, ago)).withColumn("delta", F.when(known, F.col("products") - ago))
    return rows.withColumn("delta_pct", F.when(F.col("window_ago") != 0, half_up(F.col("delta") / F.col("window_ago") * 1000) / 10))


def growth_signals(delta: Column, delta_pct: Column, price_changes: Column, days: int) -> Column:
    """What a window shows, as an array of (kind, detail); empty without enough history (a null delta)."""
    text = lambda *xs: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in xs])
    window = f" over the last {days} days"
    pct = lambda sign: F.when(delta_pct.isNull(), "").otherwise(text(f" ({sign}", delta_pct, "%)"))
    made = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    moves = F.array(
        F.when(delta > 0, made("CATALOG_EXPANSION", text("+", delta, " products", pct("+"), window))),
        F.when(delta < 0, made("CATALOG_CONTRACTION", text(delta, " products", pct(""), window))),
        F.when(price_changes > 0, made("PRICE_ACTIVITY", text(price_changes, F.when(price_changes == 1, " price change").otherwise(" price changes"), f" observed in the last {days} days"))),
    )
    some = F.filter(moves, lambda m: m.isNotNull())
    steady = F.array(made("STEADY", F.lit(f"No catalog or price changes observed in the last {days} days")))
    return F.when(delta.isNull(), F.slice(steady, 1, 0)).when(F.size(some) > 0, some).otherwise(steady)


def interpretation(delta: Column, momentum: Column) -> Column:
    """A headline where the catalog and the ranks agree, else null."""
    return F.when((delta > 0) & (momentum == "IMPROVING"), "Storefront activity increasing").when((delta < 0) & (momentum == "DECLINING"), "Storefront activity decreasing")


def review_signal(observations: DataFrame, last: int = 10) -> DataFrame:
    """Per product the latest review count and its difference to the one known before.

    ``observations``: store_id, external_id, observed_at, review_count. A product
    without observations has no row; the caller's left join says NOT_SAMPLED.
    """
    keys = ["store_id", "external_id"]
    w = Window.partitionBy(*keys).orderBy(F.desc("observed_at"))
    recent = observations.withColumn("place", F.row_number().over(w)).where(F.col("place") <= last)
    before = F.first("review_count", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    newest = recent.withColumn("previous_count", before).where("place = 1")
    return newest.select(*keys, F.when(F.col("review_count").isNull(), "UNSUPPORTED").otherwise("OBSERVED").alias("status"), "review_count", "previous_count", (F.col("review_count") - F.col("previous_count")).alias("review_delta"))


def shared_review_counts(observations: DataFrame) -> DataFrame:
    """Whether two or more products of a crawl show the same count, which then is the shop's and not theirs."""
    n = F.count(F.lit(1)).over(Window.partitionBy("store_id", "crawl_id", "review_count"))
    return observations.withColumn("shared", F.col("review_count").isNotNull() & (n >= 2))


def review_coverage(observations: DataFrame) -> DataFrame:
    """Of each store's latest crawl: products sampled and those with a count."""
    newest = F.max(F.struct("observed_at", "crawl_id")).over(Window.partitionBy("store_id"))
    mine = observations.withColumn("__last", newest).where(F.col("crawl_id") == F.col("__last.crawl_id"))
    return mine.groupBy("store_id").agg(F.count(F.lit(1)).alias("sampled"), F.count("review_count").alias("with_count"))


def highlights(products: DataFrame, budget: Column | int = 20) -> DataFrame:
    """Of each store the ranked products by rank, then the newest, ``budget`` in all."""
    place = F.row_number().over(Window.partitionBy("store_id").orderBy(F.col("bestseller_rank").isNull(), "bestseller_rank", F.desc("first_seen_at"), "external_id"))
    return products.withColumn("place", place).where(F.col("place") <= budget)


def review_budget(has_provider: Column) -> Column:
    return F.when(has_provider, 20).otherwise(5)


def overall_momentum(ranked: DataFrame) -> DataFrame:
    """IMPROVING or DECLINING if over half of a store's decided products, of two at least, are."""
    said = ranked.groupBy("store_id").agg(F.count("momentum").alias("decided"), *[F.count_if(F.col("momentum") == m).alias(m) for m in ("IMPROVING", "DECLINING")])
    most = F.lit(None).cast("string")
    for m in ("DECLINING", "IMPROVING"):
        most = F.when((F.col("decided") >= 2) & (F.col(m) * 2 > F.col("decided")), m).otherwise(most)
    return said.select("store_id", "decided", most.alias("momentum"))


def store_stats(events: DataFrame, products: DataFrame, crawls: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Rates of the last ``days`` per store, which make an event's rarity."""
    start = now - F.make_dt_interval(F.lit(days))
    inside = events.where((F.col("occurred_at") >= start) & (F.col("occurred_at") < now))
    moves = inside.groupBy("store_id").agg(F.count_if(F.col("event_type").isin(*PRICE_EVENTS)).alias("price_changes"), F.count_if(F.col("event_type") == "PRODUCT_ADDED").alias("products_added"))
    visits = crawls.where((F.col("finished_at") >= start) & (F.col("finished_at") < now)).groupBy("store_id").agg(F.count(F.lit(1)).alias("crawls"))
    spread = price_spread(products.where(F.col("status") == "ACTIVE"), ["store_id"]).select("store_id", F.col("products").alias("product_count"), F.col("median_cents").alias("median_price_cents"))
    return spread.join(visits, "store_id", "left").join(moves, "store_id", "left").na.fill(0, ["crawls", "price_changes", "products_added"])


def cross_store_moves(events: DataFrame, identity: str = "image_hash") -> DataFrame:
    """For each event how many other stores made the same move with the same thing in the same week."""
    week = F.date_trunc("week", "occurred_at").cast("timestamp_ntz")
    keyed = events.withColumn("week", week)
    n = keyed.where(F.col(identity).isNotNull()).groupBy(identity, "event_type", "week").agg(F.count_distinct("store_id").alias("stores"))
    return keyed.join(n, [identity, "event_type", "week"], "left").withColumn("other_stores", F.coalesce(F.col("stores") - 1, F.lit(0)))
