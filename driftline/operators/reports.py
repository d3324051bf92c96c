"""Reports over all stores or users in one plan: a row per entry, never a list per report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.fingerprint import REVIEW_APPS
from driftline.functions.plans import plan_limit
from driftline.functions.text import region_names
from driftline.functions.time import days_remaining
from driftline.operators import signals
from driftline.operators.state import latest

KEYS = ["store_id", "external_id"]
# Reasons of reports, here and below.
NOT_CRAWLED = "This store has not completed an initial crawl yet."


def growth_highlights(products: DataFrame, ranks: DataFrame, presence: DataFrame, crawls: DataFrame, reviews: DataFrame, budget: Column | int = 20) -> DataFrame:
    """The highlights of each store with what is known of them: ranks, presence, freshness, reviews.

    ``products``: store_id, external_id, status, bestseller_rank, first_seen_at;
    ``ranks``, ``presence`` and ``reviews`` as of the operators in ``signals``;
    ``crawls``: store_id, finished_at. What was never observed stays null; a product
    without a review observation is NOT_SAMPLED.
    """
    chosen = signals.highlights(products.where(F.col("status") == "ACTIVE"), budget).select(*KEYS, "status", "place")
    visits = crawls.groupBy("store_id").agg(F.count(F.lit(1)).alias("store_crawls"))
    rows = chosen.join(ranks, KEYS, "left").join(presence.select(*KEYS, F.col("crawls").alias("seen_crawls"), "present", "ratio"), KEYS, "left").join(visits, "store_id", "left").join(reviews.withColumnRenamed("status", "__review"), KEYS, "left")
    fresh = signals.freshness(F.col("status"), F.col("ratio"), F.coalesce("store_crawls", F.lit(0)))
    return rows.withColumns({"freshness": fresh, "review_status": F.coalesce("__review", F.lit("NOT_SAMPLED"))}).drop("__review", "status", "store_crawls")


def dashboard(users: DataFrame, plans: DataFrame, usage: DataFrame, watches: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Per user: the plan (FREE without one), analyses of the last hours, when the next is free again, monitored stores, limits."""
    recent = usage.where((F.col("created_at") >= now - F.make_dt_interval(F.lit(0), F.lit(hours))) & (F.col("created_at") <= now))
    used = recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("used"), (F.min("created_at") + F.make_dt_interval(F.lit(0), F.lit(hours))).alias("resets_at"))
    slots = watches.where(F.col("status") == "ACTIVE").groupBy("user_id").agg(F.count(F.lit(1)).alias("slots_used"))
    rows = users.join(plans, "user_id", "left").join(used, "user_id", "left").join(slots, "user_id", "left").na.fill(0, ["used", "slots_used"]).na.fill("FREE", ["plan"])
    return rows.withColumns({"analyses_limit": plan_limit(F.col("plan"), "analyses"), "slots_limit": plan_limit(F.col("plan"), "slots")})


def dashboard_stores(usage: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """Every store that a user ever analysed, once, with the latest time and the number of active products."""
    seen = usage.groupBy("user_id", "store_id").agg(F.max("created_at").alias("analyzed_at"))
    sizes = products.where(F.col("status") == "ACTIVE").groupBy("store_id").agg(F.count(F.lit(1)).alias("product_count"))
    return seen.join(stores.select("store_id", "domain"), "store_id").join(sizes, "store_id", "left").na.fill(0, ["product_count"])


def dashboard_watches(watches: DataFrame, stores: DataFrame, now: Column) -> DataFrame:
    """Active watches that have begun. ``stores``: store_id, domain, tier, last_crawled_at, next_crawl_at; a disabled store has no next crawl."""
    rows = watches.where((F.col("status") == "ACTIVE") & F.col("started_at").isNotNull()).join(stores, "store_id")
    left = F.when(F.col("expires_at").isNotNull(), days_remaining(F.col("expires_at"), now))
    return rows.select("user_id", "domain", "started_at", "expires_at", left.alias("days_remaining"), "tier", "last_crawled_at", F.when(F.col("tier") != "DISABLED", F.col("next_crawl_at")).alias("next_crawl_at"))


def marketing_report(stores: DataFrame, runs: DataFrame, ads: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """A row per shown ad of each store, and one without an ad where none is shown.

    Where the ads have ``source_metadata``, ``regions`` are the names in it; with
    ``products`` (store_id, external_id, handle, title) an ad's matched product is told.

    ``runs``: store_id, started_at, finished_at, outcome (null: didn't finish),
    reason. The latest run decides: never checked, not completed, unavailable or
    observed. Ads without active evidence aren't shown.
    """
    last = latest(runs, ["store_id"], F.desc("started_at")).withColumn("__ran", F.lit(True))
    done = F.col("outcome").isNotNull()
    open_ = F.when(F.col("__ran"), "Advertising check did not complete").otherwise("Advertising data has not been checked yet")
    status = F.when(done & (F.col("outcome") != "UNAVAILABLE"), "OBSERVED").otherwise("UNAVAILABLE")
    reason = F.when(~done, open_).when(F.col("outcome") == "UNAVAILABLE", F.coalesce("reason", F.lit("Advertising data could not be checked")))
    heads = stores.select("store_id", "domain").join(last, "store_id", "left").select("store_id", "domain", status.alias("status"), reason.alias("reason"), F.when(done, F.col("finished_at")).alias("last_checked_at"))
    shown = ads.where(F.col("status") == "ACTIVE_EVIDENCE").drop("status")
    if "source_metadata" in ads.columns:
        shown = shown.withColumn("regions", region_names(F.col("source_metadata")))
    if products is not None:
        told = products.select("store_id", F.col("external_id").alias("matched_product_id"), F.col("handle").alias("matched_handle"), F.col("title").alias("matched_title"))
        shown = shown.join(told, ["store_id", "matched_product_id"], "left")
    return heads.join(shown.withColumn("__shown", F.lit("OBSERVED")), (heads["store_id"] == shown["store_id"]) & (heads["status"] == F.col("__shown")), "left").drop(shown["store_id"]).drop("__shown")


def observed(value: Column, reason: str | None = None, when: Column | None = None) -> Column:
    """A field of a report: OBSERVED with a value or, where it is null (or ``when`` is false), UNAVAILABLE with a reason."""
    known = value.isNotNull() if when is None else F.coalesce(when, F.lit(False))
    return F.struct(F.when(known, "OBSERVED").otherwise("UNAVAILABLE").alias("status"), F.when(known, value).alias("value"), F.when(~known, F.lit(reason)).alias("reason"))


def review_infrastructure(stores: DataFrame, entities: DataFrame) -> DataFrame:
    """store_id and ``infrastructure``: the apps of a store that collect reviews, whatever their status, once it has been crawled.

    They tell that reviews are collected, not how many there are. There is at most one
    entry for each app that is known to collect reviews.
    """
    mine = entities.where((F.col("kind") == "APP") & F.col("key").isin(*REVIEW_APPS))
    apps = mine.groupBy("store_id").agg(F.array_sort(F.collect_list(F.struct("key", "status", "first_seen_at", "last_seen_at"))).alias("__apps"))
    empty = F.array().cast(apps.schema["__apps"].dataType)
    rows = stores.select("store_id", "baselined").join(apps, "store_id", "left")
    return rows.select("store_id", observed(F.coalesce("__apps", empty), NOT_CRAWLED, F.col("baselined")).alias("infrastructure"))


def intelligence_report(stores: DataFrame, products: DataFrame, entities: DataFrame, crawls: DataFrame, activity: DataFrame, coverage: DataFrame, days: int = 30) -> DataFrame:
    """One nested row per store with all that is known of it; each field is observed or unavailable for a reason.

    ``stores``: store_id, domain, baselined, tier, theme_name, theme_version, registered_at, archived_at, last_crawled_at, next_crawl_at;
    ``products``: store_id, external_id, status, price_min_cents, bestseller_rank,
    first_seen_at; ``entities`` as of ``next_entities``; ``crawls``: store_id, status;
    ``activity``: store_id, delta, delta_pct, price_changes; ``coverage``: store_id, sampled, with_count.

    Products are summed up before they are shuffled; of them only the highlights (20, or
    5 where no app collects reviews) are brought together, which the sort cuts off in
    each task. Names of technology are bounded by what can be recognised.
    """
    live = products.where(F.col("status") == "ACTIVE")
    infrastructure = review_infrastructure(stores, entities)
    provider = F.exists("infrastructure.value", lambda a: a["status"] == "ACTIVE")
    budgets = infrastructure.select("store_id", "infrastructure", signals.review_budget(F.coalesce(provider, F.lit(False))).alias("__budget"))
    facts = live.groupBy("store_id").agg(F.count(F.lit(1)).alias("__n"), F.floor(F.avg("price_min_cents") + 0.5).alias("__price"))
    best = signals.highlights(live, 20).join(budgets.select("store_id", "__budget"), "store_id").where(F.col("place") <= F.col("__budget"))
    top = best.groupBy("store_id").agg(F.array_sort(F.collect_list(F.struct("place", "external_id", "bestseller_rank"))).alias("__top"))
    named = entities.where((F.col("status") == "ACTIVE") & F.col("kind").isin("APP", "PIXEL", "PAYMENT_PROVIDER"))
    kinds = {"APP": "apps", "PIXEL": "pixels", "PAYMENT_PROVIDER": "payment_providers"}
    tech = named.groupBy("store_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("first_seen_at", "key")))).alias(f"__{n}") for k, n in kinds.items()])
    visits = crawls.where(F.col("status").isin("OK", "PARTIAL")).groupBy("store_id").agg(F.count(F.lit(1)).alias("__crawls"))
    rows = stores
    for part in (budgets, facts, top, tech, visits, activity, coverage):
        rows = rows.join(part, "store_id", "left")
    names = lambda n: F.coalesce(F.transform(f"__{n}", lambda e: e["key"]), F.array().cast("array<string>"))
    never = lambda why: F.struct(F.lit("UNAVAILABLE").alias("status"), F.lit(why).alias("reason"), F.lit(True).alias("permanent"))
    on = F.col("tier") != "DISABLED"
    return rows.select(
        "store_id",
        F.struct(
            "domain",
            observed(F.struct(F.col("theme_name").alias("name"), F.col("theme_version").alias("version"))).alias("theme"),
            observed(F.col("registered_at"), "No public registration date found for this domain.").alias("registered"),
            observed(F.col("archived_at"), "No archived storefront snapshot found for this domain.").alias("archived"),
        ).alias("identity"),
        F.struct(*[names(n).alias(n) for n in kinds.values()]).alias("technology"),
        F.struct(F.coalesce("__n", F.lit(0)).alias("products"), observed(F.col("__price"), "No active products to average").alias("average_price")).alias("catalog"),
        F.coalesce("__top", F.array().cast(top.schema["__top"].dataType)).alias("highlights"),
        F.struct("delta", "delta_pct", signals.growth_signals(F.col("delta"), F.col("delta_pct"), F.col("price_changes"), days).alias("signals"), F.col("delta").isNotNull().alias("has_enough_history")).alias("growth"),
        F.struct("infrastructure", never("Review history is not yet reliably collected").alias("velocity"), F.coalesce("sampled", F.lit(0)).alias("sampled"), F.coalesce("with_count", F.lit(0)).alias("with_count")).alias("reviews"),
        F.struct(never("No validated revenue model implemented yet").alias("revenue"), never("No validated traffic estimation model implemented yet").alias("traffic")).alias("commercial"),
        F.struct("tier", on.alias("active"), "last_crawled_at", F.when(on, F.col("next_crawl_at")).alias("next_crawl_at"), F.coalesce("__crawls", F.lit(0)).alias("total_crawls")).alias("monitoring"),
    )


def store_access(asked: DataFrame, usage: DataFrame) -> DataFrame:
    """What a user (null: not signed in) may see of a store: ``full`` if they ever analysed it, else a preview."""
    done = usage.select("user_id", "store_id").distinct().withColumn("__done", F.lit(True))
    rows = asked.join(done, ["user_id", "store_id"], "left")
    return rows.withColumn("access", F.when(F.col("user_id").isNull(), "anonymous_preview").when(F.col("__done"), "full").otherwise("unanalyzed_preview")).drop("__done")


def user_details(users: DataFrame, plans: DataFrame, roles: DataFrame, usage: DataFrame, watches: DataFrame) -> DataFrame:
    """Per user (user_id, email, created_at) the plan (FREE without one), the role (USER without one), all analyses and the active watches."""
    used = usage.groupBy("user_id").agg(F.count(F.lit(1)).alias("analyses_used"))
    watching = watches.where(F.col("status") == "ACTIVE").groupBy("user_id").agg(F.count(F.lit(1)).alias("active_watches"))
    rows = users.select("user_id", "email", "created_at")
    for part in (plans.select("user_id", "plan"), roles.select("user_id", "role"), used, watching):
        rows = rows.join(part, "user_id", "left")
    return rows.na.fill(0, ["analyses_used", "active_watches"]).na.fill({"plan": "FREE", "role": "USER"})


def user_export(users: DataFrame, consents: DataFrame, purpose: str = "operations") -> DataFrame:
    """What may leave: user_id, email, plan, role, created_at; for marketing only of users whose consent (user_id, consent) is on record and true."""
    rows = users.select("user_id", "email", "plan", "role", "created_at")
    return rows.join(consents.where("consent").select("user_id").distinct(), "user_id", "left_semi") if purpose == "marketing" else rows
