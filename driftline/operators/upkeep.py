"""Sweeps, retention, claims, tiers and the paged feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.functions.time import after_hours, next_after_failure, next_after_success


def expired(rows: DataFrame, now: Column, until: str = "expires_at", status: str = "status", live: tuple[str, ...] = ("ACTIVE",), to: str = "EXPIRED", inclusive: bool = True) -> DataFrame:
    """Rows with the status of those whose time has come set, and ``changed``."""
    over = F.col(until) <= now if inclusive else F.col(until) < now
    due = F.coalesce(F.col(status).isin(*live) & over, F.lit(False))
    return rows.withColumn("changed", due).withColumn(status, F.when(due, to).otherwise(F.col(status)))


def stale_crawls(crawls: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Crawls that have been running for too long have failed."""
    due = (F.col("status") == "RUNNING") & (F.col("started_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
    return crawls.withColumn("changed", F.coalesce(due, F.lit(False))).withColumn("status", F.when(due, "FAILED").otherwise(F.col("status")))


def retained(rows: DataFrame, now: Column, hours: int, at: str = "created_at") -> DataFrame:
    """What a retention period leaves."""
    return rows.where(F.col(at) >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))


def claimed(stores: DataFrame, now: Column, limit: int, lease_minutes: int = 10) -> DataFrame:
    """The ``limit`` stores that have been due longest, with a lease until which no other run takes them."""
    due = stores.where((F.col("next_crawl_at") <= now) & (F.col("tier") != "DISABLED") & (F.col("lease_until").isNull() | (F.col("lease_until") <= now)))
    return due.orderBy("next_crawl_at", "store_id").limit(limit).withColumn("lease_until", now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lease_minutes)))


def tiers(stores: DataFrame, watches: DataFrame) -> DataFrame:
    """HOT where someone watches, COLD elsewhere; DISABLED stays."""
    n = watches.where(F.col("status") == "ACTIVE").groupBy("store_id").agg(F.count(F.lit(1)).alias("active_watches"))
    rows = stores.join(n, "store_id", "left").na.fill(0, ["active_watches"])
    return rows.withColumn("tier", F.when(F.col("tier") == "DISABLED", "DISABLED").when(F.col("active_watches") > 0, "HOT").otherwise("COLD"))


def after_crawl(stores: DataFrame, outcomes: DataFrame, now: Column, demote_at: int = 5) -> DataFrame:
    """Streaks and the next visit after crawls (store_id, outcome): a failure backs off and demotes in the end, an aborted diff is tried again in an hour.

    If the stores have ``baselined_at``, the first good crawl sets it, and no later one changes it.
    """
    rows = stores.join(outcomes, "store_id")
    if "baselined_at" in stores.columns:
        rows = rows.withColumn("baselined_at", F.coalesce("baselined_at", F.when(F.col("outcome") == "OK", now)))
    streak = F.when(F.col("outcome") == "OK", 0).when(F.col("outcome") == "ABORTED", F.col("failure_streak")).otherwise(F.col("failure_streak") + 1)
    rows = rows.withColumn("failure_streak", streak)
    rows = rows.withColumn("tier", F.when((F.col("outcome") == "FAILED") & (F.col("failure_streak") >= demote_at), "DISABLED").otherwise(F.col("tier")))
    return rows.withColumn(
        "next_crawl_at",
        F.when(F.col("outcome") == "OK", next_after_success(now, F.col("tier"))).when(F.col("outcome") == "ABORTED", after_hours(now, F.lit(1))).otherwise(next_after_failure(now, F.greatest(F.lit(1), F.col("failure_streak")))),
    ).drop("outcome")


def page(rows: DataFrame, cursor: tuple | None, limit: int | None = 20, at: str = "occurred_at", key: str = "event_id") -> DataFrame:
    """A page of the newest rows after the cursor (time, key) and whether there is more: ``next`` is true on the last row of a page that isn't the last.

    The limit is kept between 1 and 100. The cursor is a place in the order, so
    that rows that arrive meanwhile neither repeat nor hide any.
    """
    n = max(1, min(100, limit or 20))
    if cursor is not None:
        t, k = F.lit(cursor[0]), F.lit(cursor[1])
        rows = rows.where((F.col(at) < t) | ((F.col(at) == t) & (F.col(key) < k)))
    some = rows.orderBy(F.desc(at), F.desc(key)).limit(n + 1)
    w = Window.orderBy(F.desc(at), F.desc(key))  # n + 1 rows
    placed = some.withColumn("__place", F.row_number().over(w)).withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy()))
    return placed.where(F.col("__place") <= n).withColumn("next", (F.col("__place") == n) & (F.col("__all") > n)).drop("__place", "__all")


def users_where(users: DataFrame, admins: DataFrame, subscriptions: DataFrame, email: str | None = None, role: str | None = None, plan: str | None = None) -> DataFrame:
    """Users by optional conditions; the role USER is having no other role."""
    conditions = []
    if email:
        conditions.append(F.lower("email").contains(email.lower()))
    out = users.where(reduce(lambda a, b: a & b, conditions)) if conditions else users
    if role == "USER":
        out = out.join(admins, "user_id", "left_anti")
    elif role:
        out = out.join(admins.where(F.col("role") == role), "user_id", "left_semi")
    if plan:
        live = subscriptions.where((F.col("plan") == plan) & (F.col("status") == "ACTIVE"))
        out = out.join(live, "user_id", "left_semi")
    return out


def active_grants(grants: DataFrame, now: Column) -> DataFrame:
    return grants.where(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def effective_permissions(users: DataFrame, roles: DataFrame, grants: DataFrame, now: Column) -> DataFrame:
    """Permissions of the role and of active grants, sorted. ``roles``: role, permissions."""
    given = active_grants(grants, now).groupBy("user_id").agg(F.collect_set("permission").alias("given"))
    none = F.array().cast("array<string>")
    rows = users.join(roles, "role", "left").join(given, "user_id", "left")
    return rows.select("user_id", F.array_sort(F.array_union(F.coalesce("permissions", none), F.coalesce("given", none))).alias("permissions"))


def plan_entitlements(subscriptions: DataFrame, matrix: DataFrame) -> DataFrame:
    """Rebuild the entitlement rows of live subscriptions from the plan matrix (plan, feature_key, quota)."""
    live = subscriptions.where(F.col("status").isin("ACTIVE", "TRIALING"))
    return live.join(matrix, "plan").select("subscription_id", "user_id", "feature_key", "quota")


def conversions(signups: DataFrame, vendors: tuple[str, ...] = ("google", "linkedin", "meta", "reddit", "tiktok")) -> DataFrame:
    """A pending conversion for each vendor and each sign-up that consented."""
    return signups.where("consent").select("user_id", "created_at", F.explode(F.array(*[F.lit(v) for v in vendors])).alias("vendor"))


def to_dispatch(pending: DataFrame, limit: int = 100) -> DataFrame:
    return pending.orderBy("created_at", "user_id", "vendor").limit(limit)


def needs_details(observed: DataFrame, known: DataFrame) -> DataFrame:
    """Ads whose details must be bought: those whose destination isn't known."""
    done = known.where(F.col("destination_url").isNotNull())
    return observed.join(done, ["store_id", "platform", "external_ad_id"], "left_anti")


def erased(audit: DataFrame, user_ids: DataFrame) -> DataFrame:
    """Audit rows with the erased users taken out of them, each row once even where actor and subject are both erased."""
    gone = user_ids.select(F.col("user_id").alias("__gone"))
    marked = audit.join(gone.withColumnRenamed("__gone", "__a"), F.col("actor_id") == F.col("__a"), "left").join(gone.withColumnRenamed("__gone", "__s"), F.col("subject_id") == F.col("__s"), "left")
    out = marked.withColumns({"actor_id": F.when(F.col("__a").isNull(), F.col("actor_id")), "subject_id": F.when(F.col("__s").isNull(), F.col("subject_id")), "changed": F.col("__a").isNotNull() | F.col("__s").isNotNull()})
    return out.drop("__a", "__s")


def watch_expiry(plan: Column, own_end: Column, trial_end: Column) -> Column:
    """When a watch that is started now ends: by its own term, on the free plan with the trial if that is earlier. Null is never."""
    return F.when(plan == "FREE", F.least(own_end, trial_end)).otherwise(own_end)


def checkout_status(final_cents: Column, created_at: Column, now: Column, minutes: int = 60) -> Column:
    """COMPLETED at once where nothing is to be paid, else PENDING, and EXPIRED after a while, for nobody collects."""
    return F.when(final_cents <= 0, "COMPLETED").when(created_at <= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)), "EXPIRED").otherwise("PENDING")
