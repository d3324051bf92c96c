"""Business figures: funnel, activation, retention, revenue, usage and its cost.

Frames: ``users`` (user_id, created_at); ``analyses`` (user_id, created_at, and
perhaps plan); ``watches`` (user_id, created_at, store_id); ``subscriptions``
(user_id, plan, source, status, started_at, expires_at, created_at); ``crawls``
(crawl_id, status, started_at); ``runs`` (store_id, started_at, paid_calls).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.config import PLAN_CENTS, PLANS, VENDOR_CALL_CENTS
from driftline.functions.time import day_floor, in_window, month_floor

PAID = tuple(p for p in PLANS if PLAN_CENTS[p] > 0)


def _price(plan: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in PLAN_CENTS.items() for x in pair])
    return F.coalesce(known[plan], F.lit(0)).cast("long")


def first_times(events: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Per user the first time of each step, in one pass."""
    return events.groupBy("user_id").agg(*[F.min(F.when(c, F.col("created_at"))).alias(n) for n, c in steps.items()])


def funnel(firsts: DataFrame, steps: list[str], start: Column, end: Column) -> DataFrame:
    """Users whose first time of a step lies in [start, end), and the share of the step before."""
    counts = firsts.agg(*[F.count_if(in_window(F.col(s), start, end)).alias(s) for s in steps])
    pairs = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("name"), F.col(s).alias("users")) for i, s in enumerate(steps)])
    rows = F.transform(pairs, lambda p: F.struct(p["step"].alias("step"), p["name"].alias("name"), p["users"].alias("users"), F.try_divide(p["users"], F.get(pairs, p["step"] - 1)["users"]).alias("conversion")))
    first = lambda p: F.when(p["step"] > 0, p["conversion"])
    return counts.select(F.inline(F.transform(rows, lambda p: F.struct(p["step"].alias("step"), p["name"].alias("name"), p["users"].alias("users"), first(p).alias("conversion")))))


def activation(users: DataFrame, analyses: DataFrame, watches: DataFrame, start: Column, end: Column, hours: int = 24) -> DataFrame:
    """Of the users who signed up in the window, those who analysed and who watched within ``hours``; there is only an upper bound of time."""
    a = analyses.groupBy("user_id").agg(F.min("created_at").alias("analysed_at"))
    w = watches.groupBy("user_id").agg(F.min("created_at").alias("watched_at"))
    cohort = users.where(in_window(F.col("created_at"), start, end)).join(a, "user_id", "left").join(w, "user_id", "left")
    until = F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(hours))
    out = cohort.agg(F.count(F.lit(1)).alias("signups"), F.count_if(F.col("analysed_at") <= until).alias("analysed"), F.count_if(F.col("watched_at") <= until).alias("watched"))
    return out.withColumns({"analysed_rate": F.try_divide("analysed", "signups"), "watched_rate": F.try_divide("watched", "signups")})


def retention(users: DataFrame, subscriptions: DataFrame, now: Column) -> DataFrame:
    """Per month of sign-up: the cohort, who ever paid, who pays now."""
    paid = subscriptions.where(F.col("plan").isin(*PAID))
    live = (F.col("status") == "ACTIVE") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    flags = paid.groupBy("user_id").agg(F.lit(True).alias("ever"), F.bool_or(live).alias("live"))
    rows = users.join(flags, "user_id", "left").groupBy(month_floor(F.col("created_at")).alias("cohort"))
    out = rows.agg(F.count(F.lit(1)).alias("cohort_size"), F.count_if(F.col("ever")).alias("ever_paid"), F.count_if(F.col("live")).alias("currently_paid"))
    return out.withColumns({"ever_paid_rate": F.try_divide("ever_paid", "cohort_size"), "currently_paid_rate": F.try_divide("currently_paid", "cohort_size")})


def active_revenue(subscriptions: DataFrame, end: Column) -> DataFrame:
    """Active subscriptions begun by ``end`` and their monthly cents, by plan and source. It is today's status, even for the past."""
    live = subscriptions.where((F.col("status") == "ACTIVE") & (F.col("started_at") <= end) & (F.col("expires_at").isNull() | (F.col("expires_at") > end)))
    return live.groupBy("plan", "source").agg(F.count(F.lit(1)).alias("subscriptions"), F.sum(_price(F.col("plan"))).alias("mrr_cents"), F.count_distinct("user_id").alias("users"))


def average_revenue(subscriptions: DataFrame, end: Column) -> DataFrame:
    live = subscriptions.where((F.col("status") == "ACTIVE") & (F.col("started_at") <= end) & (F.col("expires_at").isNull() | (F.col("expires_at") > end)))
    out = live.agg(F.coalesce(F.sum(_price(F.col("plan"))), F.lit(0)).alias("mrr_cents"), F.count_distinct("user_id").alias("users"))
    return out.withColumn("arpu_cents", F.try_divide("mrr_cents", "users"))


def with_previous_plan(subscriptions: DataFrame) -> DataFrame:
    """Add the plan that the user had strictly before, as of the start; rows that start together have the same one, and of rows that started together the larger plan counts."""
    before = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("started_at").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    return subscriptions.withColumn("previous_plan", F.max_by("plan", F.struct("started_at", "plan")).over(before))


def revenue_movements(subscriptions: DataFrame, start: Column, end: Column) -> DataFrame:
    """New, expansion, contraction and churned monthly cents of the window."""
    rows = with_previous_plan(subscriptions)
    change = _price(F.col("plan")) - _price(F.col("previous_plan"))
    begun = in_window(F.col("started_at"), start, end)
    total = lambda when, x: F.coalesce(F.sum(F.when(when, x)), F.lit(0)).alias
    ended = (F.col("status") == "EXPIRED") & in_window(F.col("expires_at"), start, end)
    return rows.agg(
        total(begun & F.col("previous_plan").isNull(), _price(F.col("plan")))("new_cents"),
        total(begun & (change > 0) & F.col("previous_plan").isNotNull(), change)("expansion_cents"),
        total(begun & (change < 0), -change)("contraction_cents"),
        total(ended, _price(F.col("plan")))("churned_cents"),
    )


def current_plans(subscriptions: DataFrame) -> DataFrame:
    """The newest live plan of each user."""
    live = subscriptions.where(F.col("status").isin("ACTIVE", "TRIALING"))
    return live.groupBy("user_id").agg(F.max_by("plan", F.struct("started_at", "subscription_id")).alias("plan"))


def usage_by_plan(analyses: DataFrame, subscriptions: DataFrame, start: Column, end: Column) -> DataFrame:
    """Analyses of the window by the user's current plan, FREE by default; every plan has a row."""
    inside = analyses.where(in_window(F.col("created_at"), start, end))
    counts = inside.join(current_plans(subscriptions), "user_id", "left").groupBy(F.coalesce("plan", F.lit("FREE")).alias("plan")).agg(F.count(F.lit(1)).alias("analyses"))
    plans = analyses.sparkSession.createDataFrame([(p,) for p in PLANS], "plan string")
    return plans.join(counts, "plan", "left").na.fill(0, ["analyses"])


def daily_usage(analyses: DataFrame, subscriptions: DataFrame, start: Column, end: Column) -> DataFrame:
    """(day, plan, analyses)."""
    inside = analyses.where(in_window(F.col("created_at"), start, end))
    return inside.join(current_plans(subscriptions), "user_id", "left").groupBy(day_floor(F.col("created_at")).alias("day"), F.coalesce("plan", F.lit("FREE")).alias("plan")).agg(F.count(F.lit(1)).alias("analyses"))


def daily_usage_wide(daily: DataFrame) -> DataFrame:
    return daily.groupBy("day").pivot("plan", list(PLANS)).agg(F.sum("analyses")).na.fill(0)


def crawl_volume(crawls: DataFrame, start: Column, end: Column) -> DataFrame:
    """Crawls of the window, running ones too, and failures; a blocked crawl is none."""
    inside = crawls.where(in_window(F.col("started_at"), start, end))
    return inside.agg(F.count(F.lit(1)).alias("crawls"), F.count_if(F.col("status") == "FAILED").alias("failed")).withColumn("failure_rate", F.try_divide("failed", "crawls"))


def vendor_cost(runs: DataFrame, watches: DataFrame, subscriptions: DataFrame, start: Column, end: Column) -> DataFrame:
    """Paid calls of the window for stores that a BUSINESS account watches, and their cents; a run counts once however many watch."""
    business = current_plans(subscriptions).where(F.col("plan") == "BUSINESS")
    watched = watches.join(business, "user_id", "left_semi").select("store_id").distinct()
    calls = runs.where(in_window(F.col("started_at"), start, end)).join(watched, "store_id", "left_semi").agg(F.coalesce(F.sum("paid_calls"), F.lit(0)).alias("paid_calls"))
    accounts = business.agg(F.count(F.lit(1)).alias("accounts"))
    both = calls.join(F.broadcast(accounts))  # one row each
    cents = F.col("paid_calls") * F.lit(VENDOR_CALL_CENTS)
    return both.withColumns({"cost_cents": cents, "cost_per_account_cents": F.try_divide(cents, F.col("accounts"))})


def rolling_usage(usage: DataFrame, hours: int = 24) -> DataFrame:
    """At each use: the user's uses in the hours up to it, and when the oldest of them frees its place."""
    seconds = F.unix_micros(F.col("created_at").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-hours * 3_600_000_000 + 1, 0)
    return usage.withColumns({"used": F.count(F.lit(1)).over(w), "resets_at": F.min("created_at").over(w) + F.make_dt_interval(F.lit(0), F.lit(hours))})


def best_entitlements(entitlements: DataFrame) -> DataFrame:
    """One entitlement per account and feature: by reason, then the larger quota (null is unlimited), then the newer."""
    reason = F.when(F.col("reason") == "OVERRIDE", 0).when(F.col("reason") == "SUBSCRIPTION", 1).when(F.col("reason") == "TRIAL", 2).otherwise(3)
    w = Window.partitionBy("account_id", "feature_key").orderBy(reason, F.col("quota").isNotNull(), F.desc("quota"), F.desc("created_at"), "entitlement_id")
    return entitlements.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def over_limit_watches(watches: DataFrame, limits: DataFrame) -> DataFrame:
    """Watches beyond their user's limit: the oldest stay."""
    w = Window.partitionBy("user_id").orderBy("created_at", "watch_id")
    return watches.join(limits, "user_id").withColumn("place", F.row_number().over(w)).where(F.col("place") > F.col("max_watches")).drop("place")


def operational(watches: DataFrame, stores: DataFrame, crawls: DataFrame, now: Column) -> DataFrame:
    """Counts of the moment, as long rows (metric, value)."""
    due = (F.col("next_crawl_at") <= now) & (F.col("tier") != "DISABLED")
    parts = [
        watches.agg(F.count_if(F.col("status") == "ACTIVE").alias("value")).withColumn("metric", F.lit("watches.active")),
        stores.agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("stores.total")),
        stores.agg(F.count_if(due).alias("value")).withColumn("metric", F.lit("stores.due")),
        crawls.agg(F.count_if(F.col("status") == "RUNNING").alias("value")).withColumn("metric", F.lit("crawls.running")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("metric", "value")


def failed_logins(attempts: DataFrame, minutes: int = 15) -> DataFrame:
    """At each attempt the earlier failures of its e-mail, since that e-mail's last success, and of its address, within ``minutes``. Attempts of one moment don't see each other."""
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    span = (-minutes * 60_000_000, -1)
    failed = (~F.col("succeeded")).cast("long")
    ok_at = F.max(F.when(F.col("succeeded"), at)).over(Window.partitionBy("email").orderBy(at).rangeBetween(Window.unboundedPreceding, -1))
    rows = attempts.withColumn("__era", F.coalesce(ok_at, F.lit(0)))
    by_email = Window.partitionBy("email", "__era").orderBy(at).rangeBetween(*span)
    by_ip = Window.partitionBy("ip").orderBy(at).rangeBetween(*span)
    return rows.withColumns({"email_failures": F.coalesce(F.sum(failed).over(by_email), F.lit(0)), "ip_failures": F.coalesce(F.sum(failed).over(by_ip), F.lit(0))}).drop("__era")


def login_delay_ms(email_failures: Column, ip_failures: Column) -> Column:
    """What a further attempt waits; null where it is locked out."""
    delay = F.least(F.lit(8000.0), F.lit(500.0) * F.pow(F.lit(2.0), F.least(email_failures, F.lit(10)) - 5))
    return F.when((email_failures >= 10) | (ip_failures >= 30), F.lit(None)).when(email_failures < 5, F.lit(0.0)).otherwise(delay).cast("long")
