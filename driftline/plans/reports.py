"""Reports over the derived catalogs, users and ads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import plans as P
from driftline.functions.text import csv_line
from driftline.operators import analytics, reports
from driftline.operators import signals as S
from driftline.plans import derived as D
from driftline.plans.business import _PLANS
from driftline.plans.registry import query
from driftline.plans.signals import _presence
from driftline.session import table, written

TODAY = "2024-01-20 00:00:00"


@query(
    "growth_report",
    f"""WITH {D.CATALOG}, o AS (SELECT store_id, external_id, year, variant_count, bestseller_rank AS rank, lag(bestseller_rank) OVER w AS before, last_value(bestseller_rank) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS now FROM catalog WINDOW w AS (PARTITION BY store_id, external_id ORDER BY year)),
        g AS (SELECT store_id, external_id, arg_max(rank, year) AS current_rank, arg_max(rank, year) FILTER (WHERE rank <> now) AS previous_rank, count(*) AS n, min(year) AS first, max(year) AS last, arg_max(CASE WHEN variant_count > 1 THEN variant_count END, year) AS any_count,
              coalesce(bool_or(rank < before), false) AS up, coalesce(bool_or(rank > before), false) AS down FROM o GROUP BY ALL),
        e AS (SELECT store_id, max(year) AS fin, count(DISTINCT year) AS crawls FROM catalog GROUP BY ALL), y AS (SELECT DISTINCT store_id, year FROM catalog),
        k AS (SELECT g.store_id, g.external_id, count(*) AS seen FROM g JOIN y ON y.store_id = g.store_id AND y.year >= g.first GROUP BY ALL),
        r AS (SELECT store_id, external_id, variant_count FROM catalog JOIN e USING (store_id) WHERE year = fin AND part % 3 > 0),
        c AS (SELECT g.*, crawls, seen, CASE WHEN current_rank < 15 THEN current_rank END AS shown FROM g JOIN e USING (store_id) JOIN k USING (store_id, external_id) WHERE last = fin),
        p AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY shown IS NULL, shown, first DESC, external_id) AS place FROM c)
        SELECT store_id, external_id, place, current_rank, previous_rank, CASE WHEN n >= 4 AND up AND NOT down THEN 'IMPROVING' WHEN n >= 4 AND down AND NOT up THEN 'DECLINING' WHEN n >= 4 AND NOT up AND NOT down THEN 'STABLE' END AS momentum,
               CASE WHEN seen >= 3 THEN 'ESTABLISHED' WHEN crawls >= 3 THEN 'NEW' ELSE 'INSUFFICIENT_HISTORY' END AS freshness, n AS present, seen AS seen_crawls,
               CASE WHEN variant_count IS NULL THEN 'NOT_SAMPLED' WHEN variant_count > 1 THEN 'OBSERVED' ELSE 'UNSUPPORTED' END AS review_status
        FROM p LEFT JOIN r USING (store_id, external_id) WHERE place <= 20""",
)
def growth_report(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of 15 and more aren't shown, and a third of the products never had their reviews sampled."""
    rows = written(D.catalog(spark, sf), "catalog")
    crawls, products, moves = _presence(spark, sf, rows)
    seen = rows.select("store_id", "external_id", "part", F.col("year").alias("crawl_id"), F.make_date("year", F.lit(12), F.lit(31)).cast("timestamp_ntz").alias("captured_at"), F.col("bestseller_rank").alias("rank"), F.when(F.col("variant_count") > 1, F.col("variant_count")).alias("review_count"))
    ranks = S.rank_signals(seen).select("store_id", "external_id", "current_rank", "previous_rank", "momentum")
    ended = products.join(ranks.select("store_id", "external_id", F.when(F.col("current_rank") < 15, F.col("current_rank")).alias("bestseller_rank")), ["store_id", "external_id"])
    reviews = S.review_signal(seen.where("part % 3 > 0").withColumnRenamed("captured_at", "observed_at")).select("store_id", "external_id", "status")
    out = reports.growth_highlights(ended, ranks, S.persistence(crawls, products, moves), crawls, reviews)
    return out.select("store_id", "external_id", F.col("place").cast("long").alias("place"), "current_rank", "previous_rank", "momentum", "freshness", "present", "seen_crawls", "review_status")


def _usage(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.events(spark, sf).where((F.col("event_type") == "click") & (F.col("created_at") <= D.at(TODAY)))
    return rows.select("user_id", (F.col("event_id") % 5).alias("store_id"), "created_at")


def _watches(spark: SparkSession, sf: str) -> DataFrame:
    bought = D.events(spark, sf).where(F.col("event_type") == "purchase").select("user_id", (F.col("event_id") % 5).alias("store_id"), "created_at")
    begun = bought.groupBy("user_id", "store_id").agg(F.min("created_at").alias("started_at"))
    return begun.select("user_id", "store_id", "started_at", F.when(F.col("store_id") % 2 == 1, F.col("started_at") + F.expr("INTERVAL 30 DAY")).alias("expires_at"), F.when(F.col("store_id") == 4, "EXPIRED").otherwise("ACTIVE").alias("status"))


_USERS = f"""use AS (SELECT user_id, event_id % 5 AS store_id, ts FROM events WHERE event_type = 'click' AND ts <= TIMESTAMP '{TODAY}'),
    watch AS (SELECT user_id, event_id % 5 AS store_id, min(ts) AS started_at, CASE WHEN event_id % 5 % 2 = 1 THEN min(ts) + INTERVAL 30 DAY END AS expires_at FROM events WHERE event_type = 'purchase' GROUP BY user_id, event_id % 5)"""


@query(
    "dashboard_summary",
    f"""WITH {_PLANS}, {_USERS}, u AS (SELECT user_id, count(*) AS used, min(ts) + INTERVAL 24 HOUR AS resets_at FROM use WHERE ts >= TIMESTAMP '{TODAY}' - INTERVAL 24 HOUR GROUP BY ALL),
        w AS (SELECT user_id, count(*) AS slots_used FROM watch WHERE store_id <> 4 GROUP BY ALL), p AS (SELECT c_custkey AS user_id, coalesce(plan, 'FREE') AS plan FROM customer LEFT JOIN live ON user_id = c_custkey)
        SELECT user_id, plan, coalesce(used, 0) AS used, resets_at, coalesce(slots_used, 0) AS slots_used, CASE plan WHEN 'FREE' THEN 10 WHEN 'BASIC' THEN 50 ELSE 100 END AS analyses_limit, CASE plan WHEN 'FREE' THEN 1 WHEN 'BASIC' THEN 20 ELSE 50 END AS slots_limit
        FROM p LEFT JOIN u USING (user_id) LEFT JOIN w USING (user_id)""",
)
def dashboard_summary(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    rows = reports.dashboard(users, analytics.current_plans(D.subscriptions(spark, sf)), _usage(spark, sf), _watches(spark, sf), D.at(TODAY))
    return rows.select("user_id", "plan", "used", "resets_at", "slots_used", "analyses_limit", "slots_limit")


@query(
    "dashboard_stores",
    f"""WITH {_USERS}, {D.CATALOG}, n AS (SELECT store_id, count(*) AS product_count FROM catalog WHERE year = 1998 GROUP BY ALL)
        SELECT user_id, 'shop' || use.store_id || '.example' AS domain, max(ts) AS analyzed_at, coalesce(any_value(product_count), 0) AS product_count FROM use LEFT JOIN n USING (store_id) GROUP BY user_id, use.store_id""",
)
def dashboard_stores(spark: SparkSession, sf: str) -> DataFrame:
    products = D.year_of(D.catalog(spark, sf, D.CURRENT, D.CURRENT), D.CURRENT).withColumn("status", F.lit("ACTIVE"))
    return reports.dashboard_stores(_usage(spark, sf), D.stores(spark, sf), products).select("user_id", "domain", "analyzed_at", "product_count")


@query(
    "dashboard_watches",
    f"""WITH {_USERS} SELECT user_id, 'shop' || store_id || '.example' AS domain, started_at, expires_at, CASE WHEN expires_at IS NOT NULL THEN greatest(0, CAST(ceil((epoch_us(expires_at) - epoch_us(TIMESTAMP '{TODAY}')) / 86400000000.0) AS BIGINT)) END AS days_remaining,
        CASE WHEN store_id = 3 THEN 'DISABLED' ELSE 'HOT' END AS tier, CASE WHEN store_id <> 2 THEN TIMESTAMP '{TODAY}' - INTERVAL 1 DAY END AS last_crawled_at, CASE WHEN store_id <> 3 THEN TIMESTAMP '{TODAY}' END AS next_crawl_at FROM watch WHERE store_id <> 4""",
)
def dashboard_watches(spark: SparkSession, sf: str) -> DataFrame:
    stores = D.stores(spark, sf).select("store_id", "domain", F.when(F.col("store_id") == 3, "DISABLED").otherwise("HOT").alias("tier"), F.when(F.col("store_id") != 2, D.at(TODAY) - F.expr("INTERVAL 1 DAY")).alias("last_crawled_at"), D.at(TODAY).alias("next_crawl_at"))
    return reports.dashboard_watches(_watches(spark, sf), stores, D.at(TODAY))


@query(
    "marketing_report",
    f"""WITH a AS (SELECT n_regionkey AS store_id, s_suppkey, s_suppkey % 4 AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        s AS (SELECT r_regionkey AS store_id, CASE r_regionkey WHEN 0 THEN 'Advertising data has not been checked yet' WHEN 1 THEN 'Advertising check did not complete' WHEN 2 THEN 'Advertising data could not be checked' END AS reason FROM region)
        SELECT s.store_id, 'shop' || s.store_id || '.example' AS domain, CASE WHEN reason IS NULL THEN 'OBSERVED' ELSE 'UNAVAILABLE' END AS status, reason, CASE WHEN s.store_id >= 2 THEN TIMESTAMP '{TODAY}' END AS last_checked_at, CAST(s_suppkey AS VARCHAR) AS external_ad_id
        FROM s LEFT JOIN a ON a.store_id = s.store_id AND s.reason IS NULL AND k > 0""",
)
def marketing_report(spark: SparkSession, sf: str) -> DataFrame:
    """Store 0 was never checked, 1 broke off in its latest run, 2 couldn't be checked; a quarter of the suppliers' ads is no longer seen."""
    stores = D.stores(spark, sf)
    run = lambda n, outcome: stores.where(F.col("store_id") > 0).select("store_id", (D.at(TODAY) - F.make_dt_interval(F.lit(n))).alias("started_at"), F.when(outcome.isNotNull(), D.at(TODAY)).alias("finished_at"), outcome.alias("outcome"), F.lit(None).cast("string").alias("reason"))
    runs = run(2, F.lit("OBSERVED")).union(run(1, F.when(F.col("store_id") == 2, "UNAVAILABLE").when(F.col("store_id") > 2, "OBSERVED")))
    supplier = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    ads = supplier.select(F.col("n_regionkey").alias("store_id"), F.col("s_suppkey").cast("string").alias("external_ad_id"), F.when(F.col("s_suppkey") % 4 > 0, "ACTIVE_EVIDENCE").otherwise("NOT_OBSERVED").alias("status"))
    return reports.marketing_report(stores, runs, ads)


@query(
    "store_access",
    f"""WITH {_USERS} SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'anonymous_preview' WHEN EXISTS (SELECT 1 FROM use WHERE use.user_id = e.user_id AND use.store_id = e.event_id % 4) THEN 'full' ELSE 'unanalyzed_preview' END AS access FROM events e""",
)
def store_access(spark: SparkSession, sf: str) -> DataFrame:
    asked = D.events(spark, sf).select("event_id", F.when(F.col("event_id") % 7 > 0, F.col("user_id")).alias("user_id"), (F.col("event_id") % 4).alias("store_id"))
    return reports.store_access(asked, _usage(spark, sf)).select("event_id", "access")


@query(
    "plan_limits",
    f"""WITH {D.SUBSCRIPTIONS} SELECT subscription_id, CASE plan WHEN 'FREE' THEN 'BASIC' ELSE 'BUSINESS' END AS upgrade_to, subscription_id % 30 < CASE plan WHEN 'FREE' THEN 1 WHEN 'BASIC' THEN 20 ELSE 50 END AS under_limit, coalesce(expires_at, started_at + INTERVAL 30 DAY) AS trial_end FROM subs""",
)
def plan_limits(spark: SparkSession, sf: str) -> DataFrame:
    plan = F.col("plan")
    return D.subscriptions(spark, sf).select("subscription_id", P.next_plan_up(plan).alias("upgrade_to"), P.under_limit(F.col("subscription_id") % 30, P.plan_limit(plan, "slots")).alias("under_limit"), P.trial_end(F.col("expires_at"), F.col("started_at")).alias("trial_end"))


_DETAILS = f"""WITH {_PLANS}, {D.USERS}, {_USERS}, a AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 40 = 0 THEN 'OWNER' ELSE 'SUPPORT' END AS role FROM customer WHERE c_custkey % 20 = 0),
    d AS (SELECT user_id, email, created_at, coalesce(plan, 'FREE') AS plan, coalesce(role, 'USER') AS role, (SELECT count(*) FROM use WHERE use.user_id = u.user_id) AS analyses_used, (SELECT count(*) FROM watch w WHERE w.user_id = u.user_id AND store_id <> 4) AS active_watches
          FROM users u LEFT JOIN live USING (user_id) LEFT JOIN a USING (user_id))"""


def _details(spark: SparkSession, sf: str) -> DataFrame:
    from driftline.plans.upkeep import _admins

    return reports.user_details(D.users(spark, sf), analytics.current_plans(D.subscriptions(spark, sf)), _admins(spark, sf), _usage(spark, sf), _watches(spark, sf))


@query("user_details", f"{_DETAILS} SELECT * FROM d")
def user_details(spark: SparkSession, sf: str) -> DataFrame:
    return _details(spark, sf)


@query("marketing_export", f"{_DETAILS} SELECT user_id, email || ',' || plan || ',' || role AS line FROM d WHERE user_id % 3 = 0 AND user_id % 4 > 0")
def marketing_export(spark: SparkSession, sf: str) -> DataFrame:
    """CSV lines of users who consented; every third did, every fourth refused or was never asked."""
    key = F.col("c_custkey")
    consents = table(spark, sf, "customer").where(key % 4 > 0).select(key.alias("user_id"), (key % 3 == 0).alias("consent"))
    rows = reports.user_export(_details(spark, sf), consents, "marketing")
    return rows.select("user_id", csv_line(F.col("email"), F.col("plan"), F.col("role")).alias("line"))
