"""Business analytics over orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import analytics as A
from driftline.operators import rollups as R
from driftline.plans import derived as D
from driftline.plans.registry import query
from driftline.session import table

START, END = "2024-01-08 00:00:00", "2024-01-22 00:00:00"
FROM, TO = "1998-01-01 00:00:00", "1999-01-01 00:00:00"
STEPS = ["view", "click", "signup", "purchase"]


def _span() -> tuple:
    return D.at(START), D.at(END)


def _years() -> tuple:
    return D.at(FROM), D.at(TO)


_FIRSTS = "f AS (SELECT user_id, " + ", ".join(f"min(ts) FILTER (WHERE event_type = '{s}') AS \"{s}\"" for s in STEPS) + " FROM events GROUP BY ALL)"


@query(
    "funnel",
    f"WITH {_FIRSTS}, c AS ("
    + " UNION ALL ".join(f"SELECT {i} AS step, '{s}' AS name, count(*) FILTER (WHERE \"{s}\" >= TIMESTAMP '{START}' AND \"{s}\" < TIMESTAMP '{END}') AS users FROM f" for i, s in enumerate(STEPS))
    + ") SELECT step, name, users, CASE WHEN step > 0 THEN users / nullif(lag(users) OVER (ORDER BY step), 0)::DOUBLE END AS conversion FROM c",
)
def funnel(spark: SparkSession, sf: str) -> DataFrame:
    firsts = A.first_times(D.events(spark, sf), {s: F.col("event_type") == s for s in STEPS})
    return A.funnel(firsts, STEPS, *_span())


def _of(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return D.events(spark, sf).where(F.col("event_type") == kind)


@query(
    "activation",
    f"""WITH u AS (SELECT user_id, min(ts) AS created_at FROM events WHERE event_type = 'signup' GROUP BY ALL), c AS (SELECT * FROM u WHERE created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}'),
        n AS (SELECT count(*) AS signups, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.user_id AND event_type = 'click' AND ts <= created_at + INTERVAL 24 HOUR)) AS analysed,
              count(*) FILTER (WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.user_id AND event_type = 'purchase' AND ts <= created_at + INTERVAL 24 HOUR)) AS watched FROM c)
        SELECT *, analysed / nullif(signups, 0)::DOUBLE AS analysed_rate, watched / nullif(signups, 0)::DOUBLE AS watched_rate FROM n""",
)
def activation(spark: SparkSession, sf: str) -> DataFrame:
    users = _of(spark, sf, "signup").groupBy("user_id").agg(F.min("created_at").alias("created_at"))
    return A.activation(users, _of(spark, sf, "click"), _of(spark, sf, "purchase"), *_span())


@query(
    "retention",
    f"""WITH {D.SUBSCRIPTIONS}, {D.USERS}, f AS (SELECT user_id, true AS ever, bool_or(status = 'ACTIVE' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{TO}')) AS live FROM subs WHERE plan <> 'FREE' GROUP BY ALL)
        SELECT CAST(date_trunc('month', created_at) AS TIMESTAMP) AS cohort, count(*) AS cohort_size, count(*) FILTER (WHERE ever) AS ever_paid, count(*) FILTER (WHERE live) AS currently_paid,
               count(*) FILTER (WHERE ever) / count(*)::DOUBLE AS ever_paid_rate, count(*) FILTER (WHERE live) / count(*)::DOUBLE AS currently_paid_rate FROM users LEFT JOIN f USING (user_id) GROUP BY 1""",
)
def retention(spark: SparkSession, sf: str) -> DataFrame:
    return A.retention(D.users(spark, sf), D.subscriptions(spark, sf), D.at(TO))


_LIVE = f"status = 'ACTIVE' AND started_at <= TIMESTAMP '{TO}' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{TO}')"


@query("active_revenue", f"WITH {D.SUBSCRIPTIONS} SELECT plan, source, count(*) AS subscriptions, CAST(sum(cents) AS BIGINT) AS mrr_cents, count(DISTINCT user_id) AS users FROM priced WHERE {_LIVE} GROUP BY ALL")
def active_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return A.active_revenue(D.subscriptions(spark, sf), D.at(TO))


@query("average_revenue", f"WITH {D.SUBSCRIPTIONS} SELECT CAST(coalesce(sum(cents), 0) AS BIGINT) AS mrr_cents, count(DISTINCT user_id) AS users, sum(cents) / nullif(count(DISTINCT user_id), 0)::DOUBLE AS arpu_cents FROM priced WHERE {_LIVE}")
def average_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return A.average_revenue(D.subscriptions(spark, sf), D.at(TO))


_PRECEDED = f"WITH {D.SUBSCRIPTIONS}, before AS (SELECT s.*, (SELECT q.plan FROM subs q WHERE q.user_id = s.user_id AND q.started_at < s.started_at ORDER BY q.started_at DESC, q.plan DESC LIMIT 1) AS previous_plan FROM priced s)"


@query("plan_history", f"{_PRECEDED} SELECT subscription_id, plan, previous_plan FROM before")
def plan_history(spark: SparkSession, sf: str) -> DataFrame:
    return A.with_previous_plan(D.subscriptions(spark, sf)).select("subscription_id", "plan", "previous_plan")


@query(
    "revenue_movements",
    f"""{_PRECEDED}, m AS (SELECT *, CASE previous_plan WHEN 'BASIC' THEN 1900 WHEN 'BUSINESS' THEN 4900 ELSE 0 END AS old, started_at >= TIMESTAMP '{FROM}' AND started_at < TIMESTAMP '{TO}' AS begun FROM before)
        SELECT CAST(coalesce(sum(cents) FILTER (WHERE begun AND previous_plan IS NULL), 0) AS BIGINT) AS new_cents, CAST(coalesce(sum(cents - old) FILTER (WHERE begun AND previous_plan IS NOT NULL AND cents > old), 0) AS BIGINT) AS expansion_cents,
               CAST(coalesce(sum(old - cents) FILTER (WHERE begun AND cents < old), 0) AS BIGINT) AS contraction_cents,
               CAST(coalesce(sum(cents) FILTER (WHERE status = 'EXPIRED' AND expires_at >= TIMESTAMP '{FROM}' AND expires_at < TIMESTAMP '{TO}'), 0) AS BIGINT) AS churned_cents FROM m""",
)
def revenue_movements(spark: SparkSession, sf: str) -> DataFrame:
    return A.revenue_movements(D.subscriptions(spark, sf), *_years())


_PLANS = f"{D.SUBSCRIPTIONS}, live AS (SELECT user_id, arg_max(plan, (started_at, subscription_id)) AS plan FROM subs WHERE status = 'ACTIVE' GROUP BY ALL)"
_IN = f"ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'"


@query(
    "usage_by_plan",
    f"""WITH {_PLANS}, n AS (SELECT coalesce(plan, 'FREE') AS plan, count(*) AS analyses FROM events LEFT JOIN live USING (user_id) WHERE event_type = 'click' AND {_IN} GROUP BY 1)
        SELECT p.plan, coalesce(analyses, 0) AS analyses FROM (VALUES ('FREE'), ('BASIC'), ('BUSINESS')) p(plan) LEFT JOIN n USING (plan)""",
)
def usage_by_plan(spark: SparkSession, sf: str) -> DataFrame:
    return A.usage_by_plan(_of(spark, sf, "click"), D.subscriptions(spark, sf), *_span())


_DAILY = f"WITH {_PLANS}, daily AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, coalesce(plan, 'FREE') AS plan, count(*) AS analyses FROM events LEFT JOIN live USING (user_id) WHERE event_type = 'click' AND {_IN} GROUP BY 1, 2)"


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return A.daily_usage(_of(spark, sf, "click"), D.subscriptions(spark, sf), *_span())


@query("daily_usage", f"{_DAILY} SELECT * FROM daily")
def daily_usage(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf)


@query("daily_usage_wide", f"{_DAILY} SELECT day, " + ", ".join(f"CAST(coalesce(sum(analyses) FILTER (WHERE plan = '{p}'), 0) AS BIGINT) AS \"{p}\"" for p in ("FREE", "BASIC", "BUSINESS")) + " FROM daily GROUP BY day")
def daily_usage_wide(spark: SparkSession, sf: str) -> DataFrame:
    return A.daily_usage_wide(_daily(spark, sf))


@query("crawl_volume", f"SELECT count(*) AS crawls, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'error') / nullif(count(*), 0)::DOUBLE AS failure_rate FROM events WHERE {_IN}")
def crawl_volume(spark: SparkSession, sf: str) -> DataFrame:
    crawls = D.events(spark, sf).select(F.col("created_at").alias("started_at"), F.when(F.col("event_type") == "error", "FAILED").otherwise("OK").alias("status"))
    return A.crawl_volume(crawls, *_span())


@query(
    "vendor_cost",
    f"""WITH {_PLANS}, w AS (SELECT DISTINCT user_id % 40 AS store_id FROM events JOIN live USING (user_id) WHERE plan = 'BUSINESS' AND event_type = 'purchase'),
        n AS (SELECT count(*) AS paid_calls FROM events WHERE event_type = 'view' AND {_IN} AND event_id % 40 IN (SELECT store_id FROM w)), b AS (SELECT count(*) AS accounts FROM live WHERE plan = 'BUSINESS')
        SELECT paid_calls, accounts, paid_calls * 1.5::DOUBLE AS cost_cents, paid_calls * 1.5::DOUBLE / nullif(accounts, 0) AS cost_per_account_cents FROM n, b""",
)
def vendor_cost(spark: SparkSession, sf: str) -> DataFrame:
    runs = _of(spark, sf, "view").select((F.col("event_id") % 40).alias("store_id"), F.col("created_at").alias("started_at"), F.lit(1).cast("long").alias("paid_calls"))
    watches = _of(spark, sf, "purchase").select("user_id", (F.col("user_id") % 40).alias("store_id"))
    return A.vendor_cost(runs, watches, D.subscriptions(spark, sf), *_span())


@query(
    "rolling_usage",
    """SELECT event_id, count(*) OVER w AS used, min(ts) OVER w + INTERVAL 24 HOUR AS resets_at FROM events WHERE event_type = 'click'
        WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW)""",
)
def rolling_usage(spark: SparkSession, sf: str) -> DataFrame:
    return A.rolling_usage(_of(spark, sf, "click")).select("event_id", "used", "resets_at")


@query(
    "best_entitlements",
    """WITH e AS (SELECT o_orderkey AS entitlement_id, o_custkey AS account_id, o_orderpriority AS feature_key, CASE o_orderkey % 4 WHEN 0 THEN 'OVERRIDE' WHEN 1 THEN 'SUBSCRIPTION' WHEN 2 THEN 'TRIAL' ELSE 'DEFAULT' END AS reason,
               CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 7 END AS quota, o_orderdate AS created_at FROM orders)
        SELECT account_id, feature_key, entitlement_id, quota FROM e QUALIFY row_number() OVER (PARTITION BY account_id, feature_key ORDER BY CASE reason WHEN 'OVERRIDE' THEN 0 WHEN 'SUBSCRIPTION' THEN 1 WHEN 'TRIAL' THEN 2 ELSE 3 END, quota IS NOT NULL, quota DESC, created_at DESC, entitlement_id) = 1""",
)
def best_entitlements(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        key.alias("entitlement_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderpriority").alias("feature_key"),
        F.when(key % 4 == 0, "OVERRIDE").when(key % 4 == 1, "SUBSCRIPTION").when(key % 4 == 2, "TRIAL").otherwise("DEFAULT").alias("reason"),
        F.when(key % 7 != 0, key % 7).alias("quota"),
        F.col("o_orderdate").alias("created_at"),
    )
    return A.best_entitlements(rows).select("account_id", "feature_key", "entitlement_id", "quota")


_LIMITS = "CASE plan WHEN 'BUSINESS' THEN 5 WHEN 'BASIC' THEN 3 ELSE 1 END"


@query(
    "over_limit_watches",
    f"""WITH {_PLANS} SELECT event_id AS watch_id FROM (SELECT event_id, {_LIMITS} AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events JOIN live USING (user_id) WHERE event_type = 'purchase') WHERE place > m""",
)
def over_limit_watches(spark: SparkSession, sf: str) -> DataFrame:
    limits = A.current_plans(D.subscriptions(spark, sf)).select("user_id", F.expr(_LIMITS).alias("max_watches"))
    watches = _of(spark, sf, "purchase").withColumnRenamed("event_id", "watch_id")
    return A.over_limit_watches(watches, limits).select("watch_id")


@query(
    "failed_logins",
    """WITH a AS (SELECT event_id, user_id AS email, user_id % 50 AS ip, event_type <> 'error' AS ok, ts FROM events),
        e AS (SELECT *, coalesce(max(CASE WHEN ok THEN ts END) OVER (PARTITION BY email ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TIMESTAMP '1970-01-01') AS era FROM a)
        SELECT event_id, CAST(coalesce(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY email, era ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND INTERVAL '0.000001 seconds' PRECEDING), 0) AS BIGINT) AS email_failures,
               CAST(coalesce(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY ip ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND INTERVAL '0.000001 seconds' PRECEDING), 0) AS BIGINT) AS ip_failures FROM e""",
)
def failed_logins(spark: SparkSession, sf: str) -> DataFrame:
    attempts = D.events(spark, sf).select("event_id", F.col("user_id").alias("email"), (F.col("user_id") % 50).alias("ip"), (F.col("event_type") != "error").alias("succeeded"), "created_at")
    return A.failed_logins(attempts).select("event_id", "email_failures", "ip_failures")


@query(
    "operational",
    """SELECT 'watches.active' AS metric, count(*) FILTER (WHERE o_orderstatus <> 'F') AS value FROM orders UNION ALL SELECT 'stores.total', count(*) FROM supplier
        UNION ALL SELECT 'stores.due', count(*) FILTER (WHERE s_acctbal <= 5000 AND s_suppkey % 5 <> 0) FROM supplier UNION ALL SELECT 'crawls.running', count(*) FILTER (WHERE event_type = 'view') FROM events""",
)
def operational(spark: SparkSession, sf: str) -> DataFrame:
    watches = D.subscriptions(spark, sf)
    stores = table(spark, sf, "supplier").select((D.at("2000-01-01 00:00:00") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("s_acctbal").cast("decimal(18,6)"))).alias("next_crawl_at"), F.when(F.col("s_suppkey") % 5 == 0, "DISABLED").otherwise("HOT").alias("tier"))
    crawls = D.events(spark, sf).select(F.when(F.col("event_type") == "view", "RUNNING").otherwise("OK").alias("status"))
    return A.operational(watches, stores, crawls, D.at("2000-01-01 01:23:20"))


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Daily usage as stored metrics: a point per day, and the last day's again under a rolled-up key."""
    daily = _daily(spark, sf)
    day = F.col("day")
    later = day + F.expr("INTERVAL 1 DAY")
    n = {"usage.analyses": F.col("analyses")}
    return R.long_rows(daily, n, F.col("plan"), day, later, later).unionByName(R.long_rows(daily, n, F.col("plan"), day, later, later, ":1d"))


_METRICS = f"{_DAILY}, m AS (SELECT 'usage.analyses' || s AS metric_key, plan AS dimension, day AS window_start, day + INTERVAL 1 DAY AS window_end, analyses::DOUBLE AS value FROM daily, (VALUES (''), (':1d')) x(s))"


@query("metric_rollup", f"{_METRICS} SELECT metric_key, dimension, window_start, window_end, value FROM m WHERE NOT metric_key LIKE '%:1d' OR window_end = (SELECT max(window_end) FROM m q WHERE q.metric_key = m.metric_key AND q.dimension = m.dimension)")
def metric_rollup(spark: SparkSession, sf: str) -> DataFrame:
    stored = _metrics(spark, sf)
    again = stored.withColumn("computed_at", F.col("computed_at") + F.expr("INTERVAL 1 HOUR"))
    return R.pruned(R.upserted(stored, again)).drop("computed_at")


@query("latest_metric", f"{_METRICS} SELECT dimension, arg_max(value, window_end) AS value FROM m WHERE metric_key = 'usage.analyses' GROUP BY ALL")
def latest_metric(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest_per_dimension(_metrics(spark, sf), "usage.analyses").select("dimension", "value")


@query("metric_dashboard", f"{_METRICS} SELECT metric_key, dimension, arg_max(value, window_end) AS value, max(window_end) AS window_end FROM m GROUP BY ALL")
def metric_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return R.dashboard(_metrics(spark, sf))


@query(
    "retention_cohorts",
    f"""WITH {D.SUBSCRIPTIONS}, {D.USERS}, f AS (SELECT user_id, true AS ever, bool_or(status = 'ACTIVE') AS live FROM subs WHERE plan <> 'FREE' GROUP BY ALL)
        SELECT strftime(date_trunc('month', created_at), '%Y-%m') AS cohort, count(*)::DOUBLE AS cohort_size, (count(*) FILTER (WHERE ever))::DOUBLE AS ever_paid, (count(*) FILTER (WHERE live))::DOUBLE AS currently_paid FROM users LEFT JOIN f USING (user_id) GROUP BY 1""",
)
def retention_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    wide = A.retention(D.users(spark, sf), D.subscriptions(spark, sf), D.at(TO))
    names = {f"retention.{c}": F.col(c) for c in ("cohort_size", "ever_paid", "currently_paid")}
    return R.retention_cohorts(R.long_rows(wide, names, F.date_format("cohort", "yyyy-MM"), F.col("cohort"), F.col("cohort"), D.at(TO)))


@query(
    "current_plans",
    f"WITH {_PLANS} SELECT c_custkey AS user_id, coalesce(plan, 'FREE') AS plan FROM customer LEFT JOIN live ON user_id = c_custkey",
)
def current_plans(spark: SparkSession, sf: str) -> DataFrame:
    plans = A.current_plans(D.subscriptions(spark, sf))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).join(plans, "user_id", "left").na.fill("FREE", ["plan"])
