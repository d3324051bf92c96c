"""State upkeep: merges, sweeps, claims, ledgers, feeds and access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import ledger as L
from driftline.operators import state as S
from driftline.operators import upkeep as U
from driftline.plans import derived as D
from driftline.plans.registry import query
from driftline.session import table

NOW = "2000-01-01 00:00:00"
MID = "2024-01-15 00:00:00"


@query(
    "product_upsert",
    f"""WITH {D.CATALOG}, a AS (SELECT * FROM catalog WHERE year = 1997), b AS (SELECT * FROM catalog WHERE year = 1998)
        SELECT coalesce(a.store_id, b.store_id) AS store_id, coalesce(a.external_id, b.external_id) AS external_id, CASE WHEN a.part IS NOT NULL THEN 1997 ELSE 1998 END::BIGINT AS first_seen,
               CASE WHEN b.part IS NULL OR (a.part IS NOT NULL AND b.available_variants = 0) THEN coalesce(a.year, b.year) ELSE 1998 END AS last_seen, coalesce(b.price_min_cents, a.price_min_cents) AS price_min_cents,
               CASE WHEN b.part IS NULL THEN 'ACTIVE' WHEN b.available_variants = 0 THEN 'MISSING' ELSE 'ACTIVE' END AS status, coalesce(b.compare_at_max_cents, a.compare_at_max_cents) AS compare_at
        FROM a FULL JOIN b ON a.store_id = b.store_id AND a.external_id = b.external_id""",
)
def product_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A first sighting stays, a last one moves only for what is active, an unknown value doesn't erase a known one."""
    catalog = D.catalog(spark, sf, D.SINCE, D.CURRENT)
    shape = lambda y, status: D.year_of(catalog, y).select("store_id", "external_id", F.col("year").alias("first_seen"), F.col("year").alias("last_seen"), "price_min_cents", status.alias("status"), F.col("compare_at_max_cents").alias("compare_at"))
    state = shape(D.SINCE, F.lit("ACTIVE"))
    new = shape(D.CURRENT, F.when(F.col("available_variants") == 0, "MISSING").otherwise("ACTIVE"))
    return S.merge(state, new, ["store_id", "external_id"], keep=("first_seen",), fill=("compare_at",), when_active=("last_seen",))


@query("insert_missing", "SELECT c_custkey AS user_id, c_mktsegment AS segment FROM customer")
def insert_missing(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return S.insert_missing(rows.where("user_id % 2 = 0"), rows, ["user_id"])


@query("versioned_state", "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer")
def versioned_state(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions on disk; a version that is written again replaces itself."""
    from driftline.session import scratch_path

    target = S.VersionedTable(spark, scratch_path(spark, "versions"))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    target.write(rows, 0)
    for _ in range(2):
        target.write(S.merge(target.read(0), rows.where("user_id % 3 = 0").withColumn("segment", F.lit("new")), ["user_id"]), 1)
    return target.read()


@query("purge", "SELECT o_orderkey FROM orders WHERE o_custkey % 10 <> 0")
def purge(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return S.purge(table(spark, sf, "orders"), gone, ["o_custkey"]).select("o_orderkey")


@query("expiry_sweep", f"WITH {D.SUBSCRIPTIONS}, s AS (SELECT subscription_id, CASE WHEN subscription_id % 2 = 0 THEN 'ACTIVE' ELSE status END AS status, expires_at FROM subs) SELECT subscription_id, CASE WHEN status = 'ACTIVE' AND expires_at <= TIMESTAMP '{NOW}' THEN 'EXPIRED' ELSE status END AS status, coalesce(status = 'ACTIVE' AND expires_at <= TIMESTAMP '{NOW}', false) AS changed FROM s")
def expiry_sweep(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.subscriptions(spark, sf).withColumn("status", F.when(F.col("subscription_id") % 2 == 0, "ACTIVE").otherwise(F.col("status")))
    return U.expired(rows, D.at(NOW)).select("subscription_id", "status", "changed")


@query("stale_crawls", f"SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '{MID}' - INTERVAL 30 MINUTE THEN 'FAILED' WHEN event_type = 'view' THEN 'RUNNING' ELSE 'OK' END AS status FROM events")
def stale_crawls(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", "RUNNING").otherwise("OK").alias("status"), F.col("ts").alias("started_at"))
    return U.stale_crawls(rows, D.at(MID)).select("event_id", "status")


@query("retention_sweep", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{MID}' - INTERVAL 48 HOUR")
def retention_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return U.retained(D.events(spark, sf), D.at(MID), 48).select("event_id")


_DUE = "CASE WHEN s_suppkey % 5 = 0 THEN 'DISABLED' ELSE 'HOT' END AS tier, TIMESTAMP '2024-01-15' + to_minutes(CAST(s_suppkey % 100 - 50 AS BIGINT)) AS next_crawl_at"


@query("due_claim", f"WITH s AS (SELECT s_suppkey AS store_id, {_DUE} FROM supplier) SELECT store_id, TIMESTAMP '2024-01-15 00:10:00' AS lease_until FROM s WHERE tier <> 'DISABLED' AND next_crawl_at <= TIMESTAMP '{MID}' ORDER BY next_crawl_at, store_id LIMIT 20")
def due_claim(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    stores = table(spark, sf, "supplier").select(key.alias("store_id"), F.when(key % 5 == 0, "DISABLED").otherwise("HOT").alias("tier"), (D.at(MID) + F.make_dt_interval(F.lit(0), F.lit(0), (key % 100 - 50).cast("int"))).alias("next_crawl_at"), F.lit(None).cast("timestamp_ntz").alias("lease_until"))
    return U.claimed(stores, D.at(MID), 20).select("store_id", "lease_until")


@query("tiers", "WITH n AS (SELECT l_suppkey, count(*) FILTER (WHERE l_linestatus = 'O') AS k FROM lineitem GROUP BY ALL) SELECT s_suppkey AS store_id, CASE WHEN s_suppkey % 5 = 0 THEN 'DISABLED' WHEN coalesce(k, 0) > 0 THEN 'HOT' ELSE 'COLD' END AS tier, coalesce(k, 0) AS active_watches FROM supplier LEFT JOIN n ON l_suppkey = s_suppkey")
def tiers(spark: SparkSession, sf: str) -> DataFrame:
    stores = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("store_id"), F.when(F.col("s_suppkey") % 5 == 0, "DISABLED").otherwise("COLD").alias("tier"))
    watches = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("store_id"), F.when(F.col("l_linestatus") == "O", "ACTIVE").otherwise("EXPIRED").alias("status"))
    return U.tiers(stores, watches).select("store_id", "tier", "active_watches")


@query(
    "after_crawl",
    f"""WITH s AS (SELECT s_suppkey AS store_id, s_suppkey % 6 AS streak, ['OK', 'FAILED', 'ABORTED'][s_suppkey % 3 + 1] AS o FROM supplier), t AS (SELECT *, CASE o WHEN 'OK' THEN 0 WHEN 'ABORTED' THEN streak ELSE streak + 1 END AS f FROM s)
        SELECT store_id, CAST(f AS BIGINT) AS failure_streak, CASE WHEN o = 'FAILED' AND f >= 5 THEN 'DISABLED' ELSE 'HOT' END AS tier, TIMESTAMP '{MID}' + to_hours(CASE o WHEN 'OK' THEN 8 WHEN 'ABORTED' THEN 1 ELSE least(48, CAST(pow(2, f - 1) AS INTEGER)) END) AS next_crawl_at FROM t""",
)
def after_crawl(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    stores = table(spark, sf, "supplier").select(key.alias("store_id"), (key % 6).alias("failure_streak"), F.lit("HOT").alias("tier"), D.at(MID).alias("next_crawl_at"))
    outcome = F.element_at(F.array(F.lit("OK"), F.lit("FAILED"), F.lit("ABORTED")), (key % 3 + 1).cast("int"))
    outcomes = table(spark, sf, "supplier").select(key.alias("store_id"), outcome.alias("outcome"))
    return U.after_crawl(stores, outcomes, D.at(MID)).select("store_id", "failure_streak", "tier", "next_crawl_at")


@query("baselined_stores", f"SELECT s_suppkey AS store_id, CASE WHEN s_suppkey % 4 = 0 THEN TIMESTAMP '{NOW}' WHEN s_suppkey % 3 = 0 THEN TIMESTAMP '{MID}' END AS baselined_at FROM supplier")
def baselined_stores(spark: SparkSession, sf: str) -> DataFrame:
    """The first good crawl of a store sets its baseline; a fourth of the stores had theirs before."""
    key = F.col("s_suppkey")
    stores = table(spark, sf, "supplier").select(key.alias("store_id"), F.lit(0).alias("failure_streak"), F.lit("HOT").alias("tier"), D.at(MID).alias("next_crawl_at"), F.when(key % 4 == 0, D.at(NOW)).alias("baselined_at"))
    outcomes = table(spark, sf, "supplier").select(key.alias("store_id"), F.when(key % 3 == 0, "OK").otherwise("FAILED").alias("outcome"))
    return U.after_crawl(stores, outcomes, D.at(MID)).select("store_id", "baselined_at")


@query(
    "watch_expiries",
    f"""WITH {D.SUBSCRIPTIONS}, w AS (SELECT *, CASE WHEN subscription_id % 2 = 0 THEN started_at + INTERVAL 90 DAY END AS own, CASE WHEN subscription_id % 5 > 0 THEN started_at + to_days((subscription_id % 7 * 20)::INTEGER) END AS trial FROM subs)
        SELECT subscription_id, CASE WHEN plan <> 'FREE' THEN own WHEN own IS NULL OR trial IS NULL THEN coalesce(own, trial) ELSE least(own, trial) END AS expires_at FROM w""",
)
def watch_expiries(spark: SparkSession, sf: str) -> DataFrame:
    key, start = F.col("subscription_id"), F.col("started_at")
    own = F.when(key % 2 == 0, start + F.expr("INTERVAL 90 DAY"))
    trial = F.when(key % 5 > 0, start + F.make_dt_interval((key % 7 * 20).cast("int")))
    return D.subscriptions(spark, sf).select("subscription_id", U.watch_expiry(F.col("plan"), own, trial).alias("expires_at"))


@query(
    "checkouts",
    f"""WITH {D.SUBSCRIPTIONS}, c AS (SELECT subscription_id, cents, greatest(0, cents - least(cents, CASE WHEN subscription_id % 3 = 0 THEN CAST(floor(cents * (subscription_id % 5 * 25) / 100) AS BIGINT) WHEN subscription_id % 3 = 1 THEN 1900 ELSE 0 END)) AS final_cents, started_at FROM priced)
        SELECT subscription_id, final_cents::BIGINT AS final_cents, CASE WHEN final_cents = 0 THEN 'COMPLETED' WHEN started_at <= TIMESTAMP '{NOW}' - INTERVAL 60 MINUTE THEN 'EXPIRED' ELSE 'PENDING' END AS status FROM c""",
)
def checkouts(spark: SparkSession, sf: str) -> DataFrame:
    """Prices after a percentage, an amount or nothing off; what costs nothing is completed at once."""
    key = F.col("subscription_id")
    price = F.coalesce(F.create_map(F.lit("BASIC"), F.lit(1900), F.lit("BUSINESS"), F.lit(4900))[F.col("plan")], F.lit(0))
    final = L.discounted(price, F.when(key % 3 == 0, key % 5 * 25), F.when(key % 3 == 1, F.lit(1900)))
    return D.subscriptions(spark, sf).select("subscription_id", final.alias("final_cents"), U.checkout_status(final, F.col("started_at"), D.at(NOW)).alias("status"))


@query(
    "promo_listing",
    """WITH u AS (SELECT user_id % 4 AS promo, count(*) AS redemptions, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'purchase' GROUP BY 1)
        SELECT p AS promo, coalesce(redemptions, 0) AS redemptions, coalesce(users, 0) AS users, CASE WHEN p <> 3 THEN greatest(0, 60 - coalesce(redemptions, 0)) END AS "left" FROM range(6) r(p) LEFT JOIN u ON promo = p""",
)
def promo_listing(spark: SparkSession, sf: str) -> DataFrame:
    promos = spark.range(6).select(F.col("id").alias("promo"), F.when(F.col("id") != 3, 60).alias("max_redemptions"))
    used = D.events(spark, sf).where("event_type = 'purchase'").select((F.col("user_id") % 4).alias("promo"), "user_id")
    return L.promo_listing(promos, used).select("promo", "redemptions", "users", "left")


@query("metrics_due", "SELECT event_type AS dimension, max(ts) <= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 55 MINUTE AS due FROM events GROUP BY event_type")
def metrics_due(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each kind of metric was last computed long enough ago."""
    from driftline.operators.rollups import due_by

    return due_by(D.events(spark, sf).select(F.col("event_type").alias("dimension"), F.col("created_at").alias("computed_at")), ["dimension"], D.at("2024-01-30 12:00:00"))


@query("feed_first_page", "SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) = 20 AS next FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def feed_first_page(spark: SparkSession, sf: str) -> DataFrame:
    return U.page(table(spark, sf, "events"), None, at="ts").select("event_id", "ts", "next")


@query("feed_next_page", f"SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) = 50 AS next FROM events WHERE (ts, event_id) < (TIMESTAMP '{MID}', 1000) ORDER BY ts DESC, event_id DESC LIMIT 50")
def feed_next_page(spark: SparkSession, sf: str) -> DataFrame:
    import datetime

    cursor = (datetime.datetime.fromisoformat(MID), 1000)
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return U.page(rows, cursor, 50, at="ts").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "next")


_ADMINS = "admins AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 40 = 0 THEN 'OWNER' ELSE 'SUPPORT' END AS role FROM customer WHERE c_custkey % 20 = 0)"


def _admins(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").where(key % 20 == 0).select(key.alias("user_id"), F.when(key % 40 == 0, "OWNER").otherwise("SUPPORT").alias("role"))


@query("user_search", f"WITH {D.SUBSCRIPTIONS}, {D.USERS}, {_ADMINS} SELECT user_id, email FROM users WHERE email LIKE '%00%' AND user_id NOT IN (SELECT user_id FROM admins) AND EXISTS (SELECT 1 FROM subs s WHERE s.user_id = users.user_id AND plan = 'BUSINESS' AND status = 'ACTIVE')")
def user_search(spark: SparkSession, sf: str) -> DataFrame:
    return U.users_where(D.users(spark, sf), _admins(spark, sf), D.subscriptions(spark, sf), email="00", role="USER", plan="BUSINESS").select("user_id", "email")


@query(
    "effective_permissions",
    f"""WITH {_ADMINS}, r AS (SELECT user_id, unnest(CASE role WHEN 'OWNER' THEN ['users.read', 'users.write', 'stats.read'] ELSE ['users.read'] END) AS p FROM admins),
        g AS (SELECT o_custkey AS user_id, 'grant.' || o_orderstatus AS p FROM orders WHERE o_custkey % 20 = 0 AND o_orderkey % 3 <> 0 AND (o_orderstatus <> 'F' OR o_orderdate + INTERVAL 365 DAY > TIMESTAMP '{NOW}')),
        u AS (SELECT * FROM r UNION SELECT * FROM g) SELECT user_id, string_agg(p, ',' ORDER BY p) AS permissions FROM u GROUP BY ALL""",
)
def effective_permissions(spark: SparkSession, sf: str) -> DataFrame:
    roles = spark.createDataFrame([("OWNER", ["users.read", "users.write", "stats.read"]), ("SUPPORT", ["users.read"])], "role string, permissions array<string>")
    orders = table(spark, sf, "orders")
    grants = orders.select(
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("grant."), "o_orderstatus").alias("permission"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("revoked_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 365 DAY")).alias("expires_at"),
    )
    return U.effective_permissions(_admins(spark, sf), roles, grants, D.at(NOW)).select("user_id", F.array_join("permissions", ",").alias("permissions"))


@query("plan_entitlements", f"WITH {D.SUBSCRIPTIONS}, m(plan, feature_key, quota) AS (VALUES ('FREE', 'analyses', 3), ('BASIC', 'analyses', 20), ('BASIC', 'watches', 3), ('BUSINESS', 'analyses', NULL), ('BUSINESS', 'watches', NULL)) SELECT subscription_id, user_id, feature_key, quota FROM subs JOIN m USING (plan) WHERE status = 'ACTIVE'")
def plan_entitlements(spark: SparkSession, sf: str) -> DataFrame:
    matrix = spark.createDataFrame([("FREE", "analyses", 3), ("BASIC", "analyses", 20), ("BASIC", "watches", 3), ("BUSINESS", "analyses", None), ("BUSINESS", "watches", None)], "plan string, feature_key string, quota int")
    return U.plan_entitlements(D.subscriptions(spark, sf), matrix)


@query("conversion_dispatch", "SELECT user_id, vendor, ts AS created_at FROM events, (VALUES ('google'), ('linkedin'), ('meta'), ('reddit'), ('tiktok')) v(vendor) WHERE event_type = 'signup' AND event_id % 2 = 0 ORDER BY ts, user_id, vendor LIMIT 100")
def conversion_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    signups = D.events(spark, sf).where("event_type = 'signup'").withColumn("consent", F.col("event_id") % 2 == 0)
    return U.to_dispatch(U.conversions(signups)).select("user_id", "vendor", "created_at")


@query("erased_audit", "SELECT event_id, CASE WHEN user_id % 10 <> 0 THEN user_id END AS actor_id, CASE WHEN (user_id + 5) % 10 <> 0 THEN user_id + 5 END AS subject_id, user_id % 10 = 0 OR (user_id + 5) % 10 = 0 AS changed FROM events")
def erased_audit(spark: SparkSession, sf: str) -> DataFrame:
    audit = table(spark, sf, "events").select("event_id", F.col("user_id").alias("actor_id"), (F.col("user_id") + 5).alias("subject_id"))
    ids = audit.select(F.explode(F.array("actor_id", "subject_id")).alias("user_id"))
    gone = ids.where(F.col("user_id") % 10 == 0).distinct()
    return U.erased(audit, gone)


@query("promo_redemptions", "WITH r AS (SELECT event_id, user_id % 4 AS promo, user_id, ts, row_number() OVER (PARTITION BY user_id % 4, user_id ORDER BY ts, event_id) AS mine FROM events WHERE event_type = 'purchase') SELECT event_id, mine = 1 AND sum(CASE WHEN mine = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY promo ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 25 AS redeemed FROM r")
def promo_redemptions(spark: SparkSession, sf: str) -> DataFrame:
    requests = D.events(spark, sf).where("event_type = 'purchase'").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 4).alias("promo"), "user_id", "created_at", F.lit(25).alias("max_redemptions"))
    return L.redemptions(requests).select(F.col("request_id").alias("event_id"), "redeemed")


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return D.events(spark, sf).where("event_type IN ('click', 'view')").select(F.col("event_id").alias("request_id"), "user_id", "created_at", (F.col("event_id") % 3).alias("store_id"))


_REQUESTS = """r AS (SELECT event_id AS request_id, user_id, ts AS created_at, event_id % 3 AS store_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place
    FROM events WHERE event_type IN ('click', 'view'))"""


@query(
    "quota_ledger",
    f"""WITH RECURSIVE {_REQUESTS}, d AS (
            SELECT request_id, user_id, created_at, store_id, place, [{{'at': created_at, 'store': store_id}}] AS used, 'ALLOWED' AS outcome FROM r WHERE place = 1
            UNION ALL SELECT request_id, user_id, created_at, store_id, place, CASE WHEN outcome = 'ALLOWED' THEN list_append(used, {{'at': created_at, 'store': store_id}}) ELSE used END, outcome FROM (
                SELECT *, CASE WHEN list_contains(list_transform(used, lambda u: u.store), store_id) THEN 'REPEATED' WHEN len(used) < 2 THEN 'ALLOWED' ELSE 'REFUSED' END AS outcome FROM (
                    SELECT r.*, list_filter(d.used, lambda u: u.at > r.created_at - INTERVAL 24 HOUR) AS used FROM d JOIN r ON r.user_id = d.user_id AND r.place = d.place + 1)))
        SELECT request_id, user_id, created_at, store_id, 2 AS quota, outcome FROM d""",
)
def quota_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Which analyses a quota of 2 stores in 24 hours lets through."""
    return L.quota(_requests(spark, sf).withColumn("quota", F.lit(2)))


@query(
    "rate_limit",
    f"""WITH RECURSIVE {_REQUESTS}, d AS (SELECT r.*, created_at AS begun, 1 AS n FROM r WHERE place = 1
            UNION ALL SELECT r.*, CASE WHEN r.created_at >= begun + INTERVAL 6 HOUR THEN r.created_at ELSE begun END, CASE WHEN r.created_at >= begun + INTERVAL 6 HOUR THEN 1 ELSE n + 1 END
            FROM d JOIN r ON r.user_id = d.user_id AND r.place = d.place + 1)
        SELECT request_id, user_id, created_at, store_id, n <= 3 AS allowed FROM d""",
)
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return L.rate_limit(_requests(spark, sf), "user_id", 3, 21_600)


@query(
    "watch_slots",
    f"""WITH RECURSIVE {_REQUESTS}, d AS (
            SELECT r.*, [{{'store': store_id, 'until': created_at + INTERVAL 2 DAY}}] AS active, 'STARTED' AS outcome FROM r WHERE place = 1
            UNION ALL SELECT request_id, user_id, created_at, store_id, place, CASE WHEN outcome = 'STARTED' THEN list_append(active, {{'store': store_id, 'until': created_at + INTERVAL 2 DAY}}) ELSE active END, outcome FROM (
                SELECT *, CASE WHEN list_contains(list_transform(active, lambda a: a.store), store_id) THEN 'ALREADY_ACTIVE' WHEN len(active) < 1 THEN 'STARTED' ELSE 'NO_SLOT' END AS outcome FROM (
                    SELECT r.*, list_filter(d.active, lambda a: a.until > r.created_at) AS active FROM d JOIN r ON r.user_id = d.user_id AND r.place = d.place + 1)))
        SELECT request_id, user_id, created_at, store_id, 1 AS slots, created_at + INTERVAL 2 DAY AS expires_at, outcome FROM d""",
)
def watch_slots(spark: SparkSession, sf: str) -> DataFrame:
    rows = _requests(spark, sf).withColumns({"slots": F.lit(1), "expires_at": F.col("created_at") + F.expr("INTERVAL 2 DAY")})
    return L.slots(rows)


@query(
    "anonymous_quota",
    """WITH RECURSIVE r AS (SELECT event_id AS request_id, 'ip-' || user_id % 40 AS address, ts AS created_at, row_number() OVER (ORDER BY ts, event_id) AS place FROM events WHERE event_type = 'view'),
        d AS (
            SELECT 0::BIGINT AS place, NULL::BIGINT AS request_id, NULL::VARCHAR AS address, NULL::TIMESTAMP AS created_at, []::STRUCT(t TIMESTAMP, who VARCHAR)[] AS recorded, '' AS outcome
            UNION ALL SELECT place, request_id, address, created_at, CASE WHEN outcome = 'RECORDED' THEN list_append(recorded, {'t': created_at, 'who': address}) ELSE recorded END, outcome FROM (
                SELECT *, CASE WHEN len(list_filter(recorded, lambda x: x.t >= created_at - INTERVAL 3 HOUR)) >= 4 THEN 'CIRCUIT_OPEN' WHEN len(list_filter(recorded, lambda x: x.who = address)) >= 2 THEN 'LIMIT_REACHED' ELSE 'RECORDED' END AS outcome
                FROM (SELECT r.*, list_filter(d.recorded, lambda x: x.t >= r.created_at - INTERVAL 24 HOUR) AS recorded FROM d JOIN r ON r.place = d.place + 1)))
        SELECT request_id, address, created_at, outcome FROM d WHERE place > 0""",
)
def anonymous_quota(spark: SparkSession, sf: str) -> DataFrame:
    """Two analyses in 24 hours for each of 40 addresses, while no more than four were recorded in three hours by all."""
    views = D.events(spark, sf).where("event_type = 'view'")
    requests = views.select(F.col("event_id").alias("request_id"), F.concat(F.lit("ip-"), (F.col("user_id") % 40).cast("string")).alias("address"), "created_at")
    return L.anonymous(requests, most=2, ceiling=4, breaker_hours=3)


@query("needs_details", "SELECT store_id, ad FROM (SELECT DISTINCT l_suppkey AS store_id, CAST(l_partkey AS VARCHAR) AS ad FROM lineitem WHERE year(l_shipdate) = 1998) ANTI JOIN (SELECT DISTINCT l_suppkey AS store_id, CAST(l_partkey AS VARCHAR) AS ad FROM lineitem WHERE year(l_shipdate) = 1997 AND l_linenumber > 2) USING (store_id, ad)")
def needs_details(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    ads = lambda y: lines.where(F.year("l_shipdate") == y).select(F.col("l_suppkey").alias("store_id"), F.lit("GOOGLE").alias("platform"), F.col("l_partkey").cast("string").alias("external_ad_id"), F.when(F.col("l_linenumber") > 2, "x").alias("destination_url")).distinct()
    return U.needs_details(ads(1998), ads(1997)).select("store_id", F.col("external_ad_id").alias("ad")).distinct()


@query("fill_once", "SELECT s_suppkey AS store_id, CASE WHEN s_suppkey % 2 = 0 THEN 'old' WHEN s_suppkey % 3 = 0 THEN 'new' END AS registered FROM supplier")
def fill_once(spark: SparkSession, sf: str) -> DataFrame:
    from driftline.sources.vendors import filled_once

    key = F.col("s_suppkey")
    stores = table(spark, sf, "supplier").select(key.alias("store_id"), F.when(key % 2 == 0, "old").alias("registered"), F.when(key % 2 == 0, D.at(NOW)).alias("checked_at"))
    answers = table(spark, sf, "supplier").where(key % 3 == 0).select(key.alias("store_id"), F.lit("new").alias("registered"))
    return filled_once(stores, answers, ["registered"], D.at(MID)).select("store_id", "registered")
