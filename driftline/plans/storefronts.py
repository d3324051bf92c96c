"""What storefronts are built with: technology, themes, review apps, and the report of a store.

A store is a supplier; its page is made of its number, its products are the parts that it shipped in 1998.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import fingerprint as P
from driftline.functions import text as X
from driftline.operators import entity_diff, product_diff, reports
from driftline.plans import derived as D
from driftline.plans.changes import _key, _score
from driftline.plans.registry import query
from driftline.session import scratch_path, table, written

def _k() -> Column:
    return F.col("store_id")


def _page(turn: int) -> Column:
    """A storefront at its first crawl (0) or a later one (1)."""
    k = _k().cast("string")
    piece = lambda when, *xs: F.when(when, F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])).otherwise("")
    theme = F.when((_k() % 2 == 0) & F.lit(turn == 1), "Impulse").when(_k() % 3 == 0, "Dawn").when(_k() % 3 == 1, "Sense")
    return F.concat(
        F.lit("<html><head>"),
        piece(theme.isNotNull(), '<script>Shopify.theme = {"name":"', theme, '","id":', k, "};</script>"),
        piece(_k() % 4 < 2, '<meta content="1', (_k() % 10).cast("string"), '.2.0" name="theme_version">'),
        piece(_k() % 4 == 2, "<script>var theme_version = '2.", (_k() % 5).cast("string"), "';</script>"),
        piece((_k() + turn) % 2 == 0, '<script src="https://static.klaviyo.com/a.js"></script>'),
        piece((_k() + turn) % 3 == 0, '<script src="https://judge.me/widgets/x"></script>'),
        piece(_k() % 5 == 0, '<script src="https://staticw2.yotpo.com/y.js"></script>'),
        piece(_k() % 4 == turn, "<script>fbq('init', '1000000", k, "');</script>"),
        piece(_k() % 3 == 1, "<script>gtag('config', 'G-AB", k, "');</script>"),
        piece((_k() % 2 == 1) | F.lit(turn == 1), '<img alt="paypal">'),
        F.lit("</head></html>"),
    )


def _sites(spark: SparkSession, sf: str, turn: int) -> DataFrame:
    keys = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("store_id"))
    return keys.select("store_id", P.technology(_page(turn)).alias("tech"), F.lit(None).cast("array<string>").alias("collection_handles"))


_THEME = "CASE WHEN k % 2 = 0 AND {turn} = 1 THEN 'Impulse' WHEN k % 3 = 0 THEN 'Dawn' WHEN k % 3 = 1 THEN 'Sense' END"
_VERSION = "CASE WHEN k % 4 < 2 THEN '1' || k % 10 || '.2.0' WHEN k % 4 = 2 THEN '2.' || k % 5 END"
#: The technology of both crawls: turn, k, kind, key, id.
_TECH = """s AS (SELECT s_suppkey AS k FROM supplier), t AS (SELECT k, turn FROM s, (VALUES (0), (1)) v(turn)), tech AS (
        SELECT turn, k, 'APP' AS kind, 'klaviyo' AS key, NULL AS id FROM t WHERE (k + turn) % 2 = 0 UNION ALL SELECT turn, k, 'APP', 'judgeme', NULL FROM t WHERE (k + turn) % 3 = 0
        UNION ALL SELECT turn, k, 'APP', 'yotpo', NULL FROM t WHERE k % 5 = 0 UNION ALL SELECT turn, k, 'PIXEL', 'facebook', '1000000' || k FROM t WHERE k % 4 = turn
        UNION ALL SELECT turn, k, 'PIXEL', 'ga4', 'G-AB' || k FROM t WHERE k % 3 = 1 UNION ALL SELECT turn, k, 'PAYMENT_PROVIDER', 'paypal', NULL FROM t WHERE k % 2 = 1 OR turn = 1)"""


@query(
    "storefront_technology",
    f"""WITH {_TECH} SELECT k AS store_id, {_THEME.format(turn=0)} AS theme_name, {_VERSION} AS theme_version,
        coalesce((SELECT string_agg(key || '=' || id, ',' ORDER BY key) FROM tech x WHERE x.k = s.k AND turn = 0 AND kind = 'PIXEL'), '') AS pixels,
        coalesce((SELECT string_agg(key, ',' ORDER BY key) FROM tech x WHERE x.k = s.k AND turn = 0 AND kind = 'APP'), '') AS apps FROM s""",
)
def storefront_technology(spark: SparkSession, sf: str) -> DataFrame:
    pixels = F.array_join(F.array_sort(F.transform(F.map_entries("tech.pixels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return _sites(spark, sf, 0).select("store_id", "tech.theme_name", "tech.theme_version", pixels.alias("pixels"), F.array_join("tech.apps", ",").alias("apps"))


@query(
    "theme_events",
    f"""WITH s AS (SELECT s_suppkey AS k FROM supplier), t AS (SELECT k, {_THEME.format(turn=0)} AS was, {_THEME.format(turn=1)} AS now FROM s)
        SELECT k AS store_id, 'THEME_CHANGED' AS event_type, 'Rebuilt storefront: ' || was || ' → ' || now AS headline, {_score('THEME_CHANGED', '0.9', None)} AS significance, {_key('k', "'theme'", 'THEME_CHANGED', 'now')} AS dedupe_key FROM t WHERE was <> now""",
)
def theme_events(spark: SparkSession, sf: str) -> DataFrame:
    themes = lambda turn: _sites(spark, sf, turn).select("store_id", "tech.theme_name", "tech.theme_version")
    return product_diff.theme_events(themes(0), themes(1), D.at(D.NOW)).select("store_id", "event_type", "headline", "significance", "dedupe_key")


def _entities(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Observed now, the kinds that were fetched (of every seventh store none), known from the first crawl and missed once, stores."""
    stores = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("store_id"), F.lit(True).alias("baselined"))
    kinds = entity_diff.observed_kinds(stores.select("store_id", (_k() % 7 != 0).alias("has_tech_data"), F.lit(False).alias("has_collection_data")))
    now = lambda text: D.at(text)
    first = entity_diff.observed_entities(_sites(spark, sf, 0))
    known = first.withColumns({"status": F.lit("ACTIVE"), "missing_streak": F.lit(1), "missing_since": now("1997-12-31 12:00:00"), "first_seen_at": now("1996-12-31 12:00:00"), "last_seen_at": now("1996-12-31 12:00:00")})
    seen = entity_diff.observed_entities(_sites(spark, sf, 1).where(_k() % 7 != 0))
    return seen, kinds, known, stores


_SAID = """CASE kind WHEN 'APP' THEN CASE WHEN added THEN 'Installed ' ELSE 'Removed ' END || key WHEN 'PIXEL' THEN CASE WHEN added THEN 'Added ' || key || ' pixel — likely opening a new ad channel' ELSE 'Removed ' || key || ' pixel' END
        ELSE CASE WHEN added THEN 'Added ' || key || ' at checkout' ELSE 'Removed ' || key || ' from checkout' END END"""


@query(
    "technology_events",
    f"""WITH {_TECH}, e AS (SELECT k, kind, key, true AS added FROM tech WHERE turn = 1 AND k % 7 <> 0 AND (k, kind, key) NOT IN (SELECT (k, kind, key) FROM tech WHERE turn = 0)
            UNION ALL SELECT k, kind, key, false FROM tech WHERE turn = 0 AND k % 7 <> 0 AND (k, kind, key) NOT IN (SELECT (k, kind, key) FROM tech WHERE turn = 1))
        SELECT k AS store_id, CASE WHEN kind = 'PIXEL' THEN 'pixel:' || key ELSE key END AS entity_key, kind || CASE WHEN added THEN '_ADDED' ELSE '_REMOVED' END AS event_type, {_SAID} AS headline FROM e""",
)
def technology_events(spark: SparkSession, sf: str) -> DataFrame:
    """From pages to events; stores whose technology wasn't fetched say nothing."""
    return entity_diff.entity_events(*_entities(spark, sf), D.at(D.NOW)).select("store_id", "entity_key", "event_type", "headline")


_REVIEW_APPS = f"""{_TECH}, a AS (SELECT k, key, max(turn) AS turn, min(turn) AS first FROM tech WHERE key IN ('judgeme', 'yotpo') AND (turn = 0 OR k % 7 <> 0) GROUP BY k, key),
    r AS (SELECT k, key, CASE WHEN turn = 1 OR k % 7 = 0 THEN 'ACTIVE' ELSE 'REMOVED' END AS status FROM a)"""


@query("review_infrastructure", f"WITH {_REVIEW_APPS} SELECT k AS store_id, CASE WHEN k % 11 = 0 THEN 'UNAVAILABLE' ELSE 'OBSERVED' END AS status, CASE WHEN k % 11 = 0 THEN 'This store has not completed an initial crawl yet.' END AS reason, CASE WHEN k % 11 <> 0 THEN coalesce((SELECT string_agg(key || ':' || status, ',' ORDER BY key) FROM r WHERE r.k = s.k), '') END AS apps FROM s")
def review_infrastructure(spark: SparkSession, sf: str) -> DataFrame:
    entities = entity_diff.next_entities(*_entities(spark, sf), D.at(D.NOW))
    stores = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("store_id"), (F.col("s_suppkey") % 11 != 0).alias("baselined"))
    made = reports.review_infrastructure(stores, entities).select("store_id", "infrastructure.*")
    return made.select("store_id", "status", "reason", F.array_join(F.transform("value", lambda a: F.concat(a["key"], F.lit(":"), a["status"])), ",").alias("apps"))


@query(
    "intelligence_report",
    f"""WITH {_REVIEW_APPS}, p AS (SELECT l_suppkey AS k, l_partkey AS part, min(CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT)) AS price, CASE WHEN l_partkey % 4 > 0 THEN l_partkey % 50 END AS rank FROM lineitem WHERE year(l_shipdate) = 1998 GROUP BY l_suppkey, l_partkey),
        f AS (SELECT k, count(*) AS n, CAST(floor(avg(price) + 0.5) AS BIGINT) AS price FROM p GROUP BY k),
        h AS (SELECT k, part, row_number() OVER (PARTITION BY k ORDER BY rank IS NULL, rank, part::VARCHAR) AS place FROM p),
        b AS (SELECT k, CASE WHEN k % 11 <> 0 AND EXISTS (SELECT 1 FROM r WHERE r.k = s.k AND status = 'ACTIVE') THEN 20 ELSE 5 END AS budget FROM s),
        top AS (SELECT k, string_agg(part::VARCHAR, ',' ORDER BY place) AS highlights FROM h JOIN b USING (k) WHERE place <= budget GROUP BY k),
        g AS (SELECT k, CASE WHEN k % 6 > 0 THEN k % 6 - 3 END AS delta, k % 3 AS changes FROM s),
        now AS (SELECT k, kind, key FROM tech WHERE turn = 1 AND k % 7 <> 0 UNION SELECT k, kind, key FROM tech WHERE turn = 0 AND k % 7 = 0)
        SELECT s.k AS store_id, coalesce({_THEME.format(turn=1)}, '-') || ' ' || coalesce({_VERSION}, '-') AS theme,
               CASE WHEN k % 4 = 0 THEN 'No public registration date found for this domain.' ELSE 'OBSERVED' END AS registered, CASE WHEN k % 5 = 0 THEN 'No archived storefront snapshot found for this domain.' ELSE 'OBSERVED' END AS archived,
               coalesce((SELECT string_agg(key, ',' ORDER BY first, key) FROM (SELECT key, (k, kind, key) NOT IN (SELECT (k, kind, key) FROM tech WHERE turn = 0) AS first FROM now n WHERE n.k = s.k AND kind = 'APP')), '') AS apps,
               coalesce((SELECT string_agg(key, ',' ORDER BY first, key) FROM (SELECT key, (k, kind, key) NOT IN (SELECT (k, kind, key) FROM tech WHERE turn = 0) AS first FROM now n WHERE n.k = s.k AND kind = 'PIXEL')), '') AS pixels,
               coalesce(n, 0) AS products, price AS average_price, CASE WHEN price IS NULL THEN 'No active products to average' END AS price_reason, coalesce(highlights, '') AS highlights,
               CASE WHEN delta IS NULL THEN '' WHEN delta = 0 AND changes = 0 THEN 'STEADY' ELSE concat_ws(',', CASE WHEN delta > 0 THEN 'CATALOG_EXPANSION' WHEN delta < 0 THEN 'CATALOG_CONTRACTION' END, CASE WHEN changes > 0 THEN 'PRICE_ACTIVITY' END) END AS growth,
               CASE WHEN k % 11 = 0 THEN 'UNAVAILABLE' ELSE 'OBSERVED' END AS infrastructure, k % 9 AS sampled, k % 10 > 0 AS active, CASE WHEN k % 10 > 0 THEN TIMESTAMP '1999-01-01 12:00:00' END AS next_crawl_at, k % 4 AS total_crawls
        FROM s LEFT JOIN f USING (k) LEFT JOIN top USING (k) JOIN g USING (k)""",
)
def intelligence_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report of every store, with its nested fields laid flat."""
    sites = written(_sites(spark, sf, 1), "sites")
    entities = written(entity_diff.next_entities(*_entities(spark, sf), D.at(D.NOW)), "entities")
    stores = sites.select(
        "store_id",
        F.concat(F.lit("shop"), _k().cast("string"), F.lit(".example")).alias("domain"),
        (_k() % 11 != 0).alias("baselined"),
        F.when(_k() % 10 == 0, "DISABLED").otherwise("HOT").alias("tier"),
        "tech.theme_name",
        "tech.theme_version",
        F.when(_k() % 4 > 0, D.at("1990-01-01 00:00:00")).alias("registered_at"),
        F.when(_k() % 5 > 0, D.at("1991-01-01 00:00:00")).alias("archived_at"),
        D.at(D.NOW).alias("last_crawled_at"),
        D.at("1999-01-01 12:00:00").alias("next_crawl_at"),
    )
    lines = table(spark, sf, "lineitem").where((F.col("l_shipdate") >= D.at("1998-01-01 00:00:00")) & (F.col("l_shipdate") < D.at("1999-01-01 00:00:00")))
    products = lines.groupBy(F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("part")).agg(F.min(F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5)).alias("price_min_cents"))
    products = written(products.select("store_id", F.col("part").cast("string").alias("external_id"), F.lit("ACTIVE").alias("status"), "price_min_cents", F.when(F.col("part") % 4 > 0, F.col("part") % 50).alias("bestseller_rank"), D.at(D.NOW).alias("first_seen_at")), "products")
    crawls = stores.select("store_id", F.explode(F.sequence(F.lit(0), (_k() % 4).cast("int"))).alias("n")).select("store_id", F.when(F.col("n") == 0, "FAILED").when(F.col("n") == 1, "PARTIAL").otherwise("OK").alias("status"))
    activity = stores.select("store_id", F.when(_k() % 6 > 0, _k() % 6 - 3).alias("delta"), F.lit(None).cast("double").alias("delta_pct"), (_k() % 3).alias("price_changes"))
    coverage = stores.select("store_id", (_k() % 9).alias("sampled"), F.lit(0).alias("with_count"))
    made = reports.intelligence_report(stores, products, entities, crawls, activity, coverage)
    dash = lambda c: F.coalesce(c, F.lit("-"))
    return made.select(
        "store_id",
        F.concat(dash(F.col("identity.theme.value.name")), F.lit(" "), dash(F.col("identity.theme.value.version"))).alias("theme"),
        *[F.coalesce(f"identity.{c}.reason", f"identity.{c}.status").alias(c) for c in ("registered", "archived")],
        *[F.array_join(f"technology.{c}", ",").alias(c) for c in ("apps", "pixels")],
        "catalog.products",
        F.col("catalog.average_price.value").alias("average_price"),
        F.col("catalog.average_price.reason").alias("price_reason"),
        F.array_join(F.transform("highlights", lambda h: h["external_id"]), ",").alias("highlights"),
        F.array_join(F.transform("growth.signals", lambda g: g["kind"]), ",").alias("growth"),
        F.col("reviews.infrastructure.status").alias("infrastructure"),
        "reviews.sampled",
        "monitoring.active",
        "monitoring.next_crawl_at",
        "monitoring.total_crawls",
    )


@query("ad_regions", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN r_name || ',' || n_name WHEN s_suppkey % 3 = 1 THEN n_name END AS regions FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def ad_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Region names out of the JSON of ads: two, one beside an entry without a name, none."""
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    name = lambda c: F.struct(F.col(c).alias("name"))
    regions = F.when(F.col("s_suppkey") % 3 == 0, F.array(name("r_name"), name("n_name"))).when(F.col("s_suppkey") % 3 == 1, F.array(F.struct(F.lit("").alias("name")), name("n_name")))
    return rows.select("s_suppkey", F.array_join(X.region_names(F.to_json(F.struct(regions.alias("regions")))), ",").alias("regions"))


@query("plan_texts", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Business' WHEN o_orderkey % 4 = 1 THEN 'Basic' WHEN o_orderkey % 4 = 2 THEN 'Free' ELSE 'LEGACY' END AS label, CASE WHEN o_orderkey % 5 = 0 THEN 'Unlimited' ELSE CAST(o_orderkey % 5 AS VARCHAR) END AS shown FROM orders")
def plan_texts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    plan = F.when(k % 4 == 0, "BUSINESS").when(k % 4 == 1, "BASIC").when(k % 4 == 2, "FREE").otherwise("LEGACY")
    return table(spark, sf, "orders").select("o_orderkey", X.plan_label(plan).alias("label"), X.format_limit(F.when(k % 5 > 0, k % 5)).alias("shown"))


@query(
    "vendor_search",
    """WITH s AS (SELECT s_suppkey AS k FROM supplier), p AS (SELECT k, page, k % 5 = 0 AND page = 1 AS lost, CASE WHEN page = 1 AND k % 2 = 1 THEN 2 ELSE 1 END AS attempts FROM s, range(3) r(page) WHERE page <= k % 3)
        SELECT k AS store_id, sum(CASE WHEN NOT lost THEN 2 ELSE 0 END)::BIGINT AS ads, sum(CASE WHEN lost THEN 3 ELSE attempts END)::BIGINT AS attempts, CASE WHEN bool_or(lost) THEN 'status 503' END AS reason
        FROM p WHERE NOT (k % 5 = 0 AND page > 1) GROUP BY k""",
)
def vendor_search(spark: SparkSession, sf: str) -> DataFrame:
    """Ads of each supplier by way of the vendor's pages: up to three of two ads each; some fail once, some for good."""
    from driftline.sources.adsource import AdSearch, FiledSearch
    from driftline.sources.vendors import ad_summaries

    spark.dataSource.register(AdSearch)
    text = lambda *xs: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in xs])

    def answer(page: Column) -> Column:
        """A page's token and what its attempts get."""
        ad = lambda i: F.struct(text(_k(), "-", page, f"-{i}").alias("ad_creative_id"), F.lit("a").alias("advertiser_id"))
        body = F.to_json(F.struct(F.array(ad(0), ad(1)).alias("ad_creatives"), F.when(page < _k() % 3, text("t", page + 1)).alias("next")))
        down, good = F.struct(F.lit(503).alias("status"), F.lit(None).cast("string").alias("body")), F.struct(F.lit(200).alias("status"), body.alias("body"))
        told = F.when((_k() % 5 == 0) & (page == 1), F.array(down)).when((page == 1) & (_k() % 2 == 1), F.array(down, good)).otherwise(F.array(good))
        return F.struct(F.when(page == 0, "first").otherwise(text("t", page)), told)

    stores = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("store_id"))
    stores = stores.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "store_id")  # a given number: asking takes time, not bytes
    pages = F.map_from_entries(F.transform(F.sequence(F.lit(0), (_k() % 3).cast("int")), answer))
    path = scratch_path(spark, "ad-search")
    stores.select(F.to_json(F.struct(_k().alias("request"), text("shop", _k(), ".example").alias("domain"), pages.alias("pages"))).alias("value")).write.text(path)
    asks = spark.read.format("ad_search").option("path", path).option("client", f"{FiledSearch.__module__}:{FiledSearch.__name__}")
    answers = written(asks.option("backoffMs", "1").option("retries", "2").load(), "answers")
    ads = ad_summaries(answers.where("outcome = 'OK'").select("domain", "body")).groupBy("domain").agg(F.count(F.lit(1)).alias("ads"))
    asked = answers.groupBy("request", "domain").agg(F.sum("attempts").alias("attempts"), F.max("reason").alias("reason"))
    return asked.join(ads, "domain", "left").select(F.col("request").alias("store_id"), F.coalesce("ads", F.lit(0)).alias("ads"), "attempts", "reason")
