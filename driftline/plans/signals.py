"""Signals over the derived catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.operators import signals as S
from driftline.plans import derived as D
from driftline.plans.changes import _EVENTS, events_1998
from driftline.plans.registry import query
from driftline.session import written

_CURRENT = f"WITH {D.CATALOG}, cur AS (SELECT * FROM catalog WHERE year = 1998)"


def _current(spark: SparkSession, sf: str) -> DataFrame:
    return D.year_of(D.catalog(spark, sf, D.CURRENT, D.CURRENT), D.CURRENT)


@query("catalog_snapshot", f"{_CURRENT} SELECT store_id, external_id, title, price_min_cents, price_max_cents, compare_at_max_cents, variant_count, available_variants, bestseller_rank FROM cur")
def catalog_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return _current(spark, sf).select("store_id", "external_id", "title", "price_min_cents", "price_max_cents", "compare_at_max_cents", "variant_count", "available_variants", "bestseller_rank")


@query(
    "price_spread",
    f"""{_CURRENT}, o AS (SELECT store_id, price_min_cents AS x, row_number() OVER (PARTITION BY store_id ORDER BY price_min_cents) - 1 AS i, count(*) OVER (PARTITION BY store_id) AS n FROM cur)
        SELECT store_id, count(*) AS products, min(x) AS min_cents, max(CASE WHEN i = least(n - 1, CAST(floor(0.25 * n) AS BIGINT)) THEN x END) AS p25_cents,
               max(CASE WHEN i = least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) THEN x END) AS median_cents, max(CASE WHEN i = least(n - 1, CAST(floor(0.75 * n) AS BIGINT)) THEN x END) AS p75_cents, max(x) AS max_cents FROM o GROUP BY store_id""",
)
def price_spread(spark: SparkSession, sf: str) -> DataFrame:
    return S.price_spread(_current(spark, sf), ["store_id"])


@query(
    "discount_depth",
    f"""{_CURRENT} SELECT store_id, count(*) FILTER (WHERE compare_at_max_cents > price_min_cents) AS on_sale,
        CAST(floor(avg(CASE WHEN compare_at_max_cents > price_min_cents THEN (compare_at_max_cents - price_min_cents)::DOUBLE / compare_at_max_cents END) * 100 + 0.5) AS BIGINT) AS mean_discount_pct FROM cur GROUP BY store_id""",
)
def discount_depth(spark: SparkSession, sf: str) -> DataFrame:
    return S.discount_depth(_current(spark, sf), ["store_id"])


_MIX = "SELECT * FROM (SELECT store_id, {0}, count(*) AS n, row_number() OVER (PARTITION BY store_id ORDER BY count(*) DESC, {0}) AS place FROM cur GROUP BY store_id, {0}) WHERE place <= 8"


@query("vendor_mix", f"{_CURRENT} {_MIX.format('vendor')}")
def vendor_mix(spark: SparkSession, sf: str) -> DataFrame:
    return S.mix(_current(spark, sf), ["store_id"], "vendor").withColumn("place", F.col("place").cast("long"))


@query("type_mix", f"{_CURRENT} {_MIX.format('product_type')}")
def type_mix(spark: SparkSession, sf: str) -> DataFrame:
    return S.mix(_current(spark, sf), ["store_id"], "product_type").withColumn("place", F.col("place").cast("long"))


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    return D.catalog(spark, sf).select("store_id", "external_id", F.col("year").alias("crawl_id"), F.make_date("year", F.lit(12), F.lit(31)).cast("timestamp_ntz").alias("captured_at"), F.col("bestseller_rank").alias("rank"), "variant_count")


@query(
    "rank_signals",
    f"""WITH {D.CATALOG}, o AS (SELECT store_id, external_id, year, bestseller_rank AS rank, lag(bestseller_rank) OVER w AS before, last_value(bestseller_rank) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS now FROM catalog WINDOW w AS (PARTITION BY store_id, external_id ORDER BY year)),
        g AS (SELECT store_id, external_id, string_agg(rank, ',' ORDER BY year) AS trajectory, arg_max(rank, year) AS current_rank, arg_max(rank, year) FILTER (WHERE rank <> now) AS previous_rank, count(*) AS observations,
              coalesce(bool_or(rank < before), false) AS up, coalesce(bool_or(rank > before), false) AS down FROM o GROUP BY ALL)
        SELECT store_id, external_id, trajectory, current_rank, previous_rank, previous_rank - current_rank AS delta, observations,
               CASE WHEN observations >= 4 AND up AND NOT down THEN 'IMPROVING' WHEN observations >= 4 AND down AND NOT up THEN 'DECLINING' WHEN observations >= 4 AND NOT up AND NOT down THEN 'STABLE' END AS momentum FROM g""",
)
def rank_signals(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.rank_signals(_observations(spark, sf))
    return rows.withColumn("trajectory", F.array_join(F.transform("trajectory", lambda x: x.cast("string")), ",")).drop("crawls")


@query(
    "overall_momentum",
    f"""WITH {D.CATALOG}, o AS (SELECT store_id, external_id, year, bestseller_rank AS rank, lag(bestseller_rank) OVER (PARTITION BY store_id, external_id ORDER BY year) AS before FROM catalog),
        g AS (SELECT store_id, external_id, count(*) AS n, coalesce(bool_or(rank < before), false) AS up, coalesce(bool_or(rank > before), false) AS down FROM o GROUP BY ALL),
        m AS (SELECT store_id, CASE WHEN n >= 4 AND up AND NOT down THEN 'IMPROVING' WHEN n >= 4 AND down AND NOT up THEN 'DECLINING' WHEN n >= 4 AND NOT up AND NOT down THEN 'STABLE' END AS momentum FROM g),
        c AS (SELECT store_id, count(momentum) AS decided, count(*) FILTER (WHERE momentum = 'IMPROVING') AS i, count(*) FILTER (WHERE momentum = 'DECLINING') AS d FROM m GROUP BY ALL)
        SELECT store_id, decided, CASE WHEN decided < 2 THEN NULL WHEN i * 2 > decided THEN 'IMPROVING' WHEN d * 2 > decided THEN 'DECLINING' END AS momentum FROM c""",
)
def overall_momentum(spark: SparkSession, sf: str) -> DataFrame:
    return S.overall_momentum(S.rank_signals(_observations(spark, sf)))


def _presence(spark: SparkSession, sf: str, catalog: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Crawls (years), products and their transitions, read out of the years in which a product was there (``catalog``, written once, if there is none yet)."""
    columns = ["store_id", "external_id", "year"]
    rows = written(D.catalog(spark, sf, ranked=False).select(*columns), "presence") if catalog is None else catalog.select(*columns)
    stamp = lambda y: F.make_date(y, F.lit(12), F.lit(31)).cast("timestamp_ntz")
    crawls = rows.select("store_id", stamp(F.col("year")).alias("finished_at")).distinct()
    w = Window.partitionBy("store_id", "external_id").orderBy("year")
    gaps = rows.withColumn("before", F.lag("year").over(w))
    ends = rows.groupBy("store_id").agg(F.max("year").alias("end"))  # joined: a window would bring a whole store into one task
    last = rows.groupBy("store_id", "external_id").agg(F.min("year").alias("first"), F.max("year").alias("last")).join(ends, "store_id")
    gone = F.col("last") < F.col("end")
    products = last.select("store_id", "external_id", stamp(F.col("first")).alias("first_seen_at"), F.when(gone, "REMOVED").otherwise("ACTIVE").alias("status"), F.when(gone, stamp(F.col("last") + 1)).alias("missing_since"))
    holes = gaps.where(F.col("year") > F.col("before") + 1)
    moves = F.array(F.struct(F.lit("PRODUCT_REMOVED").alias("type"), stamp(F.col("before") + 1).alias("occurred_at")), F.struct(F.lit("PRODUCT_RESTORED").alias("type"), stamp(F.col("year")).alias("occurred_at")))
    return crawls, products, holes.select("store_id", "external_id", F.inline(moves))


@query(
    "persistence",
    f"""WITH {D.CATALOG}, y AS (SELECT DISTINCT store_id, year FROM catalog), p AS (SELECT store_id, external_id, min(year) AS first FROM catalog GROUP BY ALL)
        SELECT p.store_id, p.external_id, count(*) AS crawls, count(c.part) AS present, CASE WHEN count(*) >= 3 THEN count(c.part) / count(*)::DOUBLE END AS ratio
        FROM p JOIN y ON y.store_id = p.store_id AND y.year >= p.first LEFT JOIN catalog c ON c.store_id = p.store_id AND c.external_id = p.external_id AND c.year = y.year GROUP BY ALL""",
)
def persistence(spark: SparkSession, sf: str) -> DataFrame:
    return S.persistence(*_presence(spark, sf))


@query(
    "catalog_trend",
    f"""WITH {D.CATALOG}, r AS (SELECT store_id, external_id, min(year) AS first, max(year) AS last FROM catalog GROUP BY ALL), e AS (SELECT store_id, max(year) AS fin FROM catalog GROUP BY ALL), y AS (SELECT DISTINCT store_id, year FROM catalog)
        SELECT y.store_id, make_timestamp(y.year, 12, 31, 0, 0, 0) AS at, count(*) FILTER (WHERE r.first <= y.year AND (r.last = e.fin OR r.last >= y.year)) AS products FROM y JOIN r USING (store_id) JOIN e USING (store_id) GROUP BY ALL""",
)
def catalog_trend(spark: SparkSession, sf: str) -> DataFrame:
    crawls, products, _ = _presence(spark, sf)
    return S.catalog_sizes(products.withColumn("source_created_at", F.lit(None).cast("timestamp_ntz")), crawls.select("store_id", F.col("finished_at").alias("at")))


@query(
    "catalog_history",
    f"""WITH {D.CATALOG}, r AS (SELECT store_id, external_id, min(year) AS first, max(year) AS last FROM catalog GROUP BY ALL), e AS (SELECT store_id, max(year) AS fin FROM catalog GROUP BY ALL),
        y AS (SELECT DISTINCT store_id, year, make_timestamp(year, 12, 31, 0, 0, 0) AS t FROM catalog JOIN e USING (store_id) WHERE store_id NOT IN (1, 2, 3) OR store_id IN (1, 2) AND year > fin - store_id),
        n AS (SELECT r_regionkey AS store_id, (SELECT count(*) FROM y WHERE y.store_id = r_regionkey) AS crawls, (SELECT max(t) FROM y WHERE y.store_id = r_regionkey) AS final, CASE WHEN r_regionkey <> 1 THEN (SELECT make_timestamp(min(first), 6, 30, 0, 0, 0) FROM r WHERE r.store_id = r_regionkey) END AS launch FROM region),
        told AS (SELECT *, CASE WHEN crawls >= 3 OR crawls > 0 AND launch IS NOT NULL THEN 'OBSERVED' ELSE 'INSUFFICIENT_HISTORY' END AS status, crawls > 0 AND crawls < 3 AND launch IS NOT NULL AS reconstructed FROM n),
        at_ AS (SELECT store_id, t FROM y JOIN told USING (store_id) WHERE crawls >= 3 UNION ALL SELECT store_id, make_timestamp((epoch_ms(launch) + CAST(floor((epoch_ms(final) - epoch_ms(launch)) * j / 11.0::DOUBLE) AS BIGINT)) * 1000) FROM told, range(12) k(j) WHERE reconstructed),
        born AS (SELECT store_id, CASE WHEN store_id <> 1 THEN make_timestamp(first, 6, 30, 0, 0, 0) ELSE make_timestamp(first, 12, 31, 0, 0, 0) END AS born, CASE WHEN last < fin THEN make_timestamp(last + 1, 12, 31, 0, 0, 0) END AS gone FROM r JOIN e USING (store_id)),
        size AS (SELECT a.store_id, a.t, count(*) FILTER (WHERE born <= t AND (gone IS NULL OR gone > t)) AS products FROM at_ a JOIN born b USING (store_id) GROUP BY ALL)
        SELECT store_id, status, crawls, reconstructed, t AS at, products FROM told LEFT JOIN size USING (store_id)""",
)
def catalog_history(spark: SparkSession, sf: str) -> DataFrame:
    """Store 1 has one crawl and no launches, 2 has two crawls, 3 has none; a product's launch is in the middle of its first year."""
    crawls, products, _ = _presence(spark, sf)
    k = F.col("store_id")
    end = F.max("finished_at").over(Window.partitionBy("store_id"))
    ago = F.year(F.col("end")) - F.year("finished_at")
    mine = crawls.withColumn("end", end).where(~k.isin(1, 2, 3) | (k.isin(1, 2) & (ago < k))).drop("end")
    launch = F.when(k != 1, F.make_date(F.year("first_seen_at"), F.lit(6), F.lit(30)).cast("timestamp_ntz"))
    return S.catalog_trend(mine, products.withColumn("source_created_at", launch))


@query(
    "trend_samples",
    """WITH d AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY ALL)),
        k AS (SELECT CAST(range AS DOUBLE) AS j FROM range(12))
        SELECT user_id, ts FROM d WHERE n <= 12 OR i IN (SELECT CAST(floor(j * ((n - 1) / 11.0::DOUBLE) + 0.5) AS BIGINT) FROM k)""",
)
def trend_samples(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.events(spark, sf).select("user_id", F.col("created_at").alias("ts")).distinct()
    return S.sampled_evenly(rows, ["user_id"], "ts")


@query(
    "highlights",
    f"""{_CURRENT} SELECT store_id, external_id, bestseller_rank, place FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY shown IS NULL, shown, external_id) AS place
        FROM (SELECT *, CASE WHEN bestseller_rank < 15 THEN bestseller_rank END AS shown FROM cur)) WHERE place <= 20""",
)
def highlights(spark: SparkSession, sf: str) -> DataFrame:
    """Only 15 products are ranked here, so that the newest fill up."""
    rows = _current(spark, sf).withColumns({"__rank": F.col("bestseller_rank"), "bestseller_rank": F.when(F.col("bestseller_rank") < 15, F.col("bestseller_rank")), "first_seen_at": D.at(D.NOW)})
    return S.highlights(rows).select("store_id", "external_id", F.col("__rank").alias("bestseller_rank"), F.col("place").cast("long").alias("place"))


def _reviews(spark: SparkSession, sf: str) -> DataFrame:
    return _observations(spark, sf).select("store_id", "external_id", "crawl_id", F.col("captured_at").alias("observed_at"), F.when(F.col("variant_count") > 1, F.col("variant_count")).alias("review_count"))


_REVIEWS = f"WITH {D.CATALOG}, r AS (SELECT store_id, external_id, year, CASE WHEN variant_count > 1 THEN variant_count END AS review_count FROM catalog)"


@query(
    "review_signal",
    f"""{_REVIEWS}, l AS (SELECT *, row_number() OVER (PARTITION BY store_id, external_id ORDER BY year DESC) AS place FROM r),
        p AS (SELECT l.store_id, l.external_id, arg_max(review_count, year) FILTER (WHERE place > 1 AND review_count IS NOT NULL) AS previous_count FROM l GROUP BY ALL)
        SELECT l.store_id, l.external_id, CASE WHEN review_count IS NULL THEN 'UNSUPPORTED' ELSE 'OBSERVED' END AS status, review_count, previous_count, review_count - previous_count AS review_delta FROM l JOIN p USING (store_id, external_id) WHERE place = 1""",
)
def review_signal(spark: SparkSession, sf: str) -> DataFrame:
    return S.review_signal(_reviews(spark, sf))


@query(
    "shared_review_counts",
    f"{_REVIEWS} SELECT store_id, year AS crawl_id, count(*) FILTER (WHERE n >= 2 AND review_count IS NOT NULL) AS shared, count(*) AS products FROM (SELECT *, count(*) OVER (PARTITION BY store_id, year, review_count) AS n FROM r) GROUP BY ALL",
)
def shared_review_counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.shared_review_counts(_reviews(spark, sf)).groupBy("store_id", "crawl_id").agg(F.count_if("shared").alias("shared"), F.count(F.lit(1)).alias("products"))


@query("review_coverage", f"{_REVIEWS} SELECT store_id, count(*) AS sampled, count(review_count) AS with_count FROM r WHERE year = (SELECT max(year) FROM r q WHERE q.store_id = r.store_id) GROUP BY store_id")
def review_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return S.review_coverage(_reviews(spark, sf))


_COUNTED = """, n AS (SELECT store_id, count(*) FILTER (WHERE event_type = 'PRODUCT_ADDED') AS added, count(*) FILTER (WHERE event_type = 'PRODUCT_REMOVED') AS removed, count(*) FILTER (WHERE event_type = 'PRODUCT_RESTORED') AS restored,
        count(*) FILTER (WHERE event_type IN ('PRICE_DROP', 'PRICE_INCREASE', 'SALE_STARTED', 'SALE_ENDED')) AS price_changes FROM event GROUP BY ALL),
        s AS (SELECT store_id, count(*) AS products FROM cur GROUP BY ALL),
        u_ AS (SELECT s.store_id, products, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(restored, 0) AS restored, coalesce(price_changes, 0) AS price_changes FROM s LEFT JOIN n USING (store_id)),
        t AS (SELECT *, products - added + removed AS window_ago, added - removed AS delta FROM u_)"""


def _activity(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _current(spark, sf).groupBy("store_id").agg(F.count(F.lit(1)).alias("products"))
    crawls = D.stores(spark, sf).select("store_id", F.lit(3).alias("crawls"))
    return S.store_activity(events_1998(spark, sf), sizes, crawls, D.at("1998-12-01 00:00:00"), D.at("1999-01-01 00:00:00"))


@query("store_activity", f"{_EVENTS}{_COUNTED} SELECT *, floor(delta / window_ago::DOUBLE * 1000 + 0.5) / 10 AS delta_pct FROM t")
def store_activity(spark: SparkSession, sf: str) -> DataFrame:
    return _activity(spark, sf).select("store_id", "products", "added", "removed", "restored", "price_changes", "window_ago", "delta", "delta_pct")


@query(
    "growth_signals",
    f"""{_EVENTS}{_COUNTED}, u AS (SELECT *, floor(delta / window_ago::DOUBLE * 1000 + 0.5) / 10 AS pct FROM t)
        SELECT store_id, 'CATALOG_EXPANSION' AS kind, '+' || delta || ' products (+' || pct || '%) over the last 30 days' AS detail FROM u WHERE delta > 0
        UNION ALL SELECT store_id, 'CATALOG_CONTRACTION', delta || ' products (' || pct || '%) over the last 30 days' FROM u WHERE delta < 0
        UNION ALL SELECT store_id, 'PRICE_ACTIVITY', price_changes || CASE WHEN price_changes = 1 THEN ' price change' ELSE ' price changes' END || ' observed in the last 30 days' FROM u WHERE price_changes > 0
        UNION ALL SELECT store_id, 'STEADY', 'No catalog or price changes observed in the last 30 days' FROM u WHERE delta = 0 AND price_changes = 0""",
)
def growth_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _activity(spark, sf).select("store_id", F.inline(S.growth_signals(F.col("delta"), F.col("delta_pct"), F.col("price_changes"), 30)))


@query(
    "interpretation",
    f"""WITH {D.CATALOG}, o AS (SELECT store_id, external_id, year, units, bestseller_rank AS rank, lag(bestseller_rank) OVER w AS before FROM catalog WHERE year >= 1998 WINDOW w AS (PARTITION BY store_id, external_id ORDER BY year)),
        g AS (SELECT store_id, external_id, count(*) AS n, coalesce(bool_or(rank < before), false) AS up, coalesce(bool_or(rank > before), false) AS down, arg_max(units, year) - arg_min(units, year) AS delta FROM o GROUP BY ALL),
        m AS (SELECT *, n >= 4 AND up AND NOT down AS better, n >= 4 AND down AND NOT up AS worse FROM g)
        SELECT coalesce(CASE WHEN delta > 0 AND better THEN 'Storefront activity increasing' WHEN delta < 0 AND worse THEN 'Storefront activity decreasing' END, 'none') AS headline, count(*) AS products FROM m GROUP BY ALL""",
)
def interpretation(spark: SparkSession, sf: str) -> DataFrame:
    """Each product stands for a store: its sales moved by ``delta`` since 1998, its ranks have a momentum."""
    rows = D.catalog(spark, sf, D.CURRENT)
    ranks = S.rank_signals(rows.select("store_id", "external_id", F.col("year").alias("crawl_id"), F.make_date("year", F.lit(12), F.lit(31)).cast("timestamp_ntz").alias("captured_at"), F.col("bestseller_rank").alias("rank")))
    moved = rows.groupBy("store_id", "external_id").agg((F.max_by("units", "year") - F.min_by("units", "year")).alias("delta"))
    said = ranks.drop("delta").join(moved, ["store_id", "external_id"]).select(S.interpretation(F.col("delta"), F.col("momentum")).alias("headline"))
    return said.groupBy(F.coalesce("headline", F.lit("none")).alias("headline")).agg(F.count(F.lit(1)).alias("products"))


@query(
    "store_stats",
    f"""{_EVENTS}, n AS (SELECT store_id, count(*) FILTER (WHERE event_type IN ('PRICE_DROP', 'PRICE_INCREASE', 'SALE_STARTED', 'SALE_ENDED')) AS price_changes, count(*) FILTER (WHERE event_type = 'PRODUCT_ADDED') AS products_added FROM event GROUP BY ALL),
        o AS (SELECT store_id, price_min_cents AS x, row_number() OVER (PARTITION BY store_id ORDER BY price_min_cents) - 1 AS i, count(*) OVER (PARTITION BY store_id) AS n FROM cur)
        SELECT o.store_id, any_value(o.n) AS product_count, max(CASE WHEN i = least(o.n - 1, CAST(floor(0.5 * o.n) AS BIGINT)) THEN x END) AS median_price_cents, 1::BIGINT AS crawls, coalesce(any_value(price_changes), 0) AS price_changes, coalesce(any_value(products_added), 0) AS products_added
        FROM o LEFT JOIN n USING (store_id) GROUP BY o.store_id""",
)
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    products = _current(spark, sf).withColumn("status", F.lit("ACTIVE"))
    crawls = D.stores(spark, sf).select("store_id", D.at("1998-12-30 00:00:00").alias("finished_at"))
    return S.store_stats(events_1998(spark, sf), products, crawls, D.at("1999-01-01 00:00:00"))


@query(
    "cross_store_moves",
    f"{_EVENTS}, n AS (SELECT entity_key, event_type, count(DISTINCT store_id) - 1 AS others FROM event GROUP BY ALL) SELECT event_type, others AS other_stores, count(*) AS n FROM event JOIN n USING (entity_key, event_type) GROUP BY ALL",
)
def cross_store_moves(spark: SparkSession, sf: str) -> DataFrame:
    """The part stands for the image: the same part in other stores is the same thing."""
    rows = S.cross_store_moves(events_1998(spark, sf).withColumn("image_hash", F.col("entity_key")))
    return rows.groupBy("event_type", "other_stores").agg(F.count(F.lit(1)).alias("n"))


@query(
    "freshness",
    f"""WITH {D.CATALOG}, p AS (SELECT store_id, external_id, min(year) AS first, max(year) AS last FROM catalog GROUP BY ALL), e AS (SELECT store_id, max(year) AS fin, count(DISTINCT year) AS n FROM catalog GROUP BY ALL), y AS (SELECT DISTINCT store_id, year FROM catalog),
        k AS (SELECT p.store_id, external_id, last < fin AS gone, n, count(*) AS crawls FROM p JOIN e USING (store_id) JOIN y ON y.store_id = p.store_id AND y.year >= first GROUP BY ALL)
        SELECT store_id, CASE WHEN gone THEN 'RECENTLY_MISSING' WHEN crawls >= 3 THEN 'ESTABLISHED' WHEN n >= 3 THEN 'NEW' ELSE 'INSUFFICIENT_HISTORY' END AS label, count(*) AS products FROM k GROUP BY ALL""",
)
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    crawls, products, moves = _presence(spark, sf)
    known = S.persistence(crawls, products, moves).join(products.select("store_id", "external_id", "status"), ["store_id", "external_id"])
    counted = known.join(crawls.groupBy("store_id").agg(F.count(F.lit(1)).alias("store_crawls")), "store_id")
    return counted.groupBy("store_id", S.freshness(F.col("status"), F.col("ratio"), F.col("store_crawls")).alias("label")).agg(F.count(F.lit(1)).alias("products"))


@query(
    "store_report",
    f"""{_CURRENT}, a AS (SELECT store_id, count(*) AS products, min(price_min_cents) AS min_cents, max(price_min_cents) AS max_cents, CAST(floor(avg(price_min_cents) + 0.5) AS BIGINT) AS average_cents, count(*) FILTER (WHERE available_variants = 0) AS sold_out FROM cur GROUP BY ALL),
        t AS (SELECT store_id, string_agg(external_id, ',' ORDER BY bestseller_rank) AS bestsellers FROM cur WHERE bestseller_rank < 5 GROUP BY ALL)
        SELECT r_regionkey AS store_id, 'shop' || r_regionkey || '.example' AS domain, CASE WHEN products > 0 THEN 'OBSERVED' ELSE 'UNAVAILABLE' END AS status, products, min_cents, max_cents, average_cents, sold_out, bestsellers
        FROM region LEFT JOIN a ON a.store_id = r_regionkey LEFT JOIN t ON t.store_id = r_regionkey""",
)
def store_report(spark: SparkSession, sf: str) -> DataFrame:
    """One row per store with what its report shows."""
    rows = _current(spark, sf)
    price = F.col("price_min_cents")
    facts = rows.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("products"),
        F.min(price).alias("min_cents"),
        F.max(price).alias("max_cents"),
        F.floor(F.avg(price) + 0.5).alias("average_cents"),
        F.count_if(F.col("available_variants") == 0).alias("sold_out"),
        F.array_sort(F.collect_list(F.when(F.col("bestseller_rank") < 5, F.struct("bestseller_rank", "external_id")))).alias("top"),
    )
    out = D.stores(spark, sf).select("store_id", "domain").join(facts, "store_id", "left")
    return out.select("store_id", "domain", F.when(F.col("products") > 0, "OBSERVED").otherwise("UNAVAILABLE").alias("status"), "products", "min_cents", "max_cents", "average_cents", "sold_out", F.array_join(F.transform("top", lambda t: t["external_id"]), ",").alias("bestsellers"))


@query("catalog_cube", f"WITH {D.CATALOG} SELECT store_id, year, vendor, count(*) AS products, CAST(sum(units) AS BIGINT) AS units FROM catalog GROUP BY CUBE (store_id, year, vendor)")
def catalog_cube(spark: SparkSession, sf: str) -> DataFrame:
    return D.catalog(spark, sf).cube("store_id", "year", "vendor").agg(F.count(F.lit(1)).alias("products"), F.sum("units").alias("units"))
