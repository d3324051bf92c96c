"""Change detection over the derived catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.config import BASE_SCORES
from driftline.operators import ad_diff, entity_diff, history, product_diff, reports, signals
from driftline.operators.events import appended
from driftline.operators.state import content_hashes, list_hashes
from driftline.plans import derived as D
from driftline.plans.registry import query
from driftline.session import partitioned, table, written


def _score(kind: str, magnitude: str, rank: str | None = "c.bestseller_rank", cents: str = "c.price_min_cents", rarity: float = 1.0) -> str:
    relevance = f"(CASE WHEN {rank} IS NULL THEN 0.7 WHEN {rank} < 5 THEN 1.6 WHEN {rank} < 15 THEN 1.35 WHEN {rank} < 40 THEN 1.15 WHEN {rank} < 100 THEN 0.95 ELSE 0.8 END::DOUBLE * CASE WHEN {cents} > 15000 THEN 1.1 ELSE 1.0 END::DOUBLE)" if rank else "0.7::DOUBLE"
    return f"CAST(floor(100::DOUBLE * (1::DOUBLE - exp(-({BASE_SCORES[kind]}::DOUBLE * (0.6::DOUBLE + 0.8::DOUBLE * least(1::DOUBLE, greatest(0::DOUBLE, ({magnitude})::DOUBLE))) * {relevance} * {rarity}::DOUBLE) / 70::DOUBLE)) + 0.5::DOUBLE) AS INTEGER)"


def _key(store: str, entity: str, kind: str, tail: str) -> str:
    return f"substr(sha256(concat_ws('|', {store}, {entity}, '{kind}', {tail})), 1, 40)"


#: Stores whose catalog shrank too much to be compared.
_COLLAPSED = """collapsed AS (
        SELECT a.store_id FROM (SELECT store_id, count(*) AS n FROM known GROUP BY ALL) a LEFT JOIN (SELECT store_id, count(*) AS n FROM cur GROUP BY ALL) b USING (store_id)
        WHERE a.n >= 10 AND coalesce(b.n, 0) / a.n::DOUBLE < 0.6
    )"""


def _events_sql() -> str:
    both = "k.store_id IS NOT NULL AND c.store_id IS NOT NULL"
    money = lambda x: f"format('${{:,.2f}}', ({x}) / 100.0)"
    delta = "(c.price_min_cents - k.price_min_cents)"
    pct = f"({delta}::DOUBLE / k.price_min_cents)"
    had, has = "coalesce(k.compare_at_max_cents, 0) > 0", "coalesce(c.compare_at_max_cents, 0) > 0"
    on, off = f"({both} AND NOT {had} AND {has} AND {delta} < 0)", f"({both} AND {had} AND NOT {has} AND {delta} > 0)"
    moved = f"({both} AND NOT {on} AND NOT {off} AND k.price_min_cents <> 0 AND {delta} <> 0 AND (abs({pct}) >= 0.02 OR abs({delta}) >= 100))"
    disc = "((c.price_min_cents - c.compare_at_max_cents)::DOUBLE / c.compare_at_max_cents)"
    change = f"c.title || ' ' || {money('k.price_min_cents')} || ' → ' || {money('c.price_min_cents')} || ' (' || CASE WHEN {pct} > 0 THEN '+' ELSE '' END || CAST(floor({pct} * 100 + 0.5) AS BIGINT) || '%)'"
    day = "'1998-12-31'"
    today, at_price = f"c.external_id || ':' || {day}", "c.external_id || ':' || c.price_min_cents"
    stock = "c.available_variants", "k.available_variants"
    gone, back = f"({both} AND {stock[1]} > 0 AND {stock[0]} = 0)", f"({both} AND {stock[1]} = 0 AND {stock[0]} > 0)"
    rank, old = "c.bestseller_rank", "k.bestseller_rank"
    kinds = [
        ("PRODUCT_ADDED", "k.store_id IS NULL", 0, "0.6", "c.external_id", f"'New product: ' || c.title || ' at ' || {money('c.price_min_cents')}", 1.4),
        ("PRODUCT_RESTORED", f"{both} AND k.status <> 'ACTIVE'", 1, "0.5", today, "c.title || ' is back in the catalog'", 1),
        ("SALE_STARTED", on, 2, f"least(1, abs({disc}) / 0.5)", at_price, f"c.title || ' on sale: ' || {money('c.price_min_cents')} || ' (' || CAST(floor(abs({disc}) * 100 + 0.5) AS BIGINT) || '% off)'", 1.4),
        ("SALE_ENDED", off, 2, "0.4", at_price, f"c.title || ' back to ' || {money('c.price_min_cents')}", 1.4),
        ("PRICE_DROP", f"{moved} AND {delta} < 0", 2, f"least(1, abs({pct}) / 0.5)", at_price, change, 1.4),
        ("PRICE_INCREASE", f"{moved} AND {delta} > 0", 2, f"least(1, abs({pct}) / 0.5)", at_price, change, 1.4),
        ("PRODUCT_SOLD_OUT", gone, 3, "0.8", today, "c.title || ' sold out'", 1),
        ("PRODUCT_RESTOCKED", back, 3, "0.6", today, "c.title || ' restocked'", 1),
        ("VARIANT_SOLD_OUT", f"{both} AND NOT {gone} AND NOT {back} AND {stock[0]} < {stock[1]} AND c.variant_count > 1", 3, f"({stock[1]} - {stock[0]})::DOUBLE / greatest(1, c.variant_count)", f"c.external_id || ':' || {stock[0]} || ':' || {day}", f"c.title || ': ' || ({stock[1]} - {stock[0]}) || ' of ' || c.variant_count || ' variants sold out'", 1),
        ("BESTSELLER_ENTERED", f"{both} AND {old} IS NULL AND {rank} < 60", 4, f"1 - {rank} / 60.0::DOUBLE", today, f"c.title || ' entered the bestsellers at #' || ({rank} + 1)", 1),
        ("BESTSELLER_CLIMBED", f"{both} AND {rank} < 60 AND {old} - {rank} >= 3", 4, f"least(1, ({old} - {rank}) / 20.0::DOUBLE)", f"c.external_id || ':' || {rank} || ':' || {day}", f"c.title || ' climbed #' || ({old} + 1) || ' → #' || ({rank} + 1)", 1),
    ]
    parts = [f"SELECT c.store_id, c.external_id AS entity_key, '{k}' AS event_type, {head} AS headline, {_score(k, mag, rarity=rar)} AS significance, {_key('c.store_id', 'c.external_id', k, tail)} AS dedupe_key, {seq} AS seq FROM both_ AS b, LATERAL (SELECT b.c AS c, b.k AS k) WHERE {when}" for k, when, seq, mag, tail, head, rar in kinds]
    parts = [p.replace("FROM both_ AS b, LATERAL (SELECT b.c AS c, b.k AS k)", "FROM known k FULL JOIN cur c ON k.store_id = c.store_id AND k.external_id = c.external_id") for p in parts]
    parts.append(f"SELECT k.store_id, k.external_id, 'PRODUCT_REMOVED', k.title || ' discontinued', {_score('PRODUCT_REMOVED', '0.6', 'k.bestseller_rank', 'k.price_min_cents', 1.4)}, {_key('k.store_id', 'k.external_id', 'PRODUCT_REMOVED', 'k.external_id')}, 5 FROM known k LEFT JOIN cur c ON k.store_id = c.store_id AND k.external_id = c.external_id WHERE c.store_id IS NULL AND k.missing_streak + 1 >= 2")
    return f"WITH {D.STATE}, {_COLLAPSED}, event AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE store_id NOT IN (SELECT store_id FROM collapsed))"


_EVENTS = _events_sql()
SHOWN = ["store_id", "entity_key", "event_type", "headline", "significance", "dedupe_key"]


def state_1997(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The catalog and the state after two crawls, both written, as between crawls of a real job."""
    catalog = written(D.catalog(spark, sf, D.BEFORE, D.CURRENT), "catalog")
    was = D.first_state(D.year_of(catalog, D.BEFORE), D.at("1996-12-31 12:00:00"))
    state = product_diff.next_state(D.stores(spark, sf), D.headers(spark, sf), D.year_of(catalog, D.SINCE), was, D.at("1997-12-31 12:00:00"))
    return catalog, written(state, "state")


def events_1998(spark: SparkSession, sf: str, cap: bool = False) -> DataFrame:
    catalog, state = state_1997(spark, sf)
    return product_diff.product_events(D.stores(spark, sf), D.headers(spark, sf), D.year_of(catalog, D.CURRENT), state, D.at(D.NOW), cap=cap)


@query("diff_events", _EVENTS + " SELECT store_id, entity_key, event_type, headline, significance, dedupe_key FROM event")
def diff_events(spark: SparkSession, sf: str) -> DataFrame:
    return events_1998(spark, sf).select(*SHOWN)


@query(
    "diff_events_capped",
    _EVENTS
    + """ SELECT store_id, entity_key, event_type, significance, suppressed FROM (
        SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY significance DESC, seq, entity_key, event_type) AS place,
               greatest(0, count(*) OVER (PARTITION BY store_id) - 200) AS suppressed FROM event) WHERE place <= 200""",
)
def diff_events_capped(spark: SparkSession, sf: str) -> DataFrame:
    return events_1998(spark, sf, cap=True).select("store_id", "entity_key", "event_type", "significance", "suppressed")


@query("diff_event_counts", _EVENTS + " SELECT store_id, event_type, count(*) AS n, CAST(sum(significance) AS BIGINT) AS total FROM event GROUP BY ALL")
def diff_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return events_1998(spark, sf).groupBy("store_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("significance").alias("total"))


@query(
    "diff_events_gaps",
    f"""WITH {D.STATE}, {_COLLAPSED}, c AS (SELECT *, CASE WHEN part % 7 > 0 THEN bestseller_rank END AS rank FROM cur), b AS (
            SELECT coalesce(k.store_id, c.store_id) AS store_id, coalesce(k.external_id, c.external_id) AS entity_key, k.store_id IS NOT NULL AS had, c.store_id IS NOT NULL AS has, k.bestseller_rank AS was, c.rank AS now, k.missing_streak AS streak
            FROM known k FULL JOIN c ON k.store_id = c.store_id AND k.external_id = c.external_id WHERE coalesce(k.store_id, c.store_id) NOT IN (SELECT store_id FROM collapsed))
        SELECT store_id, entity_key, 'BESTSELLER_DROPPED' AS event_type FROM b WHERE had AND has AND store_id % 3 <> 1 AND now IS NULL AND was < 60
        UNION ALL SELECT store_id, entity_key, 'BESTSELLER_ENTERED' FROM b WHERE had AND has AND store_id % 3 <> 1 AND was IS NULL AND now < 60
        UNION ALL SELECT store_id, entity_key, 'BESTSELLER_CLIMBED' FROM b WHERE had AND has AND store_id % 3 <> 1 AND now < 60 AND was - now >= 3
        UNION ALL SELECT store_id, entity_key, 'PRODUCT_REMOVED' FROM b WHERE had AND NOT has AND store_id % 2 = 1 AND streak + 1 >= 2""",
)
def diff_events_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """What a crawl with gaps tells: some products have no rank, ranks of some stores weren't fetched, and every second crawl broke off, which removes nothing."""
    catalog, state = state_1997(spark, sf)
    store = F.col("store_id")
    headers = D.headers(spark, sf).withColumns({"has_rank_data": store % 3 != 1, "partial": store % 2 == 0})
    now = D.year_of(catalog, D.CURRENT).withColumn("bestseller_rank", F.when(F.col("part") % 7 > 0, F.col("bestseller_rank")))
    events = product_diff.product_events(D.stores(spark, sf), headers, now, state, D.at(D.NOW), cap=False)
    return events.where(F.col("event_type").isin("BESTSELLER_DROPPED", "BESTSELLER_ENTERED", "BESTSELLER_CLIMBED", "PRODUCT_REMOVED")).select("store_id", "entity_key", "event_type")


@query(
    "event_log_append",
    _EVENTS + " SELECT store_id, event_type, dedupe_key FROM event WHERE event_type NOT IN ('PRICE_DROP', 'PRICE_INCREASE') QUALIFY row_number() OVER (PARTITION BY dedupe_key) = 1",
)
def event_log_append(spark: SparkSession, sf: str) -> DataFrame:
    """What a second delivery adds to a log that has the price events already."""
    new = events_1998(spark, sf)
    log = new.where(F.col("event_type").isin("PRICE_DROP", "PRICE_INCREASE"))
    return appended(log, new).select("store_id", "event_type", "dedupe_key")


@query(
    "product_state",
    f"""WITH {D.STATE}, {_COLLAPSED}, both_ AS (
        SELECT coalesce(c.store_id, k.store_id) AS store_id, coalesce(c.external_id, k.external_id) AS external_id, c.part IS NOT NULL AS seen, k.store_id IS NOT NULL AS had, k.status AS old_status, k.missing_streak AS old_streak,
               c.price_min_cents AS new_price, k.price_min_cents AS old_price, c.available_variants AS new_stock, k.available_variants AS old_stock, c.bestseller_rank AS new_rank, k.bestseller_rank AS old_rank
        FROM known k FULL JOIN cur c ON k.store_id = c.store_id AND k.external_id = c.external_id
    ), told AS (SELECT *, store_id IN (SELECT store_id FROM collapsed) AS stays FROM both_)
        SELECT store_id, external_id, CASE WHEN stays THEN old_price ELSE coalesce(new_price, old_price) END AS price_min_cents, CASE WHEN stays THEN old_stock ELSE coalesce(new_stock, 0) END AS available_variants, CASE WHEN stays THEN old_rank ELSE new_rank END AS bestseller_rank,
               CASE WHEN stays THEN old_status WHEN seen THEN 'ACTIVE' WHEN old_streak + 1 >= 2 THEN 'REMOVED' ELSE 'MISSING' END AS status, CASE WHEN stays THEN old_streak WHEN seen THEN 0 ELSE old_streak + 1 END AS missing_streak
        FROM told WHERE had OR NOT stays""",
)
def product_state(spark: SparkSession, sf: str) -> DataFrame:
    catalog, state = state_1997(spark, sf)
    after = product_diff.next_state(D.stores(spark, sf), D.headers(spark, sf), D.year_of(catalog, D.CURRENT), state, D.at(D.NOW))
    return after.select("store_id", "external_id", "price_min_cents", "available_variants", "bestseller_rank", "status", "missing_streak")


@query(
    "shrink_check",
    f"""WITH {D.STATE} SELECT coalesce(a.store_id, b.store_id) AS store_id, coalesce(n_current, 0) AS n_current, coalesce(n_previous, 0) AS n_previous,
        CASE WHEN n_previous >= 10 THEN coalesce(n_current, 0) / n_previous::DOUBLE < 0.6 ELSE false END AS aborted
        FROM (SELECT store_id, count(*) AS n_previous FROM known GROUP BY ALL) a FULL JOIN (SELECT store_id, count(*) AS n_current FROM cur GROUP BY ALL) b ON a.store_id = b.store_id""",
)
def shrink_check(spark: SparkSession, sf: str) -> DataFrame:
    catalog, state = state_1997(spark, sf)
    return product_diff.shrink_check(D.year_of(catalog, D.CURRENT), state)


@query(
    "baseline_events",
    f"""WITH {D.CATALOG}, cur AS (SELECT * FROM catalog WHERE year = 1995)
        SELECT store_id, CAST(store_id AS VARCHAR) AS entity_key, 'STORE_BASELINED' AS event_type, false AS backfilled, 5 AS significance,
               {_key('store_id', 'store_id', 'STORE_BASELINED', "'1998-12-31'")} AS dedupe_key FROM (SELECT r_regionkey AS store_id FROM region)
        UNION ALL SELECT store_id, external_id, 'PRODUCT_ADDED', true, 20, {_key('store_id', 'external_id', 'PRODUCT_ADDED', "'1995-01-01T00:00:00.000Z'")} FROM cur""",
)
def baseline_events(spark: SparkSession, sf: str) -> DataFrame:
    fresh = D.stores(spark, sf).withColumn("baselined", F.lit(False))
    first = D.year_of(D.catalog(spark, sf, until=1995), 1995).withColumn("source_created_at", D.at("1995-01-01 00:00:00"))
    return product_diff.baseline_events(fresh, first, D.at(D.NOW)).select("store_id", "entity_key", "event_type", "backfilled", "significance", "dedupe_key")


_KIND = "CASE size % 4 WHEN 0 THEN 'APP' WHEN 1 THEN 'PIXEL' WHEN 2 THEN 'PAYMENT_PROVIDER' ELSE 'COLLECTION' END"


def _entities(catalog: DataFrame, year: int) -> DataFrame:
    key = F.concat("vendor", F.lit("/"), F.col("size").cast("string"))
    return D.year_of(catalog, year).select("store_id", F.expr(_KIND).alias("kind"), key.alias("key"), F.lit(None).cast("string").alias("meta")).distinct()


def _known_entities(rows: DataFrame, stamp: str) -> DataFrame:
    now = D.at(stamp)
    return rows.select("store_id", "kind", "key", "meta", F.lit("ACTIVE").alias("status"), F.lit(0).alias("missing_streak"), F.lit(None).cast("timestamp_ntz").alias("missing_since"), now.alias("first_seen_at"), now.alias("last_seen_at"))


_ENTITY = f"""WITH {D.CATALOG}, ent AS MATERIALIZED (SELECT DISTINCT store_id, year, {_KIND} AS kind, vendor || '/' || size AS key, store_id || '|' || {_KIND} || '|' || vendor || '/' || size AS id FROM catalog),
    a AS (SELECT * FROM ent WHERE year = 1996), b AS (SELECT * FROM ent WHERE year = 1997), c AS (SELECT * FROM ent WHERE year = 1998),
    was AS MATERIALIZED (SELECT coalesce(b.store_id, a.store_id) AS store_id, coalesce(b.kind, a.kind) AS kind, coalesce(b.key, a.key) AS key, coalesce(b.id, a.id) AS id, b.store_id IS NULL AS missing
            FROM a FULL JOIN b ON a.id = b.id)"""


def _entity_frames(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    catalog = D.catalog(spark, sf, D.BEFORE, D.CURRENT).select("store_id", "year", "vendor", "size")
    catalog, stores = written(catalog.distinct(), "entities"), D.stores(spark, sf)
    kinds = entity_diff.observed_kinds(D.headers(spark, sf))
    known = entity_diff.next_entities(_entities(catalog, D.SINCE), kinds, _known_entities(_entities(catalog, D.BEFORE), "1996-12-31 12:00:00"), stores, D.at("1997-12-31 12:00:00"))
    return _entities(catalog, D.CURRENT), kinds, written(known, "known-entities"), stores


def _entity_score(added: bool) -> str:
    from driftline.config import ENTITY_MAGNITUDES

    word = "ADDED" if added else "REMOVED"
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {_score(f'{k}_{word}', str(m), None)}" for k, m in ENTITY_MAGNITUDES.items()) + " END"


@query(
    "entity_events",
    f"""{_ENTITY} SELECT store_id, CASE WHEN kind = 'PIXEL' THEN 'pixel:' || key ELSE key END AS entity_key, kind || '_ADDED' AS event_type, {_entity_score(True)} AS significance,
        substr(sha256(concat_ws('|', store_id, key, kind || '_ADDED', key || ':added')), 1, 40) AS dedupe_key FROM c WHERE id NOT IN (SELECT id FROM was)
        UNION ALL SELECT store_id, CASE WHEN kind = 'PIXEL' THEN 'pixel:' || key ELSE key END, kind || '_REMOVED', {_entity_score(False)},
        substr(sha256(concat_ws('|', store_id, key, kind || '_REMOVED', key || ':removed')), 1, 40) FROM was WHERE missing AND id NOT IN (SELECT id FROM c)""",
)
def entity_events(spark: SparkSession, sf: str) -> DataFrame:
    observed, kinds, known, stores = _entity_frames(spark, sf)
    return entity_diff.entity_events(observed, kinds, known, stores, D.at(D.NOW)).select("store_id", "entity_key", "event_type", "significance", "dedupe_key")


@query(
    "entity_state",
    f"""{_ENTITY} SELECT coalesce(c.store_id, was.store_id) AS store_id, coalesce(c.kind, was.kind) AS kind, coalesce(c.key, was.key) AS key,
        CASE WHEN c.store_id IS NOT NULL THEN 'ACTIVE' WHEN missing THEN 'REMOVED' ELSE 'MISSING' END AS status
        FROM was FULL JOIN c ON was.id = c.id""",
)
def entity_state(spark: SparkSession, sf: str) -> DataFrame:
    observed, kinds, known, stores = _entity_frames(spark, sf)
    return entity_diff.next_entities(observed, kinds, known, stores, D.at(D.NOW)).select("store_id", "kind", "key", "status")


def _ads(spark: SparkSession, sf: str) -> DataFrame:
    """Ads of 1997 and 1998: a supplier's lines of one number in a year, leading to the largest part."""
    supplier = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    lines = table(spark, sf, "lineitem").where((F.col("l_shipdate") >= D.at(f"{D.SINCE}-01-01 00:00:00")) & (F.col("l_shipdate") < D.at(f"{D.CURRENT + 1}-01-01 00:00:00"))).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = lines.groupBy(F.year("l_shipdate").alias("year"), F.col("n_regionkey").alias("store_id"), "s_suppkey", "s_name", "l_linenumber").agg(F.max("l_partkey").alias("part"), F.max("l_returnflag").alias("format"))
    return rows.select(
        "year",
        "store_id",
        F.lit("GOOGLE").alias("platform"),
        F.concat_ws("-", F.col("s_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("external_ad_id"),
        F.concat(F.lit("https://www.shop"), F.col("store_id").cast("string"), F.lit(".example/products/part-"), F.col("part").cast("string"), F.lit("/?utm_source=ad")).alias("destination_url"),
        F.col("s_suppkey").cast("string").alias("advertiser_external_id"),
        F.col("s_name").alias("advertiser_name"),
        "format",
        F.lit(None).cast("string").alias("source_metadata"),
    )


_ADS = f"""WITH {D.CATALOG}, ads AS (
        SELECT year(l_shipdate) AS year, n_regionkey AS store_id, s_suppkey || '-' || l_linenumber AS ad, max(l_partkey) AS part, max(l_returnflag) AS format, s_suppkey, s_name
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY year(l_shipdate), n_regionkey, s_suppkey, s_name, l_linenumber
    ), matched AS (SELECT ads.*, c.external_id AS product, 'https://www.shop' || ads.store_id || '.example/products/part-' || ads.part || '/?utm_source=ad' AS url
        FROM ads LEFT JOIN catalog c ON c.store_id = ads.store_id AND c.part = ads.part AND c.year = 1998
    ), a AS (SELECT * FROM matched WHERE year = 1997), b AS (SELECT * FROM matched WHERE year = 1998)"""


@query(
    "ad_events",
    f"""{_ADS} SELECT b.store_id, 'google:' || b.ad AS entity_key, 'AD_DETECTED' AS event_type, {_score('AD_DETECTED', '0.5', None)} AS significance, {_key('b.store_id', "'google:' || b.ad", 'AD_DETECTED', "b.ad || ':detected'")} AS dedupe_key
            FROM b ANTI JOIN a ON a.store_id = b.store_id AND a.ad = b.ad
        UNION ALL SELECT b.store_id, 'google:' || b.ad, 'AD_CHANGED', {_score('AD_CHANGED', '0.5', None)}, {_key('b.store_id', "'google:' || b.ad", 'AD_CHANGED', "b.ad || ':changed:' || b.url || '|' || b.s_suppkey || '|' || b.format")}
            FROM b JOIN a ON a.store_id = b.store_id AND a.ad = b.ad WHERE a.url <> b.url OR a.format <> b.format
        UNION ALL SELECT b.store_id, 'google:' || b.ad, 'PRODUCT_AD_MATCHED', {_score('PRODUCT_AD_MATCHED', '0.5', None)}, {_key('b.store_id', "'google:' || b.ad", 'PRODUCT_AD_MATCHED', "b.ad || ':matched:' || b.product")}
            FROM b LEFT JOIN a ON a.store_id = b.store_id AND a.ad = b.ad WHERE b.product IS NOT NULL AND b.product IS DISTINCT FROM a.product
        UNION ALL SELECT a.store_id, 'google:' || a.ad, 'AD_REMOVED', {_score('AD_REMOVED', '0.5', None)}, {_key('a.store_id', "'google:' || a.ad", 'AD_REMOVED', "a.ad || ':removed'")}
            FROM a ANTI JOIN b ON a.store_id = b.store_id AND a.ad = b.ad""",
)
def ad_events(spark: SparkSession, sf: str) -> DataFrame:
    """Ads of 1997, missing once already, against those of 1998."""
    return _ad_events(spark, sf)[0].select("store_id", "entity_key", "event_type", "significance", "dedupe_key")


def _ad_events(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The events, and the ads of 1998 with their products."""
    products, stores, now = D.year_of(D.catalog(spark, sf, D.CURRENT, D.CURRENT), D.CURRENT), D.stores(spark, sf), D.at(D.NOW)
    both = written(ad_diff.match_products(_ads(spark, sf), products, stores), "matched-ads")
    matched = lambda y: both.where(F.col("year") == y).drop("year")
    known = matched(D.SINCE).withColumns({"status": F.lit("ACTIVE_EVIDENCE"), "missing_streak": F.lit(1), "first_seen_at": now, "last_seen_at": now})
    return ad_diff.ad_events(matched(D.CURRENT), known, now), matched(D.CURRENT)


@query(
    "marketing_activity",
    f"""{_ADS}, e AS (SELECT b.store_id, 'd' AS kind FROM b ANTI JOIN a ON a.store_id = b.store_id AND a.ad = b.ad
            UNION ALL SELECT b.store_id, 'c' FROM b JOIN a ON a.store_id = b.store_id AND a.ad = b.ad WHERE a.url <> b.url OR a.format <> b.format
            UNION ALL SELECT b.store_id, 'm' FROM b LEFT JOIN a ON a.store_id = b.store_id AND a.ad = b.ad WHERE b.product IS NOT NULL AND b.product IS DISTINCT FROM a.product
            UNION ALL SELECT a.store_id, 'r' FROM a ANTI JOIN b ON a.store_id = b.store_id AND a.ad = b.ad)
        SELECT r_regionkey AS store_id, count(*) FILTER (WHERE kind = 'd') AS ad_detected, count(*) FILTER (WHERE kind = 'c') AS ad_changed, count(*) FILTER (WHERE kind = 'r') AS ad_removed, count(*) FILTER (WHERE kind = 'm') AS product_ad_matched
        FROM region LEFT JOIN e ON store_id = r_regionkey GROUP BY ALL""",
)
def marketing_activity(spark: SparkSession, sf: str) -> DataFrame:
    """What the ads of each store did in a month."""
    events, _ = _ad_events(spark, sf)
    stores = D.stores(spark, sf)
    sizes, crawls = stores.select("store_id", F.lit(0).alias("products")), stores.select("store_id", F.lit(1).alias("crawls"))
    return signals.store_activity(events, sizes, crawls, D.at("1998-12-01 00:00:00"), D.at("1999-01-01 00:00:00")).select("store_id", "ad_detected", "ad_changed", "ad_removed", "product_ad_matched")


@query(
    "marketing_ads",
    f"""{_ADS} SELECT b.store_id, b.ad AS external_ad_id, CASE WHEN b.store_id = 1 THEN 'UNAVAILABLE' ELSE 'OBSERVED' END AS status, b.s_name AS advertiser_name, 'Region ' || b.store_id || ',World' AS regions, p.handle AS matched_handle, p.title AS matched_title
        FROM b LEFT JOIN catalog p ON p.store_id = b.store_id AND p.external_id = b.product AND p.year = 1998 WHERE b.store_id <> 1
        UNION ALL SELECT 1, NULL, 'UNAVAILABLE', NULL, NULL, NULL, NULL""",
)
def marketing_ads(spark: SparkSession, sf: str) -> DataFrame:
    """The shown ads of each store with advertiser, regions and the product that they lead to; the data of store 1 couldn't be had."""
    catalog = written(D.catalog(spark, sf, D.CURRENT, D.CURRENT).select("store_id", "external_id", "handle", "title"), "products")
    region = lambda *x: F.struct(F.concat(*x).alias("name"))
    meta = F.to_json(F.struct(F.array(region(F.lit("Region "), F.col("store_id").cast("string")), region(F.lit("World"))).alias("regions")))
    ads = _ad_events(spark, sf)[1].withColumns({"status": F.lit("ACTIVE_EVIDENCE"), "source_metadata": meta})
    runs = D.stores(spark, sf).select("store_id", D.at(D.NOW).alias("started_at"), D.at(D.NOW).alias("finished_at"), F.when(F.col("store_id") == 1, "UNAVAILABLE").otherwise("OBSERVED").alias("outcome"), F.lit(None).cast("string").alias("reason"))
    made = reports.marketing_report(D.stores(spark, sf), runs, ads, catalog)
    return made.select("store_id", "external_ad_id", "status", "advertiser_name", F.array_join("regions", ",").alias("regions"), "matched_handle", "matched_title")


_LINE = "concat_ws('|', external_id, price_min_cents, price_max_cents, coalesce(CAST(compare_at_max_cents AS VARCHAR), '-'), variant_count, available_variants)"
_PLACE = "concat_ws('|', external_id, bestseller_rank)"


def _bag(text: str) -> str:
    part = "sum(('0x' || substr(sha256({}), {}, 15))::HUGEINT)"
    return f"concat_ws('-', count({text}), {part.format(text, 1)}, {part.format(text, 16)})"


def _hashes(rows: DataFrame, *keys: str) -> DataFrame:
    """Hashes of catalogs and of their rankings, which change far more often."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("price_min_cents", "price_max_cents", "compare_at_max_cents", "variant_count", "available_variants")]
    return content_hashes(rows, list(keys), catalog_hash=F.concat_ws("|", "external_id", *fields), rank_hash=F.concat_ws("|", "external_id", "bestseller_rank"))


@query(
    "content_hashes",
    f"""WITH {D.CATALOG} SELECT store_id, year, sha256('[' || string_agg('["' || external_id || '",' || price_min_cents || ',' || price_max_cents || ',' || coalesce(CAST(compare_at_max_cents AS VARCHAR), 'null') || ',' || variant_count || ',' || available_variants || ']', ',' ORDER BY external_id) || ']') AS catalog_hash,
        sha256('[' || string_agg('"' || external_id || '"', ',' ORDER BY bestseller_rank) || ']') AS rank_hash FROM catalog GROUP BY store_id, year""",
)
def content_hashes_by_store(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of each store's catalog, by product, and of its ranking alone."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    quoted = F.concat(F.lit('"'), "external_id", F.lit('"'))
    line = F.concat(F.lit("["), F.concat_ws(",", quoted, *[word(c) for c in ("price_min_cents", "price_max_cents", "compare_at_max_cents", "variant_count", "available_variants")]), F.lit("]"))
    part = lambda kind, name, rank, text: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"), rank.cast("long").alias("rank"), text.alias("t"))
    none = F.lit(None)
    parts = F.array(part("catalog_hash", F.col("external_id"), none, line), part("rank_hash", none, F.col("bestseller_rank"), quoted))
    rows = D.catalog(spark, sf).select("store_id", "year", F.inline(parts))
    block = F.struct(F.substring("name", 1, 4), F.floor(F.col("rank") / 4096))
    hashes = list_hashes(rows, ["store_id", "year", "kind"], block, F.struct("name", "rank"), "t")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("hash"))).alias(kind)
    return hashes.groupBy("store_id", "year").agg(of("catalog_hash"), of("rank_hash"))


def _half_unchanged(catalog: DataFrame) -> DataFrame:
    """The crawl of 1998, in which stores with an even number come as in 1997."""
    return catalog.where(F.col("year") == F.when(F.col("store_id") % 2 == 0, D.SINCE).otherwise(D.CURRENT))


@query(
    "unchanged_stores",
    f"""WITH {D.CATALOG}, snap AS (
            SELECT *, 1 AS crawl FROM catalog WHERE year = 1997
            UNION ALL SELECT *, 2 FROM catalog WHERE year = CASE WHEN store_id % 2 = 0 THEN 1997 ELSE 1998 END),
        h AS (SELECT store_id, crawl, string_agg({_LINE} || '#' || bestseller_rank, ';' ORDER BY external_id) AS content FROM snap GROUP BY ALL),
        same AS (SELECT a.store_id FROM h a JOIN h b ON a.store_id = b.store_id AND a.crawl = 1 AND b.crawl = 2 AND a.content = b.content)
        SELECT store_id, count(*) FILTER (WHERE store_id NOT IN (SELECT store_id FROM same)) AS compared, count(*) AS products FROM snap WHERE crawl = 2 GROUP BY ALL""",
)
def unchanged_stores(spark: SparkSession, sf: str) -> DataFrame:
    """How many products a diff has to compare."""
    catalog = D.catalog(spark, sf, D.SINCE, D.CURRENT)
    again = _half_unchanged(catalog)
    to_do = product_diff.changed_stores(_hashes(D.year_of(catalog, D.SINCE), "store_id"), _hashes(again, "store_id")).withColumn("changed", F.lit(True))
    sizes = again.groupBy("store_id").agg(F.count(F.lit(1)).alias("products"))
    return sizes.join(to_do, "store_id", "left").select("store_id", F.when(F.col("changed"), F.col("products")).otherwise(F.lit(0)).alias("compared"), "products")


def short_circuit(spark: SparkSession, sf: str) -> DataFrame:
    """The diff of a crawl in which half of the stores are as they were; catalog and state lie partitioned by store."""
    catalog = written(D.catalog(spark, sf, D.BEFORE, D.CURRENT), "catalog")
    was = D.first_state(D.year_of(catalog, D.BEFORE), D.at("1996-12-31 12:00:00"))
    state = partitioned(product_diff.next_state(D.stores(spark, sf), D.headers(spark, sf), D.year_of(catalog, D.SINCE), was, D.at("1997-12-31 12:00:00")), "state-by-store", "store_id")
    now = partitioned(_half_unchanged(catalog), "catalog-by-store", "store_id")
    hashes = written(_hashes(D.year_of(catalog, D.SINCE), "store_id"), "hashes"), written(_hashes(now, "store_id"), "hashes")
    return product_diff.product_events(D.stores(spark, sf), D.headers(spark, sf), now, state, D.at(D.NOW), cap=False, hashes=hashes)


@query("diff_events_changed", _EVENTS + " SELECT store_id, entity_key, event_type, headline, significance, dedupe_key FROM event WHERE store_id % 2 = 1")
def diff_events_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the stores whose content hashes differ; what the others are made of isn't read."""
    return short_circuit(spark, sf).select(*SHOWN)


_HISTORY = f"""WITH {D.STATE}, {_COLLAPSED}, s96 AS (
        SELECT store_id, external_id, price_min_cents, available_variants, bestseller_rank, 'ACTIVE' AS status, TIMESTAMP '1996-12-31 12:00:00' AS at_ FROM catalog WHERE year = 1996
    ), s97 AS (
        SELECT k.store_id, k.external_id, k.price_min_cents, k.available_variants, k.bestseller_rank, k.status, TIMESTAMP '1997-12-31 12:00:00' AS at_
        FROM known k LEFT JOIN (SELECT * FROM catalog WHERE year = 1996) a USING (store_id, external_id)
        WHERE k.status = 'MISSING' OR a.part IS NULL OR (k.price_min_cents, k.price_max_cents, k.variant_count, k.available_variants, k.bestseller_rank) <> (a.price_min_cents, a.price_max_cents, a.variant_count, a.available_variants, a.bestseller_rank) OR k.compare_at_max_cents IS DISTINCT FROM a.compare_at_max_cents
    ), s98 AS (
        SELECT coalesce(c.store_id, k.store_id) AS store_id, coalesce(c.external_id, k.external_id) AS external_id, coalesce(c.price_min_cents, k.price_min_cents) AS price_min_cents, coalesce(c.available_variants, 0) AS available_variants, c.bestseller_rank,
               CASE WHEN c.part IS NOT NULL THEN 'ACTIVE' WHEN k.missing_streak = 1 THEN 'REMOVED' ELSE 'MISSING' END AS status, TIMESTAMP '1998-12-31 12:00:00' AS at_
        FROM known k FULL JOIN cur c ON k.store_id = c.store_id AND k.external_id = c.external_id
        WHERE coalesce(c.store_id, k.store_id) NOT IN (SELECT store_id FROM collapsed) AND (
              c.part IS NULL OR k.status IS NULL OR k.status <> 'ACTIVE' OR (k.price_min_cents, k.price_max_cents, k.variant_count, k.available_variants) <> (c.price_min_cents, c.price_max_cents, c.variant_count, c.available_variants)
              OR k.bestseller_rank IS DISTINCT FROM c.bestseller_rank OR k.compare_at_max_cents IS DISTINCT FROM c.compare_at_max_cents)
    ), told AS (SELECT * FROM s96 UNION ALL SELECT * FROM s97 UNION ALL SELECT * FROM s98),
    history AS (SELECT * EXCLUDE at_, at_ AS valid_from, lead(at_) OVER (PARTITION BY store_id, external_id ORDER BY at_) AS valid_to FROM told)"""


def _history(spark: SparkSession, sf: str) -> history.History:
    """Three crawls, each of which adds intervals for what it changes."""
    catalog = written(D.catalog(spark, sf, D.BEFORE, D.CURRENT), "catalog")
    stamps = [f"{y}-12-31 12:00:00" for y in (D.BEFORE, D.SINCE, D.CURRENT)]
    held = ["store_id", "external_id", "price_min_cents", "available_variants", "bestseller_rank", "status"]
    state = D.first_state(D.year_of(catalog, D.BEFORE), D.at(stamps[0]))
    told = history.begun(state.select(*held), D.at(stamps[0]))
    for year, stamp in zip((D.SINCE, D.CURRENT), stamps[1:], strict=True):
        after = written(product_diff.next_state(D.stores(spark, sf), D.headers(spark, sf), D.year_of(catalog, year), state, D.at(stamp)), "state")
        told, _ = history.advanced(told, after.select(*held, "state_changed"), "state_changed", ["store_id", "external_id"], D.at(stamp))
        told = history.History(written(told.open, "open"), written(told.closed, "closed"))
        state = after.drop("state_changed")
    return told


@query("state_history", _HISTORY + " SELECT * FROM history")
def state_history(spark: SparkSession, sf: str) -> DataFrame:
    """The states of products as intervals; a crawl that finds a product as it was adds none."""
    told = _history(spark, sf)
    return told.open.unionByName(told.closed)


@query("state_as_of", _HISTORY + " SELECT * EXCLUDE (valid_from, valid_to) FROM history WHERE valid_from <= TIMESTAMP '1998-06-30 00:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-06-30 00:00:00')")
def state_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog as it was known in the middle of 1998."""
    return history.as_of(_history(spark, sf), D.at("1998-06-30 00:00:00"))
