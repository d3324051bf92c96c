"""Scalar functions over columns of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import fingerprint as P
from driftline.functions import money as M
from driftline.functions import scoring
from driftline.functions import text as X
from driftline.functions import time as T
from driftline.operators import ledger as L
from driftline.plans import derived as D
from driftline.plans.registry import query
from driftline.session import table
from driftline.sources import reviews
from driftline.sources.catalog import variant_rollup
from driftline.sources.sinks import csv_lines, personal_documents

_URL = """regexp_extract(url, '^https?://([^/?#]+)', 1) AS h, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p FROM pages"""


@query(
    "normalized_urls",
    f"""WITH u AS (SELECT page_id, {_URL}), v AS (SELECT page_id, regexp_replace(lower(h), '^www\\.', '') AS h, CASE WHEN p = '' THEN '/' ELSE url_decode(p) END AS p FROM u)
        SELECT page_id, h || CASE WHEN length(p) > 1 AND p LIKE '%/' THEN left(p, length(p) - 1) ELSE p END AS match_url FROM v""",
)
def normalized_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.normalized_url(F.col("url")).alias("match_url"))


@query("canonical_domains", "SELECT regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', ''), '/.*$', '', 's') AS domain, count(*) AS pages FROM pages GROUP BY ALL")
def canonical_domains(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(X.canonical_domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


def _found_sql(patterns: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(html, '{p}', 'i') THEN '{k}' END" for k, p in sorted(patterns.items()))
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',')"


@query(
    "page_technology",
    f"""SELECT page_id, {_found_sql(P.APPS)} AS apps, {_found_sql(P.PAYMENTS)} AS payments, """
    + "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(html, '{p}', 'i') THEN '{k}' END" for k, p in P.EMAIL_PLATFORMS.items()) + ", 'none') AS email_platform, "
    + "regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages",
)
def page_technology(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.array_join(P.found(html, P.APPS), ",").alias("apps"), F.array_join(P.found(html, P.PAYMENTS), ",").alias("payments"), F.coalesce(P.email_platform(html), F.lit("none")).alias("email_platform"), F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("lang"))


@query(
    "page_reviews",
    """SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'ABSENT' WHEN p_size % 6 = 3 THEN 'PRESENT_BUT_INVALID' WHEN p_size % 6 IN (4, 5) THEN 'AMBIGUOUS' ELSE 'PRESENT' END AS status,
        CASE WHEN p_size % 6 IN (1, 2) THEN p_partkey END AS review_count, CASE WHEN p_size % 6 IN (1, 2) THEN p_size / 10.0::DOUBLE END AS rating_value FROM part""",
)
def page_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Pages made of parts: no data, a product, a rating that names its product, a broken count, two ratings, a broken block."""
    part, size = F.col("p_partkey").cast("string"), F.col("p_size")
    block = lambda *xs: F.concat(F.lit('<script type="application/ld+json">'), *[x if isinstance(x, Column) else F.lit(x) for x in xs], F.lit("</script>"))
    rating = lambda count: F.concat(F.lit('{"@type":"AggregateRating","reviewCount":'), count, F.lit(',"ratingValue":"'), (size / 10.0).cast("string"), F.lit('"}'))
    product = lambda count: F.concat(F.lit('{"@type":"Product","url":"/products/part-'), part, F.lit('","aggregateRating":'), rating(count), F.lit("}"))
    html = (
        F.when(size % 6 == 0, F.lit("<p>nothing</p>"))
        .when(size % 6 == 1, block(product(part)))
        .when(size % 6 == 2, block('{"@graph":[', F.lit('{"@type":"WebPage"},'), product(F.concat(F.lit('"'), part, F.lit('"'))), "]}"))
        .when(size % 6 == 3, block(product(F.lit('"many"'))))
        .when(size % 6 == 4, F.concat(block('{"@type":"Product","aggregateRating":', rating(part), "}"), block('{"@type":"Product","aggregateRating":', rating(part), "}")))
        .otherwise(block('{"@type":"Product",,'))
    )
    rows = reviews.observed_reviews(table(spark, sf, "part").select("p_partkey", html.alias("html")), handle=F.concat(F.lit("part-"), part))
    return rows.select("p_partkey", "review.*")


@query("price_texts", "SELECT p_partkey, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS cents FROM part")
def price_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", M.to_cents(F.concat(F.lit("US$ "), F.format_number("p_retailprice", 2))).alias("cents"))


@query("money_texts", "SELECT o_orderkey, format('${:,.2f}', CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) / 100.0) AS shown FROM orders")
def money_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", M.format_cents(M.half_up(F.col("o_totalprice") * 100), F.lit("USD")).alias("shown"))


@query("price_changes", "WITH c AS (SELECT o_orderkey, o_totalprice AS now, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) SELECT o_orderkey, CASE WHEN before <> 0 THEN (now - before) / before END AS change FROM c")
def price_changes(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").withColumn("before", before).select("o_orderkey", M.pct_change(F.col("before"), F.col("o_totalprice")).alias("change"))


@query(
    "significance_scores",
    """SELECT l_orderkey, l_linenumber, CAST(floor(100::DOUBLE * (1::DOUBLE - exp(-(55::DOUBLE * (0.6::DOUBLE + 0.8::DOUBLE * least(1::DOUBLE, l_discount / 0.5::DOUBLE)) *
        ((CASE WHEN l_linenumber < 5 THEN 1.6 WHEN l_linenumber < 15 THEN 1.35 ELSE 1.15 END)::DOUBLE * (CASE WHEN floor(l_extendedprice) > 15000 THEN 1.1 ELSE 1.0 END)::DOUBLE) * 1.4::DOUBLE *
        (CASE WHEN l_suppkey % 10 < 2 THEN 1.0 WHEN l_suppkey % 10 < 4 THEN 1.25 WHEN l_suppkey % 10 < 8 THEN 1.5 ELSE 1.75 END)::DOUBLE) / 70::DOUBLE)) + 0.5::DOUBLE) AS INTEGER) AS score FROM lineitem""",
)
def significance_scores(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.lit("PRICE_DROP")
    relevance = scoring.relevance(F.col("l_linenumber"), F.floor("l_extendedprice"))
    rarity = scoring.rarity(kind, F.lit(2), F.lit(3), F.lit(30))
    score = scoring.significance(scoring.base_score(kind).cast("double"), scoring.price_magnitude(F.col("l_discount")), relevance, rarity, scoring.cross_store(F.col("l_suppkey") % 10))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"))


@query("dedupe_keys", "SELECT event_id, substr(sha256(concat_ws('|', user_id, event_id, event_type, strftime(ts, '%Y-%m-%d'))), 1, 40) AS dedupe_key FROM events")
def dedupe_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", scoring.dedupe_key(F.col("user_id"), F.col("event_id"), F.col("event_type"), T.day_bucket(F.col("ts"))).alias("dedupe_key"))


@query("tags", "SELECT p_partkey, array_to_string(list_sort(list_filter(list_transform(string_split(p_type || ', ' || p_brand || ',,' || p_name, ','), lambda t: lower(trim(t))), lambda t: t <> '')), ';') AS tags FROM part")
def tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.normalized_tags(F.concat("p_type", F.lit(", "), "p_brand", F.lit(",,"), "p_name")), ";").alias("tags"))


@query(
    "schedule",
    """WITH s AS (SELECT s_suppkey, ['HOT', 'WARM', 'COOL', 'COLD', 'DORMANT', 'DISABLED'][s_suppkey % 6 + 1] AS tier, s_suppkey % 9 AS streak FROM supplier), n AS (SELECT TIMESTAMP '2024-01-15' AS now)
        SELECT s_suppkey, tier, now + to_hours((CASE tier WHEN 'HOT' THEN 8 WHEN 'WARM' THEN 24 WHEN 'COOL' THEN 168 WHEN 'COLD' THEN 720 WHEN 'DORMANT' THEN 2160 END)::INTEGER) AS after_success,
               now + to_hours(least(48, CAST(pow(2, greatest(0, streak - 1)) AS INTEGER))) AS after_failure FROM s, n""",
)
def schedule(spark: SparkSession, sf: str) -> DataFrame:
    key, now = F.col("s_suppkey"), D.at("2024-01-15 00:00:00")
    tier = F.element_at(F.array(*[F.lit(t) for t in ("HOT", "WARM", "COOL", "COLD", "DORMANT", "DISABLED")]), (key % 6 + 1).cast("int"))
    rows = table(spark, sf, "supplier").select("s_suppkey", tier.alias("tier"), (key % 9).alias("streak"))
    return rows.select("s_suppkey", "tier", T.next_after_success(now, F.col("tier")).alias("after_success"), T.next_after_failure(now, F.col("streak")).alias("after_failure"))


@query(
    "time_texts",
    """WITH d AS (SELECT event_id, epoch_ms(ts) - epoch_ms(TIMESTAMP '2024-01-15') AS ms FROM events), a AS (SELECT *, abs(ms) AS s FROM d),
        t AS (SELECT *, CASE WHEN s < 3600000 THEN CAST(floor(s / 60000.0 + 0.5) AS BIGINT) WHEN s < 86400000 THEN CAST(floor(s / 3600000.0 + 0.5) AS BIGINT) ELSE CAST(floor(s / 86400000.0 + 0.5) AS BIGINT) END AS n,
              CASE WHEN s < 3600000 THEN 'minute' WHEN s < 86400000 THEN 'hour' ELSE 'day' END AS unit FROM a)
        SELECT event_id, CASE WHEN s < 60000 THEN CASE WHEN ms > 0 THEN 'in a moment' ELSE 'just now' END ELSE CASE WHEN ms > 0 THEN 'in ' ELSE '' END || n || ' ' || unit || CASE WHEN n = 1 THEN '' ELSE 's' END || CASE WHEN ms > 0 THEN '' ELSE ' ago' END END AS shown,
               greatest(0, CAST(ceil(ms / 86400000.0) AS BIGINT)) AS days_left FROM t""",
)
def time_texts(spark: SparkSession, sf: str) -> DataFrame:
    now, ts = D.at("2024-01-15 00:00:00"), F.col("ts")
    return table(spark, sf, "events").select("event_id", T.relative_time(ts, now).alias("shown"), T.days_remaining(ts, now).alias("days_left"))


@query("metric_windows", "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_end, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month FROM events")
def metric_windows(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf, "events").select("event_id", T.hour_floor(ts).alias("window_end"), T.day_floor(ts).alias("day"), T.month_floor(ts).alias("month"))


@query("even_dates", "WITH r AS (SELECT user_id, epoch_us(min(ts)) // 1000 AS a, epoch_us(max(ts)) // 1000 AS b FROM events GROUP BY ALL) SELECT user_id, i, CAST(make_timestamp_ms(a + CAST(floor((b - a) * i / 11.0::DOUBLE) AS BIGINT)) AS TIMESTAMP) AS at FROM r, range(12) x(i)")
def even_dates(spark: SparkSession, sf: str) -> DataFrame:
    from driftline.operators.signals import evenly_spaced

    ends = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return ends.select("user_id", F.posexplode(evenly_spaced(F.col("a"), F.col("b"))).alias("i", "at")).select("user_id", F.col("i").cast("long").alias("i"), "at")


@query(
    "json_rowset",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM events""",
)
def json_rowset(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON list becomes typed rows; what the list lacks is null."""
    listed = F.concat(F.lit("["), "props", F.lit("]"))
    rows = table(spark, sf, "events").select("event_id", F.inline(F.from_json(listed, "array<struct<k:bigint,other:string>>")))
    return rows.select("event_id", "k", F.when(F.col("k") % 2 == 0, "even").otherwise("odd").alias("parity"))


@query("json_scrub", """SELECT event_id, '{"kept":"' || event_type || '"}' AS metadata, user_id % 3 = 0 AS was_email FROM events""")
def json_scrub(spark: SparkSession, sf: str) -> DataFrame:
    who = F.when(F.col("user_id") % 3 == 0, F.concat(F.col("user_id").cast("string"), F.lit("@mail.example"))).otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit("@mail.example")))
    rows = table(spark, sf, "events").withColumn("j", F.to_json(F.struct(F.col("event_type").alias("kept"), who.alias("who"))))
    return rows.select("event_id", X.scrubbed(F.col("j"), ("who",)).alias("metadata"), X.holds_email_leaf(F.col("j")).alias("was_email"))


@query("csv_export", "SELECT CASE WHEN c_custkey % 3 = 0 THEN '~''=' || c_name || '~' ELSE c_name END || ',' || CASE WHEN c_custkey % 2 = 0 THEN '~' || c_mktsegment || ', ~~x~~~' ELSE c_mktsegment END AS line FROM customer".replace("~", '"'))
def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        F.when(key % 3 == 0, F.concat(F.lit("="), "c_name")).otherwise(F.col("c_name")).alias("name"),
        F.when(key % 2 == 0, F.concat("c_mktsegment", F.lit(', "x"'))).otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    return csv_lines(rows, ["name", "segment"])


@query(
    "personal_export",
    f"""WITH {D.SUBSCRIPTIONS} SELECT c_custkey AS user_id, c_name AS name, (SELECT count(*) FROM subs WHERE user_id = c_custkey) AS subscriptions, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS events FROM customer""",
)
def personal_export(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    docs = personal_documents(users, subscriptions=D.subscriptions(spark, sf), events=D.events(spark, sf))
    count = lambda p: F.json_array_length(F.get_json_object("document", p)).cast("long")
    return docs.select("user_id", F.get_json_object("document", "$.profile.name").alias("name"), count("$.subscriptions").alias("subscriptions"), count("$.events").alias("events"))


@query(
    "variant_rollup",
    """WITH v AS (SELECT l_orderkey, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS c, CASE WHEN l_discount > 0.05 THEN CAST(floor(l_extendedprice * 110 + 0.5) AS BIGINT) ELSE 0 END AS b, l_returnflag <> 'R' AS a FROM lineitem)
        SELECT l_orderkey, min(c) AS price_min_cents, max(c) AS price_max_cents, max(b) FILTER (WHERE b > 0) AS compare_at_max_cents, count(*) AS variant_count, count(*) FILTER (WHERE a) AS available_variants FROM v GROUP BY ALL""",
)
def variants(spark: SparkSession, sf: str) -> DataFrame:
    """Nested lines of an order, rolled up in place."""
    cents = lambda k: M.half_up(F.col("l_extendedprice") * k)
    v = F.struct(cents(100).alias("price_cents"), F.when(F.col("l_discount") > 0.05, cents(110)).otherwise(0).alias("compare_at_cents"), (F.col("l_returnflag") != "R").alias("available"))
    nested = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(v).alias("variants"))
    return nested.select("l_orderkey", *[c.alias(n) for n, c in variant_rollup(F.col("variants")).items()])


@query(
    "promo_verdicts",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'not_found' WHEN o_orderkey % 7 = 0 THEN 'disabled' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'not_yet_valid' WHEN o_orderdate > TIMESTAMP '2000-01-01' THEN 'expired'
        WHEN o_orderpriority[1] = '3' THEN 'wrong_plan' WHEN o_orderkey % 5 >= 3 THEN 'exhausted' ELSE 'ok' END AS verdict, CAST(greatest(0, 4900 - least(4900, CAST(floor(4900 * (o_orderkey % 120) / 100.0) AS BIGINT))) AS BIGINT) AS price FROM orders""",
)
def promo_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    key, none = F.col("o_orderkey"), F.lit(None)
    promo = {
        "code": F.when(key % 11 != 0, "CODE"),
        "assigned_to": none.cast("long"),
        "status": F.when(key % 7 == 0, "DISABLED").otherwise("ACTIVE"),
        "valid_from": D.at("1996-01-01 00:00:00"),
        "valid_until": D.at("2000-01-01 00:00:00"),
        "plan": F.when(F.col("o_orderpriority").startswith("3"), "BASIC"),
        "max_redemptions": F.lit(3),
        "redemptions": key % 5,
        "per_user_limit": F.lit(1),
        "user_redemptions": F.lit(0),
    }
    verdict = L.promo_verdict(promo, F.col("o_custkey"), F.lit("BUSINESS"), F.col("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", verdict.alias("verdict"), L.discounted(M.list_price_cents(F.lit("BUSINESS"), F.lit("MONTHLY")), key % 120, none.cast("long")).alias("price"))


@query(
    "client_addresses",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'unknown' WHEN 1 THEN '10.0.' || user_id % 256 || '.7' WHEN 2 THEN '93.184.' || user_id % 256 || '.7' WHEN 3 THEN '2606:4700::' || to_hex(user_id) WHEN 4 THEN '::ffff:10.0.0.' || user_id % 256
        WHEN 5 THEN 'FE80::1:' || to_hex(user_id) WHEN 6 THEN '::ffff:93.184.0.' || user_id % 256 ELSE '2001:db8:0:1:2:3:4:' || to_hex(user_id) END AS ip, event_id % 8 IN (2, 3, 6) AS public FROM events""",
)
def client_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """The caller's address out of a header of both families, and whether it is a public one."""
    low, hexed = (F.col("user_id") % 256).cast("string"), F.hex("user_id")
    kinds = [F.lit("junk"), F.concat(F.lit("10.0."), low, F.lit(".7")), F.concat(F.lit("93.184."), low, F.lit(".7")), F.concat(F.lit("2606:4700::"), hexed), F.concat(F.lit("::ffff:10.0.0."), low)]
    kinds += [F.concat(F.lit("FE80::1:"), hexed), F.concat(F.lit("::ffff:93.184.0."), low), F.concat(F.lit("2001:db8:0:1:2:3:4:"), hexed)]
    own = F.get(F.array(*kinds), (F.col("event_id") % 8).cast("int"))
    header = F.when(F.col("event_id") % 8 == 0, F.lit("junk")).otherwise(F.concat(F.lit("8.8.8.8, nonsense, "), own))
    ip = X.client_ip(header, 1)
    return table(spark, sf, "events").select("event_id", ip.alias("ip"), X.is_public_unicast(ip).alias("public"))


@query(
    "json_scrub_nested",
    """SELECT event_id, '{"id":' || event_id || ',"user":{"no":' || user_id || ',"seen":true,"tags":[{"k":1},{"k":' || event_id % 7 || ',"n":[1,2.5,null]}]},"kind":"' || event_type || '"}' AS props FROM events""",
)
def json_scrub_nested(spark: SparkSession, sf: str) -> DataFrame:
    """E-mail addresses go at any depth, one path goes, another is set; the rest stays as it is nested."""
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    text = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    json = text('{"id": ', e, ', "email": "a@b.c", "user": {"email": {"x": 1}, "no": ', u, ', "seen": false, "phone": "1", "tags": [{"k": 1, "email": "d@e.f"}, {"k": ', (F.col("event_id") % 7).cast("string"), ', "n": [1, 2.50, null], "ip": "::1"}]}, "kind": "', F.col("event_type"), '"}')
    props = X.changed_json(json, remove=("user.phone", "user.tags.*.ip", "no.such"), put={"user.seen": "true"}, anywhere=("email",))
    return table(spark, sf, "events").select("event_id", props.alias("props"))
