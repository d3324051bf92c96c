import datetime as dt
import json
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.operators import analytics, ledger, signals, state, upkeep
from driftline.plans import QUERIES
from driftline.session import scratch_root, table
from driftline.sources import catalog, reviews, sinks, vendors


def day(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def test_percentiles_by_place(spark):
    rows = spark.createDataFrame([("s", x) for x in (1, 2, 3, 4)], "k string, price_min_cents int")
    got = signals.price_spread(rows, ["k"]).first()
    assert (got.p25_cents, got.median_cents, got.p75_cents) == (2, 3, 4)


@pytest.mark.parametrize(("ranks", "want"), [([9, 7, 5, 3], "IMPROVING"), ([3, 5, 7, 9], "DECLINING"), ([4, 4, 4, 4], "STABLE"), ([5, 3, 6, 4], None), ([9, 7, 5], None)])
def test_momentum(spark, ranks, want):
    rows = spark.createDataFrame([("s", "p", str(i), day(i), r) for i, r in enumerate(ranks)], "store_id string, external_id string, crawl_id string, captured_at timestamp_ntz, rank int")
    assert signals.rank_signals(rows).first().momentum == want


def persistence(spark, moves, status="ACTIVE", since=None, first=0, crawls=7):
    c = spark.createDataFrame([("s", day(i)) for i in range(crawls)], "store_id string, finished_at timestamp_ntz")
    p = spark.createDataFrame([("s", "p", day(first), status, since)], "store_id string, external_id string, first_seen_at timestamp_ntz, status string, missing_since timestamp_ntz")
    t = spark.createDataFrame([("s", "p", k, at) for k, at in moves], "store_id string, external_id string, type string, occurred_at timestamp_ntz")
    r = signals.persistence(c, p, t).first()
    return r.present, r.crawls, r.ratio


def test_persistence(spark):
    assert persistence(spark, []) == (7, 7, 1.0)
    assert persistence(spark, [("PRODUCT_REMOVED", day(2)), ("PRODUCT_RESTORED", day(4))]) == (5, 7, 5 / 7)
    assert persistence(spark, [], "MISSING", day(5)) == (5, 7, 5 / 7)
    assert persistence(spark, [], first=5) == (2, 2, None)
    assert persistence(spark, [("PRODUCT_REMOVED", day(-3))])[0] == 0


def test_login_delays(spark):
    f = lambda e, i: analytics.login_delay_ms(F.lit(e), F.lit(i))
    assert list(spark.range(1).select(f(0, 0), f(4, 0), f(5, 0), f(7, 0), f(9, 0), f(10, 0), f(0, 30)).first()) == [0, 0, 500, 2000, 8000, None, None]


def test_rows_that_start_together_have_no_predecessor(spark):
    rows = spark.createDataFrame([(1, "u", "BASIC", day(0)), (2, "u", "BUSINESS", day(0)), (3, "u", "FREE", day(1))], "subscription_id int, user_id string, plan string, started_at timestamp_ntz")
    got = {r.subscription_id: r.previous_plan for r in analytics.with_previous_plan(rows).collect()}
    assert got == {1: None, 2: None, 3: "BUSINESS"}


def test_windows_compare_in_utc(spark):
    was = spark.conf.get("spark.sql.session.timeZone")
    rows = spark.createDataFrame([("2026-08-07 23:30:00",), ("2026-08-08 00:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("started_at"), F.lit("OK").alias("status"))
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kathmandu")
        at = lambda s: F.lit(s).cast("timestamp_ntz")
        assert analytics.crawl_volume(rows, at("2026-08-01"), at("2026-08-08")).first().crawls == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_merge_contract(spark):
    known = spark.createDataFrame([("p1", 1, 10, "ACTIVE", 7900)], "key string, id int, seen int, status string, price int")
    step = lambda s, **x: state.merge(s, spark.createDataFrame([x], "key string, id int, seen int, status string, price int"), ["key"], keep=("id",), when_active=("seen",)).first()
    up = step(known, key="p1", id=2, seen=11, status="ACTIVE", price=5900)
    assert (up.id, up.seen, up.price) == (1, 11, 5900)
    down = step(known, key="p1", id=2, seen=11, status="MISSING", price=5900)
    assert (down.seen, down.status) == (10, "MISSING")


def test_versions(spark, tmp_path):
    target = state.VersionedTable(spark, str(tmp_path / "t"))
    assert target.read() is None
    for n in range(4):
        assert target.write(spark.range(n + 1)) == n
    target.vacuum(2)
    assert target.versions() == [2, 3] and target.read().count() == 4


def test_quota_against_a_loop(spark, small):
    got = QUERIES["quota_ledger"](spark, small).toPandas()
    want = {}
    for _, rows in got.sort_values(["created_at", "request_id"]).groupby("user_id"):
        used = []
        for r in rows.itertuples():
            used = [(t, s) for t, s in used if t > r.created_at - pd.Timedelta(hours=24)]
            if r.store_id in [s for _, s in used]:
                want[r.request_id] = "REPEATED"
            elif len(used) < 2:
                used.append((r.created_at, r.store_id))
                want[r.request_id] = "ALLOWED"
            else:
                want[r.request_id] = "REFUSED"
    assert dict(zip(got.request_id, got.outcome, strict=True)) == want and len(set(want.values())) == 3


def test_a_hot_key_is_decided_batch_by_batch(spark):
    rows = [(i, None if i % 4 == 3 else i % 2, day(0) + dt.timedelta(minutes=7 * (i * 37 % 101)), i % 3, 1, day(1) if i % 2 else None) for i in range(101)]
    requests = spark.createDataFrame(rows, "request_id long, user_id long, created_at timestamp_ntz, store_id long, quota int, expires_at timestamp_ntz").withColumn("slots", F.col("quota"))
    runs = [lambda: ledger.quota(requests, hours=1), lambda: ledger.rate_limit(requests, "user_id", 3, 3600), lambda: ledger.slots(requests)]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {}
    try:
        for size in ("2", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got[size] = [{r.request_id: r[-1] for r in run().collect()} for run in runs]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got["2"] == got["10000"] and all(len(x) == 101 for x in got["2"])
    want = {}
    for key in (None, 0, 1):
        begun, n = None, 0
        for r in sorted((r for r in rows if r[1] == key), key=lambda r: r[2]):
            if begun is None or r[2] >= begun + dt.timedelta(hours=1):
                begun, n = r[2], 0
            n += 1
            want[r[0]] = n <= 3
    assert got["2"][1] == want
    assert not any("InPandas" in run()._jdf.queryExecution().executedPlan().toString() for run in runs)


def test_erasure_has_no_greatest_id(spark, tmp_path):
    spark.createDataFrame([(1, 1_000_000), (2, 7), (3, 2_000_005), (4, 20), (5, None)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.actor_id, r.subject_id, r.changed) for r in QUERIES["erased_audit"](spark, str(tmp_path)).collect()}
    assert got == {1: (None, 1_000_005, True), 2: (7, 12, False), 3: (2_000_005, None, True), 4: (None, 25, True), 5: (None, None, False)}


def test_stream_and_batch_limits_agree(spark, small):
    stream = QUERIES["stream_rate_limit"](spark, small).toPandas().set_index("event_id").allowed
    rows = table(spark, small, "events").select(F.col("event_id").alias("request_id"), "user_id", F.col("ts").alias("created_at"))
    batch = ledger.rate_limit(rows, "user_id", 3, 21_600).toPandas().set_index("request_id").allowed
    assert stream.sort_index().tolist() == batch.sort_index().tolist() and not batch.all()


def test_pages_neither_repeat_nor_skip(spark, small):
    rows = table(spark, small, "events").select("event_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"))
    seen, cursor = [], None
    for _ in range(4):
        page = upkeep.page(rows, cursor, 7, at="ts").orderBy(F.desc("ts"), F.desc("event_id")).collect()
        seen += [r.event_id for r in page]
        assert page[-1].next
        cursor = (page[-1].ts, page[-1].event_id)
    want = [r.event_id for r in rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(28).collect()]
    assert seen == want


def _landing(spark, *pages):
    return spark.createDataFrame([("d", "c", p, status, body, error) for p, status, body, error in pages], catalog.LANDING)


def _products(*ids, price="10.00"):
    return json.dumps({"products": [{"id": i, "handle": f"h{i}", "title": f"T{i}", "vendor": "", "tags": ["B", " a "] if i % 2 else "B, a", "created_at": "2026-01-01T00:00:00Z", "variants": [{"id": i * 10, "price": price, "compare_at_price": "0.00", "available": True}, {"id": i * 10 + 1, "price": "30", "compare_at_price": "40.00", "available": False}]} for i in ids]})


def test_landing(spark):
    rows = _landing(spark, (1, 200, _products(1, 2), None), (2, 200, _products(3), None), (3, 200, _products(9), None))
    head = catalog.crawl_headers(rows, page_size=2).first()
    assert (head.status, head.pages_fetched, head.http_errors, head.partial) == ("ok", 2, 0, False)
    got = {r.external_id: r for r in catalog.normalized_products(catalog.crawl_pages(rows, page_size=2)).collect()}
    assert sorted(got) == ["1", "2", "3"]
    p = got["1"]
    assert (p.price_min_cents, p.price_max_cents, p.compare_at_max_cents, p.variant_count, p.available_variants, p.vendor, p.tags) == (1000, 3000, 4000, 2, 1, None, ["a", "b"])
    assert got["2"].tags == ["a", "b"]


def test_landing_failures(spark):
    first = lambda status, body=None, error=None: catalog.crawl_headers(_landing(spark, (1, status, body, error))).first().status
    assert first(403) == "blocked" and first(404) == "not_found" and first(503) == "error" and first(200, "<html>Just a moment...</html>") == "blocked" and first(200, "{}") == "not_found"
    late = catalog.crawl_headers(_landing(spark, (1, 200, _products(1, 2), None), (2, 500, None, "boom")), page_size=2).first()
    assert late.status == "ok" and late.partial and late.http_errors == 1
    full = catalog.crawl_headers(_landing(spark, (1, 200, _products(1, 2), None), (2, 200, _products(3, 4), None)), page_size=2, max_pages=2).first()
    assert full.partial
    same = catalog.crawl_headers(_landing(spark, (1, 200, _products(1, 2), None), (2, 200, _products(1, 2), None)), page_size=2).first()
    assert same.pages_fetched == 1 and not same.partial


def test_page_source(spark, tmp_path):
    from driftline.sources.datasource import CatalogPages

    for domain, page, ids in (("a.example", 1, (1, 2)), ("a.example", 2, (3,)), ("b.example", 1, (4,))):
        (tmp_path / domain).mkdir(exist_ok=True)
        (tmp_path / domain / f"{page}.json").write_text(_products(*ids))
    spark.dataSource.register(CatalogPages)
    rows = spark.read.format("catalog_pages").option("path", str(tmp_path)).load()
    assert rows.count() == 3
    got = catalog.normalized_products(catalog.crawl_pages(rows, page_size=2))
    assert sorted((r.domain, r.external_id) for r in got.collect()) == [("a.example", "1"), ("a.example", "2"), ("a.example", "3"), ("b.example", "4")]


def test_ranks_and_collections(spark):
    ranks = catalog.bestseller_ranks(_landing(spark, (1, 200, _products(7, 5), None), (2, 500, None, "x"))).collect()
    assert {r.external_id: r.bestseller_rank for r in ranks} == {"7": 0, "5": 1}
    made = lambda *pages: catalog.collection_handles(_landing(spark, *pages)).first()
    body = json.dumps({"collections": [{"handle": "b"}, {"handle": "a"}]})
    ok, bad = made((1, 200, body, None)), made((1, 200, body, None), (2, 500, None, "x"))
    assert ok.handles == ["a", "b"] and ok.complete and not bad.complete


def test_vendor_answers(spark):
    body = json.dumps({"ad_creatives": [{"ad_creative_id": "CR1", "advertiser_id": "AR1", "advertiser": "Acme", "target_domain": "Shop.example"}, {"ad_creative_id": "CR2"}, {"ad_creative_id": "CR3", "advertiser_id": "AR1", "target_domain": "other.example"}]})
    ads = vendors.ad_summaries(spark.createDataFrame([("shop.example", body)], "domain string, body string"))
    assert [r.external_ad_id for r in ads.collect()] == ["CR1"]
    detail = json.dumps({"search_information": {"ad_funded_by": "Acme Inc", "first_shown": 5, "regions": [{"region_name": "Nepal"}]}})
    got = vendors.ad_details(ads.withColumn("body", F.lit(detail))).first()
    assert got.destination_url is None and got.advertiser_name == "Acme Inc" and json.loads(got.source_metadata)["regions"][0]["regionName"] == "Nepal"
    rdap = json.dumps({"events": [{"eventAction": "expiration", "eventDate": "2030-01-01"}, {"eventAction": "registration", "eventDate": "2001-02-03T00:00:00Z"}]})
    row = spark.range(1).select(vendors.registration_date(F.lit(rdap)).cast("string"), vendors.first_archived(F.lit('[["urlkey","timestamp"],["x","20050607080910"]]')).cast("string"), vendors.first_archived(F.lit("[]"))).first()
    assert list(row) == ["2001-02-03 00:00:00", "2005-06-07 08:09:10", None]


LD = '<script type="application/ld+json">%s</script>'
REVIEWS = [
    ("<p>none</p>", ("ABSENT", None, None)),
    (LD % '{"@type":"Product","url":"https://x.example/products/cool-shirt","aggregateRating":{"reviewCount":"218","ratingValue":4.5}}', ("PRESENT", 218, 4.5)),
    (LD % '{"@graph":[{"@type":"ProductGroup","aggregateRating":{"ratingCount":44}}]}', ("PRESENT", 44, None)),
    (LD % '{"@type":"Thing","aggregateRating":{"reviewCount":7,"itemReviewed":{"@type":"Product","offers":[{"url":"/products/cool-shirt/"}]}}}', ("PRESENT", 7, None)),
    (LD % '{"@type":"Organization","aggregateRating":{"reviewCount":7}}', ("ABSENT", None, None)),
    (LD % '{"@type":"Product","aggregateRating":{"reviewCount":"many"}}', ("PRESENT_BUT_INVALID", None, None)),
    (LD % '{"@type":"Product","aggregateRating":{"reviewCount":-1}}', ("PRESENT_BUT_INVALID", None, None)),
    (LD % "{broken", ("AMBIGUOUS", None, None)),
    (LD % '[{"@type":"Product","aggregateRating":{"reviewCount":1}},{"@type":"Product","aggregateRating":{"reviewCount":2}}]', ("AMBIGUOUS", None, None)),
    (None, ("ABSENT", None, None)),
]


def test_reviews(spark):
    assert [reviews.observation(h, "cool-shirt") for h, _ in REVIEWS] == [w for _, w in REVIEWS]
    rows = spark.createDataFrame([(i, h, "cool-shirt") for i, (h, _) in enumerate(REVIEWS)], "i int, html string, handle string")
    got = {r.i: tuple(r.review) for r in reviews.observed_reviews(rows).collect()}
    assert [got[i] for i in range(len(REVIEWS))] == [w for _, w in REVIEWS]


def test_exports(spark, tmp_path):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "user_id int, name string")
    uses = spark.createDataFrame([(1, "x"), (1, "w")], "user_id int, store string")
    got = {r.user_id: json.loads(r.document) for r in sinks.personal_documents(users, uses=uses).collect()}
    assert got[1]["uses"] == [{"store": "w"}, {"store": "x"}] and got[2]["uses"] == []
    sinks.write_csv(users, ["user_id", "name"], str(tmp_path / "c"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "c/lines")).collect()) == ["1,a", "2,b"]


def test_promo(spark):
    assert list(spark.range(1).select(ledger.discounted(F.lit(1900), F.lit(33), F.lit(None).cast("int")), ledger.discounted(F.lit(1900), F.lit(None).cast("int"), F.lit(5000))).first()) == [1273, 0]


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(SimpleNamespace(conf={}, sparkContext=context))


def test_no_window_holds_a_whole_store(spark, small):
    """Ranks are counted by blocks, ends of stores are joined; both came from windows over a store (and year)."""
    import re

    from pyspark.sql import functions as F

    from driftline.operators import signals as S
    from driftline.plans import derived as D
    from driftline.plans import signals as plans

    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    ranks = text(D.catalog(spark, small).select("store_id", "bestseller_rank"))
    wide = [line for line in ranks.splitlines() if "row_number()" in line and "Window" in line]
    assert wide and all(re.search(r"\[store_id#\d+, year#\d+L?, units#\d+L?, __block#\d+L?\]", line) for line in wide)
    assert all("Window" not in text(df) for df in plans._presence(spark, small)[:2])

    rows = spark.range(400).select((F.col("id") % 2).alias("store_id"), F.lit(1998).alias("year"), (F.col("id") * 1000).alias("part"), (F.col("id") % 3).alias("units"))
    got = D._ranked(rows).collect()
    for store in (0, 1):
        mine = sorted((r for r in got if r.store_id == store), key=lambda r: (-r.units, r.part))
        assert [r.bestseller_rank for r in mine] == list(range(200))

    seen = spark.createDataFrame([(1, "a", c, c, r) for c, r in enumerate((5, None, 4, 4, 2))], "store_id int, external_id string, crawl_id int, captured_at int, rank long")
    said = S.rank_signals(seen)
    assert text(said).count("Window ") == 1
    r = said.first()
    assert (r.trajectory, r.current_rank, r.previous_rank, r.observations, r.crawls, r.momentum) == ([5, 4, 4, 2], 2, 4, 4, 4, "IMPROVING")
