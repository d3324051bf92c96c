import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from driftline.operators import ad_diff, entity_diff, product_diff
from driftline.operators.events import appended, capped

AT = dt.datetime(2026, 8, 8, 12)
CURRENT = "store_id string, external_id string, title string, handle string, price_min_cents long, price_max_cents long, compare_at_max_cents long, variant_count long, available_variants long, bestseller_rank long"
PREVIOUS = CURRENT + ", status string, missing_streak int, missing_since timestamp_ntz, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"
SEEN = dt.datetime(2026, 6, 1)


def test_hashes_of_bags(spark, small):
    """Order and partitions don't count, repetitions do; the sums are combined before they are shuffled, without Python."""
    from driftline.operators.state import content_hashes
    from driftline.plans import QUERIES

    frame = lambda *texts: spark.createDataFrame([("k", t) for t in texts], "k string, t string")
    got = lambda df: content_hashes(df, ["k"], hash=F.col("t")).first().hash
    parts = [int(hashlib.sha256(t).hexdigest()[a : a + 15], 16) for a in (0, 15) for t in (b"x", b"y")]
    assert got(frame("x", "y", None)) == got(frame("y", None, "x").repartition(3)) == f"2-{parts[0] + parts[1]}-{parts[2] + parts[3]}"
    assert len({got(frame("x", "y")), got(frame("x", "y", "y")), got(frame("x")), got(frame(None))}) == 4
    assert content_hashes(frame("x").limit(0), ["k"], hash=F.col("t")).count() == 0
    plan = QUERIES["content_hashes"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Python" not in plan and "Arrow" not in plan


def test_hashes_of_lists(spark, small):
    """The SHA-256 of all texts in order, however they fall into blocks; the query had become sums of hashes of rows."""
    from driftline.operators.state import list_hashes
    from driftline.plans import QUERIES

    rows = spark.createDataFrame([("k", str(i), f"t{i}") for i in range(300)] + [("l", "a", "x")], "k string, id string, t string").repartition(5)
    want = lambda texts: hashlib.sha256(f"[{','.join(texts)}]".encode()).hexdigest()
    for size in (1, 2, 9):
        got = {r.k: r.hash for r in list_hashes(rows, ["k"], F.substring("id", 1, size), F.col("id"), "t").collect()}
        assert got == {"k": want(f"t{i}" for i in sorted(map(str, range(300)))), "l": want("x")}
    assert all(len(h) == 64 for r in QUERIES["content_hashes"](spark, small).collect() for h in (r.catalog_hash, r.rank_hash))


def test_unchanged_stores_are_not_read(spark, small):
    from driftline.plans import changes

    before = spark.createDataFrame([(1, "a", "r"), (2, "b", "r"), (3, None, "r"), (5, "c", "r")], "store_id int, catalog_hash string, rank_hash string")
    now = spark.createDataFrame([(1, "a", "r"), (2, "b", "s"), (3, None, "r"), (4, "x", "r")], "store_id int, catalog_hash string, rank_hash string")
    assert sorted(r.store_id for r in product_diff.changed_stores(before, now).collect()) == [2, 3, 4]

    events = changes.short_circuit(spark, small)
    assert {r.store_id for r in events.select("store_id").distinct().collect()} == {3}  # at this size the catalog of 1 shrinks too much
    plan = events._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.count("dynamicpruning") >= 2  # catalog and state


def test_history_holds_a_row_for_each_change(spark):
    from driftline.operators import history

    at = lambda day: F.lit(f"2026-01-0{day} 00:00:00").cast("timestamp_ntz")
    rows = lambda *r: spark.createDataFrame([(k, v, c) for k, v, c in r], "k string, v int, changed boolean")
    told = history.begun(rows(("a", 1, True), ("b", 1, True)).drop("changed"), at(1))
    told, ended = history.advanced(told, rows(("a", 1, False), ("b", 9, None)), "changed", ["k"], at(2))
    assert ended.count() == 0 and told.closed.count() == 0 and told.open.count() == 2
    told, ended = history.advanced(told, rows(("a", 2, True), ("c", 5, True)), "changed", ["k"], at(3))
    assert [(r.k, r.v) for r in ended.collect()] == [("a", 1)]
    told, ended = history.advanced(told, rows(("a", 3, True)), "changed", ["k"], at(3))  # at the time at which the interval began
    assert ended.count() == 0
    told, _ = history.advanced(told, rows(("a", 4, True)).limit(0), "changed", ["k"], at(4))
    state = lambda day: {(r.k, r.v) for r in history.as_of(told, at(day)).collect()}
    assert state(1) == state(2) == {("a", 1), ("b", 1)}
    assert state(3) == state(4) == {("a", 3), ("b", 1), ("c", 5)}


def test_repeated_keys_count_by_an_order(spark):
    from driftline.operators.state import insert_missing, last_of, merge

    rows = spark.createDataFrame([("a", 1, "z"), ("a", 2, "y"), ("a", 2, "x"), ("b", None, None)], "k string, n int, t string")
    for some in (rows, rows.repartition(3), rows.orderBy(F.desc("t"))):
        assert sorted(map(tuple, last_of(some, ["k"], ("n",)).collect())) == [("a", 2, "y"), ("b", None, None)]
        assert sorted(map(tuple, last_of(some, ["k"], ("t",)).collect()))[0] == ("a", 1, "z")
    state = spark.createDataFrame([("a", 5, "old")], "k string, n int, t string")
    assert [tuple(r) for r in merge(state, rows.where("k = 'a'"), ["k"], newest="n").collect()] == [("a", 5, "old")]
    assert insert_missing(state, rows, ["k"]).count() == 2


def test_of_products_with_one_page_the_last_counts(spark):
    ads = spark.createDataFrame([("s", "https://shop.example/products/w")], "store_id string, destination_url string")
    stores = spark.createDataFrame([("s", "shop.example")], "store_id string, domain string")
    products = spark.createDataFrame([("s", "9", "w", 0), ("s", "10", "w", 1)], "store_id string, external_id string, handle string, position int")
    assert ad_diff.match_products(ads, products, stores).first().matched_product_id == "10"
    assert ad_diff.match_products(ads, products.drop("position"), stores).first().matched_product_id == "9"


def now_():
    return F.lit("2026-08-08 12:00:00").cast("timestamp_ntz")


def product(key="p1", **over):
    row = dict(store_id="s", external_id=key, title="Widget", handle="widget", price_min_cents=7900, price_max_cents=7900, compare_at_max_cents=None, variant_count=3, available_variants=3, bestseller_rank=2)
    return row | over


def known(key="p1", **over):
    return product(key) | dict(status="ACTIVE", missing_streak=0, missing_since=None, first_seen_at=SEEN, last_seen_at=SEEN) | over


def frames(spark, now, before, partial=False, ranks=True, baselined=True):
    stores = spark.createDataFrame([("s", "USD", baselined, 2, 3, 30)], "store_id string, currency string, baselined boolean, price_changes int, products_added int, crawls int")
    headers = spark.createDataFrame([("s", ranks, partial)], "store_id string, has_rank_data boolean, partial boolean")
    return stores, headers, spark.createDataFrame([tuple(p.values()) for p in now], CURRENT), spark.createDataFrame([tuple(p.values()) for p in before], PREVIOUS)


def events(spark, now, before, **how):
    rows = product_diff.product_events(*frames(spark, now, before, **how), now_()).collect()
    return {(r.entity_key, r.event_type): r for r in rows}


def kinds(*args, **how):
    return sorted(k[1] for k in events(*args, **how))


CASES = [
    ("nothing", product(), known(), []),
    ("added", product(), None, ["PRODUCT_ADDED"]),
    ("drop", product(price_min_cents=5900), known(), ["PRICE_DROP"]),
    ("rise", product(price_min_cents=9900), known(), ["PRICE_INCREASE"]),
    ("below both thresholds", product(price_min_cents=7950), known(), []),
    ("small share, many cents", product(price_min_cents=100_150), known(price_min_cents=100_000), ["PRICE_INCREASE"]),
    ("few cents, large share", product(price_min_cents=150), known(price_min_cents=100), ["PRICE_INCREASE"]),
    ("from nothing", product(price_min_cents=100), known(price_min_cents=0), []),
    ("sale", product(price_min_cents=5900, compare_at_max_cents=7900), known(), ["SALE_STARTED"]),
    ("sale over", product(), known(price_min_cents=5900, compare_at_max_cents=7900), ["SALE_ENDED"]),
    ("sold out", product(available_variants=0), known(), ["PRODUCT_SOLD_OUT"]),
    ("restocked", product(), known(available_variants=0), ["PRODUCT_RESTOCKED"]),
    ("a variant less", product(available_variants=2), known(), ["VARIANT_SOLD_OUT"]),
    ("a variant less of one", product(available_variants=1, variant_count=1), known(available_variants=2), []),
    ("entered", product(), known(bestseller_rank=None), ["BESTSELLER_ENTERED"]),
    ("dropped", product(bestseller_rank=None), known(), ["BESTSELLER_DROPPED"]),
    ("climbed", product(bestseller_rank=2), known(bestseller_rank=5), ["BESTSELLER_CLIMBED"]),
    ("climbed too little", product(bestseller_rank=2), known(bestseller_rank=4), []),
    ("climbed too low", product(bestseller_rank=60), known(bestseller_rank=90), []),
    ("restored from missing", product(), known(status="MISSING", available_variants=0, bestseller_rank=None, missing_streak=1), ["BESTSELLER_ENTERED", "PRODUCT_RESTOCKED", "PRODUCT_RESTORED"]),
    ("missing once", None, known(), []),
    ("missing twice", None, known(missing_streak=1), ["PRODUCT_REMOVED"]),
    ("removed long ago", None, known(status="REMOVED", missing_streak=5), []),
]


@pytest.mark.parametrize(("now", "before", "want"), [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_product_events(spark, now, before, want):
    assert kinds(spark, [now] if now else [], [before] if before else []) == want


def test_texts_and_scores(spark):
    got = events(spark, [product(price_min_cents=5900)], [known()])["p1", "PRICE_DROP"]
    assert got.headline == "Widget $79.00 → $59.00 (-25%)" and got.significance == 83 and got.old_value == '{"priceCents":7900}' and got.occurred_at == dt.datetime(2026, 8, 8, 12)


def test_a_partial_crawl_removes_nothing(spark):
    assert kinds(spark, [], [known(missing_streak=4)], partial=True) == []
    state = product_diff.next_state(*frames(spark, [], [known(missing_streak=4)], partial=True), now_()).first()
    assert state.status == "ACTIVE" and state.missing_streak == 4 and not state.state_changed


def test_without_ranks_there_are_no_rank_events(spark):
    assert kinds(spark, [product(bestseller_rank=None)], [known()], ranks=False) == []


def test_a_collapsed_catalog_is_not_compared(spark):
    before = [known(f"p{i}") for i in range(10)]
    now = [product(f"p{i}", price_min_cents=100) for i in range(5)]
    assert kinds(spark, now, before) == []
    state = product_diff.next_state(*frames(spark, now, before), now_())
    assert state.where("price_min_cents = 7900 AND status = 'ACTIVE'").count() == 10
    assert len(events(spark, now + [product("p5", price_min_cents=100)], before)) == 6  # 0.6 is enough


def test_the_removal_machine(spark):
    state = product_diff.next_state(*frames(spark, [], [known()]), now_())
    first = state.first()
    assert (first.status, first.missing_streak, first.available_variants, first.bestseller_rank, first.last_seen_at) == ("MISSING", 1, 0, None, SEEN)
    assert first.missing_since == dt.datetime(2026, 8, 8, 12)
    stores, headers, current, _ = frames(spark, [], [])
    second = product_diff.next_state(stores, headers, current, state.drop("state_changed"), F.lit("2026-08-09").cast("timestamp_ntz")).first()
    assert second.status == "REMOVED" and second.missing_since == first.missing_since and second.state_changed


def test_a_baseline_tells_no_changes(spark):
    stores, headers, current, previous = frames(spark, [product()], [], baselined=False)
    assert product_diff.product_events(stores, headers, current, previous, now_()).count() == 0
    rows = product_diff.baseline_events(stores, current.withColumn("source_created_at", F.lit("2026-01-01").cast("timestamp_ntz")), now_()).collect()
    assert [(r.event_type, r.significance, r.backfilled) for r in sorted(rows, key=lambda r: r.seq)] == [("STORE_BASELINED", 5, False), ("PRODUCT_ADDED", 20, True)]


def test_cap_keeps_the_most_significant(spark):
    rows = spark.createDataFrame([("s", i % 50, i, str(i), "K") for i in range(300)], "store_id string, significance int, seq int, entity_key string, event_type string")
    kept = capped(rows, 200).collect()
    assert len(kept) == 200 and {r.suppressed for r in kept} == {100} and min(r.significance for r in kept) == 16


def test_a_repeated_delivery_adds_nothing(spark):
    new = product_diff.product_events(*frames(spark, [product(price_min_cents=5900)], [known()]), now_())
    empty = new.limit(0)
    log = appended(empty, new.union(new))
    assert log.count() == 1 and appended(log, new).count() == 0


def test_cross_store_moves_weigh_more(spark):
    others = spark.createDataFrame([("s", "p1", 5)], "store_id string, external_id string, cross_stores int")
    rows = product_diff.product_events(*frames(spark, [product(price_min_cents=5900)], [known()]), now_(), cross_stores=others).collect()
    assert rows[0].significance == 93


ENTITY = "store_id string, kind string, key string, meta string, status string, missing_streak int, missing_since timestamp_ntz, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"


def entity(spark, seen, before, kinds=("APP", "PIXEL", "PAYMENT_PROVIDER", "COLLECTION")):
    stores = spark.createDataFrame([("s", True)], "store_id string, baselined boolean")
    gate = spark.createDataFrame([("s", k) for k in kinds], "store_id string, kind string")
    observed = spark.createDataFrame([("s", *x) for x in seen], "store_id string, kind string, key string, meta string")
    previous = spark.createDataFrame([("s", k, key, '{"id":"1"}', status, streak, None, SEEN, SEEN) for k, key, status, streak in before], ENTITY)
    out = entity_diff.entity_events(observed, gate, previous, stores, now_()).collect()
    state = entity_diff.next_entities(observed, gate, previous, stores, now_()).collect()
    return {(r.entity_key, r.event_type): r for r in out}, {r.key: r for r in state}


def test_entities(spark):
    got, state = entity(
        spark,
        [("PIXEL", "facebook", '{"id":"9"}'), ("APP", "back", None), ("APP", "flapping", None)],
        [("APP", "back", "REMOVED", 2), ("APP", "flapping", "MISSING", 1), ("APP", "lost", "ACTIVE", 0), ("COLLECTION", "gone", "MISSING", 1)],
    )
    assert set(got) == {("pixel:facebook", "PIXEL_ADDED"), ("back", "APP_ADDED"), ("gone", "COLLECTION_REMOVED")}
    assert got["pixel:facebook", "PIXEL_ADDED"].headline == "Added facebook pixel — likely opening a new ad channel"
    assert got["pixel:facebook", "PIXEL_ADDED"].significance == 56
    assert state["lost"].status == "MISSING" and state["lost"].meta == '{"id":"1"}' and state["gone"].status == "REMOVED" and state["back"].status == "ACTIVE"


def test_kinds_that_were_not_fetched_stay(spark):
    got, state = entity(spark, [], [("APP", "a", "ACTIVE", 5)], kinds=("COLLECTION",))
    assert got == {} and state["a"].missing_streak == 5


AD = "store_id string, platform string, external_ad_id string, destination_url string, advertiser_external_id string, advertiser_name string, format string, source_metadata string, matched_product_id string, match_method string, match_confidence string"


def test_ads(spark):
    row = lambda ad, url="https://x.example/a", p=None: ("s", "GOOGLE", ad, url, "AR1", "Acme", "text", None, p, None, None)
    known_ads = [(*row("same"), "ACTIVE_EVIDENCE", 0, SEEN, SEEN), (*row("changed"), "ACTIVE_EVIDENCE", 0, SEEN, SEEN), (*row("old"), "HISTORICAL", 3, SEEN, SEEN), (*row("gone"), "ACTIVE_EVIDENCE", 1, SEEN, SEEN), (*row("missing"), "ACTIVE_EVIDENCE", 0, SEEN, SEEN)]
    previous = spark.createDataFrame(known_ads, AD + ", status string, missing_streak int, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz")
    observed = spark.createDataFrame([row("same"), row("changed", None), row("old"), row("new", p="p1")], AD)
    got = {(r.entity_key, r.event_type): r for r in ad_diff.ad_events(observed, previous, now_()).collect()}
    assert set(got) == {("google:changed", "AD_CHANGED"), ("google:old", "AD_DETECTED"), ("google:new", "AD_DETECTED"), ("google:new", "PRODUCT_AD_MATCHED"), ("google:gone", "AD_REMOVED")}
    state = {r.external_ad_id: r for r in ad_diff.next_ads(observed, previous, now_()).collect()}
    assert state["gone"].status == "HISTORICAL" and state["missing"].status == "ACTIVE_EVIDENCE" and state["missing"].missing_streak == 1 and state["old"].status == "ACTIVE_EVIDENCE"


def test_ads_find_their_products(spark):
    stores = spark.createDataFrame([("s", "shop.example")], "store_id string, domain string")
    products = spark.createDataFrame([("s", "p1", "cool-shirt"), ("s", "p2", "hat")], "store_id string, external_id string, handle string")
    ads = spark.createDataFrame([("s", "a", "http://www.shop.example/products/cool-shirt/?utm=1"), ("s", "b", "https://shop.example/"), ("s", "c", None)], "store_id string, external_ad_id string, destination_url string")
    got = {r.external_ad_id: (r.matched_product_id, r.match_confidence) for r in ad_diff.match_products(ads, products, stores).collect()}
    assert got == {"a": ("p1", "HIGH"), "b": (None, None), "c": (None, None)}


@pytest.mark.parametrize(("name", "most"), [("ad_events", 6), ("entity_events", 6), ("entity_state", 6), ("persistence", 6), ("growth_report", 10), ("diff_events", 6)])
def test_tables_are_scanned_few_times(spark, small, name, most):
    from driftline.plans import QUERIES

    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= most
