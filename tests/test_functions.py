import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftline.config import BASE_SCORES
from driftline.functions import fingerprint, money, scoring, text, time


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    ("raw", "cents"),
    [("79.00", 7900), ("1,299.00", 129900), ("79", 7900), ("$ 5.5", 550), ("1.2.3", 120), ("", None), ("-", None), ("abc", None), (None, None), ("-3.5", -350), (".5", 50)],
)
def test_to_cents(spark, raw, cents):
    assert one(spark, money.to_cents(F.lit(raw).cast("string"))) == [cents]


def test_halves_round_up(spark):
    assert one(spark, money.half_up(F.lit(-2.5)), money.half_up(F.lit(2.5))) == [-2, 3]


def test_money_texts(spark):
    assert one(spark, money.format_cents(F.lit(123456), F.lit("USD")), money.format_cents(F.lit(-5), F.lit("EUR")), money.format_cents(F.lit(100), F.lit("XYZ"))) == ["$1,234.56", "-€0.05", "XYZ\u00a01.00"]


# kind, magnitude, rank, price, rarity, other stores, score
SCORES = [
    ("PRICE_DROP", abs((5900 - 7900) / 7900) / 0.5, 2, 5900, 1.4, None, 83),
    ("PRICE_DROP", abs((5900 - 7900) / 7900) / 0.5, 2, 5900, 1.4, 5, 93),
    ("PRODUCT_SOLD_OUT", 0.8, 2, 7900, 1.0, None, 84),
    ("PRODUCT_SOLD_OUT", 0.8, None, 7900, 1.0, None, 55),
    ("PRODUCT_ADDED", 0.6, None, 7900, 1.4, None, 49),
    ("PRODUCT_REMOVED", 0.6, 2, 7900, 1.4, None, 75),
    ("PIXEL_ADDED", 0.85, None, None, 1.0, None, 56),
    ("APP_ADDED", 0.7, None, None, 1.0, None, 47),
    ("COLLECTION_ADDED", 0.6, None, None, 1.0, None, 24),
    ("PAYMENT_PROVIDER_ADDED", 0.6, None, None, 1.0, None, 38),
    ("THEME_CHANGED", 0.9, None, None, 1.0, None, 55),
    ("AD_DETECTED", 0.5, None, None, 1.0, None, 39),
    ("AD_REMOVED", 0.5, None, None, 1.0, None, 22),
    ("AD_CHANGED", 0.5, None, None, 1.0, None, 30),
    ("PRODUCT_AD_MATCHED", 0.5, None, None, 1.0, None, 18),
    ("PRODUCT_RESTORED", 0.5, None, 7900, 1.0, None, 26),
    ("PRODUCT_RESTOCKED", 0.6, None, 7900, 1.0, None, 38),
]


@pytest.mark.parametrize("case", SCORES, ids=[f"{c[0]}-{c[-1]}" for c in SCORES])
def test_scores(spark, case):
    kind, magnitude, rank, price, rarity, stores, want = case
    rel = scoring.relevance(F.lit(rank).cast("int"), F.lit(price).cast("int"))
    got = scoring.significance(F.lit(float(BASE_SCORES[kind])), F.lit(magnitude), rel, F.lit(rarity), scoring.cross_store(F.lit(stores).cast("int")))
    assert one(spark, got) == [want]


def test_rarity(spark):
    r = lambda kind, *history: scoring.rarity(F.lit(kind), *[F.lit(x).cast("int") for x in history])
    assert one(spark, r("PRICE_DROP", 2, 3, 30), r("PRICE_DROP", 60, 3, 30), r("PRICE_DROP", 200, 3, 30), r("PRICE_DROP", 2, 3, 4), r("PRODUCT_REMOVED", 99, 3, 30), r("THEME_CHANGED", 2, 3, 30), r("PRICE_DROP", None, None, None)) == [1.4, 0.9, 0.6, 1.0, 1.4, 1.0, 1.0]


def test_dedupe_key(spark):
    assert one(spark, scoring.dedupe_key(F.lit("store_1"), F.lit("p1"), F.lit("PRICE_DROP"), F.lit("p1:5900"))) == ["1efd1b94e8e6a62c3c3e7855de810175554e97e1"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.Shop.example/products/a/?x=1#y", "shop.example/products/a"),
        ("http://shop.example", "shop.example/"),
        ("https://shop.example/a%20b", "shop.example/a b"),
        ("https://shop.example/a+b", "shop.example/a+b"),
        ("https://shop.example/100%", "shop.example/100%"),
        ("ftp://shop.example/a", None),
        ("not a url", None),
        (None, None),
    ],
)
def test_normalized_url(spark, url, want):
    assert one(spark, text.normalized_url(F.lit(url).cast("string"))) == [want]


def test_csv_fields(spark):
    values = ["plain", "=1+1", 'say "hi"', "a,b", None]
    assert one(spark, *[text.csv_field(F.lit(v).cast("string")) for v in values]) == ["plain", "\"'=1+1\"", '"say ""hi"""', '"a,b"', ""]


def test_client_ip(spark):
    ip = lambda h, n: text.client_ip(F.lit(h).cast("string"), n)
    assert one(spark, ip("1.2.3.4, 5.6.7.8", 1), ip("1.2.3.4, 5.6.7.8", 2), ip("1.2.3.4", 2), ip(None, 1), ip("x, 1.2.3.4", 1), ip("1.2.3.4", 0), ip("::1", 1)) == ["5.6.7.8", "1.2.3.4", "unknown", "unknown", "1.2.3.4", "unknown", "::1"]


def test_public_addresses(spark):
    ips = ["8.8.8.8", "10.1.1.1", "172.20.0.1", "192.168.0.1", "169.254.1.1", "224.0.0.1", "300.1.1.1", None]
    assert one(spark, *[text.is_public_unicast(F.lit(i).cast("string")) for i in ips]) == [True] + [False] * 7


def test_email_leaves(spark):
    has = lambda j: text.holds_email_leaf(F.lit(j))
    assert one(spark, has('{"a":{"b":["x@y.de"]}}'), has('{"x@y.de":1}'), has('{"a":"mail x@y.de now"}')) == [True, False, False]


def test_promo_codes(spark):
    assert one(spark, text.promo_code(F.lit(" abc-def 1")), text.is_vanity_code(F.lit("LAUNCH50")), text.is_vanity_code(F.lit("AB"))) == ["ABCDEF1", True, False]


def test_times(spark):
    now = F.lit("2026-08-08 12:00:00").cast("timestamp_ntz")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, time.relative_time(at("2026-08-08 10:00:00"), now), time.relative_time(at("2026-08-11 12:00:00"), now), time.relative_time(F.lit(None).cast("timestamp_ntz"), now), time.relative_time(at("2026-08-08 11:59:30"), now), time.relative_time(at("2026-08-08 11:59:00"), now)) == ["2 hours ago", "in 3 days", "never", "just now", "1 minute ago"]
    assert one(spark, time.days_remaining(at("2026-08-09 12:00:01"), now), time.days_remaining(at("2026-08-01 00:00:00"), now)) == [2, 0]
    assert one(spark, time.next_after_success(now, F.lit("DISABLED")), time.next_after_failure(now, F.lit(3)), time.next_after_failure(now, F.lit(9))) == [None, dt.datetime(2026, 8, 8, 16), dt.datetime(2026, 8, 10, 12)]


HTML = """<html><head><meta name="theme-version" content="15.2.0"><script>Shopify.theme = {"name":"Dawn","id":1};</script>
<script src="https://static.klaviyo.com/x.js"></script><script>fbq('init', '1234567'); gtag('config','G-AB12')</script></head><body data-northbeam="1">PayPal, Shop Pay</body></html>"""


def test_fingerprint(spark):
    tech = spark.range(1).select(fingerprint.technology(F.lit(HTML)).alias("t")).first().t
    assert tech.theme_name == "Dawn" and tech.theme_version == "15.2.0" and tech.email_platform == "klaviyo"
    assert tech.apps == ["klaviyo", "northbeam"] and tech.payment_providers == ["paypal", "shop_pay"]
    assert tech.pixels == {"facebook": "1234567", "ga4": "G-AB12"}


def test_fingerprint_of_nothing(spark):
    tech = spark.range(1).select(fingerprint.technology(F.lit("<html></html>")).alias("t")).first().t
    assert tech.theme_name is None and tech.theme_version is None and tech.apps == [] and tech.pixels == {} and tech.email_platform is None


def test_theme_versions(spark):
    pages = [
        ('<meta name="theme-version" content="15.2.0">', "15.2.0"),
        ("<META content='1.2' name='Theme Version'>", "1.2"),
        ("<meta name=theme_version content=3.4>", "3.4"),
        ('<meta name="theme-version" content="latest"><meta name="x-theme-version" content="2.0.1">', "2.0.1"),
        ('<meta name="version" content="9.9"><script>theme-version: "4.5.6"</script>', "4.5.6"),
        ('<meta name="generator" content="9.9">', None),
        (None, None),
    ]
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "i int, html string")
    got = {r.i: r.v for r in rows.select("i", fingerprint.theme_version(F.col("html")).alias("v")).collect()}
    assert [got[i] for i in range(len(pages))] == [v for _, v in pages]


PUBLIC = ["8.8.8.8", "93.184.216.34", "2606:4700:4700::1111", "2001:4860:4860::8888", "::ffff:8.8.8.8", "::ffff:808:808", "2A00:1450::1", "1:2:3:4:5:6:7:8", "1::", "1:2:3:4:5:6:7::"]
CLOSED = ["::", "::1", "fe80::1", "febf::1", "fc00::1", "fd12::", "ff02::1", "::ffff:10.0.0.1", "::ffff:169.254.169.254", "::ffff:a00:1", "2002:808:808::", "2001::1", "2001:db8::1", "64:ff9b::808:808", "100::1", "10.0.0.1", "255.255.255.255", "100.64.0.1"]
NOT_ADDRESSES = ["", ":::", "1::2::3", "1:2:3", "12345::", "g::1", "::ffff:8.8.8", "::ffff:8.8.8.256", "1:2:3:4:5:6:7:8:9", "8.8.8", "8.8.8.8.8", "256.1.1.1", "localhost", None]


def test_public_addresses_of_both_families(spark):
    rows = spark.createDataFrame([(a,) for a in PUBLIC + CLOSED + NOT_ADDRESSES], "a string")
    got = {r.a: r.p for r in rows.select("a", text.is_public_unicast(F.col("a")).alias("p")).collect()}
    assert [a for a in PUBLIC if not got[a]] == [] and [a for a in CLOSED + NOT_ADDRESSES if got[a]] == []


def test_a_group_of_five_digits_is_no_public_address(spark):
    """Where the number of a user has five digits, client_addresses and its SQL part: such a text is no address."""
    assert one(spark, *[text.is_public_unicast(F.lit(a)) for a in ("2606:4700::FFFF", "2606:4700::10000")]) == [True, False]


def test_addresses_order_as_numbers_do(spark):
    import ipaddress

    known = PUBLIC + CLOSED
    rows = spark.createDataFrame([(a,) for a in known], "a string")
    for r in rows.select("a", text.address_hex(F.col("a")).alias("h")).collect():
        address = ipaddress.ip_address(r.a)
        assert int(r.h, 16) == int(address) + (0xFFFF << 32 if address.version == 4 else 0)


def test_json_at_any_depth(spark):
    change = lambda json, **how: one(spark, text.changed_json(F.lit(json).cast("string"), **how))[0]
    assert change('{"a": [1, {"b": "x", "c": [{"b": 2}]}], "b": {"b": 1}}', anywhere=("b",)) == '{"a":[1,{"c":[{}]}]}'
    assert change('{"a": {"b": {"c": 1, "d": "ü"}}}', remove=("a.b.c", "a.x.y")) == '{"a":{"b":{"d":"ü"}}}'
    assert change('{"a": [{"b": 1}, {"c": 2}, 3]}', remove=("a.*.b",), put={"a.*.e": None, "x.y": "1", "f": '{"g": [1]}'}) == '{"a":[{"e":null},{"c":2,"e":null},3],"f":{"g":[1]}}'
    assert change("[1, 2]", remove=("a",)) == "[1,2]" and change("broken {") is None and change(None) is None
