"""The catalog landing zone: fetched JSON pages as files, one line each.

A line has ``domain``, ``crawl_id``, ``page`` (from 1), ``http_status``, ``body``
(the page's JSON or whatever came) and ``error`` (null if the fetch worked).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.functions.fingerprint import footprint
from driftline.functions.money import to_cents
from driftline.functions.text import normalized_tags

LANDING = "domain string, crawl_id string, page int, http_status int, body string, error string"
VARIANT = "struct<id:string,title:string,sku:string,price:string,compare_at_price:string,available:boolean,position:int>"
PRODUCT = f"struct<id:string,handle:string,title:string,vendor:string,product_type:string,tags:string,created_at:string,published_at:string,updated_at:string,variants:array<{VARIANT}>>"
PAGE_SIZE, MAX_PAGES = 250, 60
# What a challenge page shows, any case.
CHALLENGE = r"(?i)cf-browser-verification|Just a moment\.\.\.|Attention Required! \| Cloudflare|__cf_chl_"


def first_page_failure(status: Column, body: Column, error: Column) -> Column:
    """Why a catalog can't be read: blocked, not_found or error; null if it can."""
    challenged = F.substring(F.coalesce(body, F.lit("")), 1, 2000).rlike(CHALLENGE) | F.coalesce(error, F.lit("")).contains("bot-challenge")
    readable = F.get_json_object(body, "$.products").isNotNull()
    return (
        F.when(status.isin(401, 403), "blocked")
        .when(status == 404, "not_found")
        .when(challenged, "blocked")
        .when(status.between(200, 299) & ~F.coalesce(readable, F.lit(False)), "not_found")
        .when(error.isNotNull() | status.isNull() | ~status.between(200, 299), "error")
    )


def page_failure(status: Column) -> Column:
    """ok, blocked, not_found or error of a product page."""
    return F.when(status.between(200, 299), "ok").when(status.isin(401, 403), "blocked").when(status == 404, "not_found").otherwise("error")


def crawl_pages(landing: DataFrame, page_size: int = PAGE_SIZE, max_pages: int = MAX_PAGES) -> DataFrame:
    """The pages of each crawl up to its end, with their raw products.

    A crawl ends before an empty page, before one that begins with the same
    product as the page before, before a failed one, and after a short one.
    """
    bad = first_page_failure(F.col("http_status"), F.col("body"), F.col("error"))
    rows = landing.withColumn("products", F.from_json(F.col("body"), f"products array<{PRODUCT}>")["products"]).withColumn("failure", bad)
    size, first = F.coalesce(F.size("products"), F.lit(0)), F.get("products", F.lit(0))["id"]
    w = Window.partitionBy("domain", "crawl_id").orderBy("page")
    stop = F.col("failure").isNotNull() | (size <= 0) | first.eqNullSafe(F.lag(first).over(w))
    rows = rows.withColumn("__stop", stop).withColumn("__short", size < page_size)
    rows = rows.withColumn("__over", F.coalesce(F.max((F.col("__stop") | F.col("__short")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.where((F.col("__over") == 0) & (F.col("page") <= max_pages)).drop("__over")


def crawl_headers(landing: DataFrame, page_size: int = PAGE_SIZE, max_pages: int = MAX_PAGES) -> DataFrame:
    """Per crawl: status, pages_fetched, http_errors and partial. Reaching the last page that is allowed counts as an error, for there may be more."""
    pages = crawl_pages(landing, page_size, max_pages)
    g = pages.groupBy("domain", "crawl_id").agg(
        F.count_if(~F.col("__stop")).alias("pages_fetched"),
        F.count_if((F.col("page") > 1) & F.col("failure").isNotNull()).alias("later_failures"),
        F.max_by("failure", -F.col("page")).alias("failure"),
        F.min(F.when(F.col("page") == 1, F.coalesce("failure", F.lit("")))).alias("first_failure"),
        F.count_if((F.col("page") == max_pages) & ~F.col("__stop") & ~F.col("__short")).alias("capped"),
    )
    errors = F.col("later_failures") + F.col("capped")
    return g.select("domain", "crawl_id", F.when(F.coalesce("first_failure", F.lit("error")) == "", "ok").otherwise(F.coalesce("first_failure", F.lit("error"))).alias("status"), "pages_fetched", errors.alias("http_errors"), (errors > 0).alias("partial"))


def _variants(raw: Column) -> Column:
    made = F.transform(raw, lambda v: F.struct(v["id"].alias("external_id"), v["title"].alias("title"), v["sku"].alias("sku"), to_cents(v["price"]).alias("price_cents"), to_cents(v["compare_at_price"]).alias("compare_at_cents"), F.coalesce(v["available"], F.lit(False)).alias("available")))
    return F.array_sort(F.filter(made, lambda v: v["price_cents"].isNotNull() & v["external_id"].isNotNull()))


def variant_rollup(variants: Column) -> dict[str, Column]:
    """What a product shows of its variants, without exploding them."""
    prices = F.transform(variants, lambda v: v["price_cents"])
    before = F.filter(F.transform(variants, lambda v: v["compare_at_cents"]), lambda x: x > 0)
    return {
        "price_min_cents": F.array_min(prices),
        "price_max_cents": F.array_max(prices),
        "compare_at_max_cents": F.array_max(before),
        "variant_count": F.size(variants).cast("long"),
        "available_variants": F.size(F.filter(variants, lambda v: v["available"])).cast("long"),
    }


def normalized_products(pages: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """A row per product that has a priced variant; ``ranks``: domain, external_id, bestseller_rank."""
    each = pages.where(~F.col("__stop")).select("domain", "crawl_id", F.explode("products").alias("p"))
    tags = F.col("p.tags")  # a comma-separated text or a JSON list
    listed = F.when(F.ltrim(tags).startswith("["), F.array_join(F.from_json(tags, "array<string>"), ",")).otherwise(tags)
    rows = each.select(
        "domain",
        "crawl_id",
        F.col("p.id").alias("external_id"),
        F.col("p.handle").alias("handle"),
        F.coalesce("p.title", F.lit("")).alias("title"),
        F.nullif(F.col("p.vendor"), F.lit("")).alias("vendor"),
        F.nullif(F.col("p.product_type"), F.lit("")).alias("product_type"),
        normalized_tags(listed).alias("tags"),
        F.try_to_timestamp("p.created_at").alias("source_created_at"),
        F.try_to_timestamp("p.published_at").alias("published_at"),
        _variants(F.col("p.variants")).alias("variants"),
    )
    rows = rows.where(F.size("variants") > 0).withColumns(variant_rollup(F.col("variants"))).dropDuplicates(["domain", "crawl_id", "external_id"])
    return rows if ranks is None else rows.join(ranks, ["domain", "external_id"], "left")


def bestseller_ranks(landing: DataFrame) -> DataFrame:
    """domain, external_id, bestseller_rank (from 0) out of one page in selling order; a page that can't be read gives none."""
    products = F.from_json(F.col("body"), f"products array<{PRODUCT}>")["products"]
    return landing.where(F.col("http_status").between(200, 299)).select("domain", F.posexplode(products).alias("bestseller_rank", "p")).select("domain", F.col("p.id").alias("external_id"), "bestseller_rank")


def collection_handles(landing: DataFrame, max_pages: int = 20) -> DataFrame:
    """domain, handles (sorted) and complete: whether no page failed and an end was seen."""
    found = F.from_json(F.col("body"), "collections array<struct<handle string>>")["collections"]
    ok = F.col("http_status").between(200, 299) & found.isNotNull()
    rows = landing.where(F.col("page") <= max_pages).select("domain", "page", ok.alias("ok"), F.when(ok, F.transform(found, lambda c: c["handle"])).otherwise(F.array().cast("array<string>")).alias("h"))
    g = rows.groupBy("domain").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("h")))).alias("handles"), F.bool_and("ok").alias("all_ok"), F.max("page").alias("pages"))
    return g.select("domain", "handles", (F.col("all_ok") & (F.col("pages") < max_pages)).alias("complete"))


def probe(landing: DataFrame) -> DataFrame:
    """Of first pages: products and the least and greatest variant price."""
    products = F.from_json(F.col("body"), f"products array<{PRODUCT}>")["products"]
    prices = F.flatten(F.transform(products, lambda p: F.transform(p["variants"], lambda v: to_cents(v["price"]))))
    return landing.where(F.col("page") == 1).select("domain", F.size(products).alias("products"), F.array_min(prices).alias("min_cents"), F.array_max(prices).alias("max_cents"))


def currency(html: Column) -> Column:
    return F.get_json_object(footprint(html, "currency"), "$.active")
