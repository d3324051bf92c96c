"""Review counts in the JSON-LD of product pages.

JSON-LD nests without bound, which no JSON path follows, so that a small Arrow
function walks it; everything around it is columns.
"""

from __future__ import annotations

import json
import math
import re
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = re.compile(r"""<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>""", re.I | re.S)
PRODUCTS = {"Product", "ProductGroup"}
SCHEMA = T.StructType([T.StructField("status", T.StringType()), T.StructField("review_count", T.LongType()), T.StructField("rating_value", T.DoubleType())])


def _types(node: dict) -> set[str]:
    t = node.get("@type")
    return {x for x in (t if isinstance(t, list) else [t]) if isinstance(x, str)}


def _urls(node: dict) -> list[str]:
    offers = node.get("offers") or []
    places = [node.get("url"), node.get("@id"), *(o.get("url") for o in (offers if isinstance(offers, list) else [offers]) if isinstance(o, dict))]
    return [u for u in places if isinstance(u, str)]


def _found(blocks: list) -> tuple[int, list[tuple[dict, list[str], bool]]]:
    """The number of product nodes, and the ratings with the URLs around them and whether they are a product's."""
    products, ratings, todo = 0, [], list(reversed(blocks))
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo.extend(reversed(node))
        if not isinstance(node, dict):
            continue
        is_product = bool(_types(node) & PRODUCTS)
        products += is_product
        rating = node.get("aggregateRating")
        if isinstance(rating, dict):
            about = rating.get("itemReviewed")
            about = about if isinstance(about, dict) else {}
            ratings.append((rating, _urls(node) + _urls(about), is_product or bool(_types(about) & PRODUCTS)))
        todo.extend(v for k, v in reversed(node.items()) if k not in ("@type", "aggregateRating"))
    return products, ratings


def _number(raw) -> float | None:
    if isinstance(raw, bool) or raw is None:
        return None
    try:
        n = float(raw.strip() or 0) if isinstance(raw, str) else float(raw)
    except (TypeError, ValueError):
        return None
    return n if math.isfinite(n) else None


def _path(url: str) -> str | None:
    try:
        return urlsplit(urljoin("https://page.invalid", url)).path.lower().rstrip("/")
    except ValueError:
        return None


def observation(html: str | None, handle: str | None) -> tuple[str, int | None, float | None]:
    """PRESENT with the count and the rating, PRESENT_BUT_INVALID, ABSENT or AMBIGUOUS."""
    texts = BLOCK.findall(html or "")
    blocks, broken = [], False
    for text in texts:
        try:
            blocks.append(json.loads(text.strip()))
        except ValueError:
            broken = True
    products, ratings = _found(blocks)
    if not ratings:
        return ("AMBIGUOUS" if broken and not products else "ABSENT"), None, None
    mine = [r for r in ratings if any(_path(u) == f"/products/{handle}".lower() for u in r[1])]
    if not mine:
        mine = [r for r in ratings if r[2]]
        if not mine:
            return "ABSENT", None, None
        if len(mine) > 1 or products > 1:
            return "AMBIGUOUS", None, None
    rating = mine[0][0]
    raw = rating.get("reviewCount")
    count = _number(rating.get("ratingCount") if raw is None else raw)
    if count is None or count < 0 or count != int(count):
        return "PRESENT_BUT_INVALID", None, None
    return "PRESENT", int(count), _number(rating.get("ratingValue"))


@F.pandas_udf(SCHEMA)
def review_observation(html: pd.Series, handle: pd.Series) -> pd.DataFrame:
    rows = [observation(h, n) for h, n in zip(html, handle, strict=True)]
    return pd.DataFrame({"status": [r[0] for r in rows], "review_count": pd.array([r[1] for r in rows], "Int64"), "rating_value": [r[2] for r in rows]})


def observed_reviews(pages: DataFrame, html: str = "html", handle: Column | None = None) -> DataFrame:
    """``pages`` with the struct ``review``. Pages without JSON-LD never reach Python."""
    has = F.coalesce(F.col(html).contains("ld+json"), F.lit(False))
    none = F.struct(F.lit("ABSENT").alias("status"), F.lit(None).cast("long").alias("review_count"), F.lit(None).cast("double").alias("rating_value"))
    name = F.col("handle") if handle is None else handle
    with_ld = pages.where(has).withColumn("review", review_observation(F.col(html), name))
    return with_ld.unionByName(pages.where(~has).withColumn("review", none))
