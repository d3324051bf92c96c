"""Money as integer cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs of currencies whose amounts are written with two decimals.
SIGNS = {"USD": "$", "EUR": "€", "GBP": "£", "CAD": "CA$", "AUD": "A$", "INR": "₹", "NZD": "NZ$", "MXN": "MX$", "BRL": "R$", "CNY": "CN¥"}


def half_up(x: Column) -> Column:
    """Round halves towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def to_cents(raw: Column) -> Column:
    """Cents of a written price: what isn't a digit, dot or minus goes, the longest numeric beginning counts; null if there is none."""
    kept = F.regexp_replace(raw, r"[^0-9.\-]", "")
    number = F.regexp_extract(kept, r"^(-?(?:\d+\.?\d*|\.\d+))", 1)
    return half_up(F.when(number != "", number).try_cast("double") * 100)


def pct_change(before: Column, after: Column) -> Column:
    """(after - before) / before; null from 0."""
    return F.when(before != 0, (after - before) / before)


def format_cents(cents: Column, currency: Column) -> Column:
    amount = F.format_number(F.abs(cents) / 100, 2)
    sign = F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair])[currency]
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.coalesce(sign, F.concat(currency, F.lit("\u00a0"))), amount)


def list_price_cents(plan: Column, interval: Column) -> Column:
    """What a plan costs per billing interval; a year costs twelve months."""
    from driftline.config import PLAN_CENTS

    monthly = F.create_map(*[F.lit(x) for pair in PLAN_CENTS.items() for x in pair])[plan]
    return F.coalesce(monthly, F.lit(0)) * F.when(interval == "ANNUAL", 12).otherwise(1)
