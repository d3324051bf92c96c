"""Answers of outside services: ads, domain ages, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AD = "struct<ad_creative_id:string,advertiser_id:string,advertiser:string,format:string,target_domain:string,link:string>"


def ad_summaries(answers: DataFrame) -> DataFrame:
    """Ads out of search answers (``domain``, ``body``): those with both ids, and of this domain if they name one."""
    ads = F.from_json(F.col("body"), f"ad_creatives array<{_AD}>")["ad_creatives"]
    rows = answers.select("domain", F.explode(ads).alias("a"))
    own = F.col("a.target_domain").isNull() | (F.lower("a.target_domain") == F.lower("domain"))
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return rows.where(some("a.ad_creative_id") & some("a.advertiser_id") & own).select("domain", F.col("a.ad_creative_id").alias("external_ad_id"), F.col("a.advertiser_id").alias("advertiser_external_id"), F.col("a.advertiser").alias("advertiser_name"), F.col("a.format").alias("format"))


def ad_details(ads: DataFrame) -> DataFrame:
    """Ads with the detail answer in ``body``: destination, advertiser, format and what is kept of the rest."""
    schema = f"ad_creatives array<{_AD}>, search_information struct<link:string,ad_funded_by:string,format:string,first_shown:bigint,last_shown:bigint,regions:array<struct<region_name:string,first_shown:bigint,last_shown:bigint>>>"
    rows = ads.withColumn("d", F.from_json("body", schema)).where(F.col("d.search_information").isNotNull())
    info = F.col("d.search_information")
    regions = F.transform(info["regions"], lambda r: F.struct(r["region_name"].alias("regionName"), r["first_shown"].alias("firstShown"), r["last_shown"].alias("lastShown")))
    meta = F.to_json(F.struct(info["first_shown"].alias("firstShown"), info["last_shown"].alias("lastShown"), F.when(F.size(regions) > 0, regions).alias("regions")))
    return rows.select(
        *[c for c in ads.columns if c not in ("body", "destination_url", "advertiser_name", "format")],
        F.coalesce(F.get("d.ad_creatives", F.lit(0))["link"], info["link"]).alias("destination_url"),
        F.coalesce(info["ad_funded_by"], F.col("advertiser_name")).alias("advertiser_name"),
        F.coalesce(info["format"], F.col("format")).alias("format"),
        F.when(meta != "{}", meta).alias("source_metadata"),
    )


def registration_date(rdap: Column) -> Column:
    """When a domain was registered, out of its RDAP answer."""
    events = F.from_json(rdap, "events array<struct<eventAction string, eventDate string>>")["events"]
    dates = F.filter(F.transform(F.filter(events, lambda e: e["eventAction"] == "registration"), lambda e: F.try_to_timestamp(e["eventDate"])), lambda d: d.isNotNull())
    return F.get(dates, F.lit(0))


def first_archived(cdx: Column) -> Column:
    """The first capture in an archive's answer, a JSON table whose first row holds the names."""
    rows = F.from_json(cdx, "array<array<string>>")
    return F.try_to_timestamp(F.get(F.get(rows, F.lit(1)), F.lit(1)), F.lit("yyyyMMddHHmmss"))


def filled_once(stores: DataFrame, answers: DataFrame, columns: list[str], now: Column) -> DataFrame:
    """Stores with what was found out for those that weren't checked before."""
    new = answers.select("store_id", *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__asked"))
    rows = stores.join(new, "store_id", "left")
    due = F.col("checked_at").isNull() & F.col("__asked").isNotNull()
    out = rows.withColumns({c: F.when(due, F.col(f"__{c}")).otherwise(F.col(c)) for c in columns} | {"checked_at": F.when(due, now).otherwise(F.col("checked_at"))})
    return out.drop("__asked", *[f"__{c}" for c in columns])
