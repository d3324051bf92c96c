"""Fixed values of the change model: thresholds, scores, plans, cadences."""

from __future__ import annotations

from dataclasses import dataclass

# Base scores of the event types.
BASE_SCORES = {
    "STORE_BASELINED": 5,
    "PRODUCT_ADDED": 45,
    "PRODUCT_REMOVED": 40,
    "PRODUCT_RESTORED": 30,
    "PRICE_DROP": 55,
    "PRICE_INCREASE": 40,
    "SALE_STARTED": 60,
    "SALE_ENDED": 30,
    "PRODUCT_SOLD_OUT": 65,
    "PRODUCT_RESTOCKED": 45,
    "VARIANT_SOLD_OUT": 20,
    "BESTSELLER_ENTERED": 70,
    "BESTSELLER_CLIMBED": 55,
    "BESTSELLER_DROPPED": 30,
    "COLLECTION_ADDED": 25,
    "COLLECTION_REMOVED": 25,
    "THEME_CHANGED": 60,
    "APP_ADDED": 55,
    "APP_REMOVED": 40,
    "PIXEL_ADDED": 65,
    "PIXEL_REMOVED": 35,
    "PAYMENT_PROVIDER_ADDED": 45,
    "PAYMENT_PROVIDER_REMOVED": 25,
    "AD_DETECTED": 50,
    "AD_REMOVED": 25,
    "AD_CHANGED": 35,
    "PRODUCT_AD_MATCHED": 20,
}
SATURATION = 70.0
# Event categories.
PRICE_EVENTS = ("PRICE_DROP", "PRICE_INCREASE", "SALE_STARTED", "SALE_ENDED")
TECHNOLOGY_EVENTS = (
    "THEME_CHANGED",
    "APP_ADDED",
    "APP_REMOVED",
    "PIXEL_ADDED",
    "PIXEL_REMOVED",
    "PAYMENT_PROVIDER_ADDED",
    "PAYMENT_PROVIDER_REMOVED",
    "COLLECTION_ADDED",
    "COLLECTION_REMOVED",
)
MARKETING_EVENTS = ("AD_DETECTED", "AD_CHANGED", "AD_REMOVED", "PRODUCT_AD_MATCHED")
# Magnitudes of entity events.
ENTITY_MAGNITUDES = {"PIXEL": 0.85, "APP": 0.7, "PAYMENT_PROVIDER": 0.6, "COLLECTION": 0.6}
# Monthly prices in cents, plans in ascending order.
PLANS = ("FREE", "BASIC", "BUSINESS")
PLAN_CENTS = {"FREE": 0, "BASIC": 1900, "BUSINESS": 4900}
PLAN_LABELS = {"FREE": "Free", "BASIC": "Basic", "BUSINESS": "Business"}
# Analyses in 24 hours and monitored stores of each plan; days of a trial.
PLAN_LIMITS = {"FREE": {"analyses": 10, "slots": 1}, "BASIC": {"analyses": 50, "slots": 20}, "BUSINESS": {"analyses": 100, "slots": 50}}
TRIAL_DAYS = 30
#: Cents for one paid vendor call.
VENDOR_CALL_CENTS = 1.5


@dataclass(frozen=True)
class DiffConfig:
    min_price_change_pct: float = 0.02
    min_price_change_cents: int = 100
    removal_confirmations: int = 2
    max_catalog_shrink: float = 0.4
    min_products_for_shrink: int = 10
    min_rank_improvement: int = 3
    bestseller_window: int = 60
    max_events: int = 200
