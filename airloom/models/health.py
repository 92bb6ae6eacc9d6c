"""Health score per city: category weights averaged over days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.functions.numeric import count_when, rounded
from airloom.functions.scales import HEALTH_SCALE, health_category, health_weight, risk_advice, risk_tier
from airloom.plans.features import filled, named
from airloom.sources.tables import Dataset

NAMES = [name for _, _, name, _ in HEALTH_SCALE]


def _slug(name: str) -> str:
    return name.lower().replace(" ", "_")


def health_score(ds: Dataset) -> DataFrame:
    """Score, tier, advice, and days and percentage per category."""
    days = filled(ds).select("city_id", health_category("aqi_daily").alias("category"), health_weight("aqi_daily").alias("weight"))
    counts = days.groupBy("city_id").agg(
        rounded(F.sum("weight") / F.count(F.lit(1)), 2).alias("health_score"),
        F.count(F.lit(1)).alias("total_days"),
        *[count_when(F.col("category") == name).alias(f"{_slug(name)}_days") for name in NAMES],
    )
    out = counts.select(
        "city_id",
        "health_score",
        risk_tier("health_score").alias("risk_tier"),
        risk_advice("health_score").alias("advisory"),
        "total_days",
        *[f"{_slug(name)}_days" for name in NAMES],
        *[rounded(F.col(f"{_slug(n)}_days") * 100.0 / F.col("total_days"), 1).alias(f"{_slug(n)}_pct") for n in NAMES],
    )
    return named(out, ds).orderBy("city")


def health_documents(ds: Dataset) -> DataFrame:
    """One record per city with the categories that occur as a map."""
    entries = F.array(
        *[F.struct(F.lit(n).alias("key"), F.struct(F.col(f"{_slug(n)}_days").alias("days"), F.col(f"{_slug(n)}_pct").alias("percentage")).alias("value")) for n in NAMES]
    )
    present = F.filter(entries, lambda e: e["value"]["days"] > 0)
    return health_score(ds).select(
        "city", "health_score", "risk_tier", "advisory", "total_days", F.map_from_entries(present).alias("category_breakdown")
    )


def health_map(ds: Dataset) -> DataFrame:
    """The categories that occur in each city, out of its map."""
    rows = health_documents(ds).select("city", F.explode("category_breakdown").alias("category", "share"))
    return rows.select("city", "category", "share.days", "share.percentage").orderBy("city", "category")


def health_summary(ds: Dataset) -> DataFrame:
    return health_score(ds).select("city", "health_score", "risk_tier").orderBy(F.desc("health_score"), "city")
