"""Scaled training windows for sequence models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.operators.series import numbered, trailing
from airloom.plans.features import filled, named
from airloom.sources.tables import Dataset


def training_windows(ds: Dataset, metric: str = "aqi_daily", lookback: int = 30, train_share: float = 0.8) -> DataFrame:
    """Per city: the `lookback` scaled values before each row (full windows only),
    the row's own value as target, and an ordered train / validation split."""
    rows = filled(ds).select("city_id", "date", F.col(metric).alias("value"))
    span = rows.groupBy("city_id").agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    scaled = rows.join(span, "city_id").select(
        "city_id", "date", F.coalesce(F.try_divide(F.col("value") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0)).alias("value")
    )
    placed = numbered(scaled, ["city_id"], total="_n")
    windows = trailing(placed, ["city_id"], lookback, {"features": lambda w: F.collect_list("value").over(w)}, include_current=False)
    full = windows.filter(F.col("pos") > lookback)
    train = F.col("pos") - lookback <= F.floor((F.col("_n") - lookback) * train_share)
    out = full.select("city_id", "date", "features", F.col("value").alias("target"), F.when(train, "train").otherwise("validation").alias("split"))
    return named(out, ds)


def window_summary(ds: Dataset, metric: str = "aqi_daily", lookback: int = 30) -> DataFrame:
    """The windows with their features folded to first, last and mean."""
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return training_windows(ds, metric, lookback).select(
        "city",
        "date",
        F.size("features").alias("length"),
        F.round(F.element_at("features", 1), 6).alias("first"),
        F.round(F.element_at("features", -1), 6).alias("last"),
        F.round(total / F.size("features"), 6).alias("mean"),
        F.round("target", 6).alias("target"),
        "split",
    )
