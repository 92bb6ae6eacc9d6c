"""Additive Holt-Winters forecast per city.

The fit is `models.smoothing`: series cut into blocks, a refined grid of parameters walked in all
blocks side by side.  What a city hands on to the forecast is its last state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.functions.numeric import rounded
from airloom.models.smoothing import BLOCK_ROWS, prepared, searched, start_state, walk
from airloom.plans.features import filled, named
from airloom.sources.tables import Dataset, kept

MIN_ROWS = 60
FITTED = "Holt-Winters"
TOO_SHORT = "Insufficient data (<60 days)"


def ahead(state: np.ndarray, days: int, season: int, steps: int) -> np.ndarray:
    """`steps` values after `days` days, from the state there."""
    at = np.arange(1, steps + 1)
    out = state[0] + state[1] * at
    return out + np.asarray(state[2:])[(days + at - 1) % season] if season else out


def holt_winters(y: np.ndarray, steps: int, season: int = 365) -> np.ndarray:
    """The forecast of one series in memory, by the same grid: a plain loop to compare with."""
    if len(y) < 2 * season:
        season = min(30, len(y) // 2)
    season = season if season >= 2 else 0
    centre, width = np.array([0.5, 0.5, 0.5]), 0.5
    for _ in range(3):
        axes = [np.unique(np.clip(np.linspace(c - width, c + width, 5), 0.0, 1.0)) for c in centre]
        a, b, g = (m.ravel() for m in np.meshgrid(*axes, indexing="ij"))
        sse, state = walk(y, 0, season, start_state(y, season, a.size), a, b, g)
        best = int(np.nanargmin(np.where(np.isfinite(sse), sse, np.inf)))
        centre, width = np.array([a[best], b[best], g[best]]), width / 3
    return ahead(state[best], len(y), season, steps)


REPEATED = "Last season repeated"


def repeat_last(y: np.ndarray, steps: int) -> np.ndarray:
    return y[-steps:] if len(y) >= steps else np.full(steps, y.mean())


SCHEMA = "city_id int, date date, forecast double, model string, season int"


def forecasts(
    ds: Dataset, metric: str = "aqi_daily", steps: int = 365, cap: float = 600.0, band: float = 0.15, season: int | None = None, block: int = BLOCK_ROWS
) -> DataFrame:
    """Daily forecast with its band; a short series gives one row with the reason.

    `season` is the number of days of a season, 0 for none; where a series does not have two of
    them it is fitted without.  None takes a year, or up to 30 days for less than two years.  The
    column `season` tells what a city was fitted with.  Fitted once per state of the input and
    parameters."""
    return kept(ds, "forecasts", (metric, steps, cap, band, season, block), lambda: _forecasts(ds, metric, steps, cap, band, season, block))


def _forecasts(ds: Dataset, metric: str, steps: int, cap: float, band: float, season: int | None, block: int) -> DataFrame:
    series = filled(ds).select("city_id", "date", F.col(metric).alias("value"))
    blocks, cities = prepared(series, season, block, MIN_ROWS, steps)
    fitted = searched(blocks, cities).join(cities, "city_id").select("city_id", "state", "days", "season", "tail", "last_day")

    def follow(frames):
        for frame in frames:
            for row in frame.itertuples():
                out, model = ahead(np.array(row.state, dtype=float), row.days, row.season, steps), FITTED
                if not np.isfinite(out).all():
                    out, model = repeat_last(np.array(row.tail, dtype=float), steps), REPEATED
                days = pd.date_range(pd.Timestamp(row.last_day) + pd.Timedelta(days=1), periods=steps, freq="D")
                yield pd.DataFrame({"city_id": row.city_id, "date": days.date, "forecast": np.clip(out, 0, cap), "model": model, "season": row.season})

    short = series.groupBy("city_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < MIN_ROWS)
    none = short.select("city_id", F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("forecast"), F.lit(TOO_SHORT).alias("model"), F.lit(None).cast("int").alias("season"))
    out = fitted.mapInPandas(follow, SCHEMA).unionByName(none)
    return out.select(
        "*", (F.col("forecast") * (1 - band)).alias("lower"), (F.col("forecast") * (1 + band)).alias("upper")
    )


def forecast_summary(ds: Dataset, metric: str = "aqi_daily", steps: int = 365) -> DataFrame:
    out = forecasts(ds, metric, steps).groupBy("city_id", "model").agg(
        F.count("forecast").alias("days"),
        rounded(F.avg("forecast"), 1).alias("avg"),
        rounded(F.min("forecast"), 1).alias("min"),
        rounded(F.max("forecast"), 1).alias("max"),
    )
    return named(out, ds).orderBy("city")


def forecast_monthly(ds: Dataset, metric: str = "aqi_daily", steps: int = 365) -> DataFrame:
    """Mean forecast per month, labelled like `Mar 2026`."""
    month = F.trunc("date", "month")
    out = forecasts(ds, metric, steps).filter(F.col("date").isNotNull()).groupBy("city_id", month.alias("first")).agg(
        rounded(F.avg("forecast"), 1).alias("predicted_avg")
    )
    return named(out, ds).orderBy("city", "first").select("city", F.date_format("first", "MMM yyyy").alias("month"), "predicted_avg")



def forecast_calendar(ds: Dataset, metric: str = "aqi_daily", steps: int = 365) -> DataFrame:
    """First and last forecast day and the number of days per city."""
    days = forecasts(ds, metric, steps).filter(F.col("date").isNotNull()).groupBy("city_id").agg(
        F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("days")
    )
    return named(days, ds).orderBy("city")
