"""Feature frames shared by the offline questions and the models.

Nulls count as zero here (the offline reading of the data)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.functions.dates import LONG_WINTER, SUMMER, in_months
from airloom.functions.numeric import mean_when, ratio, rounded
from airloom.model import MEASURES, with_city
from airloom.operators.quantile import percentiles
from airloom.sources.rollups import MONTH, MonthlyPartials
from airloom.sources.tables import Dataset

DIGITS = 6
AQI = "aqi_daily"
PROFILE = ("avg_aqi", "avg_pm25", "avg_pm10", "volatility", "max_spike")


def filled(ds: Dataset) -> DataFrame:
    return ds.readings.select("city_id", "date", *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in MEASURES])


def named(df: DataFrame, ds: Dataset) -> DataFrame:
    """Replace city_id by the city's name in a column `city`."""
    out = with_city(df, ds.cities).withColumnRenamed("city_name", "city")
    return out.select("city", *[c for c in df.columns if c != "city_id"])


def _means() -> list:
    return [rounded(F.avg(m), DIGITS).alias("avg_aqi" if m == AQI else f"avg_{m}") for m in MEASURES]


def city_slice(ds: Dataset, city: str) -> DataFrame:
    chosen = ds.cities.filter(F.col("city_name") == city).select("city_id")
    rows = filled(ds).join(chosen, "city_id", "left_semi")
    return named(rows, ds).orderBy("date")


def city_list(ds: Dataset) -> DataFrame:
    seen = ds.readings.select("city_id").distinct()
    return named(seen, ds).orderBy("city")


def monthly_features(ds: Dataset) -> DataFrame:
    return named(
        filled(ds).groupBy("city_id", F.year("date").alias("year"), F.month("date").alias("month")).agg(*_means()), ds
    )


def monthly_means(store: MonthlyPartials, ds: Dataset) -> DataFrame:
    """The monthly features from kept partials of the filled rows."""
    means = [rounded(store.mean(m), DIGITS).alias("avg_aqi" if m == AQI else f"avg_{m}") for m in MEASURES]
    return named(store.table().groupBy("city_id", F.year(MONTH).alias("year"), F.month(MONTH).alias("month")).agg(*means), ds)


def yearly_features(ds: Dataset) -> DataFrame:
    dev = rounded(F.stddev_samp(AQI), DIGITS).alias("std_aqi")
    return named(filled(ds).groupBy("city_id", F.year("date").alias("year")).agg(*_means(), dev), ds)


def city_features(ds: Dataset) -> DataFrame:
    """Nine aggregates and the winter / summer ratio (1 when undefined)."""
    seasonal = ratio(
        mean_when(in_months("date", LONG_WINTER), AQI), F.nullif(mean_when(in_months("date", SUMMER), AQI), F.lit(0.0))
    )
    return named(
        filled(ds)
        .groupBy("city_id")
        .agg(
            *_means(),
            rounded(F.stddev_samp(AQI), DIGITS).alias("std_aqi"),
            F.max(AQI).alias("max_aqi"),
            F.min(AQI).alias("min_aqi"),
            F.coalesce(rounded(seasonal, DIGITS), F.lit(1.0)).alias("seasonal_ratio"),
        ),
        ds,
    )


def city_profile(ds: Dataset) -> DataFrame:
    """Five-column profile for clustering; a missing value takes the column's
    median.  Nulls stay null in the means here."""
    base = ds.readings.groupBy("city_id").agg(
        F.avg(AQI).alias("avg_aqi"),
        F.avg("pm25").alias("avg_pm25"),
        F.avg("pm10").alias("avg_pm10"),
        F.stddev_samp(AQI).alias("volatility"),
        F.max(AQI).alias("max_spike"),
    )
    long = base.unpivot("city_id", list(PROFILE), "feature", "value")
    medians = percentiles(long, ["feature"], "value", {"median": 0.5})
    patched = long.join(medians, "feature", "left").select(
        "city_id", "feature", rounded(F.coalesce("value", "median"), DIGITS).alias("value")
    )
    wide = patched.groupBy("city_id").pivot("feature", list(PROFILE)).agg(F.first("value"))
    return named(wide, ds)
