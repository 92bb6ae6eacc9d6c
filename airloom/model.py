"""Schemas of the two core tables and of the landed inputs.

`readings` holds at most one row per (city_id, date).  That key is what bounds
the windows in `airloom.operators.series`, so `key_violations` checks it and
`one_row_per_day` enforces it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLLUTANTS = ("co", "no2", "o3", "pm10", "pm25")
MEASURES = (*POLLUTANTS, "aqi_daily")
KEYS = ("city_id", "date")

CITIES = T.StructType(
    [
        T.StructField("city_id", T.IntegerType()),
        T.StructField("city_name", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("region", T.StringType()),
    ]
)

READINGS = T.StructType(
    [T.StructField("city_id", T.IntegerType()), T.StructField("date", T.DateType())]
    + [T.StructField(m, T.DoubleType()) for m in MEASURES]
)

STAGING = T.StructType(
    [T.StructField("city_name", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(m, T.DoubleType()) for m in MEASURES]
)

RAW_CSV = T.StructType(
    [T.StructField("city", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(m, T.DoubleType()) for m in (*MEASURES, "aqi_monthly")]
)

LANDED_VALUES = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("sensor", T.StringType()),
        T.StructField("day", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Fact rows whose key is missing from the dimension."""
    return facts.join(dim.select(key), key, "left_anti")


def key_violations(readings: DataFrame, cities: DataFrame) -> DataFrame:
    """One row per integrity rule with the number of violations."""
    checks = [
        ("duplicate_city_day", duplicate_keys(readings, KEYS)),
        ("duplicate_city_name", duplicate_keys(cities, ["city_name"])),
        ("orphan_city_id", orphans(readings, cities, "city_id")),
    ]
    out = None
    for name, bad in checks:
        row = bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def one_row_per_day(df: DataFrame, load_order: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep the row that was loaded last for each key (map-side combined)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(load_order)).alias("r"))
    return picked.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def with_city(df: DataFrame, cities: DataFrame, *columns: str) -> DataFrame:
    """Attach dimension columns.  No hint: Spark broadcasts `cities` only while
    its measured size is under spark.sql.autoBroadcastJoinThreshold and falls
    back to a shuffled join above it."""
    return df.join(cities.select("city_id", *(columns or ("city_name",))), "city_id")


def named_readings(readings: DataFrame, cities: DataFrame) -> DataFrame:
    """Readings keyed by city name with nulls read as zero (the offline view)."""
    filled = readings.select("city_id", "date", *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in MEASURES])
    return with_city(filled, cities).withColumnRenamed("city_name", "city").drop("city_id")

