"""Cleaning and completing raw readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions.numeric import rounded
from airloom.model import MEASURES, POLLUTANTS
from airloom.operators.ranges import ROWS, neighbours
from airloom.operators.series import known_neighbours, numbered
from airloom.sources.scratch import written

# Sensor name in the landed feed -> column.
SENSORS = {"co": "co", "no2": "no2", "o3": "o3", "pm10": "pm10", "pm25": "pm25", "aqi": "aqi_daily"}


def calendar_pivot(landed: DataFrame, load_order: str = "load_seq") -> DataFrame:
    """Long (city, sensor, day, value) to one row per city and day, over the union
    of all days.  Of several loads of a value the latest wins, also a null."""
    latest = landed.groupBy("city", "day", "sensor").agg(
        F.max_by("value", F.col(load_order)).alias("value")
    )
    wide = latest.groupBy("city", "day").pivot("sensor", list(SENSORS)).agg(F.first("value"))
    return wide.select(
        "city", F.to_date("day").alias("date"), *[F.col(s).alias(column) for s, column in SENSORS.items()]
    )


def monthly_attach(daily: DataFrame, keys: Sequence[str], measure: str = "aqi_daily", out: str = "aqi_monthly") -> DataFrame:
    """Mean of the month on each of its days: one exchange, at most 31 rows per window."""
    month = Window.partitionBy(*keys, F.date_format("date", "yyyy-MM"))
    return daily.withColumn(out, rounded(F.avg(measure).over(month), 1))


def _fills(df: DataFrame, sensor_values: DataFrame, columns: Sequence[str], wanted: int) -> DataFrame:
    """(city_id, date, param, fill) for the null cells that have valid sensor values."""
    cells = df.select(
        "city_id", "date", F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))).alias("param")
    )
    valid = sensor_values.filter(F.col("value") >= 0)
    rank = F.row_number().over(Window.partitionBy("city_id", "date", "param").orderBy("sensor_rank"))
    first = cells.join(valid, ["city_id", "date", "param"]).withColumn("_rank", rank).filter(F.col("_rank") <= wanted)
    return first.groupBy("city_id", "date", "param").agg(rounded(F.avg("value"), 1).alias("fill"))


def gap_fill(df: DataFrame, sensor_values: DataFrame, columns: Sequence[str] = POLLUTANTS, wanted: int = 2) -> DataFrame:
    """Fill null cells with the mean of the first `wanted` valid values in sensor
    order.  Only null cells meet the sensor table."""
    fills = _fills(df, sensor_values, columns, wanted).groupBy("city_id", "date").pivot("param", list(columns)).agg(F.first("fill"))
    fills = fills.select("city_id", "date", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(fills, ["city_id", "date"], "left")
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def gap_fill_counts(df: DataFrame, sensor_values: DataFrame, columns: Sequence[str] = POLLUTANTS, wanted: int = 2) -> DataFrame:
    return _fills(df, sensor_values, columns, wanted).groupBy("param").agg(F.count(F.lit(1)).alias("filled"))


def unit_fix(df: DataFrame, column: str = "co", above: float = 100, factor: float = 1000) -> DataFrame:
    """Values in the wrong unit (above the limit) divided by the factor."""
    value = F.col(column)
    return df.withColumn(column, F.when(value > above, rounded(value / factor, 1)).otherwise(value))


def unit_report(df: DataFrame, column: str = "co", above: float = 100) -> DataFrame:
    return df.agg(F.count_if(F.col(column) > above).alias("fixed"), F.count(F.lit(1)).alias("rows"))


def _between(c: str) -> Column:
    before, after = F.col(f"{c}_before"), F.col(f"{c}_after")
    step = F.try_divide(F.col("pos") - before["pos"], after["pos"] - before["pos"])
    line = before["value"] + (after["value"] - before["value"]) * step
    return F.coalesce(F.col(c), line, before["value"], after["value"])


def interpolate(df: DataFrame, keys: Sequence[str], columns: Sequence[str] = MEASURES) -> DataFrame:
    """Linear interpolation over row positions inside each series; the ends take
    the nearest value, an all-null series stays null."""
    near = known_neighbours(numbered(df, keys), keys, columns, columns)
    return near.select(*[_between(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def backfill_across(df: DataFrame, name: str, columns: Sequence[str] = MEASURES, rows: int = ROWS) -> DataFrame:
    """Series that are null throughout take the first value of the next series in
    name order, or the last value of the previous one.

    Works on one row per series, dealt to sampled ranges of the name whatever the names
    share, and touches only the series that need it."""
    edges = df.groupBy(name).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(f"{c}_head") for c in columns],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(f"{c}_tail") for c in columns],
    )
    near = neighbours(
        written(edges, "series-edges"), [name], {f"{c}_tail": f"{c}_before" for c in columns}, {f"{c}_head": f"{c}_after" for c in columns}, rows
    )
    given = [F.coalesce(f"{c}_after", f"{c}_before").alias(f"_{c}") for c in columns]
    empty = " or ".join(f"{c}_head is null" for c in columns)
    fills = near.filter(empty).select(name, *given)
    joined = df.join(fills, name, "left")
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def key_join(staging: DataFrame, cities: DataFrame) -> DataFrame:
    """Staged rows by city name to facts by city_id; names match without case and
    outer blanks, unknown names are dropped."""
    key = lambda c: F.lower(F.trim(F.col(c)))
    staged = staging.withColumn("_key", key("city_name"))
    known = cities.select("city_id", key("city_name").alias("_key"))
    return staged.join(known, "_key").select("city_id", "date", *MEASURES)


def zero_fill(df: DataFrame, columns: Sequence[str] = MEASURES) -> DataFrame:
    """Text to numbers; what is not a number becomes 0."""
    return df.select(
        *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def null_report(df: DataFrame) -> DataFrame:
    """Null count per column."""
    counts = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in df.columns]
    return df.agg(F.array(*counts).alias("r")).select(F.inline("r"))


def union_sorted(frames: Sequence[DataFrame], name: str = "city") -> DataFrame:
    """Rows of several city tables as one, in city and date order."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.orderBy(name, "date")
