"""Ingest and cleaning questions.

The raw inputs (landed feeds, staged files, sensor values, damaged readings) are
derived from the given tables, so the work grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.functions.dates import valid_iso_date
from airloom.functions.numeric import rounded
from airloom.model import MEASURES, key_violations, with_city
from airloom.operators import clean
from airloom.plans import dashboard, named
from airloom.plans.features import filled, monthly_means
from airloom.plans.features import named as by_name
from airloom.sources import files
from airloom.sources.rollups import MonthlyPartials, changed_months
from airloom.sources.scratch import fresh_path, written
from airloom.sources.tables import Dataset, load, table

CITY = ["city_id"]
SENSOR_OF = {column: sensor for sensor, column in clean.SENSORS.items()}


def _named(ds: Dataset) -> DataFrame:
    return by_name(ds.readings, ds)


# -- raw inputs derived from the tables ------------------------------------------


def landed_feed(ds: Dataset) -> DataFrame:
    """Readings as a long feed; the first of each month was loaded again, one higher."""
    long = _named(ds).withColumnsRenamed(SENSOR_OF).unpivot(["city", "date"], list(clean.SENSORS), "sensor", "value")
    first = long.select("city", "sensor", F.col("date").cast("string").alias("day"), "value", F.lit(1).alias("load_seq"))
    again = first.filter(F.substring("day", 9, 2) == "01").withColumn("value", F.col("value") + 1).withColumn("load_seq", F.lit(2))
    return first.unionByName(again)


def null_cells(ds: Dataset) -> DataFrame:
    """The (city_id, date) that lack a measure which sensors can fill."""
    lacking = " or ".join(f"{c} is null" for c in clean.POLLUTANTS)
    return ds.readings.filter(lacking).select("city_id", "date")


def sensor_values(spark: SparkSession, folder: str, cells: DataFrame | None = None) -> DataFrame:
    """Line numbers as sensors of a city and day; every third sensor reports -1.

    With cells, only their days: orders are cut down before they meet the line items."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("date")
    )
    customer = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("city_id"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    wanted = orders.join(customer, "c_custkey")
    if cells is not None:
        wanted = wanted.join(cells, ["city_id", "date"], "left_semi")
    values = (
        lines.join(wanted, "l_orderkey")
        .groupBy("city_id", "date", F.col("l_linenumber").alias("sensor_rank"))
        .agg((F.sum(F.col("l_quantity").cast("bigint")) / F.count(F.lit(1))).alias("value"))
    )
    reported = F.when(F.col("sensor_rank") % 3 == 0, -1.0).otherwise(F.col("value"))
    return values.select("city_id", "date", F.explode(F.array(F.lit("o3"), F.lit("pm25"))).alias("param"), "sensor_rank", reported.alias("value"))


def staged(ds: Dataset) -> DataFrame:
    """Readings by city name in mixed case and with blanks; AFRICA under an unknown name."""
    rows = with_city(ds.readings, ds.cities, "city_name", "region")
    name = F.col("city_name")
    written = (
        F.when(F.col("region") == "AFRICA", F.concat(F.lit("new "), name))
        .when(F.col("city_id") % 3 == 0, F.lower(name))
        .when(F.col("city_id") % 3 == 1, F.concat(F.lit("  "), F.upper(name), F.lit(" ")))
        .otherwise(name)
    )
    return rows.withColumn("city_name", written).select("city_name", "date", *MEASURES)


def inflated(ds: Dataset) -> DataFrame:
    """Readings with co in the smaller unit on the first ten days of each month."""
    return ds.readings.withColumn("co", F.when(F.dayofmonth("date") <= 10, F.col("co") * 1000).otherwise(F.col("co")))


def with_empty_series(ds: Dataset) -> DataFrame:
    """Readings where some cities lack a measure throughout."""
    city = F.col("city_id")
    return _named(
        Dataset(
            ds.readings.withColumn("no2", F.when(~city.isin(0, 1, 12), F.col("no2"))).withColumn(
                "o3", F.when(~city.isin(8, 9), F.col("o3"))
            ),
            ds.cities,
        )
    )


# -- questions ---------------------------------------------------------------------


def calendar_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Feed written as JSON lines, read back and pivoted."""
    path = fresh_path(spark, "feed")
    files.write_feed(landed_feed(load(spark, folder)), path)
    return clean.calendar_pivot(files.read_feed(spark, path)).orderBy("city", "date")


def monthly_attach(ds: Dataset) -> DataFrame:
    return clean.monthly_attach(_named(ds).select("city", "date", "aqi_daily"), ["city"])


def gap_fill(spark: SparkSession, folder: str) -> DataFrame:
    ds = load(spark, folder)
    return clean.gap_fill(ds.readings, sensor_values(spark, folder, null_cells(ds)))


def gap_fill_counts(spark: SparkSession, folder: str) -> DataFrame:
    ds = load(spark, folder)
    return clean.gap_fill_counts(ds.readings, sensor_values(spark, folder, null_cells(ds)))


def union_sort(spark: SparkSession, folder: str) -> DataFrame:
    """City files written as CSV, scanned by glob, in city and date order."""
    path = fresh_path(spark, "city-csv")
    raw = _named(load(spark, folder))
    raw = clean.monthly_attach(raw, ["city"]).withColumn("city_key", F.col("city"))
    files.write_city_csv(raw, path)
    rows = files.read_city_csv(spark, path)
    return clean.union_sorted([rows.filter("year(date) < 1998"), rows.filter("year(date) >= 1998 or date is null")])


def unit_fix(ds: Dataset) -> DataFrame:
    return clean.unit_fix(inflated(ds))


def unit_report(ds: Dataset) -> DataFrame:
    return clean.unit_report(inflated(ds))


def interpolate(ds: Dataset) -> DataFrame:
    filled = clean.interpolate(ds.readings, CITY)
    return filled.select("city_id", "date", *[rounded(m, 6).alias(m) for m in MEASURES])


def backfill_global(ds: Dataset) -> DataFrame:
    """Interpolation inside cities, then the neighbours in name order.  The
    interpolated table is written once: the second step reads it three times."""
    patched = written(clean.interpolate(with_empty_series(ds), ["city"]), "interpolated")
    filled = clean.backfill_across(patched, "city")
    return filled.select("city", "date", *[rounded(m, 6).alias(m) for m in MEASURES])


def key_join(ds: Dataset) -> DataFrame:
    return clean.key_join(staged(ds), ds.cities)


def zero_fill(ds: Dataset) -> DataFrame:
    text = ds.readings.select("city_id", "date", *[F.coalesce(F.col(m).cast("string"), F.lit("n/a")).alias(m) for m in MEASURES])
    return clean.zero_fill(text)


def null_report(ds: Dataset) -> DataFrame:
    return clean.null_report(ds.readings)


def metadata(ds: Dataset) -> DataFrame:
    return ds.readings.agg(
        F.count(F.lit(1)).alias("data_rows"),
        F.count_distinct("city_id").alias("cities"),
        F.concat_ws(" to ", F.min("date").cast("string"), F.max("date").cast("string")).alias("date_range"),
    )


def key_checks(ds: Dataset) -> DataFrame:
    return key_violations(ds.readings, ds.cities)


def bulk_load(spark: SparkSession, folder: str) -> DataFrame:
    """Staging CSV loaded by position and joined to the cities by name."""
    path = fresh_path(spark, "staging-csv")
    ds = load(spark, folder)
    clean.monthly_attach(staged(ds), ["city_name"]).write.option("header", True).csv(path)
    return clean.key_join(files.read_staging_csv(spark, path), ds.cities)


def keyed_append(spark: SparkSession, folder: str) -> DataFrame:
    """Days before 1998 first, then everything: no key is inserted twice."""
    path = fresh_path(spark, "keyed")
    readings = load(spark, folder).readings
    files.append_keyed(readings.filter("year(date) < 1998"), path, ["city_id", "date"])
    files.append_keyed(readings, path, ["city_id", "date"])
    return spark.read.schema(readings.schema).parquet(path)


def kept_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly features from kept partials: built before 1998, then the months of the later rows refreshed."""
    ds = load(spark, folder)
    rows = filled(ds)
    store = MonthlyPartials(spark, fresh_path(spark, "rollup"), ["city_id"], MEASURES)
    store.build(rows.filter("date < date '1998-01-01'"))
    store.refresh(rows, changed_months(rows.filter("date >= date '1998-01-01'"), ["city_id"]))
    return monthly_means(store, ds)


def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Overview records written as JSON per state, read back and flattened."""
    path = fresh_path(spark, "documents")
    docs = dashboard.overview_documents(load(spark, folder))
    files.write_documents(docs, path, by="state")
    back = files.read_documents(spark, path, docs.schema)
    return back.select("id", "name", "state", "current_aqi", F.col("month_avg.aqi").alias("month_aqi"), F.col("month_avg.pm25").alias("month_pm25"))


def stored_result(spark: SparkSession, folder: str) -> DataFrame:
    """A named question kept for ten minutes."""
    store = files.ResultStore(spark, fresh_path(spark, "results"), ttl=600)
    build = lambda: named.run_named(load(spark, folder), 18)
    store.get("q18", {"folder": folder}, build)
    return store.get("q18", {"folder": folder}, build)


def published(spark: SparkSession, folder: str) -> DataFrame:
    """Results of several questions published as JSON, and one of them read back."""
    from airloom.plans.offline import std_mean
    from airloom.sources.publish import publish

    ds, path = load(spark, folder), fresh_path(spark, "published")
    publish(spark, ds, path, {"p16": std_mean, "d4": dashboard.cities})
    return files.read_documents(spark, f"{path}/p16", std_mean(ds).schema)


def date_check(spark: SparkSession, folder: str) -> DataFrame:
    """How many texts of order dates, some of them spoilt, are real days in ISO form."""
    orders = table(spark, folder, "orders")
    day, kind = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 1, F.date_format(day, "yyyy/MM/dd"))
        .when(kind == 2, F.concat(F.date_format(day, "yyyy"), F.lit("-02-30")))
        .otherwise(F.concat(F.date_format(day, "yyyy-MM"), F.lit("-31")))
    )
    return orders.select(kind.alias("kind"), valid_iso_date(text).alias("valid")).groupBy("kind").agg(F.count(F.lit(1)).alias("texts"), F.count_if("valid").alias("valid")).orderBy("kind")
