"""Runs of consecutive days (calendar) and of consecutive rows.

Both are built per (series, year), then only the runs that touch the edge of a
year are stitched: at most two per year and series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.operators.series import BLOCK, with_block


def _stitch(runs: DataFrame, keys: Sequence[str], touching: Column, continues: Callable[[Window], Column], *more: str) -> DataFrame:
    """Merge neighbouring edge runs; inner runs stay groups of their own."""
    span = F.when(~touching, F.col("start"))
    marked = runs.withColumn("_span", span)
    order = Window.partitionBy(*keys, "_span").orderBy("start")
    joined = marked.withColumn("_new", F.when(F.coalesce(continues(order), F.lit(False)), 0).otherwise(1))
    group = joined.withColumn("_group", F.sum("_new").over(order))
    return group.groupBy(*keys, "_span", "_group", *more).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("length").alias("length")
    ).drop("_span", "_group")


def calendar_runs(df: DataFrame, keys: Sequence[str], cond: Column, date: str = "date", split_years: bool = False) -> DataFrame:
    """Runs of consecutive calendar days where `cond` holds: start, end, length.

    With `split_years` a run ends on 31 December and `year` is returned."""
    days = with_block(df, date).filter(cond)
    rn = F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(date))
    islands = (
        days.select(*keys, BLOCK, date, rn.alias("_rn"))
        .withColumn("_island", F.date_sub(F.col(date), F.col("_rn")))
        .groupBy(*keys, BLOCK, "_island")
        .agg(F.min(date).alias("start"), F.max(date).alias("end"), F.count(F.lit(1)).alias("length"))
        .drop("_island")
    )
    if split_years:
        return islands.withColumnRenamed(BLOCK, "year")
    at_edge = (F.date_format("start", "MM-dd") == "01-01") | (F.date_format("end", "MM-dd") == "12-31")
    return _stitch(islands, keys, at_edge, lambda order: F.date_add(F.lag("end").over(order), 1) == F.col("start"))


def row_runs(df: DataFrame, keys: Sequence[str], cond: Column, date: str = "date", split_years: bool = False) -> DataFrame:
    """Runs of neighbouring rows where `cond` holds; missing days do not break a run."""
    flagged = with_block(df, date).select(*keys, BLOCK, F.col(date).alias("_day"), F.coalesce(cond, F.lit(False)).alias("_flag"))
    year = Window.partitionBy(*keys, BLOCK)
    placed = flagged.select(
        "*",
        F.row_number().over(year.orderBy("_day")).alias("_rn"),
        F.count(F.lit(1)).over(year).alias("_rows"),
        F.row_number().over(Window.partitionBy(*keys, BLOCK, "_flag").orderBy("_day")).alias("_in_flag"),
    )
    runs = placed.groupBy(*keys, BLOCK, "_flag", (F.col("_rn") - F.col("_in_flag")).alias("_run")).agg(
        F.min("_day").alias("start"),
        F.max("_day").alias("end"),
        F.count(F.lit(1)).alias("length"),
        (F.min("_rn") == 1).alias("_opens"),
        (F.max("_rn") == F.max("_rows")).alias("_closes"),
    )
    if split_years:
        return runs.filter("_flag").select(*keys, F.col(BLOCK).alias("year"), "start", "end", "length")

    def same_run(order):
        return F.lag("_closes").over(order) & F.col("_opens") & (F.lag("_flag").over(order) == F.col("_flag"))

    edge = F.col("_opens") | F.col("_closes")
    return _stitch(runs, keys, edge, same_run, "_flag").filter("_flag").drop("_flag")
