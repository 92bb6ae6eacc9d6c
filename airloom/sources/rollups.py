"""Kept monthly partials: sum, count, least and largest value of each measure by key and month.

Coarser results (months, years, all cities) are sums of partials, so they never read the rows
again.  After a change of the rows only the months that it touches are computed and written
anew, by overwrite of their partitions; the other files stay as they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.sources.scratch import written

MONTH = "month_start"


def changed_months(rows: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """The change set of added, changed or deleted rows: each (keys, month) once."""
    return rows.select(*keys, F.trunc(date, "month").alias(MONTH)).distinct()


class MonthlyPartials:
    """Partials in `folder`, one partition a month.  Keys and dates are never null; a null
    measure counts for nothing."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], measures: Sequence[str]):
        self.spark, self.folder, self.keys, self.measures = spark, folder, list(keys), list(measures)

    def _partials(self, rows: DataFrame, date: str) -> DataFrame:
        each = [f(m).alias(f"{m}_{name}") for m in self.measures for name, f in (("sum", F.sum), ("count", F.count), ("min", F.min), ("max", F.max))]
        return rows.groupBy(*self.keys, F.trunc(date, "month").alias(MONTH)).agg(F.count(F.lit(1)).alias("n_rows"), *each)

    def build(self, rows: DataFrame, date: str = "date") -> None:
        """All months anew."""
        partials = self._partials(rows, date)
        self._schema = partials.schema
        partials.repartition(MONTH).write.mode("overwrite").partitionBy(MONTH).parquet(self.folder)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(self.folder)

    def refresh(self, rows: DataFrame, changed: DataFrame, date: str = "date") -> list:
        """Make the changed (keys, month) what `rows`, the whole table, now says; returns the months written.

        The months come to the driver, as many as the calendar has.  A key that lost all rows
        of a month leaves a row of count 0 there, so that its partition is overwritten."""
        changed = written(changed.select(*self.keys, MONTH).distinct(), "changed")
        months = sorted(r[0] for r in changed.select(MONTH).distinct().collect())
        if not months:
            return months
        on = [*self.keys, MONTH]
        touched = rows.filter(F.trunc(date, "month").isin(months) & F.col(date).between(months[0], F.last_day(F.lit(months[-1]))))
        touched = touched.withColumn(MONTH, F.trunc(date, "month")).join(changed, on, "left_semi")
        fresh = changed.join(self._partials(touched.drop(MONTH), date), on, "left").fillna(0, ["n_rows", *[f"{m}_count" for m in self.measures]])
        kept = self._stored().filter(F.col(MONTH).isin(months)).join(changed, on, "left_anti")
        # what is read here is overwritten below, so it is written elsewhere first
        staged = written(fresh.unionByName(kept), "rollup")
        staged.repartition(MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(self.folder)
        return months

    def table(self) -> DataFrame:
        return self._stored().filter("n_rows > 0")

    def mean(self, measure: str) -> Column:
        """The mean of a measure, for an aggregation of the table by anything coarser than its rows."""
        return F.sum(f"{measure}_sum") / F.nullif(F.sum(f"{measure}_count"), F.lit(0))
