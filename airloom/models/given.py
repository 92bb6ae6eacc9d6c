"""The parts of the models that do not depend on a fit, for parameters that the caller gives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions.numeric import rounded
from airloom.models import anomaly
from airloom.models.cluster import _prepared
from airloom.models.smoothing import BLOCK_ROWS, best_of, prepared
from airloom.plans.features import PROFILE, filled, named
from airloom.sources.tables import Dataset


def smoothing(ds: Dataset, alpha: float, beta: float, gamma: float, season: int, metric: str = "aqi_daily", block: int = BLOCK_ROWS) -> DataFrame:
    """Level, trend, squared error and next value of additive smoothing with given parameters;
    cities with fewer than two seasons have none.  `block` is the number of days of a block."""
    return best_smoothing(ds, [(alpha, beta, gamma)], season, metric, block).select("city", "days", "level", "trend", "sse", "next")


def best_smoothing(ds: Dataset, parameters: Sequence[tuple[float, float, float]], season: int, metric: str = "aqi_daily", block: int = BLOCK_ROWS) -> DataFrame:
    """The same for the triple (a, b, g) of a given list with the least squared error, of equals the first."""
    series = filled(ds).select("city_id", "date", F.col(metric).alias("value"))
    blocks, cities = prepared(series, season, block, max(2, 2 * season))
    triples = F.array(*[F.struct(*[F.lit(float(x)).alias(k) for k, x in zip("abg", p)]) for p in parameters])
    best = best_of(blocks, cities, cities.select("city_id", triples.alias("triples"))).join(cities.select("city_id", "days", "season"), "city_id")
    slot = F.when(F.col("season") > 0, F.get("state", 2 + (F.col("days") % F.greatest("season", F.lit(1))).cast("int"))).otherwise(0.0)
    level, trend = F.col("state")[0], F.col("state")[1]
    out = {"level": level, "trend": trend, "sse": F.col("sse"), "next": level + trend + slot}
    return named(best.select("city_id", "days", "a", "b", "g", *[rounded(c, 4).alias(n) for n, c in out.items()]), ds).orderBy("city")


def assignment(ds: Dataset, centre_ids: Sequence[int]) -> DataFrame:
    """The nearest of the given cities in the space of scaled profiles, and the squared distance."""
    z = _prepared(ds)[1]
    centres = z.join(ds.cities.select(F.col("city_name").alias("city"), "city_id").filter(F.col("city_id").isin(*centre_ids)), "city")
    listed = centres.agg(F.sort_array(F.collect_list(F.struct("city_id", *PROFILE))).alias("c")).scalar()  # one for each given id
    gap = lambda c: sum(((F.col(p) - c[p]) * (F.col(p) - c[p]) for p in PROFILE), F.lit(0.0))
    best = F.array_min(F.transform("centres", lambda c: F.struct(F.round(gap(c), 9).alias("gap"), c["city_id"].alias("centre"))))
    placed = z.withColumn("centres", listed).withColumn("best", best)
    return placed.select("city", F.col("best.centre").alias("centre"), rounded("best.gap", 6).alias("distance")).orderBy("city")


def inertia(ds: Dataset, centre_ids: Sequence[int]) -> DataFrame:
    """Members and summed squared distance of each given centre."""
    return assignment(ds, centre_ids).groupBy("centre").agg(F.count(F.lit(1)).alias("members"), rounded(F.sum("distance"), 4).alias("inertia")).orderBy("centre")


def covariance(ds: Dataset) -> DataFrame:
    """The covariance matrix of the scaled profiles in long form; its trace is the total variance."""
    z = _prepared(ds)[1]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rounded(F.covar_pop(a, b), 6).alias("covariance")) for a in PROFILE for b in PROFILE]
    return z.agg(F.array(*cells).alias("m")).select(F.inline("m"))


def _given_scores(ds: Dataset, metric: str) -> DataFrame:
    return filled(ds).select("city_id", "date", (-F.col(metric)).alias("score"))


def flag_report(ds: Dataset, metric: str = "pm25", contamination: float = 0.05) -> DataFrame:
    """The anomaly report for given scores: the negative of one measure."""
    return anomaly.report(ds, anomaly.flags(ds, _given_scores(ds, metric), contamination))


def first_flags(ds: Dataset, metric: str = "pm25", contamination: float = 0.05, first: int = 5) -> DataFrame:
    """The first flagged days of each city, gathered as a list of bounded length and shown as text."""
    hits = anomaly.flags(ds, _given_scores(ds, metric), contamination).filter("anomaly")
    # ranks up to a bound are cut before the exchange, so a list never has more than `first` days a task
    rank = F.row_number().over(Window.partitionBy("city_id").orderBy("date"))
    least = hits.select("city_id", "date").withColumn("_rank", rank).filter(F.col("_rank") <= first)
    listed = least.groupBy("city_id").agg(F.sort_array(F.collect_list("date")).alias("days"))
    return named(listed.select("city_id", F.array_join(F.transform("days", lambda d: d.cast("string")), ",").alias("days")), ds).orderBy("city")
