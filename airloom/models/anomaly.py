"""Isolation forest per city over the six measures.

1. each tree takes the `sample` rows of its city with the least hashes, the least ones of
   each task first, by the same rule at every size;
2. trees are grown per (city, CHUNK of trees) from their samples;
3. rows meet the forest of their city in buckets of at most about BUCKET rows,
   so a large city is scored by many tasks;
4. the cut is the exact percentile of the scores per city.

Splits are uniform between a column's extremes, so scaling the columns first
would not change them.  All draws are seeded by hashes: a task that runs again
gives the same rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions.numeric import count_when, rounded
from airloom.model import MEASURES
from airloom.operators.quantile import percentiles
from airloom.plans.features import filled, named
from airloom.sources.scratch import written
from airloom.sources.tables import Dataset, kept

SAMPLE = 256
BUCKET = 16384
CHUNK = 25
MIN_ROWS = 30
#: Rows that are hashed at once, and cities whose least rows a task holds.
PIECE, CITIES = 4096, 32
TOO_FEW = "insufficient data"
FEATURES = ("aqi_daily", "pm25", "pm10", "co", "no2", "o3")
TREE = "city_id int, tree int, feature array<int>, cut array<double>, path array<double>"
EULER = 0.5772156649015329


def mean_path(n) -> np.ndarray:
    """Expected depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    many = 2.0 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, many))


def grow(points: np.ndarray, tree: np.ndarray, trees: int, rng: np.random.Generator, max_depth: int):
    """Random trees over the rows of `points`, all trees of a chunk level by level.

    Nodes lie in heap order: the children of node i are 2i+1 and 2i+2.  Returns
    feature (-1 for a leaf), cut and path length, each of shape (trees, nodes)."""
    width = 2 ** (max_depth + 1) - 1
    feature, cut, path = np.full(trees * width, -1), np.zeros(trees * width), np.zeros(trees * width)
    node = tree * width
    rows = np.arange(len(points))
    for depth in range(max_depth + 1):
        order = rows[np.argsort(node[rows], kind="stable")]
        ids, starts, sizes = np.unique(node[order], return_index=True, return_counts=True)
        lows = np.minimum.reduceat(points[order], starts, axis=0)
        highs = np.maximum.reduceat(points[order], starts, axis=0)
        path[ids] = depth + mean_path(sizes)
        usable = highs > lows
        split = usable.any(axis=1) & (sizes > 1) & (depth < max_depth)
        if not split.any():
            break
        drawn = np.where(usable, rng.random(usable.shape), -1.0).argmax(axis=1)
        at = np.arange(len(ids))
        value = rng.uniform(lows[at, drawn], highs[at, drawn])
        feature[ids[split]], cut[ids[split]] = drawn[split], value[split]
        rows = order[np.repeat(split, sizes)]
        here = node[rows]
        right = points[rows, feature[here]] > cut[here]
        base = tree[rows] * width
        node[rows] = base + 2 * (here - base) + 1 + right
    return tuple(x.reshape(trees, width) for x in (feature, cut, path))


def mean_depth(points: np.ndarray, feature: np.ndarray, cut: np.ndarray, path: np.ndarray, rows: int = 1024) -> np.ndarray:
    """Mean path length of every point over all trees."""
    out = np.empty(len(points))
    trees = np.arange(len(feature))[None, :]
    levels = int(np.log2(feature.shape[1] + 1))
    for start in range(0, len(points), rows):
        part = points[start : start + rows]
        at = np.zeros((len(part), len(feature)), dtype=np.int64)
        for _ in range(levels):
            f = feature[trees, at]
            right = np.take_along_axis(part, np.maximum(f, 0), axis=1) > cut[trees, at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        out[start : start + rows] = path[trees, at].mean(axis=1)
    return out


def row_hashes(city: int, days: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """A number for each row and tree, by mixing city, day, tree and seed."""
    with np.errstate(over="ignore"):
        x = days.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.uint64(city & 0xFFFFFFFF) << np.uint64(32) | np.uint64(seed & 0xFFFFFFFF))
        x = x + np.arange(1, trees + 1, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


class Least:
    """The rows of one city with the least hashes of each tree, of all rows seen so far."""

    def __init__(self, sample: int, trees: int):
        self.sample, self.trees = sample, trees
        self.rows, self.hashes, self.at = None, np.zeros((trees, 0), np.int64), np.zeros((trees, 0), np.int64)

    def add(self, frame: pd.DataFrame, hashes: np.ndarray) -> None:
        have = 0 if self.rows is None else len(self.rows)
        every = frame if self.rows is None else pd.concat([self.rows, frame], ignore_index=True)
        both = np.hstack([self.hashes, hashes.T])
        at = np.hstack([self.at, np.broadcast_to(np.arange(have, have + len(frame)), (self.trees, len(frame)))])
        if both.shape[1] > self.sample:
            least = np.argpartition(both, self.sample - 1, axis=1)[:, : self.sample]
            both, at = np.take_along_axis(both, least, 1), np.take_along_axis(at, least, 1)
        used, place = np.unique(at, return_inverse=True)
        self.rows, self.hashes, self.at = every.iloc[used].reset_index(drop=True), both, place.reshape(at.shape)

    def frame(self) -> pd.DataFrame:
        out = self.rows.iloc[self.at.ravel()].reset_index(drop=True)
        return out.assign(tree=np.repeat(np.arange(self.trees), self.at.shape[1]), _u=self.hashes.ravel())


def _samples(rows: DataFrame, trees: int, seed: int, sample: int = SAMPLE) -> DataFrame:
    """The `sample` rows with the least hashes per (city, tree), all rows of a smaller city.

    A task hands on what it has least of, at most `sample` rows a city and tree; the least of
    these are the least of all."""
    columns = ["city_id", "date", "_n", *FEATURES]

    def least(frames):
        held: dict[int, Least] = {}
        for frame in frames:
            for at in range(0, len(frame), PIECE):
                for city, part in frame.iloc[at : at + PIECE].groupby("city_id", sort=False):
                    days = pd.to_datetime(part["date"]).to_numpy().astype("datetime64[D]").astype(np.int64)
                    held.setdefault(int(city), Least(sample, trees)).add(part.reset_index(drop=True), row_hashes(int(city), days, trees, seed))
                if len(held) > CITIES:
                    yield from (x.frame() for x in held.values())
                    held.clear()
        yield from (x.frame() for x in held.values())

    slim = rows.select("city_id", "date", F.col("_n").cast("long").alias("_n"), *[F.col(c).cast("double").alias(c) for c in FEATURES])
    kinds = "city_id int, date date, _n long, " + ", ".join(f"{c} double" for c in FEATURES) + ", tree long, _u long"
    order = F.row_number().over(Window.partitionBy("city_id", "tree").orderBy("_u", "date"))
    return slim.mapInPandas(least, kinds).withColumn("_k", order).filter(F.col("_k") <= sample).select("city_id", F.col("tree").cast("int").alias("tree"), *columns[1:])


def scores(ds: Dataset, trees: int = 200, seed: int = 42, sample: int = SAMPLE) -> DataFrame:
    """Score per row, higher is more ordinary (the negative of the anomaly score).

    `sample` is the number of rows that a tree is grown from."""
    rows = filled(ds).select("city_id", "date", *MEASURES)
    sizes = rows.groupBy("city_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= MIN_ROWS)
    sized = rows.join(sizes, "city_id")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tree", "date"])
        city, chunk, n = int(pdf["city_id"].iloc[0]), int(pdf["chunk"].iloc[0]), int(pdf["_n"].iloc[0])
        rng = np.random.default_rng([seed, chunk, city & 0xFFFFFFFF])
        depth = int(np.ceil(np.log2(max(min(sample, n), 2))))
        names, slot = np.unique(pdf["tree"].to_numpy(), return_inverse=True)
        nodes = grow(pdf[list(FEATURES)].to_numpy(dtype=float), slot, len(names), rng, depth)
        return pd.DataFrame({"city_id": city, "tree": names, **{k: list(v) for k, v in zip(("feature", "cut", "path"), nodes)}})

    drawn = _samples(sized, trees, seed, sample).withColumn("chunk", F.floor(F.col("tree") / CHUNK))
    forest = written(drawn.groupBy("city_id", "chunk").applyInPandas(build, TREE), "forest")
    buckets = F.ceil(F.col("_n") / BUCKET).cast("int")
    placed = sized.withColumn("bucket", F.pmod(F.xxhash64("date"), buckets).cast("int"))
    copies = forest.join(sizes, "city_id").withColumn("bucket", F.explode(F.sequence(F.lit(0), buckets - 1)))

    def score(data: pd.DataFrame, grown: pd.DataFrame) -> pd.DataFrame:
        if data.empty:
            return pd.DataFrame({"city_id": [], "date": [], "score": []})
        points, n = data[list(FEATURES)].to_numpy(dtype=float), int(data["_n"].iloc[0])
        grown = grown.sort_values("tree")
        nodes = [np.array(grown[c].tolist()) for c in ("feature", "cut", "path")]
        depth = mean_depth(points, *nodes)
        return pd.DataFrame(
            {"city_id": data["city_id"], "date": data["date"], "score": -np.power(2.0, -depth / float(mean_path(min(sample, n))))}
        )

    paired = placed.groupBy("city_id", "bucket").cogroup(copies.drop("_n").groupBy("city_id", "bucket"))
    return paired.applyInPandas(score, "city_id int, date date, score double")


def flagged(ds: Dataset, contamination: float = 0.05, trees: int = 200, seed: int = 42, sample: int = SAMPLE) -> DataFrame:
    """Every row with its score relative to the cut and whether it is anomalous.

    Forest and flags are made once per state of the input and parameters."""
    return kept(ds, "flagged", (contamination, trees, seed, sample), lambda: flags(ds, written(scores(ds, trees, seed, sample), "scores"), contamination))


def flags(ds: Dataset, scored: DataFrame, contamination: float) -> DataFrame:
    """Given scores (city_id, date, score) less the cut of their city, with the readings."""
    cut = percentiles(scored, ["city_id"], "score", {"cut": contamination})
    rows = scored.join(cut, "city_id").withColumn("score", F.col("score") - F.col("cut")).drop("cut")
    joined = rows.join(filled(ds), ["city_id", "date"])
    return joined.withColumn("anomaly", F.col("score") < 0)


def _levels(rows: DataFrame, k: float) -> DataFrame:
    return rows.groupBy("city_id").agg((F.avg("aqi_daily") + k * F.stddev_samp("aqi_daily")).alias("threshold"))


def thresholds(ds: Dataset, k: float = 2) -> DataFrame:
    """Mean + k sample deviations per city and the days above it, to compare with the forest."""
    rows = filled(ds).select("city_id", "aqi_daily")
    out = rows.join(_levels(rows, k), "city_id").groupBy("city_id").agg(
        rounded(F.first("threshold"), 1).alias("sql_threshold"), count_when(F.col("aqi_daily") > F.col("threshold")).alias("days_above")
    )
    return named(out, ds).orderBy("city")


def anomaly_report(ds: Dataset, contamination: float = 0.05, trees: int = 200, k: float = 2, sample: int = SAMPLE) -> DataFrame:
    """Counts and rate per city; `ml_extra_detections` are anomalies at or under
    mean + k sample deviations."""
    return report(ds, flagged(ds, contamination, trees, sample=sample), k)


def report(ds: Dataset, rows: DataFrame, k: float = 2) -> DataFrame:
    """The counts of flagged rows; a city that has none of them is listed with the reason."""
    found = rows.join(_levels(rows, k), "city_id").groupBy("city_id").agg(
        count_when(F.col("anomaly")).alias("anomalies_detected"),
        rounded(count_when(F.col("anomaly")) * 100.0 / F.count(F.lit(1)), 2).alias("anomaly_rate"),
        rounded(F.first("threshold"), 1).alias("sql_threshold"),
        count_when(F.col("anomaly") & (F.col("aqi_daily") <= F.col("threshold"))).alias("ml_extra_detections"),
        F.lit("ok").alias("status"),
    )
    sizes = ds.readings.groupBy("city_id").agg(F.count(F.lit(1)).alias("total_points"))
    out = sizes.join(found, "city_id", "left").withColumn("status", F.coalesce("status", F.lit(TOO_FEW)))
    return named(out, ds).orderBy("city")


def anomaly_days(ds: Dataset, contamination: float = 0.05, trees: int = 200, first: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """All anomalous days of each city, or the first ones by date."""
    hits = flagged(ds, contamination, trees, sample=sample).filter("anomaly")
    by_date = F.row_number().over(Window.partitionBy("city_id").orderBy("date"))
    chosen = hits if first is None else hits.withColumn("_k", by_date).filter(F.col("_k") <= first)
    out = chosen.select(
        "city_id", "date", rounded("aqi_daily", 1).alias("aqi"), rounded("pm25", 1).alias("pm25"), rounded("pm10", 1).alias("pm10"), rounded("score", 4).alias("score")
    )
    return named(out, ds).orderBy("city", "date")


def anomaly_summary(ds: Dataset, contamination: float = 0.05, trees: int = 200, sample: int = SAMPLE) -> DataFrame:
    rows = anomaly_report(ds, contamination, trees, sample=sample)
    return rows.select("city", "anomaly_rate", "anomalies_detected", "status").orderBy(F.desc("anomaly_rate"), "city")


def score_shape(ds: Dataset, contamination: float = 0.05, trees: int = 200, sample: int = SAMPLE) -> DataFrame:
    """Median score of the anomalies per city and the most anomalous day."""
    hits = flagged(ds, contamination, trees, sample=sample).filter("anomaly")
    medians = percentiles(hits, ["city_id"], "score", {"median_score": 0.5})
    worst = hits.groupBy("city_id").agg(F.min_by(F.struct("date", "aqi_daily", "score"), F.struct("score", "date")).alias("w"))
    out = medians.join(worst, "city_id").select(
        "city_id", rounded("median_score", 4).alias("median_score"), F.col("w.date").alias("worst_date"), rounded("w.score", 4).alias("worst_score")
    )
    return named(out, ds).orderBy("median_score", "city")


