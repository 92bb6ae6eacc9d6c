"""K-means over city profiles, all k and all restarts in one pass per iteration.

Ten restarts of nine values of k are ninety models.  Fitting them one after the
other reads the profiles some thousand times; here every iteration assigns each
row for all models at once, and only per-cluster sums leave the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.functions.numeric import rounded
from airloom.plans.features import PROFILE, city_profile
from airloom.sources.tables import Dataset, kept

# Cluster names from cleanest to worst; further clusters keep the last.
SEVERITY = (
    "Clean & Stable",
    "Moderate Seasonal",
    "High Pollution",
    "Severe/Volatile",
    "Extreme Chronic",
    "Hazardous (Level 6)",
    "Hazardous (Level 7)",
    "Hazardous (Level 8)",
)


def standardised(profile: DataFrame, columns=PROFILE) -> DataFrame:
    """Columns minus mean over population deviation (0 for a constant column)."""
    stats = profile.agg(
        *[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns]
    ).first()
    scaled = [((F.col(c) - F.lit(stats[f"{c}_m"])) / F.lit(stats[f"{c}_s"] or 1.0)).alias(c) for c in columns]
    return profile.select("city", *scaled)


def standardised_profile(ds: Dataset) -> DataFrame:
    """The scaled profiles the clusters are found on."""
    z = _prepared(ds)[1]
    return z.select("city", *[rounded(c, 6).alias(c) for c in PROFILE]).orderBy("city")


def _uniform(rows: np.ndarray, *salt: int) -> np.ndarray:
    """A number in (0, 1) for each row hash, different for each salt."""
    x = rows.astype(np.uint64)
    for k in salt:
        x = (x ^ np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def spread_seeds(z: DataFrame, columns, models: list[tuple[int, int]], seed: int) -> dict[int, np.ndarray]:
    """Starting points of all models, each drawn from all rows by squared distance to those before it.

    Every step is one pass: a row's key is an exponential draw over its weight, and the
    row of the least key is taken, which each task can find for its own rows."""
    names = [f"x{i}" for i in range(len(columns))]
    chosen: dict[int, list[np.ndarray]] = {i: [] for i in range(len(models))}
    rows = z.select(*columns, F.xxhash64("city").alias("_row"))
    for step in range(max((k for k, _ in models), default=0)):
        now = {i: np.array(chosen[i]) for i, (k, _) in enumerate(models) if k > step}

        def draw(batches: Iterator[pd.DataFrame], step=step, now=now) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x, row = batch[list(columns)].to_numpy(dtype=float), batch["_row"].to_numpy().view(np.uint64)
                out = []
                for i, c in now.items():
                    weight = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2).min(axis=1) if step else np.ones(len(x))
                    k, r = models[i]
                    key = -np.log(_uniform(row, seed, k, r, step)) / np.maximum(weight, 1e-300)
                    at = int(key.argmin())
                    out.append((i, float(key[at]), int(row[at].astype(np.int64)), *x[at].tolist()))
                yield pd.DataFrame(out, columns=["model", "key", "row", *names])

        drawn = rows.mapInPandas(draw, "model int, key double, row long, " + ", ".join(f"{n} double" for n in names))
        best = drawn.groupBy("model").agg(F.min_by(F.struct(*names), F.struct("key", "row")).alias("x")).collect()
        for b in best:  # one row per model
            chosen[b["model"]].append(np.array(list(b["x"])))
    return {i: np.array(c) for i, c in chosen.items()}


def _iterate(z: DataFrame, columns, centres: dict[int, np.ndarray]) -> pd.DataFrame:
    """Per (model, cluster): count, squared error and coordinate sums."""
    names = [f"s{i}" for i in range(len(columns))]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[list(columns)].to_numpy(dtype=float)
            parts = []
            for model, c in centres.items():
                gap = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
                near = gap.argmin(axis=1)
                part = pd.DataFrame(x, columns=names).groupby(near).sum()
                part["n"] = np.bincount(near, minlength=len(c))[part.index]
                part["sse"] = np.bincount(near, weights=gap.min(axis=1), minlength=len(c))[part.index]
                parts.append(part.reset_index(names="cluster").assign(model=model))
            yield pd.concat(parts)[["model", "cluster", "n", "sse", *names]]

    schema = "model int, cluster int, n bigint, sse double, " + ", ".join(f"{n} double" for n in names)
    sums = z.mapInPandas(partial, schema).groupBy("model", "cluster").agg(*[F.sum(c).alias(c) for c in ("n", "sse", *names)])
    # One row per model and cluster: at most ninety times ten.
    return sums.toPandas()


def fit_all(z: DataFrame, columns, ks: range, restarts: int = 10, seed: int = 42) -> dict[int, tuple[float, np.ndarray]]:
    """Best (inertia, centres) for every k; every model moves until its centres stand still."""
    models = [(k, r) for k in ks for r in range(restarts)]
    centres = spread_seeds(z, columns, models, seed)
    inertia: dict[int, float] = {}
    moving = dict(centres)
    while moving:
        sums = _iterate(z, columns, moving)
        for model, part in sums.groupby("model"):
            inertia[model] = float(part["sse"].sum())
            new = centres[model].copy()
            new[part["cluster"]] = part[[c for c in part.columns if c.startswith("s") and c != "sse"]].to_numpy() / part[["n"]].to_numpy()
            if np.allclose(new, centres[model], rtol=0, atol=1e-9):
                moving.pop(model)
            else:
                moving[model] = new
            centres[model] = new
    best: dict[int, tuple[float, np.ndarray]] = {}
    for i, (k, _) in enumerate(models):
        if k not in best or inertia[i] < best[k][0]:
            best[k] = (inertia[i], centres[i])
    return best


def knee(inertias: list[float], max_k: int) -> int:
    """Largest second difference, offset to its k, kept within 3 and max_k."""
    second = np.diff(inertias, 2)
    return min(max(int(np.argmax(second)) + 3, 3), max_k) if len(second) else 3


def _prepared(ds: Dataset) -> tuple[DataFrame, DataFrame]:
    """Profiles and scaled profiles, written once per state of the input."""
    profile = kept(ds, "profile", (), lambda: city_profile(ds))
    return profile, kept(ds, "standardised", (), lambda: standardised(profile))


_fits: dict[tuple, dict[int, tuple[float, np.ndarray]]] = {}


def _fitted(ds: Dataset, z: DataFrame, ks: range) -> dict[int, tuple[float, np.ndarray]]:
    """fit_all, once per state of the input: at most ten times ten centres."""
    key = (ds.readings.sparkSession.sparkContext.applicationId, ds.state, ks.start, ks.stop)
    if not ds.state:
        return fit_all(z, PROFILE, ks)
    if key not in _fits:
        _fits[key] = fit_all(z, PROFILE, ks)
    return _fits[key]


def _ks(profile: DataFrame, max_k: int) -> range:
    return range(2, min(max_k, profile.count() - 1) + 1)


def elbow(ds: Dataset, max_k: int = 10) -> DataFrame:
    """Inertia per number of clusters."""
    profile, z = _prepared(ds)
    fits = _fitted(ds, z, _ks(profile, max_k))
    rows = [(k, round(fits[k][0], 6)) for k in sorted(fits)]
    return ds.readings.sparkSession.createDataFrame(rows, "k int, inertia double")


def clusters(ds: Dataset, k: int | None = None, max_k: int = 10) -> DataFrame:
    """Cities with their cluster, numbered and named from the lowest mean index."""
    profile, z = _prepared(ds)
    ks = _ks(profile, max_k)
    fits = _fitted(ds, z, ks if k is None else range(k, k + 1))
    if k is None:
        k = knee([fits[i][0] for i in ks], ks[-1])
    centres = fits[k][1]
    centres = centres[np.argsort(centres[:, 0], kind="stable")]
    gaps = F.array(
        *[
            F.struct(sum(((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(PROFILE, row)), F.lit(0.0)).alias("gap"), F.lit(i).alias("cluster"))
            for i, row in enumerate(centres)
        ]
    )
    names = F.array(*[F.lit(SEVERITY[min(i, len(SEVERITY) - 1)]) for i in range(k)])
    placed = z.select("city", F.array_min(gaps)["cluster"].alias("cluster"))
    shown = [rounded(c, 2).alias(c) for c in PROFILE]
    out = profile.join(placed, "city").select("city", "cluster", F.get(names, F.col("cluster")).alias("cluster_name"), *shown)
    return out.orderBy("cluster", "city")


def components(ds: Dataset, k: int = 2) -> DataFrame:
    """Coordinates on the first principal components and their share of variance."""
    _, z = _prepared(ds)
    vectors = VectorAssembler(inputCols=list(PROFILE), outputCol="x").transform(z)
    model = PCA(k=k, inputCol="x", outputCol="pc").fit(vectors)
    share = model.explainedVariance.toArray()
    at = vector_to_array("pc")
    return model.transform(vectors).select(
        "city",
        *[rounded(at[i], 6).alias(f"pc{i + 1}") for i in range(k)],
        *[F.lit(round(float(share[i]), 4)).alias(f"explained_{i + 1}") for i in range(k)],
    ).orderBy("city")


