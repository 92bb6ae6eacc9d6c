"""Properties of the models, which have no SQL twin."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from airloom.models import anomaly, cluster, forecast
from airloom.operators.search import expanded, query_tokens, search, STOP_WORDS
from airloom.sources.files import ResultStore
from airloom.sources.scratch import fresh_path
from airloom.sources.tables import Dataset
from airloom.streaming.live import live_batch, run_live
from tests.conftest import SMALL


def test_holt_winters_follows_trend_and_season():
    t = np.arange(400)
    y = 100 + 0.1 * t + 20 * np.sin(2 * np.pi * t / 30)
    ahead = np.arange(400, 460)
    out = forecast.holt_winters(y, 60, season=30)
    assert np.abs(out - (100 + 0.1 * ahead + 20 * np.sin(2 * np.pi * ahead / 30))).max() < 3


def test_short_series_repeat():
    assert list(forecast.repeat_last(np.array([1.0, 2.0, 3.0]), 2)) == [2.0, 3.0]
    assert list(forecast.repeat_last(np.array([1.0, 3.0]), 3)) == [2.0, 2.0, 2.0]


def test_forecast_dates_band_and_reason(small, make):
    rows = forecast.forecasts(small, steps=40).filter("date is not null")
    stats = rows.groupBy("city_id").agg(F.count("*").alias("n"), F.min("date").alias("d")).collect()
    last = {r.city_id: r.d for r in small.readings.groupBy("city_id").agg(F.max("date").alias("d")).collect()}
    assert stats and all(r.n == 40 and (r.d - last[r.city_id]).days == 1 for r in stats)
    assert rows.filter("forecast < 0 or forecast > 600 or lower > forecast or upper < forecast").count() == 0
    tiny = make({"A": [("2020-01-01", 1)]})
    assert [r.model for r in forecast.forecasts(tiny).collect()] == [forecast.TOO_SHORT]


def test_trees_isolate_an_outlier():
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(size=(255, 6)), np.full((1, 6), 12.0)])
    stacked, tree = np.vstack([points] * 20), np.repeat(np.arange(20), 256)
    depth = anomaly.mean_depth(points, *anomaly.grow(stacked, tree, 20, rng, 8))
    assert depth.argmin() == 255


def test_tree_paths_equal_a_walk():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(64, 3))
    feature, cut, path = anomaly.grow(points, np.zeros(64, dtype=int), 1, rng, 6)
    for p, d in zip(points, anomaly.mean_depth(points, feature, cut, path)):
        node = 0
        while feature[0, node] >= 0:
            node = 2 * node + 1 + (p[feature[0, node]] > cut[0, node])
        assert path[0, node] == d


def test_anomaly_rate_and_repeatability(small):
    rows = anomaly.anomaly_report(small, trees=40).collect()
    fitted, short = [r for r in rows if r.status == "ok"], [r for r in rows if r.status != "ok"]
    assert fitted and all(r.anomaly_rate <= 15 and abs(r.anomalies_detected - 0.05 * r.total_points) <= 2 for r in fitted)
    # a short city is listed with the reason, and has no figures
    assert all(r.total_points < anomaly.MIN_ROWS and r.anomaly_rate is None and r.status == anomaly.TOO_FEW for r in short)
    again = Dataset(small.readings, small.cities)  # without a state nothing is kept: the forest is grown again
    assert rows == anomaly.anomaly_report(again, trees=40).collect()


def test_sample_is_bounded_and_per_tree(spark, small):
    rows = small.readings.withColumn("_n", F.lit(3000)).fillna(0.0)
    counts = anomaly._samples(rows, 10, 1).groupBy("city_id", "tree").count()
    assert counts.agg(F.max("count")).first()[0] <= anomaly.SAMPLE


def test_samples_of_a_long_series_are_the_least_hashes(spark):
    """One rule at every size, whatever the partitions; more trees' worth of rows than any pool."""
    import datetime

    n, trees, sample = 20_000, 7, 64
    days = spark.range(n).select(
        (F.col("id") % 2 * F.when(F.col("id") % 9 == 0, 1).otherwise(0)).cast("int").alias("city_id"), F.expr("date_add(date'1900-01-01', cast(id as int))").alias("date"), F.lit(n).alias("_n"),
        *[F.col("id").cast("double").alias(c) for c in anomaly.FEATURES],
    )
    got = {}
    for r in anomaly._samples(days.repartition(5), trees, 3, sample).collect():
        got.setdefault((r.city_id, r.tree), set()).add(r.date)
    first = datetime.date(1900, 1, 1)
    since = (first - datetime.date(1970, 1, 1)).days
    for city in (0, 1):
        mine = np.array([i for i in range(n) if (i % 2 if i % 9 == 0 else 0) == city])
        hashes = anomaly.row_hashes(city, mine + since, trees, 3)
        for t in range(trees):
            least = mine[np.argsort(hashes[:, t])[:sample]]
            assert got[city, t] == {first + datetime.timedelta(days=int(i)) for i in least}
    assert len({tuple(sorted(v)) for v in got.values()}) == 2 * trees


def test_kmeans_finds_the_best_split(spark):
    points = {"a": (0, 0), "b": (0, 1), "c": (9, 9), "d": (9, 8), "e": (20, 0)}
    z = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in points.items()], "city string, x double, y double")
    fits = cluster.fit_all(z, ("x", "y"), range(2, 4))
    data = np.array(list(points.values()), dtype=float)

    def cost(labels, k):
        return sum(((data[np.array(labels) == i] - data[np.array(labels) == i].mean(axis=0)) ** 2).sum() for i in range(k) if i in labels)

    for k in (2, 3):
        best = min(cost(labels, k) for labels in itertools.product(range(k), repeat=5))
        assert fits[k][0] == pytest.approx(best)


def test_knee():
    assert cluster.knee([100, 40, 35, 33], 5) == 3
    assert cluster.knee([100, 90, 20, 18, 17], 6) == 4
    assert cluster.knee([10, 5], 3) == 3


def test_clusters_are_ordered_and_named(small):
    rows = cluster.clusters(small, k=3).collect()
    means = {}
    for r in rows:
        means.setdefault(r.cluster, []).append(r.avg_aqi)
        assert r.cluster_name == cluster.SEVERITY[r.cluster]
    assert sorted(means) == [0, 1, 2]


def test_components_explain_at_most_all(small):
    r = cluster.components(small).first()
    assert 0 < r.explained_2 <= r.explained_1 and r.explained_1 + r.explained_2 <= 1.0001


@pytest.mark.parametrize("query", ["winter smog", "Which cities have no2 in it?", "what is the", "area risk air", "stable"])
def test_search_equals_a_plain_scan(spark, query):
    texts = ["Cold air in december!", "The vehicles; at_home", "nothing", "a state of emergency", "high quality, low gas", "what is the", "rea is k"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id int, text string, source string")
    got = {r.doc_id: r.score for r in search(docs, query).collect()}
    import re

    tokens = query_tokens(query)
    for i, text in enumerate(texts):
        words = [w for w in re.sub(r"[^a-z0-9_\s]", "", f"{text} s".lower()).split() if w not in STOP_WORDS]
        target = expanded(words)
        score = 1.0 if not tokens else sum(any(t in x or x in t for x in target) for t in expanded(tokens)) / len(tokens)
        if tokens and query.lower() in text.lower():
            score += 1
        assert (got.get(i) == round(score, 6)) if score > 0.2 else i not in got


def test_stream_equals_batch(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    assert sorted(run_live(spark, SMALL).collect()) == sorted(live_batch(events).collect())


def test_result_store_keeps_and_expires(spark):
    now, calls = [1000.0], []
    store = ResultStore(spark, fresh_path(spark, "store"), ttl=120, clock=lambda: now[0])

    def build():
        calls.append(1)
        return spark.range(len(calls))

    assert store.get("x", {"a": 1}, build).count() == 1
    now[0] += 100
    assert store.get("x", {"a": 1}, build).count() == 1 and len(calls) == 1
    now[0] += 100
    assert store.get("x", {"a": 1}, build).count() == 2 and len(calls) == 2
    assert store.sweep("x", {"a": 1}) == 1
    assert store.get("x", {"a": 1}, build).count() == 2


def test_publish_goes_on_after_a_failure(spark, small):
    from airloom.plans import named
    from airloom.sources.publish import publish

    folder = fresh_path(spark, "published")
    plans = {"q29": named.seasonal_drop, "broken": lambda ds: ds.readings.select(F.raise_error(F.lit("no such sensor")))}
    done = {r.query: r.error for r in publish(spark, small, folder, plans).collect()}
    assert done["q29"] is None and done["broken"]
    assert spark.read.json(f"{folder}/q29").count() == named.seasonal_drop(small).count()
    assert spark.read.json(f"{folder}/broken").columns == ["error", "query"]
    assert spark.read.json(f"{folder}/metadata").count() == 1


def test_changed_input_is_loaded_again(spark, tmp_path):
    from airloom.sources.tables import load

    source, target = SMALL, str(tmp_path)
    for name in ("nation", "region", "customer", "orders", "lineitem"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{target}/{name}.parquet")
    first = load(spark, target).readings.count()
    spark.read.parquet(f"{source}/orders.parquet").limit(10).write.mode("overwrite").parquet(f"{target}/orders.parquet")
    assert load(spark, target).readings.count() <= 10 < first


def test_shared_folder_setting_is_read(spark):
    from airloom.sources.scratch import shared_folder

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_folder(spark) == (named.rstrip("/") if named else shared_folder(spark))
