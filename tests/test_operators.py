"""Blocked operators against plain loops over each series."""

import itertools
import statistics

import numpy as np
from pyspark.sql import functions as F

from airloom.operators import runs, series
from airloom.operators.clean import backfill_across, interpolate
from airloom.operators.quantile import percentiles
from airloom.operators.ranking import ranked

CITY = ["city_id"]


def by_city(rows):
    rows = sorted(rows, key=lambda r: r[:2])
    return {c: list(g) for c, g in itertools.groupby(rows, key=lambda r: r[0])}


def test_positions_and_totals(ragged):
    df, rows = ragged
    got = {(r.city_id, r.date): (r.pos, r.n) for r in series.numbered(df, CITY, total="n").collect()}
    want = {(c, r[1]): (i + 1, len(g)) for c, g in by_city(rows).items() for i, r in enumerate(g)}
    assert got == want


def test_previous_row_crosses_years(ragged):
    df, rows = ragged
    got = {(r.city_id, r.date): r.prev_pm25 for r in series.previous_row(df, CITY, ["pm25"]).collect()}
    want = {(c, r[1]): (g[i - 1][6] if i else None) for c, g in by_city(rows).items() for i, r in enumerate(g)}
    assert got == want


def test_next_and_previous_match(ragged):
    df, rows = ragged
    rare = F.col("aqi_daily") > 495
    nxt = {(r.city_id, r.date): r.m for r in series.next_match(df, CITY, rare, "m").collect()}
    prv = {(r.city_id, r.date): r.m for r in series.previous_match(df, CITY, rare, "m").collect()}
    for c, g in by_city(rows).items():
        hits = [r[1] for r in g if r[7] > 495]
        for r in g:
            assert nxt[c, r[1]] == min((h for h in hits if h > r[1]), default=None)
            assert prv[c, r[1]] == max((h for h in hits if h < r[1]), default=None)


def test_trailing_with_small_blocks(ragged):
    df, rows = ragged
    out = series.trailing(df, CITY, 6, {"n": lambda w: F.count(F.lit(1)).over(w), "s": lambda w: F.sum("aqi_daily").over(w)}, block_rows=10)
    got = {(r.city_id, r.date): (r.n, round(r.s, 4)) for r in out.collect()}
    for c, g in by_city(rows).items():
        for i, r in enumerate(g):
            part = [x[7] for x in g[max(i - 6, 0) : i + 1]]
            assert got[c, r[1]] == (len(part), round(sum(part), 4))


def test_row_and_calendar_runs(ragged):
    df, rows = ragged
    cond = F.col("aqi_daily") > 60
    got_rows = sorted((r.city_id, r.start, r.length) for r in runs.row_runs(df, CITY, cond).collect())
    got_days = sorted((r.city_id, r.start, r.length) for r in runs.calendar_runs(df, CITY, cond).collect())
    want_rows, want_days = [], []
    for c, g in by_city(rows).items():
        for flag, part in itertools.groupby(g, key=lambda r: r[7] > 60):
            if flag:
                part = list(part)
                want_rows.append((c, part[0][1], len(part)))
        days = [r[1] for r in g if r[7] > 60]
        for _, part in itertools.groupby(enumerate(days), key=lambda t: t[1].toordinal() - t[0]):
            part = [d for _, d in part]
            want_days.append((c, part[0], len(part)))
    assert got_rows == sorted(want_rows)
    assert got_days == sorted(want_days)


def test_runs_stitch_a_whole_year(make):
    """A run that covers a full calendar year joins three blocks."""
    import datetime

    start = datetime.date(2019, 12, 30)
    ds = make({"A": [((start + datetime.timedelta(days=i)).isoformat(), 450) for i in range(370)]})
    assert [r.length for r in runs.calendar_runs(ds.readings, CITY, F.col("aqi_daily") > 400).collect()] == [370]
    assert [r.length for r in runs.row_runs(ds.readings, CITY, F.col("aqi_daily") > 400).collect()] == [370]


def test_percentiles_are_exact(spark, ragged):
    df, rows = ragged
    got = {r.city_id: (r.a, r.b, r.c) for r in percentiles(df, CITY, "pm25", {"a": 0.1, "b": 0.5, "c": 0.95}).collect()}
    for c, g in by_city(rows).items():
        values = [r[6] for r in g if r[6] is not None]
        if values:
            assert np.allclose(got[c], np.percentile(values, [10, 50, 95]))
    whole = percentiles(df, [], "pm25", {"m": 0.5}).first().m
    assert abs(whole - statistics.median(r[6] for r in rows if r[6] is not None)) < 1e-9


def test_percentiles_with_ties_negatives_and_one_value(spark):
    values = [-5.0] * 1000 + [-1.25, 0.0, 0.0, 3.5, 3.5000001, 1e9]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, 7.0)], "k int, v double")
    got = {r.k: (r.a, r.b, r.c) for r in percentiles(df, ["k"], "v", {"a": 0.0, "b": 0.9975, "c": 1.0}).collect()}
    assert np.allclose(got[1], np.percentile(values, [0, 99.75, 100]))
    assert got[2] == (7.0, 7.0, 7.0)


def test_interpolation_equals_pandas(ragged):
    import pandas as pd

    df, rows = ragged
    got = {(r.city_id, r.date): (r.pm25, r.o3) for r in interpolate(df, CITY, ["pm25", "o3"]).collect()}
    for c, g in by_city(rows).items():
        frame = pd.DataFrame({"p": [r[6] for r in g], "o": [r[4] for r in g]}, dtype=float).interpolate(method="linear", limit_direction="both")
        for r, p, o in zip(g, frame.p, frame.o):
            assert np.allclose(np.array(got[c, r[1]], dtype=float), (p, o), equal_nan=True)


def test_backfill_takes_next_then_previous_city(spark):
    rows = [("a", None), ("b", 1.0), ("c", None), ("d", None), ("e", 5.0), ("f", None)]
    df = spark.createDataFrame([(n, i, v) for i in (1, 2) for n, v in rows], "city string, k int, v double").selectExpr(
        "city", "date_add(date'2020-01-01', k) as date", "v + k as v"
    )
    got = {(r.city, r.date.day): r.v for r in backfill_across(df, "city", ["v"], rows=2).collect()}
    # next city's first value, else the previous city's last value
    assert {n: got[n, 2] for n in "acdf"} == {"a": 2.0, "c": 6.0, "d": 6.0, "f": 7.0}


def test_ranks_are_distinct_and_ordered(spark):
    df = spark.createDataFrame([("c", 5), ("a", 5), ("b", 1), ("d", 9)], "name string, v int")
    assert {r.name: r["rank"] for r in ranked(df, "v", "name").collect()} == {"b": 1, "a": 2, "c": 3, "d": 4}


def test_percentile_bins_spread_ties_and_small_values(spark):
    """Neither ties nor a small scale put many counted values into one bin."""
    import numpy as np

    from airloom.operators.quantile import counted, percentiles_of

    rng = np.random.default_rng(1)
    tied = [5.0] * 9000 + rng.uniform(0, 10, 1000).tolist()
    small = (rng.uniform(1e-6, 2e-6, 9990) * rng.choice([-1, 1], 9990)).tolist() + [0.0] * 10
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(tied, small)], "k int, tied double, small double")
    values = counted(df, ["k"], ["tied", "small"])
    assert values.where("_measure = 'tied'").count() == len(set(tied))
    assert values.groupBy("_measure", "_bin").count().agg({"count": "max"}).first()[0] <= 1000 // 10
    got = percentiles_of(df, ["k"], {"tied": {"a": 0.5, "b": 0.97}, "small": {"c": 0.1, "d": 0.5, "e": 0.9}}).first()
    want = [*np.quantile(tied, [0.5, 0.97]), *np.quantile(small, [0.1, 0.5, 0.9])]
    assert np.allclose(list(got)[1:], want, rtol=1e-12, atol=0)


def test_keyed_append_takes_each_key_once(spark, tmp_path):
    from airloom.sources.files import append_keyed

    path = str(tmp_path / "keyed")
    batch = spark.createDataFrame([(1, 5.0), (1, 7.0), (2, None)], "k int, v double")
    append_keyed(batch, path, ["k"])
    append_keyed(spark.createDataFrame([(2, 1.0), (3, 1.0), (3, 0.5)], "k int, v double"), path, ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, 5.0), (2, None), (3, 0.5)]


def test_shared_folder_needs_a_setting_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from airloom.sources.scratch import shared_folder

    def session(master, named):
        conf = {"spark.checkpoint.dir": named} if named else {}
        context = SimpleNamespace(master=master, applicationId=master, getConf=lambda: conf)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=context)

    assert shared_folder(session("yarn", "hdfs:///x/")) == "hdfs:///x"
    assert shared_folder(session("local[2]", None)) == shared_folder(session("local[2]", None))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master, None))


def test_years_and_short_cities_stay(make):
    from airloom.plans import offline

    ds = make({"Long": [(f"2010-01-{d:02d}", 450) for d in range(1, 32)] + [("2011-02-01", 100)], "Short": [("2012-05-01", 10)] * 1})
    assert [(r["city"], r["year"], r["streak"]) for r in offline.streak_table(ds).collect()] == [("Long", 2010, 31), ("Long", 2011, 0), ("Short", 2012, 0)]
    assert {r["city"]: r["status"] for r in offline.dominant(ds).collect()} == {"Long": "ok", "Short": "insufficient data"}
    assert offline.season_ratio(ds).count() == 0


def test_intermediate_tables_can_be_cleared(spark, monkeypatch, tmp_path):
    import os

    from airloom.sources import scratch

    monkeypatch.setattr(scratch, "shared_folder", lambda s: str(tmp_path))
    kept = scratch.written(spark.range(3), "some")
    assert kept.count() == 3 and os.listdir(tmp_path / "airloom")
    scratch.clear(spark)
    assert os.listdir(tmp_path / "airloom") == []
