"""Percentiles among very many close values, and episodes that span years, against plain loops."""

import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from airloom.operators.episodes import episodes
from airloom.operators.quantile import around, counted, percentiles

DAY = datetime.date(2015, 6, 1)


def test_a_bin_of_very_many_values_is_cut_until_its_parts_are_small(spark):
    # a million different values within one 1/65536 of an octave, and a cluster of them in 2 ** -20 of that
    n = 1_000_000
    close = F.when(F.col("id") % 2 == 0, F.col("id") * F.lit(2.0**-51)).otherwise(F.col("id") * F.lit(2.0**-37))
    df = spark.range(n).select(F.lit("a").alias("k"), (1 + close).alias("v"))
    df = df.union(spark.range(n // 4).select(F.lit("b"), F.lit(-7.5))).union(spark.sql("select 'c', cast(null as double)"))
    small = 500
    near = around(counted(df, ["k"], ["v"]), ["k", "_measure"], [0.25, 0.5, 0.9], small)
    assert near.agg(F.max("_values")).first()[0] <= small
    assert near.count() <= 2 * 3 * small
    got = {r["k"]: (r["p25"], r["p50"], r["p90"]) for r in percentiles(df, ["k"], "v", {"p25": 0.25, "p50": 0.5, "p90": 0.9}).collect()}
    ids = np.arange(n)
    values = 1 + np.where(ids % 2 == 0, ids * 2.0**-51, ids * 2.0**-37)
    assert got == {"a": tuple(float(np.quantile(values, p)) for p in (0.25, 0.5, 0.9)), "b": (-7.5,) * 3}


def test_percentiles_do_not_depend_on_the_size_of_the_parts(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xxxy"), rng.choice([0.0, -1.5, 2.0, rng.gauss(0, 1), rng.uniform(-1e-9, 1e-9), rng.gauss(0, 1) * 1e30])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"low": 0.0, "q": 0.31, "m": 0.5, "high": 1.0}
    from airloom.operators.quantile import percentiles_of

    want = {k: [np.quantile([v for g, v in rows if g == k], p) for p in shares.values()] for k in "xy"}
    for small in (2, 10, 10_000):
        got = {r["k"]: [r[n] for n in shares] for r in percentiles_of(df, ["k"], {"v": shares}, small).collect()}
        assert set(got) == {"x", "y"}
        for k in got:
            assert np.allclose(got[k], want[k], rtol=1e-12, atol=0)
    assert percentiles_of(df.where("false"), ["k"], {"v": shares}, 2).collect() == []


def scan(rows):
    """Start and end of each episode of (opens, closes) rows, by a plain loop."""
    out, state = [], None
    for at, (opens, closes) in enumerate(rows, 1):
        if closes:
            if state is not None:
                out.append((state, at))
            state = None
        if opens and state is None:
            state = at
    return out


def test_episodes_equal_a_plain_scan_over_years(spark):
    rng = random.Random(8)
    table, want = [], set()
    for key, days, often, rare in (("hot", 2200, 0.2, 0.1), ("long", 2500, 0.01, 0.0), ("both", 800, 0.4, 0.6), ("open", 900, 0.01, 0.0), ("one", 1, 1.0, 1.0)):
        marks = []
        for d in range(days):
            if rng.random() < 0.85 or key == "one":
                opens, closes = rng.random() < often, rng.random() < rare or key == "long" and d // 10 in (1, 90, 91, 230)
                marks.append((opens, closes))
                table.append((key, DAY + datetime.timedelta(days=d), opens, closes if closes or rng.random() < 0.5 else None))
        want |= {(key, a, b) for a, b in scan(marks)}
    df = spark.createDataFrame(table, "k string, date date, o boolean, c boolean")
    got = [tuple(r) for r in episodes(df, ["k"], F.col("o"), F.col("c")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(k == "long" and b - a > 400 for k, a, b in want)  # states cross whole years
    assert episodes(df.where("false"), ["k"], F.col("o"), F.col("c")).collect() == []
