"""Ranks, running sums and carried values over sampled ranges, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from airloom.operators.clean import backfill_across
from airloom.operators.ranges import RANGE, in_ranges, neighbours, numbered, running
from airloom.operators.ranking import ranked


@pytest.fixture(scope="module")
def rows():
    """A third of all rows has one key, many rows are equal, keys and values may be null."""
    rng = random.Random(3)
    keys = ["hot"] * 700 + [rng.choice(["a", "b", None, "é", ""]) for _ in range(1400)]
    return [(k, rng.choice([0, 0, 1, 5, rng.randrange(90), None]), i % 50) for i, k in enumerate(keys)]


def test_running_sums_of_hot_and_null_keys(spark, rows):
    df = spark.createDataFrame(rows, "k string, v long, o int")
    got = running(df, ["k"], ["o", "v"], F.col("v"), "s", rows=100).collect()
    assert len(got) == len(rows)
    want = []
    order = lambda r: (r[2], r[1] is not None, r[1] or 0)
    for key in {r[0] for r in rows}:
        total = 0
        for k, v, o in sorted((r for r in rows if r[0] == key), key=order):
            total += v or 0
            want.append((k, v, o, total))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_positions_are_distinct_within_a_key(spark, rows):
    df = spark.createDataFrame(rows, "k string, v long, o int")
    got = numbered(df, ["k"], ["o"], "n", rows=64).collect()
    for key in {r[0] for r in rows}:
        mine = sorted((r.n, r.o) for r in got if r.k == key)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1))
        assert [o for _, o in mine] == sorted(o for _, o in mine)


def test_ranges_stay_small_under_ties_and_copies(spark):
    df = spark.range(100_000).select((F.col("id") % 3).alias("v"), F.lit("x").alias("copy"))
    sizes = [r["count"] for r in in_ranges(df, ["v", "copy"], rows=1_000).groupBy(RANGE).count().collect()]
    assert len(sizes) >= 80 and max(sizes) <= 2_000 and sum(sizes) == 100_000


def test_ranks_of_many_values_with_ties(spark):
    df = spark.range(50_000).select(((F.col("id") * 7919) % 20_011).alias("v"), F.col("id").alias("name"))
    got = ranked(df, "v", "name", descending=True, rows=500).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: (-r.v, r.name))] == list(range(1, 50_001))


def test_nulls_rank_last_and_empty_tables_stay_empty(spark):
    df = spark.createDataFrame([("a", None), ("b", 2), ("c", None), ("d", 1)], "name string, v int")
    assert {r.name: r["rank"] for r in ranked(df, "v", "name").collect()} == {"d": 1, "b": 2, "a": 3, "c": 4}
    assert ranked(df.filter("false"), "v", "name").count() == 0


def test_neighbours_over_ranges(spark):
    rng = random.Random(5)
    values = [rng.random() if rng.random() < 0.02 else None for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: (r.b, r.a) for r in neighbours(df, ["i"], {"v": "b"}, {"v": "a"}, rows=50).collect()}
    for i in range(3000):
        before = next((v for v in reversed(values[:i]) if v is not None), None)
        after = next((v for v in values[i + 1 :] if v is not None), None)
        assert got[i] == (before, after)


def test_backfill_over_names_with_one_stem(spark):
    """Names that share their first twelve letters spread over the ranges."""
    n = 2000
    name = lambda i: f"station_east{i:06d}"
    known = {i: float(i) for i in range(n) if i % 7 == 3}
    df = spark.createDataFrame([(name(i), k, known.get(i)) for i in range(n) for k in (1, 2)], "city string, k int, v double").selectExpr("city", "date_add(date'2020-01-01', k) as date", "v + k as v")
    got = {r.city: r.v for r in backfill_across(df, "city", ["v"], rows=40).collect() if r.date.day == 2}
    for i in range(n):
        if i in known:
            want = known[i] + 1
        else:
            after = next((j for j in range(i, n) if j in known), None)
            want = known[after] + 1 if after is not None else known[max(known)] + 2
        assert got[name(i)] == want
