"""Smoothing over blocks against the plain loop over the whole series."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from airloom.models import forecast, smoothing
from airloom.models.smoothing import best_of, block_map, handed_on, prepared, searched, start_state, walk

TRIPLES = [(0.3, 0.1, 0.2), (0.05, 0.0, 0.4), (1.0, 1.0, 0.0), (0.5, 0.5, 0.5)]


def series(days, seed):
    rng, t = np.random.default_rng(seed), np.arange(days)
    return 80 + 0.05 * t + 9 * np.sin(t * 2 * np.pi / 7) + rng.normal(size=days) * 5


@pytest.fixture(scope="module")
def table(spark):
    made = {1: series(400, 1), 2: series(61, 2), 3: series(90, 3)}
    first = datetime.date(2019, 11, 5)
    # days are missing: positions count rows, not days
    rows = [(c, first + datetime.timedelta(days=i + i // 9), float(v)) for c, y in made.items() for i, v in enumerate(y)]
    return made, spark.createDataFrame(rows, "city_id int, date date, value double").repartition(3)


def test_maps_of_blocks_compose_to_the_walk():
    y, abg = series(50, 4), [np.array(x) for x in zip(*TRIPLES)]
    for season in (0, 2, 7):
        start = start_state(y, season, len(TRIPLES))
        whole = walk(y, 0, season, start, *abg)[1]
        if not season:
            start = np.hstack([start, np.zeros((len(TRIPLES), 0))])
        state = start
        for at in range(0, 50, 13):
            state = handed_on(block_map(y[at : at + 13], at, season, *abg), state)
        assert np.allclose(state, whole)


@pytest.mark.parametrize("block", [5, 64, 5000])
@pytest.mark.parametrize("season", [0, 7])
def test_best_of_a_list_in_blocks_of_any_length(spark, table, block, season, monkeypatch):
    monkeypatch.setattr(smoothing, "NUMBERS", 200)  # several chunks of parameters
    made, rows = table
    blocks, cities = prepared(rows, season, block)
    assert blocks.filter(F.size("values") > block).count() == 0
    listed = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip("abg", p)]) for p in TRIPLES])
    got = {r.city_id: r for r in best_of(blocks, cities, cities.select("city_id", listed.alias("triples"))).collect()}
    abg = [np.array(x) for x in zip(*TRIPLES)]
    for c, y in made.items():
        sse, state = walk(y, 0, season, start_state(y, season, len(TRIPLES)), *abg)
        best = int(np.argmin(sse))
        assert (got[c].a, got[c].b, got[c].g) == TRIPLES[best]
        assert np.isclose(got[c].sse, sse[best]) and np.allclose(got[c].state, state[best])


def test_the_refined_grid_equals_the_loop_in_memory(spark, table):
    made, rows = table
    blocks, cities = prepared(rows, None, 37)
    season = {r.city_id: r.season for r in cities.collect()}
    assert season == {1: 30, 2: 30, 3: 30}
    for r in searched(blocks, cities).collect():
        y = made[r.city_id]
        out = forecast.ahead(np.array(r.state), len(y), season[r.city_id], 40)
        assert np.allclose(out, forecast.holt_winters(y, 40), rtol=1e-6)


def test_the_season_is_told_and_can_be_given(small):
    told = lambda **k: {r.season for r in forecast.forecasts(small, steps=5, **k).filter("date is not null").select("season").distinct().collect()}
    assert told(season=7) == {7} and told(season=0) == {0} and told(season=5000) == {0}
