"""Additive smoothing (level, trend, season) of series that are cut into blocks.

One step maps (level, trend, season) to the next by an affine map, so the steps of a block
compose to one matrix, which does not depend on what came before.  A fit is three passes:

1. every block but the last of its series is composed to its map, all blocks side by side;
2. the maps of a series stream by in order and hand the state on, one map in memory at a time;
3. every block is walked from the state it was handed, again side by side; squared errors
   are summed over the blocks, and the best parameters are chosen.

A map has (season + 2)(season + 3) numbers, so blocks should be much longer than a season, and
the parameters are dealt to chunks of at most `NUMBERS` numbers of maps.  A series that fits into one
block needs no map.  No task holds a series longer than a block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.operators.series import numbered
from airloom.shipping import ship_package
from airloom.sources.scratch import written

#: Rows of a block, and numbers of the maps that a task composes at once.
BLOCK_ROWS, NUMBERS = 4096, 2_000_000
TRIPLE = "struct<a:double,b:double,g:double>"


# ---- one block, for some parameter triples at once; a state is level, trend and one number a slot


def start_state(head: np.ndarray, season: int, n: int) -> np.ndarray:
    """The state before the first value, from the first two seasons (values, without a season)."""
    if not season:
        return np.tile([head[0], head[1] - head[0]], (n, 1))
    first, second = head[:season], head[season : 2 * season]
    return np.tile(np.concatenate([[first.mean(), (second.mean() - first.mean()) / season], first - first.mean()]), (n, 1))


def walk(y: np.ndarray, first: int, season: int, state: np.ndarray, a: np.ndarray, b: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared error of `y`, whose first value has position `first`, and the state after it."""
    state, sse = state.T.copy(), np.zeros(a.shape)
    for t, value in enumerate(y, first):
        expected = state[0] + state[1]
        error = value - expected
        if season:
            slot = 2 + t % season
            error = error - state[slot]
            state[slot] += g * (1 - a) * error
        sse += error * error
        state[0] = expected + a * error
        state[1] += a * b * error
    return sse, state.T


def block_map(y: np.ndarray, first: int, season: int, a: np.ndarray, b: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The affine map of `walk` for each triple: a matrix with its constants in the last column."""
    size = season + 2
    rows = np.zeros((size, a.size, size + 1))
    rows[np.arange(size), :, np.arange(size)] = 1
    a, b, g = (x[:, None] for x in (a, b, g))
    for t, value in enumerate(y, first):
        expected = rows[0] + rows[1]
        error = -expected
        error[:, size] += value
        if season:
            slot = 2 + t % season
            error -= rows[slot]
            rows[slot] += g * (1 - a) * error
        rows[0] = expected + a * error
        rows[1] += a * b * error
    return rows.transpose(1, 0, 2)


def handed_on(maps: np.ndarray, state: np.ndarray) -> np.ndarray:
    return np.einsum("pij,pj->pi", maps[:, :, :-1], state) + maps[:, :, -1]


# ---- series of a table


def season_of(days: Column, season: int | None) -> Column:
    """The season that a series of so many days is fitted with: the given one, where two of them
    are there; with None a year, or up to 30 days for less than two years."""
    given = F.lit(365 if season is None else season)
    short = F.least(F.lit(30), F.expr("days div 2")) if season is None else F.lit(0)
    found = F.when(days >= 2 * given, given).otherwise(short)
    return F.when(found >= 2, found).otherwise(0).cast("int")


def prepared(series: DataFrame, season: int | None, block: int = BLOCK_ROWS, least: int = 2, last: int = 1) -> tuple[DataFrame, DataFrame]:
    """Blocks and cities of (city_id, date, value), both written.

    A city has its season, the first values that the start needs and its `last` last values; both
    are lists of a fixed bound.  Cities with fewer than `least` days are left out."""
    rows = numbered(series.select("city_id", "date", "value"), ["city_id"], total="days").filter(F.col("days") >= least)
    rows = rows.withColumn("season", season_of(F.col("days"), season)).withColumn("at", F.col("pos") - 1)
    rows = written(rows.select("city_id", "date", "value", "at", "days", "season", F.expr(f"at div {block}").alias("block")), "series")
    in_order = lambda kept: F.transform(F.sort_array(F.collect_list(F.when(kept, F.struct("at", "value")))), lambda v: v["value"])
    ends = rows.filter((F.col("at") < F.greatest(2 * F.col("season"), F.lit(2))) | (F.col("at") >= F.col("days") - last))
    cities = ends.groupBy("city_id", "days", "season").agg(
        in_order(F.col("at") < F.greatest(2 * F.col("season"), F.lit(2))).alias("head"), in_order(F.col("at") >= F.col("days") - last).alias("tail"), F.max("date").alias("last_day")
    )
    blocks = rows.groupBy("city_id", "block").agg(F.min("at").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda v: v["value"]).alias("values"))
    cities = cities.withColumn("last_block", F.expr(f"(days - 1) div {block}"))
    return written(blocks, "series-blocks"), written(cities, "series-cities")


def _triples(column) -> list[np.ndarray]:
    return [np.array([t[k] for t in column], dtype=float) for k in "abg"]


def _maps(frames):
    """The start of a series (as block -1) and the map of each block that has a next one."""
    for frame in frames:
        for row in frame.itertuples():
            abg = _triples(row.triples)
            rows = [(row.block, block_map(np.array(row.values, dtype=float), row.first, row.season, *abg))]
            if row.block == 0:
                rows.append((-1, start_state(np.array(row.head, dtype=float), row.season, abg[0].size)))
            yield pd.DataFrame([(row.city_id, row.chunk, n, row.season, x.tobytes()) for n, x in rows], columns=["city_id", "chunk", "block", "season", "numbers"])


def _carried(frames):
    """The state that each later block starts from; the rows of a series come in order."""
    state = None
    for frame in frames:
        for row in frame.itertuples():
            numbers, size = np.frombuffer(row.numbers), row.season + 2
            if row.block < 0:
                state = numbers.reshape(-1, size)
                continue
            state = handed_on(numbers.reshape(-1, size, size + 1), state)
            yield pd.DataFrame([(row.city_id, row.chunk, row.block + 1, state.tobytes())], columns=["city_id", "chunk", "block", "state"])


def _walked(frames):
    for frame in frames:
        for row in frame.itertuples():
            if row.block == 0:
                state = start_state(np.array(row.head, dtype=float), row.season, len(row.triples))
            else:
                state = np.frombuffer(row.state).reshape(-1, row.season + 2)
            with np.errstate(all="ignore"):
                sse, end = walk(np.array(row.values, dtype=float), row.first, row.season, state, *_triples(row.triples))
            ends = [e.tolist() for e in end] if row.block == row.last_block else None
            yield pd.DataFrame([(row.city_id, row.chunk, row.block, sse.tolist(), ends)], columns=["city_id", "chunk", "block", "sse", "ends"])


def best_of(blocks: DataFrame, cities: DataFrame, triples: DataFrame) -> DataFrame:
    """(city_id, a, b, g, sse, state): the parameters of the least squared error, of those that
    (city_id, triples) lists for each city; of equals the first."""
    ship_package(blocks.sparkSession)
    each = F.greatest(F.lit(1), F.expr(f"{NUMBERS} div ((season + 2) * (season + 3))"))
    listed = triples.join(cities, "city_id").withColumn("_each", F.when(F.col("last_block") == 0, F.size("triples")).otherwise(each).cast("int"))
    listed = listed.withColumn("chunk", F.explode(F.expr("sequence(0, (size(triples) - 1) div _each)"))).withColumn("triples", F.expr("slice(triples, cast(chunk * _each + 1 as int), _each)"))
    listed = listed.select("city_id", F.col("chunk").cast("int").alias("chunk"), "triples", "season", "head", "last_block")
    # little data and much work: tasks by number, which adaptive execution leaves apart
    spark = blocks.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    cells = blocks.join(listed, "city_id").repartition(tasks, "city_id", "block", "chunk")
    columns = ["city_id", "chunk", "block", "first", "season", "last_block", "triples", "values"]
    met = cells.filter("block = 0").select(*columns, "head", F.lit(None).cast("binary").alias("state"))
    if not cities.filter("last_block > 0").isEmpty():
        maps = cells.filter("block < last_block").select(*columns, "head").mapInPandas(_maps, "city_id int, chunk int, block long, season int, numbers binary")
        in_order = maps.repartition("city_id", "chunk").sortWithinPartitions("city_id", "chunk", "block")
        states = in_order.mapInPandas(_carried, "city_id int, chunk int, block long, state binary")
        later = cells.join(states, ["city_id", "chunk", "block"]).select(*columns, "head", "state")
        met = met.unionByName(later.repartition(tasks, "city_id", "block", "chunk"))
    walked = met.mapInPandas(_walked, "city_id int, chunk int, block long, sse array<double>, ends array<array<double>>")
    walked = written(walked, "smoothing-walks")
    errors = walked.select("city_id", "chunk", F.posexplode("sse").alias("i", "sse")).groupBy("city_id", "chunk", "i").agg(F.sum("sse").alias("sse"))
    # a fit that grew beyond all numbers comes last
    finite = F.when(F.isnan("sse") | F.col("sse").isNull(), F.lit(float("inf"))).otherwise(F.col("sse"))
    best = errors.groupBy("city_id").agg(F.min(F.struct(finite.alias("sse"), "chunk", "i")).alias("m")).select("city_id", "m.sse", "m.chunk", "m.i")
    named = best.join(listed.select("city_id", "chunk", "triples"), ["city_id", "chunk"]).join(walked.filter("ends is not null").select("city_id", "chunk", "ends"), ["city_id", "chunk"])
    chosen = F.element_at("triples", F.col("i") + 1)
    return named.select("city_id", *[chosen[k].alias(k) for k in "abg"], "sse", F.element_at("ends", F.col("i") + 1).alias("state"))


def grid(centre: dict[str, Column], width: float, steps: int = 5) -> Column:
    """All triples of `steps` values around a centre, cut to 0..1."""
    axis = lambda c: F.array_sort(
        F.array_distinct(F.array(*[F.greatest(F.lit(0.0), F.least(F.lit(1.0), c - width + k * (2 * width / (steps - 1)))) for k in range(steps)]))
    )
    axes = {k: axis(c) for k, c in centre.items()}
    triple = lambda a, b, g: F.struct(a.alias("a"), b.alias("b"), g.alias("g"))
    return F.flatten(F.transform(axes["a"], lambda a: F.flatten(F.transform(axes["b"], lambda b: F.transform(axes["g"], lambda g: triple(a, b, g))))))


def searched(blocks: DataFrame, cities: DataFrame, rounds: int = 3) -> DataFrame:
    """The best triple of a grid that is refined around its best cell."""
    centre, width, best = dict.fromkeys("abg", F.lit(0.5)), 0.5, cities
    for _ in range(rounds):
        best = written(best_of(blocks, cities, best.select("city_id", grid(centre, width).alias("triples"))), "smoothing-best")
        centre, width = {k: F.col(k) for k in "abg"}, width / 3
    return best
