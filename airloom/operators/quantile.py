"""Exact interpolated percentiles without a task per group.

`percentile(x, p)` keeps every distinct value of a group in one task.  Here the
wanted ranks are found in four steps:

1. equal values are counted as one row (map-side combined), so ties meet no join;
2. the counts are summed per group and bin.  A bin keeps the order of the values
   and is 1/1024 of an octave wide at any scale, on both sides of zero;
3. only the values of bins that hold a wanted rank are kept.  A bin of more than
   SMALL different values is cut into PARTS equal parts from its least to its largest
   value, and again only the parts with a wanted rank are kept, until all are small.
   Two cuts are enough for any doubles, so this is a bounded number of passes;
4. the rank is read off inside the part.

Several measures go through the same pass as rows of (measure, value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.sources.scratch import written

OCTAVE_BINS = 1024
#: Different values that one window may order, and the parts a larger bin is cut into.
SMALL, PARTS = 100_000, 1 << 17
#: More than any logarithm of a double times OCTAVE_BINS.
_FAR = 1 << 40


def _bin(value: Column) -> Column:
    octave = F.floor(F.log2(F.abs(value)) * OCTAVE_BINS) + _FAR
    return F.when(value > 0, octave).when(value < 0, -octave).otherwise(F.lit(0)).cast("long")


def counted(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(keys, _measure, value, _bin, _n): every distinct non-null value once, with its number of rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("_measure"), F.col(m).cast("double").alias("value")) for m in measures])).alias("_c")
    rows = df.select(*keys, cells).select(*keys, "_c._measure", "_c.value").filter(F.col("value").isNotNull())
    return rows.groupBy(*keys, "_measure", "value").agg(F.count(F.lit(1)).alias("_n")).withColumn("_bin", _bin(F.col("value")))


def _holding(parts: DataFrame, ranks: Column) -> DataFrame:
    """Of parts with `_upto` rows up to and in them, those that hold one of the ranks."""
    return parts.filter(F.exists(ranks, lambda r: (r <= F.col("_upto")) & (r > F.col("_upto") - F.col("_in"))))


_SIZES = (F.sum, "_n", "_in"), (F.count, "value", "_values"), (F.min, "value", "_low"), (F.max, "value", "_high")


def _sizes() -> list[Column]:
    return [f(c).alias(name) for f, c, name in _SIZES]


def around(values: DataFrame, group: Sequence[str], shares: Sequence[float], small: int = SMALL) -> DataFrame:
    """The counted values near the wanted ranks, written: with `_under`, the rows below their
    part (it names the part within its group), `_total`, the rows of the group, and `_values`,
    the different values of the part, at most `small`."""
    at = [(F.col("_total") - 1) * F.lit(p) for p in shares]
    ranks = F.array(*[f(x) + 1 for x in at for f in (F.floor, F.ceil)])
    kept = ["_total", (F.col("_upto") - F.col("_in")).alias("_under"), "_values", "_low", "_high"]
    over = Window.partitionBy(*group)
    bins = values.groupBy(*group, "_bin").agg(*_sizes())
    bins = bins.withColumn("_upto", F.sum("_in").over(over.orderBy("_bin"))).withColumn("_total", F.sum("_in").over(over))
    near = written(values.join(_holding(bins, ranks).select(*group, "_bin", *kept), [*group, "_bin"]).drop("_bin"), "ranks")
    while (near.agg(F.max("_values")).first()[0] or 0) > small:
        share = (F.col("value") - F.col("_low")) / (F.col("_high") - F.col("_low"))
        cut = near.withColumn("_part", F.when(F.col("_values") > small, F.floor(share * PARTS)).otherwise(F.lit(0)))
        cut = cut.select(*group, "value", "_n", F.col("_under").alias("_from"), "_total", "_part")
        own = [*group, "_from"]
        parts = cut.groupBy(*own, "_total", "_part").agg(*_sizes())
        parts = parts.withColumn("_upto", F.col("_from") + F.sum("_in").over(Window.partitionBy(*own).orderBy("_part")))
        parts = _holding(parts, ranks).select(*own, "_part", *kept)
        near = written(cut.drop("_total").join(parts, [*own, "_part"]).drop("_from", "_part"), "ranks")
    return near


def percentiles_of(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, Mapping[str, float]], small: int = SMALL) -> DataFrame:
    """Linear-interpolated percentiles of several measures: the keys plus one column per
    entry of each measure's mapping.  With no keys: one row, or none on empty input.
    No window orders more than `small` different values (2 or more)."""
    own = list(keys) or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(1))
    group = [*own, "_measure"]
    shares = sorted({float(p) for ps in wanted.values() for p in ps.values()})
    near = around(counted(base, own, list(wanted)), group, shares, small)
    inside = Window.partitionBy(*group, "_under").orderBy("value")
    ranked = near.withColumn("_upto", F.col("_under") + F.sum("_n").over(inside))

    def at(p: float) -> Column:
        return (F.col("_total") - 1) * F.lit(p)

    def statistic(measure: str, rank: Column) -> Column:
        here = (F.col("_measure") == measure) & (rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_n"))
        return F.max(F.when(here, F.col("value")))

    def interpolated(measure: str, p: float) -> Column:
        low, high = statistic(measure, F.floor(at(p)) + 1), statistic(measure, F.ceil(at(p)) + 1)
        return low + (high - low) * F.max(F.when(F.col("_measure") == measure, at(p) - F.floor(at(p))))

    out = [interpolated(m, float(p)).alias(name) for m, ps in wanted.items() for name, p in ps.items()]
    return ranked.groupBy(*own).agg(*out).select(*keys, *[name for ps in wanted.values() for name in ps])


def percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: dict[str, float]) -> DataFrame:
    """The percentiles of one measure."""
    return percentiles_of(df, keys, {value: ps})
