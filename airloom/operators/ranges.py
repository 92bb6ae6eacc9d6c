"""Running sums, positions and carried values over rows in one global order.

A window without a partition, or over a key that holds most rows, would put them into one
task.  Here rows are dealt to ranges of the order (Spark samples the splitters), each range
is worked through by itself, and one summary row a range hands on what came before it.
Rows that are equal in every order column are split too: where they meet, the place they
were read from decides, so such rows should be equal in all that matters.

The table of ranges is written, so that a range keeps its rows when a task runs again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.sources.scratch import written

RANGE, TIE = "_range", "_tie"
#: Rows of a range, and the number of ranges above which they get longer instead.
ROWS, RANGES = 100_000, 20_000


def in_ranges(df: DataFrame, order: Sequence[Column | str], rows: int = ROWS) -> DataFrame:
    """`df` written in ranges of `order`, with the number of the range and a last tie.

    `df` is counted first, so it should be cheap to read."""
    ranges = max(1, min(RANGES, -(-df.count() // rows)))
    tied = df.withColumn(TIE, F.monotonically_increasing_id())
    return written(tied.repartitionByRange(ranges, *order, TIE).withColumn(RANGE, F.spark_partition_id()), "ranges")


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & left[c].eqNullSafe(right[c])
    return found


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str | Column, out: str, rows: int = ROWS) -> DataFrame:
    """The sum of `value` over the rows of the same key up to and with each row.

    Null keys are one key; a null value counts 0.  Only the first key of a range can have rows in
    earlier ranges, so at most one row a range is broadcast."""
    placed = in_ranges(df.withColumn(out, F.coalesce(value, F.lit(0))), [*keys, *order], rows)
    own = [RANGE, *keys]
    until_here = Window.partitionBy(*own).orderBy(*order, TIE).rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy(*own).agg(F.sum(out).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*own, F.sum("_sum").over(before).alias("_before")).filter("_before is not null")
    within = placed.withColumn(out, F.sum(out).over(until_here)).alias("w")
    joined = within.join(F.broadcast(carried), _same(within, carried, own), "left")
    return joined.select(*[within[c] for c in df.columns if c != out], (within[out] + F.coalesce(carried["_before"], F.lit(0))).alias(out))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str, rows: int = ROWS) -> DataFrame:
    """The position of each row among the rows of its key, from 1."""
    return running(df, keys, order, F.lit(1).cast("long"), out, rows)


def neighbours(df: DataFrame, order: Sequence[str], before: dict[str, str], after: dict[str, str], rows: int = ROWS) -> DataFrame:
    """For each row the last known value of some columns in the rows before it, and the
    first known one in the rows after it: `before` and `after` map a column to its new name."""
    placed = in_ranges(df, order, rows)
    at = F.struct(*order, TIE)
    known = lambda c: F.when(F.col(c).isNotNull(), at)
    ends = placed.groupBy(RANGE).agg(
        *[F.max_by(c, known(c)).alias(f"_l_{o}") for c, o in before.items()], *[F.min_by(c, known(c)).alias(f"_f_{o}") for c, o in after.items()]
    )
    # one row a range meets here
    past, next_ = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(
        F.col(RANGE),
        *[F.last(f"_l_{o}", ignorenulls=True).over(past).alias(f"_l_{o}") for o in before.values()],
        *[F.last(f"_f_{o}", ignorenulls=True).over(next_).alias(f"_f_{o}") for o in after.values()],
    )
    up = Window.partitionBy(RANGE).orderBy(*order, TIE).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(RANGE).orderBy(*[F.desc(c) for c in order], F.desc(TIE)).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.select(
        "*", *[F.last(c, ignorenulls=True).over(up).alias(o) for c, o in before.items()], *[F.last(c, ignorenulls=True).over(down).alias(o) for c, o in after.items()]
    )
    joined = within.join(F.broadcast(handed), RANGE)
    filled = [F.coalesce(o, f"_l_{o}").alias(o) for o in before.values()] + [F.coalesce(o, f"_f_{o}").alias(o) for o in after.values()]
    return joined.select(*[F.col(c) for c in df.columns], *filled)
