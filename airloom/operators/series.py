"""Ordered operators over long series, without one task per series.

A window over `partitionBy(city).orderBy(date)` puts a whole city into one
task; when one city holds a third of the rows that task is the job.  Here a
series is cut into calendar years.  Each operator works in two levels:

1. inside (series, year): with one row per day at most 366 rows per window;
2. over one summary row per (series, year): what a year hands to the next.

The summary is joined back on (series, year), the partitioning the first level
already has.  Results equal the plain window form (see the tests).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"
HALO_ROWS = 4096


def with_block(df: DataFrame, date: str = "date") -> DataFrame:
    return df if BLOCK in df.columns else df.withColumn(BLOCK, F.year(date))


def _inside(keys: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*keys, BLOCK).orderBy(order)


def _across(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(BLOCK)


def _inside_back(keys: Sequence[str], order: str) -> Window:
    """Backwards through a block.  A frame that grows from the start of the window
    is a running value; one that shrinks towards its end is computed anew per row."""
    return Window.partitionBy(*keys, BLOCK).orderBy(F.desc(order))


def _across_back(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(F.desc(BLOCK))


BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, 0)


def _attach(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join block summaries to their rows.  Plain equality: above the broadcast
    size the join keeps the (keys, block) partitioning of the windows.  Keys and
    order column are never null, they are the key of the table."""
    extra = [c for c in summary.columns if c not in (*keys, BLOCK)]
    return df.join(summary, [*keys, BLOCK]).select(*df.columns, *extra)


def numbered(df: DataFrame, keys: Sequence[str], date: str = "date", pos: str = "pos", total: str | None = None) -> DataFrame:
    """Position of each row in its series, 1-based, and the series length."""
    rows = with_block(df, date)
    sizes = rows.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(
        *keys,
        BLOCK,
        (F.sum("_n").over(_across(keys)) - F.col("_n")).alias("_start"),
        *([F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []),
    )
    placed = _attach(rows.withColumn("_rn", F.row_number().over(_inside(keys, date))), starts, keys)
    return placed.withColumn(pos, F.col("_rn") + F.col("_start")).drop("_rn", "_start")


def previous_row(df: DataFrame, keys: Sequence[str], columns: Sequence[str], date: str = "date", prefix: str = "prev_") -> DataFrame:
    """Values of the row before, by row order (a missing day is no row)."""
    rows = with_block(df, date)
    ends = rows.groupBy(*keys, BLOCK).agg(*[F.max_by(c, F.col(date)).alias(f"_{c}_end") for c in columns])
    handed = ends.select(*keys, BLOCK, *[F.lag(f"_{c}_end").over(_across(keys)).alias(f"_{c}_handed") for c in columns])
    window = _inside(keys, date)
    inner = rows.select(
        "*",
        (F.row_number().over(window) == 1).alias("_opens"),
        *[F.lag(c).over(window).alias(prefix + c) for c in columns],
    )
    out = _attach(inner, handed, keys)
    crossed = {prefix + c: F.when(F.col("_opens"), F.col(f"_{c}_handed")).otherwise(F.col(prefix + c)) for c in columns}
    return out.withColumns(crossed).drop("_opens", *[f"_{c}_handed" for c in columns])


def next_match(df: DataFrame, keys: Sequence[str], target: Column, out: str, order: str = "date", date: str = "date") -> DataFrame:
    """Order value (date or position) of the first later row where `target` holds."""
    rows = with_block(df, date)
    hit = F.when(target, F.col(order))
    later = _across_back(keys).rowsBetween(*BEFORE)
    first = rows.groupBy(*keys, BLOCK).agg(F.min(hit).alias("_first"))
    handed = first.select(*keys, BLOCK, F.min("_first").over(later).alias("_handed"))
    inner = rows.withColumn(out, F.min(hit).over(_inside_back(keys, order).rowsBetween(*BEFORE)))
    return _attach(inner, handed, keys).withColumn(out, F.coalesce(out, "_handed")).drop("_handed")


def previous_match(df: DataFrame, keys: Sequence[str], target: Column, out: str, order: str = "date", date: str = "date") -> DataFrame:
    """Order value of the last earlier row where `target` holds."""
    rows = with_block(df, date)
    hit = F.when(target, F.col(order))
    earlier = _across(keys).rowsBetween(*BEFORE)
    last = rows.groupBy(*keys, BLOCK).agg(F.max(hit).alias("_last"))
    handed = last.select(*keys, BLOCK, F.max("_last").over(earlier).alias("_handed"))
    inner = rows.withColumn(out, F.max(hit).over(_inside(keys, order).rowsBetween(*BEFORE)))
    return _attach(inner, handed, keys).withColumn(out, F.coalesce(out, "_handed")).drop("_handed")


def known_neighbours(
    df: DataFrame, keys: Sequence[str], before: Sequence[str], after: Sequence[str], pos: str = "pos", date: str = "date"
) -> DataFrame:
    """The nearest present value at or before the row for the columns of `before`,
    at or after it for those of `after`, as structs `<c>_before` and `<c>_after`
    of (pos, value)."""
    rows = with_block(df, date)
    known = {
        c: F.when(F.col(c).isNotNull(), F.struct(F.col(pos).alias("pos"), F.col(c).alias("value"))) for c in {*before, *after}
    }
    # Plain numbers in the aggregation keep it hash-based; structs are built after it.
    at = {c: F.when(F.col(c).isNotNull(), F.col(pos)) for c in known}
    edges = rows.groupBy(*keys, BLOCK).agg(
        *[x for c in before for x in (F.max(at[c]).alias(f"_{c}_last_pos"), F.max_by(c, at[c]).alias(f"_{c}_last"))],
        *[x for c in after for x in (F.min(at[c]).alias(f"_{c}_first_pos"), F.min_by(c, at[c]).alias(f"_{c}_first"))],
    )

    def edge(c: str, end: str) -> Column:
        found = F.col(f"_{c}_{end}_pos")
        return F.when(found.isNotNull(), F.struct(found.alias("pos"), F.col(f"_{c}_{end}").alias("value")))

    earlier = _across(keys).rowsBetween(*BEFORE)
    later = _across_back(keys).rowsBetween(*BEFORE)
    handed = edges.select(
        *keys,
        BLOCK,
        *[F.last(edge(c, "last"), ignorenulls=True).over(earlier).alias(f"_{c}_from") for c in before],
        *[F.last(edge(c, "first"), ignorenulls=True).over(later).alias(f"_{c}_to") for c in after],
    )
    back = _inside(keys, pos).rowsBetween(*SO_FAR)
    ahead = _inside_back(keys, pos).rowsBetween(*SO_FAR)
    inner = rows.select(
        "*",
        *[F.last(known[c], ignorenulls=True).over(back).alias(f"{c}_before") for c in before],
        *[F.last(known[c], ignorenulls=True).over(ahead).alias(f"{c}_after") for c in after],
    )
    return _attach(inner, handed, keys).select(
        *rows.columns,
        *[F.coalesce(f"{c}_before", f"_{c}_from").alias(f"{c}_before") for c in before],
        *[F.coalesce(f"{c}_after", f"_{c}_to").alias(f"{c}_after") for c in after],
    )


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    before: int,
    aggregates: dict[str, Callable[[Window], Column]],
    date: str = "date",
    pos: str = "pos",
    include_current: bool = True,
    block_rows: int | None = None,
) -> DataFrame:
    """Aggregates over the last rows of each row: `before` rows plus the row itself.

    `aggregates` maps a name to a function of the window frame.
    The series is cut into blocks of equal row count; the last `before` rows of
    a block are copied to the next one, so no frame needs two tasks."""
    size = max(block_rows or HALO_ROWS, before)
    rows = df if pos in df.columns else numbered(df, keys, date, pos)
    home = F.floor((F.col(pos) - 1) / size)
    copied = F.when((F.col(pos) - 1) % size >= size - before, F.array(home, home + 1)).otherwise(F.array(home))
    spread = rows.withColumn("_home", home).withColumn("_chunk", F.explode(copied))
    frame = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(-before, 0 if include_current else -1)
    out = spread.select("*", *[build(frame).alias(name) for name, build in aggregates.items()])
    return out.filter(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home")
