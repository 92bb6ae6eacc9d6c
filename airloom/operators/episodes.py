"""Episodes of a series: from the first row that opens one to the first later row that closes it.

The scan is an automaton whose state is the row that opened the running episode, or none.  A
calendar year of it is a map of that state: a year with a closing row forgets what came in and
leaves what opened after its last closing row; a year without one keeps what came in, or leaves
what it opened itself.  These maps compose, so the years are scanned side by side in one pass that
also counts the rows, and one summary row a year hands state and row number on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.operators.series import BEFORE, BLOCK, SO_FAR, with_block


def episodes(df: DataFrame, keys: Sequence[str], opens: Column, closes: Column, date: str = "date") -> DataFrame:
    """(keys, start, end) of every closed episode, as row numbers of its series from 1.

    A row that both closes and opens does so in this order; openings inside a running episode
    are part of it; an episode that nothing closes is left out.  Null conditions are false."""
    year = Window.partitionBy(*keys, BLOCK).orderBy(date)
    rows = with_block(df, date).select(
        *keys,
        BLOCK,
        F.row_number().over(year).alias("_at"),
        F.coalesce(opens, F.lit(False)).alias("_opens"),
        # a closing row begins a new stretch
        F.sum(F.when(closes, 1).otherwise(0)).over(year.rowsBetween(*SO_FAR)).alias("_stretch"),
    )
    stretches = rows.groupBy(*keys, BLOCK, "_stretch").agg(
        F.min("_at").alias("_begin"), F.min(F.when(F.col("_opens"), F.col("_at"))).alias("_open"), F.count(F.lit(1)).alias("_n")
    )
    order = Window.partitionBy(*keys, BLOCK).orderBy("_stretch")
    stretches = stretches.withColumn("_before", F.lag("_open").over(order))
    years = stretches.groupBy(*keys, BLOCK).agg(
        F.sum("_n").alias("_n"), (F.max("_stretch") > 0).alias("_closes"), F.max_by("_open", "_stretch").alias("_left")
    )
    along = Window.partitionBy(*keys).orderBy(BLOCK)
    years = years.select(
        *keys,
        BLOCK,
        "_left",
        F.coalesce(F.sum("_n").over(along.rowsBetween(*BEFORE)), F.lit(0)).alias("_past"),
        F.sum(F.col("_closes").cast("int")).over(along.rowsBetween(*SO_FAR)).alias("_era"),
    )
    era = Window.partitionBy(*keys, "_era").orderBy(BLOCK).rowsBetween(*SO_FAR)
    years = years.withColumn("_state", F.min(F.col("_left") + F.col("_past")).over(era))
    handed = years.select(*keys, BLOCK, "_past", F.lag("_state").over(along).alias("_handed"))
    # only the first closing row of a year meets what came in
    own = F.col("_before") + F.col("_past")
    start = F.when(F.col("_stretch") == 1, F.coalesce("_handed", own)).otherwise(own)
    closed = stretches.filter(F.col("_stretch") > 0).join(handed, [*keys, BLOCK])
    return closed.select(*keys, start.alias("start"), (F.col("_begin") + F.col("_past")).alias("end")).filter(F.col("start").isNotNull())
