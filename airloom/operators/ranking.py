"""Global ranks without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.operators.ranges import ROWS, numbered
from airloom.sources.scratch import written


def ranked(df: DataFrame, value: str, tie: str, out: str = "rank", descending: bool = False, rows: int = ROWS) -> DataFrame:
    """Distinct 1-based ranks by `value`, ties in order of `tie`, null values last.

    Rows are dealt to sampled ranges of (value, tie) and numbered there; the ranges before
    give the offset."""
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    return numbered(written(df, "unranked"), [], [order, F.col(tie)], out, rows)


def first_names(df: DataFrame, column: str, n: int) -> DataFrame:
    """The first `n` distinct values in order (partial top-n on each task)."""
    return df.select(column).distinct().orderBy(column).limit(n)
