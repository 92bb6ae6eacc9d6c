"""Number helpers: rounding that does not depend on partition order, safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNAP = 9


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Column | str, digits: int) -> Column:
    """Half-up rounding.  The value is first snapped to nine digits: a sum of
    doubles differs in its last bits with the order of the partitions, and a
    tie such as 2.25 must not flip because of it."""
    return F.round(F.round(col(x), SNAP), digits)


def half_up(x: Column | str) -> Column:
    """Whole number, ties towards plus infinity: floor(x + 0.5)."""
    return F.floor(F.round(col(x), SNAP) + 0.5)


def metric(x: Column | str) -> Column:
    """A dashboard number: half-up whole number, null read as 0."""
    return F.coalesce(half_up(x), F.lit(0).cast("bigint"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 (ANSI division would raise)."""
    return F.try_divide(col(a), col(b))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part * 100.0, whole)


def mean_when(cond: Column, x: Column | str) -> Column:
    return F.avg(F.when(cond, col(x)))


def count_when(cond: Column) -> Column:
    return F.count_if(cond)


def moments_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation from plain moments with population deviations.

    The product mean runs over pairs, the two means over all non-null values,
    so it differs from `corr` when only one of the columns is null.  Zero
    variance gives null."""
    x, y = col(x), col(y)
    covariance = F.avg(x * y) - F.avg(x) * F.avg(y)
    return ratio(covariance, F.stddev_pop(x) * F.stddev_pop(y))


def pair_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over rows where both are present; null on zero variance."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(F.round(spread, SNAP) > 0, ratio(F.covar_pop(a, b), spread))
