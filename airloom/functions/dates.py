"""Month sets and day-of-week helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month sets of the seasonal questions.
WINTER = (12, 1, 2)
SUMMER = (4, 5, 6)
LONG_WINTER = (11, 12, 1, 2)
OZONE_SUMMER = (3, 4, 5, 6)
PRE_RAIN = (4, 5)
POST_RAIN = (10, 11)
ONSET_MONTHS = (9, 10, 11, 12)


def in_months(date: Column | str, months: Iterable[int]) -> Column:
    return F.month(date).isin(*months)


def is_weekend(date: Column | str) -> Column:
    """Saturday or Sunday; dayofweek counts 1 = Sunday."""
    return F.dayofweek(date).isin(1, 7)


def valid_iso_date(text: Column | str) -> Column:
    """True for YYYY-MM-DD text that names a real calendar day."""
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()
