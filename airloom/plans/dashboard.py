"""Dashboard queries and the roll-ups behind its panels.

Figures are whole numbers rounded half up, a missing figure reads as 0."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.functions.numeric import count_when, half_up, metric, ratio, rounded
from airloom.functions.scales import DASHBOARD_SCALE, DASHBOARD_TOP, dashboard_category, momentum, volatility_label
from airloom.model import with_city
from airloom.operators.ranking import ranked
from airloom.operators.series import numbered
from airloom.sources.tables import Dataset

SHOWN = {"aqi": "aqi_daily", "pm25": "pm25", "pm10": "pm10"}
CITY = ["city_id"]


def _date(text: str, name: str) -> datetime.date:
    try:
        return datetime.datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError as bad:
        raise ValueError(f"{name} must be in YYYY-MM-DD format") from bad


def _city(city_id: int) -> int:
    if not isinstance(city_id, int) or city_id <= 0:
        raise ValueError("city_id must be a positive integer")
    return city_id


def daily_records(ds: Dataset) -> DataFrame:
    """Whole-number daily figures of every city."""
    return ds.readings.select("city_id", "date", *[metric(m).alias(f"avg_{k}") for k, m in SHOWN.items()])


def _within(start: str | None, end: str | None) -> Column:
    """Days of a closed range; an end that is not given is open."""
    first, last = (_date(x, name) if x is not None else None for x, name in ((start, "start"), (end, "end")))
    if first is not None and last is not None and first > last:
        raise ValueError("start cannot be after end")
    inside = F.col("date").isNotNull()
    if first is not None:
        inside &= F.col("date") >= first
    return inside & (F.col("date") <= last) if last is not None else inside


def daily_range(ds: Dataset, city_id: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """One city's days in a closed range; a day's maximum and minimum are its figure."""
    rows = ds.readings.filter((F.col("city_id") == _city(city_id)) & _within(start, end))
    figures = [metric(m).alias(f"{part}_{k}") for k, m in SHOWN.items() for part in ("avg", "max", "min")]
    return rows.select("date", *figures).orderBy("date")


def month_period(year: int, month: int) -> tuple[str, str]:
    """First and last day of a month."""
    first = datetime.date(year, month, 1)
    return first.isoformat(), (datetime.date(year + month // 12, month % 12 + 1, 1) - datetime.timedelta(days=1)).isoformat()


def period_days(ds: Dataset, city_id: int, year: int, month: int) -> DataFrame:
    """One city's days of a month, with the last day of the month beside them."""
    return daily_range(ds, city_id, *month_period(year, month)).withColumn("last_of_month", F.last_day("date"))


def overview(ds: Dataset) -> DataFrame:
    """Every city with its latest day and the mean of its latest month."""
    month = ds.readings.groupBy("city_id", F.trunc("date", "month").alias("month")).agg(
        F.max("date").alias("day"),
        *[F.max_by(m, "date").alias(f"now_{k}") for k, m in SHOWN.items()],
        *[F.avg(m).alias(f"mean_{k}") for k, m in SHOWN.items()],
    )
    rest = [c for c in month.columns if c not in ("city_id", "month")]
    latest = month.groupBy("city_id").agg(*[F.max_by(c, "month").alias(c) for c in rest])
    out = ds.cities.join(latest, "city_id", "left").select(
        "city_id",
        "city_name",
        "state",
        F.col("day").alias("latest_date"),
        *[metric(f"now_{k}").alias(f"current_{k}") for k in SHOWN],
        *[metric(f"mean_{k}").alias(f"month_{k}") for k in SHOWN],
    )
    return out.orderBy("city_name")


def overview_documents(ds: Dataset) -> DataFrame:
    """The overview as nested records, the shape the JSON sink writes."""
    return overview(ds).select(
        F.col("city_id").alias("id"),
        F.col("city_name").alias("name"),
        "state",
        *[f"current_{k}" for k in SHOWN],
        F.struct(*[F.col(f"month_{k}").alias(k) for k in SHOWN]).alias("month_avg"),
    )


def historical(ds: Dataset, city_id: int, month: int) -> DataFrame:
    """Yearly figures of one calendar month (1..12)."""
    if not 1 <= month <= 12:
        raise ValueError("month must be in range 1-12")
    rows = ds.readings.filter((F.col("city_id") == _city(city_id)) & (F.month("date") == month))
    figures = [metric(F.avg(m)).alias(f"avg_{k}") for k, m in SHOWN.items()]
    return rows.groupBy(F.year("date").alias("year")).agg(*figures).orderBy("year")


def cities(ds: Dataset) -> DataFrame:
    return ds.cities.select("city_id", "city_name", "state", "region").orderBy("city_name")


# -- roll-ups -----------------------------------------------------------------


def _folded() -> list[Column]:
    out = [half_up(F.avg(f"avg_{k}")).alias(f"avg_{k}") for k in SHOWN]
    return out + [f(f"avg_{k}").alias(f"{n}_{k}") for k in SHOWN for n, f in (("max", F.max), ("min", F.min))]


def weekly_rollup(ds: Dataset, rows: int = 7) -> DataFrame:
    """Chunks of seven rows, not calendar weeks; the last chunk may be shorter."""
    chunk = F.floor((F.col("pos") - 1) / rows).alias("chunk")
    folded = numbered(daily_records(ds), CITY).groupBy("city_id", chunk).agg(
        F.min("date").alias("start"), F.max("date").alias("end"), *_folded()
    )
    return with_city(folded, ds.cities).drop("city_id").orderBy("city_name", "chunk")


def monthly_rollup(ds: Dataset) -> DataFrame:
    folded = daily_records(ds).groupBy("city_id", F.date_format("date", "yyyy-MM").alias("month")).agg(*_folded())
    return with_city(folded, ds.cities).drop("city_id").orderBy("city_name", "month")


def hourly_records(events: DataFrame, entity: str, ts: str, value: str) -> DataFrame:
    """Hourly figures of timestamped values: mean value and number of events."""
    time = F.col(ts)
    return events.groupBy(F.col(entity).alias("entity"), F.to_date(time).alias("date"), F.hour(time).alias("hour")).agg(
        rounded(F.avg(value), 2).alias("value"), F.count(F.lit(1)).alias("n")
    )


def hourly_to_daily(hourly: DataFrame, measures: Sequence[str] = ("value", "n"), lead: str = "value") -> DataFrame:
    """Mean, maximum and minimum per day; the leading measure also for day (06-18)
    and night with the hours of its extremes, the later hour on ties."""
    is_day = (F.col("hour") >= 6) & (F.col("hour") < 18)
    aggs = []
    for m in measures:
        aggs += [half_up(F.avg(m)).alias(f"avg_{m}"), F.max(m).alias(f"max_{m}"), F.min(m).alias(f"min_{m}")]
    for part, cond in (("day", is_day), ("night", ~is_day)):
        v, h = F.when(cond, F.col(lead)), F.when(cond, F.col("hour"))
        aggs += [
            half_up(F.avg(v)).alias(f"{part}_avg"),
            F.max(v).alias(f"{part}_max"),
            F.min(v).alias(f"{part}_min"),
            F.max_by(h, F.when(cond, F.struct(v, h))).alias(f"{part}_max_hour"),
            F.min_by(h, F.when(cond, F.struct(v, -h))).alias(f"{part}_min_hour"),
        ]
    labels = {f"{part}_{edge}_label": hour_label(f"{part}_{edge}_hour") for part in ("day", "night") for edge in ("max", "min")}
    return hourly.groupBy("entity", "date").agg(*aggs).withColumns(labels).orderBy("entity", "date")


# -- period statistics ----------------------------------------------------------


def period_stats(ds: Dataset, year: int, month: int | None = None) -> DataFrame:
    """Mean of the rounded monthly means for a year (or one month of it) and for
    the year before.  Cities without data in the year drop out."""
    rows = ds.readings.filter(F.year("date").isin(year, year - 1))
    if month is not None:
        rows = rows.filter(F.month("date") == month)
    months = rows.groupBy("city_id", F.year("date").alias("y"), F.month("date").alias("m")).agg(
        *[metric(F.avg(c)).alias(k) for k, c in SHOWN.items()]
    )
    now = F.col("y") == year
    means = months.groupBy("city_id").agg(
        *[half_up(F.avg(F.when(now, F.col(k)))).alias(f"current_{k}") for k in SHOWN],
        half_up(F.avg(F.when(~now, F.col("aqi")))).alias("previous_aqi"),
    )
    kept = means.filter(F.col("current_aqi").isNotNull())
    return with_city(kept, ds.cities, "city_name", "state").select(
        "city_name", "state", *[f"current_{k}" for k in SHOWN], "previous_aqi"
    )


def period_summary(ds: Dataset, year: int, month: int | None = None) -> DataFrame:
    """Overall mean, worst and best city; the later name on ties."""
    return period_stats(ds, year, month).agg(
        half_up(F.avg("current_aqi")).alias("avg_aqi"),
        F.max_by("city_name", F.struct("current_aqi", "city_name")).alias("worst"),
        F.max_by("city_name", F.struct(-F.col("current_aqi"), F.col("city_name"))).alias("best"),
    )


def ranks(ds: Dataset, year: int, month: int | None = None, search: str | None = None, sort: str = "best") -> DataFrame:
    """Period statistics with rank (1 = lowest), optionally searched by name or
    state, in the order worst, best or improving."""
    rows = ranked(period_stats(ds, year, month), "current_aqi", "city_name")
    change = F.coalesce(F.col("current_aqi") - F.col("previous_aqi"), F.lit(0)).alias("change")
    rows = rows.select("*", change, growth_percent(F.col("current_aqi"), F.col("previous_aqi")).alias("growth_percent"))
    if search:
        term = search.lower()
        rows = rows.filter(F.lower("city_name").contains(term) | F.lower("state").contains(term))
    order = {"worst": F.desc("current_aqi"), "best": F.asc("current_aqi"), "improving": F.asc("change")}[sort]
    return rows.orderBy(order, "rank")


def growth_percent(current: Column, previous: Column) -> Column:
    """Change in percent, 0 without a previous figure."""
    return F.coalesce(rounded(ratio((current - previous) * 100.0, F.nullif(previous, F.lit(0))), 4), F.lit(0.0))


def period_growth(ds: Dataset, year: int) -> DataFrame:
    rows = period_stats(ds, year)
    return rows.select("city_name", growth_percent(F.col("current_aqi"), F.col("previous_aqi")).alias("growth_percent"))


def city_distribution(ds: Dataset, year: int, month: int | None = None) -> DataFrame:
    """Cities by the category of their period mean, with the size of the category."""
    placed = period_stats(ds, year, month).select(
        dashboard_category("current_aqi").alias("category"), "city_name", "state", F.col("current_aqi").alias("avg_aqi")
    )
    sizes = placed.groupBy("category").agg(F.count(F.lit(1)).alias("cities"))
    return placed.join(sizes, "category").orderBy("category", "city_name")


# -- per-city insight ------------------------------------------------------------


def overview_category(ds: Dataset) -> DataFrame:
    return overview(ds).select("city_name", "current_aqi", dashboard_category("current_aqi").alias("category"))


def category_share(ds: Dataset) -> DataFrame:
    """Percentage of days per dashboard category."""
    labels = [label for _, label in DASHBOARD_SCALE] + [DASHBOARD_TOP]
    days = daily_records(ds).withColumn("label", dashboard_category("avg_aqi"))
    shares = [half_up(count_when(F.col("label") == x) * 100.0 / F.count(F.lit(1))).alias(x.lower()) for x in labels]
    return with_city(days.groupBy("city_id").agg(*shares), ds.cities).drop("city_id").orderBy("city_name")


def volatility_labels(ds: Dataset, metric_name: str = "aqi") -> DataFrame:
    value = f"avg_{metric_name}"
    dev = daily_records(ds).groupBy("city_id").agg(F.stddev_pop(value).alias("dev"), F.count(value).alias("n"))
    out = with_city(dev, ds.cities).select(
        "city_name",
        F.when(F.col("n") < 2, 0.0).otherwise(rounded("dev", 1)).alias("stddev"),
        volatility_label(F.round("dev", 9), "n").alias("label"),
    )
    return out.orderBy("city_name")


def best_worst_month(ds: Dataset) -> DataFrame:
    """Months with the lowest and the highest mean, the later month on ties."""
    months = daily_records(ds).groupBy("city_id", F.date_format("date", "yyyy-MM").alias("month")).agg(
        half_up(F.avg("avg_aqi")).alias("mean")
    )
    out = months.groupBy("city_id").agg(
        F.max_by("month", F.struct(-F.col("mean"), F.col("month"))).alias("best_month"),
        F.min("mean").alias("best_avg"),
        F.max_by("month", F.struct("mean", "month")).alias("worst_month"),
        F.max("mean").alias("worst_avg"),
    )
    return with_city(out, ds.cities).drop("city_id").orderBy("city_name")


def _placed(ds: Dataset, metric_name: str) -> DataFrame:
    days = daily_records(ds).select("city_id", "date", F.col(f"avg_{metric_name}").alias("value"))
    return numbered(days, CITY, total="n")


def deep_dive(ds: Dataset, metric_name: str = "aqi") -> DataFrame:
    """Mean, first peak and low, latest value and the one a week of rows before."""
    value, pos, n = F.col("value"), F.col("pos"), F.col("n")
    back = F.when(n > 7, n - 7).otherwise(1)
    figures = _placed(ds, metric_name).groupBy("city_id").agg(
        F.max("n").alias("n"),
        half_up(F.avg("value")).alias("avg"),
        F.max("value").alias("max"),
        F.max_by("date", F.struct(value, -pos)).alias("max_date"),
        F.min("value").alias("min"),
        F.min_by("date", F.struct(value, pos)).alias("min_date"),
        F.max(F.when(pos == n, value)).alias("latest"),
        F.max(F.when(pos == back, value)).alias("previous"),
        F.round(F.stddev_pop("value"), 9).alias("dev"),
    )
    diff = F.col("latest") - F.col("previous")
    out = with_city(figures.filter("n >= 2"), ds.cities).select(
        "city_name", "avg", dashboard_category("avg").alias("category"), "max", "max_date", "min", "min_date", "latest", "previous",
        rounded("dev", 1).alias("stddev"), volatility_label("dev", "n").alias("volatility"),
        diff.alias("change"), momentum(diff).alias("momentum"),
    )
    return out.orderBy("city_name")


def momentum_labels(ds: Dataset, metric_name: str = "aqi") -> DataFrame:
    return deep_dive(ds, metric_name).select("city_name", "change", "momentum")


def best_worst_week(ds: Dataset, metric_name: str = "aqi", rows: int = 7) -> DataFrame:
    """Seven-row chunks with the lowest and the highest mean, the later chunk on
    ties; a city needs seven rows and two chunks."""
    chunk = F.floor((F.col("pos") - 1) / rows).alias("chunk")
    weeks = _placed(ds, metric_name).filter(F.col("n") >= rows).groupBy("city_id", chunk).agg(
        F.min("date").alias("start"), F.max("date").alias("end"), half_up(F.avg("value")).alias("mean")
    )
    pick = F.struct("start", "end", "mean")
    ends = weeks.groupBy("city_id").agg(
        F.max_by(pick, F.struct(-F.col("mean"), F.col("chunk"))).alias("best"),
        F.max_by(pick, F.struct("mean", "chunk")).alias("worst"),
        F.count(F.lit(1)).alias("weeks"),
    )
    out = with_city(ends.filter("weeks >= 2"), ds.cities)
    shown = [F.col(f"{w}.{f}").alias(f"{w}_{f}") for w in ("best", "worst") for f in ("start", "end", "mean")]
    return out.select("city_name", *shown).orderBy("city_name")


def half_growth(ds: Dataset, metric_name: str = "aqi") -> DataFrame:
    """First half of the rows against the rest, at least four rows."""
    early = F.col("pos") <= F.floor(F.col("n") / 2)
    halves = _placed(ds, metric_name).filter("n >= 4").groupBy("city_id").agg(
        half_up(F.avg(F.when(early, F.col("value")))).alias("avg_first"),
        half_up(F.avg(F.when(~early, F.col("value")))).alias("avg_second"),
    )
    change = F.col("avg_second") - F.col("avg_first")
    pct = F.when(F.col("avg_first") > 0, half_up(ratio(change * 100.0, F.col("avg_first")))).otherwise(F.lit(0).cast("bigint"))
    out = with_city(halves, ds.cities)
    return out.select("city_name", "avg_first", "avg_second", change.alias("change"), pct.alias("pct")).orderBy("city_name")


def trend_statement(ds: Dataset, metric_name: str = "aqi") -> DataFrame:
    """Expected direction with the latest figure and its category.  A city with
    fewer than four rows has no halves and is expected to stay."""
    latest = deep_dive(ds, metric_name).select("city_name", "latest", dashboard_category("latest").alias("category"))
    halves = half_growth(ds, metric_name).select("city_name", "change")
    direction = F.when(F.col("change") > 0, "continue rising").otherwise("remain stable or improve")
    return latest.join(halves, "city_name", "left").select("city_name", direction.alias("direction"), "latest", "category").orderBy("city_name")


def compare_cities(ds: Dataset, city_ids: Sequence[int], start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily figures of the given cities side by side."""
    if not city_ids:
        raise ValueError("no city to compare")
    days = daily_records(ds).filter(F.col("city_id").isin(*city_ids) & _within(start, end))
    wide = days.groupBy("date").pivot("city_id", list(city_ids)).agg(F.first("avg_aqi"))
    return wide.select("date", *[F.col(str(c)).alias(f"city_{c}") for c in city_ids]).orderBy("date")


def hour_label(hour: Column | str) -> Column:
    hour = F.col(hour) if isinstance(hour, str) else hour
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.concat(twelve.cast("string"), F.when(hour < 12, F.lit(" AM")).otherwise(F.lit(" PM")))


