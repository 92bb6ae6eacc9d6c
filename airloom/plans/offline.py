"""Offline twins of the named questions.

Same subjects, other rules: nulls are zero, runs and distances count rows
instead of calendar days, deviations are sample deviations, results are per
city.  Rounding is half-up throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions.dates import LONG_WINTER, ONSET_MONTHS, OZONE_SUMMER, POST_RAIN, PRE_RAIN, SUMMER, WINTER, in_months, is_weekend
from airloom.functions.numeric import count_when, mean_when, pair_corr, ratio, rounded
from airloom.model import MEASURES
from airloom.operators.episodes import episodes
from airloom.operators.quantile import percentiles, percentiles_of
from airloom.operators.ranking import first_names
from airloom.operators.runs import row_runs
from airloom.operators.series import next_match, numbered, previous_match, previous_row, trailing
from airloom.plans.features import filled, named
from airloom.sources.tables import Dataset

AQI = "aqi_daily"
CITY = ["city_id"]
# Month labels.
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def _yearly_means(ds: Dataset, *measures: str) -> DataFrame:
    return filled(ds).groupBy("city_id", F.year("date").alias("year")).agg(*[F.avg(m).alias(m) for m in measures])


def _by_year() -> Window:
    return Window.partitionBy("city_id").orderBy("year")


# -- runs ------------------------------------------------------------------


def _yearly_streaks(ds: Dataset, min_aqi: float) -> DataFrame:
    runs = row_runs(filled(ds), CITY, F.col(AQI) >= min_aqi, split_years=True)
    return runs.groupBy("city_id", "year").agg(F.max("length").alias("streak"))


def streaks(ds: Dataset, min_aqi: float = 401, limit: int = 15) -> DataFrame:
    risk = F.when(F.col("streak") >= 10, "SEVERE").when(F.col("streak") >= 5, "HIGH").otherwise("MODERATE")
    best = named(_yearly_streaks(ds, min_aqi), ds).withColumn("risk", risk)
    return best.orderBy(F.desc("streak"), "city", "year").limit(limit)


def streak_trend(ds: Dataset, min_aqi: float = 401) -> DataFrame:
    """Least-squares line through the yearly maximum; next year's value cut to a whole number."""
    yearly = _yearly_streaks(ds, min_aqi).groupBy("year").agg(F.max("streak").alias("streak"))
    slope, start = F.regr_slope("streak", "year"), F.regr_intercept("streak", "year")
    fit = yearly.agg(slope.alias("slope"), start.alias("start"), F.max("year").alias("last"))
    return fit.select(
        rounded("slope", 2).alias("trend_slope"),
        (F.col("last") + 1).alias("next_year"),
        F.round(F.col("start") + F.col("slope") * (F.col("last") + 1), 6).cast("int").alias("predicted_streak"),
    )


def streak_projection(ds: Dataset, min_aqi: float = 401, ahead: int = 2) -> DataFrame:
    """The same line carried on for the next years."""
    yearly = _yearly_streaks(ds, min_aqi).groupBy("year").agg(F.max("streak").alias("streak"))
    fit = yearly.agg(
        F.regr_slope("streak", "year").alias("slope"), F.regr_intercept("streak", "year").alias("start"), F.max("year").alias("last")
    )
    year = F.col("last") + F.col("step")
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(ahead))))
    return steps.select(year.alias("year"), rounded(F.col("start") + F.col("slope") * year, 4).alias("projected_streak")).orderBy("year")


def spells(ds: Dataset, above: float = 200) -> DataFrame:
    """Mean, number and longest polluted spell for every city, 0 without any."""
    rows = filled(ds)
    found = row_runs(rows, CITY, F.col(AQI) > above).groupBy("city_id").agg(
        rounded(F.avg("length"), 1).alias("mean"), F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")
    )
    cities = rows.select("city_id").distinct()
    out = cities.join(found, "city_id", "left").select(
        "city_id",
        _zero(F.col("mean")).alias("avg_spell_days"),
        F.coalesce("n", F.lit(0)).alias("total_spells"),
        F.coalesce("longest", F.lit(0)).alias("max_spell"),
    )
    return named(out, ds).orderBy(F.desc("avg_spell_days"), "city")


def clusters(ds: Dataset, min_aqi: float = 401) -> DataFrame:
    out = row_runs(filled(ds), CITY, F.col(AQI) >= min_aqi).groupBy("city_id").agg(
        F.max("length").alias("longest_cluster"),
        F.count(F.lit(1)).alias("total_clusters"),
        rounded(F.avg("length"), 1).alias("avg_cluster"),
    )
    return named(out, ds).orderBy(F.desc("longest_cluster"), "city")


# -- yearly levels and trends -----------------------------------------------


def _improvements(ds: Dataset) -> DataFrame:
    recent = F.row_number().over(Window.partitionBy("city_id").orderBy(F.desc("year")))
    levels = (
        _yearly_means(ds, AQI)
        .withColumn("recent", recent)
        .groupBy("city_id")
        .agg(
            F.max(F.when(F.col("recent") == 1, F.col(AQI))).alias("latest"),
            F.max(F.when(F.col("recent") == 3, F.col(AQI))).alias("old"),
            F.max("recent").alias("years"),
        )
        .filter("years >= 3")
    )
    out = levels.select(
        "city_id",
        rounded("latest", 1).alias("latest_avg"),
        rounded("old", 1).alias("old_avg"),
        rounded(F.col("old") - F.col("latest"), 1).alias("improvement"),
    )
    return named(out, ds)


def city_improvement(ds: Dataset) -> DataFrame:
    return _improvements(ds).orderBy(F.desc("improvement"), "city")


def improvement_extremes(ds: Dataset) -> DataFrame:
    """Best improving and worst declining city; the first and the last by name on ties."""
    return _improvements(ds).agg(
        F.min_by("city", F.struct(-F.col("improvement"), F.col("city"))).alias("best_improving"),
        F.max_by("city", F.struct(-F.col("improvement"), F.col("city"))).alias("worst_declining"),
    )


def hotspots(ds: Dataset, limit: int = 15) -> DataFrame:
    counts = filled(ds).groupBy("city_id", F.year("date").alias("year")).agg(
        count_when(F.col(AQI).between(401, 500)).alias("very_poor"), count_when(F.col(AQI) > 500).alias("severe")
    )
    bad = counts.withColumn("total_bad", F.col("very_poor") + F.col("severe")).filter("total_bad > 0")
    return named(bad, ds).orderBy(F.desc("total_bad"), "city", "year").limit(limit)


def good_flags(ds: Dataset, max_avg: float = 150) -> DataFrame:
    out = _yearly_means(ds, AQI).groupBy("city_id").agg(F.max(AQI).alias("top"), F.avg(AQI).alias("mean"))
    flags = out.select(
        "city_id",
        rounded("top", 1).alias("max_yearly_avg"),
        rounded("mean", 1).alias("mean_avg"),
        (F.col("top") <= max_avg).alias("is_good"),
    )
    return named(flags, ds).orderBy("mean_avg", "city")


def top_cities(ds: Dataset, limit: int = 5) -> DataFrame:
    counts = ds.readings.groupBy("city_id").agg(F.count(F.lit(1)).alias("days"))
    return named(counts, ds).orderBy(F.desc("days"), "city").limit(limit)


def _first_cities(ds: Dataset, means: DataFrame, limit: int | None) -> DataFrame:
    """Yearly means of all cities, or of the first `limit` by name that have readings."""
    by_name = named(means, ds)
    if limit is None:
        return by_name
    return by_name.join(first_names(by_name, "city", limit), "city", "left_semi")


def growth(ds: Dataset, limit: int | None = None) -> DataFrame:
    yearly = _first_cities(ds, _yearly_means(ds, AQI), limit)
    before = F.lag(AQI).over(Window.partitionBy("city").orderBy("year"))
    steps = yearly.withColumn("growth", ratio((F.col(AQI) - before) * 100, before))
    out = steps.groupBy("city").agg(
        rounded(F.avg("growth"), 2).alias("avg_growth"),
        _zero(rounded(F.max_by("growth", "year"), 2)).alias("latest_growth"),
        F.count(F.lit(1)).alias("years"),
    )
    return out.filter("years >= 2").drop("years").orderBy("city")


def growth_projection(ds: Dataset, limit: int | None = None, ahead: int = 3) -> DataFrame:
    """Linear projection of the yearly mean for the next years."""
    yearly = _first_cities(ds, _yearly_means(ds, AQI), limit)
    fit = yearly.groupBy("city").agg(
        F.regr_slope(AQI, "year").alias("slope"),
        F.regr_intercept(AQI, "year").alias("start"),
        F.max("year").alias("last"),
        F.count(F.lit(1)).alias("years"),
    )
    ahead_of = fit.filter("years >= 3").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(ahead))))
    year = F.col("last") + F.col("step")
    return ahead_of.select(
        "city", year.alias("year"), rounded(F.col("start") + F.col("slope") * year, 4).alias("projected_aqi")
    ).orderBy("city", "year")


# -- months and seasons -------------------------------------------------------


def _months(ds: Dataset) -> DataFrame:
    return filled(ds).groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(F.avg(AQI).alias("mean"))


def _worst(ds: Dataset) -> DataFrame:
    pick = F.max_by(F.struct("month", "mean"), F.struct("mean", -F.col("month"))).alias("w")
    return _months(ds).groupBy("year").agg(pick).select("year", "w.month", "w.mean")


def _month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), month)


def worst_months(ds: Dataset) -> DataFrame:
    return _worst(ds).select("year", _month_name(F.col("month")).alias("month"), rounded("mean", 1).alias("avg_aqi")).orderBy("year")


def month_table(ds: Dataset) -> DataFrame:
    """Mean per year and month, one column per month (the axis with a fixed size), 0 where missing."""
    wide = _months(ds).groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("mean"))
    return wide.select("year", *[_zero(rounded(F.col(str(m)), 2)).alias(MONTH_NAMES[m - 1]) for m in range(1, 13)]).orderBy("year")


def most_frequent_worst_month(ds: Dataset) -> DataFrame:
    """Mode of the worst months, the earlier month on ties."""
    counts = _worst(ds).groupBy("month").agg(F.count(F.lit(1)).alias("years"))
    top = counts.agg(F.max_by(F.struct("month", "years"), F.struct("years", -F.col("month"))).alias("t"))
    return top.select(_month_name(F.col("t.month")).alias("month"), F.col("t.years").alias("years"))


def season_ratio(ds: Dataset, region: str = "North") -> DataFrame:
    """Winter against summer pm25 for a region's cities; none for a region without any."""
    means = filled(ds).groupBy("city_id").agg(
        mean_when(in_months("date", WINTER), "pm25").alias("winter"), mean_when(in_months("date", SUMMER), "pm25").alias("summer")
    )
    both = means.filter(F.col("winter").isNotNull() & F.col("summer").isNotNull())
    placed = both.join(ds.cities.select("city_id", F.col("city_name").alias("city"), "region"), "city_id")
    kept = placed.filter(F.col("region") == region)
    return kept.select(
        "city",
        rounded("winter", 1).alias("winter_pm25"),
        rounded("summer", 1).alias("summer_pm25"),
        rounded(F.col("winter") / F.greatest("summer", F.lit(0.01)), 2).alias("ratio"),
    ).orderBy("city")


def _pair(ds: Dataset, measure: str, a: Column, b: Column, digits: int, names: tuple[str, str, str], diff_digits: int | None = None) -> DataFrame:
    """Two conditional means and their difference, 0 where a side has no rows."""
    means = filled(ds).groupBy("city_id").agg(mean_when(a, measure).alias("a"), mean_when(b, measure).alias("b"))
    diff = rounded(F.col("a") - F.col("b"), digits if diff_digits is None else diff_digits)
    out = means.select(
        "city_id",
        _zero(rounded("a", digits)).alias(names[0]),
        _zero(rounded("b", digits)).alias(names[1]),
        _zero(diff).alias(names[2]),
    )
    return named(out, ds)


def weekday_weekend(ds: Dataset) -> DataFrame:
    out = _pair(ds, AQI, ~is_weekend("date"), is_weekend("date"), 1, ("weekday_avg", "weekend_avg", "difference"))
    return out.orderBy(F.abs("difference").desc(), "city")


def rain(ds: Dataset) -> DataFrame:
    out = _pair(ds, AQI, in_months("date", PRE_RAIN), in_months("date", POST_RAIN), 1, ("pre_rainfall", "post_rainfall", "cleansing_impact"))
    return out.orderBy(F.desc("cleansing_impact"), "city")


def ozone(ds: Dataset) -> DataFrame:
    out = _pair(ds, "o3", in_months("date", OZONE_SUMMER), in_months("date", LONG_WINTER), 2, ("summer_o3", "winter_o3", "summer_spike"))
    return out.orderBy(F.desc("summer_spike"), "city")


def season_pair(ds: Dataset) -> DataFrame:
    out = _pair(ds, AQI, in_months("date", WINTER), in_months("date", SUMMER), 1, ("winter_avg", "summer_avg", "seasonal_drop"), 2)
    return out.orderBy(F.desc("seasonal_drop"), "city")


def divergence(ds: Dataset, tolerance: float = 10) -> DataFrame:
    """Second half of the years against the first half, at least three years."""
    place = _yearly_means(ds, "pm25", AQI).select(
        "*",
        F.row_number().over(_by_year()).alias("rn"),
        F.count(F.lit(1)).over(Window.partitionBy("city_id")).alias("years"),
    )
    early = F.col("rn") <= F.floor(F.col("years") / 2)
    diffs = place.filter("years >= 3").groupBy("city_id").agg(
        (mean_when(~early, "pm25") - mean_when(early, "pm25")).alias("pm25"),
        (mean_when(~early, AQI) - mean_when(early, AQI)).alias("aqi"),
    )
    kept = diffs.filter((F.col("pm25") > 0) & (F.abs("aqi") < tolerance))
    out = kept.select("city_id", rounded("pm25", 1).alias("pm25_increase"), rounded("aqi", 1).alias("aqi_change"))
    return named(out, ds).orderBy(F.desc("pm25_increase"), "city")


#: Shown for a city with too few rows.
TOO_FEW = "insufficient data"


# -- spread and correlation ---------------------------------------------------


def dominant(ds: Dataset, min_rows: int = 30) -> DataFrame:
    """Which particle size goes along with the index; a city with too few rows has the reason."""
    pairs = filled(ds).groupBy("city_id").agg(
        rounded(pair_corr("pm25", AQI), 4).alias("corr_pm25"),
        rounded(pair_corr("pm10", AQI), 4).alias("corr_pm10"),
        rounded(pair_corr("pm25", AQI) - pair_corr("pm10", AQI), 9).alias("gap"),
        F.count(F.lit(1)).alias("n"),
    )
    label = F.when(F.col("gap") > 0, "PM2.5").when(F.col("gap") < 0, "PM10").otherwise("Equal")
    enough = F.col("n") >= min_rows
    shown = [F.when(enough, c).alias(n) for c, n in ((F.col("corr_pm25"), "corr_pm25"), (F.col("corr_pm10"), "corr_pm10"), (label, "dominant"))]
    out = pairs.select("city_id", *shown, F.when(enough, "ok").otherwise(TOO_FEW).alias("status"))
    return named(out, ds).orderBy("city")


def corr_matrix(ds: Dataset) -> DataFrame:
    """All pair correlations in one aggregation, in long form."""
    pairs = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]]
    one = filled(ds).agg(*[rounded(pair_corr(a, b), 4).alias(f"{a}|{b}") for a, b in pairs])
    cells = [F.struct(F.lit(m).alias("a"), F.lit(m).alias("b"), F.lit(1.0).alias("corr")) for m in MEASURES]
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            cells.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"`{a}|{b}`").alias("corr")))
    return one.select(F.inline(F.array(*cells))).orderBy("a", "b")


def volatility_rate(ds: Dataset, jump: float = 50) -> DataFrame:
    steps = previous_row(filled(ds).select("city_id", "date", AQI), CITY, [AQI])
    counts = steps.groupBy("city_id").agg(
        count_when(F.abs(F.col(AQI) - F.col("prev_aqi_daily")) > jump).alias("drastic_changes"),
        (F.count(F.lit(1)) - 1).alias("total_days"),
    )
    rate = F.col("drastic_changes") * 100.0 / F.greatest("total_days", F.lit(1))
    return named(counts.withColumn("volatility_rate", rounded(rate, 1)), ds).orderBy(F.desc("volatility_rate"), "city")


def std_mean(ds: Dataset) -> DataFrame:
    out = filled(ds).groupBy("city_id").agg(
        rounded(F.stddev_samp(AQI), 2).alias("std_aqi"), rounded(F.avg(AQI), 2).alias("mean_aqi")
    )
    return named(out, ds).orderBy(F.desc("std_aqi"), "city")


def city_gas_profile(ds: Dataset) -> DataFrame:
    gas = F.avg("co") + F.avg("no2") + F.avg("o3")
    pm = F.avg("pm10") + F.avg("pm25")
    means = filled(ds).groupBy("city_id").agg(gas.alias("gas"), pm.alias("pm"))
    out = means.select(
        "city_id",
        rounded("gas", 2).alias("avg_gas"),
        rounded("pm", 2).alias("avg_particulate"),
        rounded(F.col("gas") / F.greatest("pm", F.lit(0.01)), 4).alias("ratio"),
        F.when(F.col("gas") > F.col("pm"), "Gas-Dominant").otherwise("Particulate-Dominant").alias("profile"),
    )
    return named(out, ds).orderBy("city")


def city_percentiles(ds: Dataset) -> DataFrame:
    cut = percentiles(filled(ds), CITY, AQI, {"p90": 0.9, "p95": 0.95})
    out = cut.select("city_id", rounded("p90", 1).alias("p90"), rounded("p95", 1).alias("p95"))
    return named(out, ds).orderBy(F.desc("p95"), "city")


def no2_ratio(ds: Dataset) -> DataFrame:
    means = filled(ds).groupBy("city_id").agg(F.avg("no2").alias("no2"), F.avg(AQI).alias("aqi"))
    out = means.select(
        "city_id",
        rounded("no2", 2).alias("avg_no2"),
        rounded("aqi", 2).alias("avg_aqi"),
        rounded(F.col("no2") / F.greatest("aqi", F.lit(1.0)), 4).alias("traffic_ratio"),
    )
    return named(out, ds).orderBy(F.desc("traffic_ratio"), "city")


def cooccurrence(ds: Dataset, p: float = 0.75) -> DataFrame:
    """Share of winter rows above both percentiles."""
    winter = filled(ds).filter(in_months("date", LONG_WINTER))
    cuts = percentiles_of(winter, [], {"co": {"co_cut": p}, "pm25": {"pm_cut": p}})
    cut = winter.withColumn("cuts", cuts.select(F.struct("co_cut", "pm_cut").alias("c")).scalar()).select("*", "cuts.*")
    counts = cut.groupBy("city_id").agg(
        F.count(F.lit(1)).alias("total_winter_days"),
        count_when((F.col("co") > F.col("co_cut")) & (F.col("pm25") > F.col("pm_cut"))).alias("co_pm_simultaneous"),
    )
    rate = F.col("co_pm_simultaneous") * 100.0 / F.greatest("total_winter_days", F.lit(1))
    return named(counts.withColumn("rate", rounded(rate, 2)), ds).orderBy(F.desc("rate"), "city")


# -- events ------------------------------------------------------------------


def _episodes(ds: Dataset, extreme: Column, good: float) -> DataFrame:
    """Length in rows of each finished episode: from its first extreme row to the
    first later row at or under `good`."""
    found = episodes(filled(ds).select("city_id", "date", AQI), CITY, extreme, F.col(AQI) <= good)
    return found.select("city_id", (F.col("end") - F.col("start")).alias("rows"))


def recovery_episodes(ds: Dataset, above: float = 300, good: float = 100) -> DataFrame:
    out = _episodes(ds, F.col(AQI) > above, good).groupBy("city_id").agg(
        rounded(F.avg("rows"), 1).alias("avg_recovery_days"), F.count(F.lit(1)).alias("events")
    )
    return named(out, ds).orderBy("avg_recovery_days", "city")


def recovery_episodes_severe(ds: Dataset, severe: float = 401, good: float = 100) -> DataFrame:
    out = _episodes(ds, F.col(AQI) >= severe, good).groupBy("city_id").agg(
        rounded(F.avg("rows"), 1).alias("avg_recovery"), F.count(F.lit(1)).alias("events")
    )
    return named(out, ds).orderBy("avg_recovery", "city")


def early_warning_rows(ds: Dataset, severe: float = 401, critical: float = 200, lookback: int = 29) -> DataFrame:
    """Rows between a severe row and the last critical row within `lookback` rows before it."""
    rows = numbered(filled(ds).select("city_id", "date", AQI, "pm25"), CITY)
    found = previous_match(rows, CITY, F.col("pm25") >= critical, "warned", order="pos")
    gap = F.col("pos") - F.col("warned")
    hits = found.filter((F.col(AQI) >= severe) & (gap <= lookback)).select("city_id", gap.alias("rows"))
    out = hits.groupBy("city_id").agg(
        rounded(F.avg("rows"), 1).alias("avg_warning_days"), F.count(F.lit(1)).alias("events")
    )
    return named(out, ds).orderBy(F.desc("avg_warning_days"), "city")


def _onsets(ds: Dataset, above: float, rows: int, months) -> DataFrame:
    smooth = trailing(filled(ds).select("city_id", "date", "pm25"), CITY, rows - 1, {"mean": lambda w: F.avg("pm25").over(w)})
    hits = smooth.filter((F.round("mean", 9) > above) & in_months("date", months))
    return hits.groupBy("city_id", F.year("date").alias("year")).agg(F.min("date").alias("onset_date"))


def onset_by_city(ds: Dataset, above: float = 100, rows: int = 7, months=ONSET_MONTHS) -> DataFrame:
    out = _onsets(ds, above, rows, months).select(
        "city_id", "year", "onset_date", F.month("onset_date").alias("onset_month"), F.dayofmonth("onset_date").alias("onset_day")
    )
    return named(out, ds).orderBy("city", "year")


def mean_onset_day(ds: Dataset, above: float = 100, rows: int = 7, months=ONSET_MONTHS) -> DataFrame:
    out = _onsets(ds, above, rows, months).groupBy("city_id").agg(
        rounded(F.avg(F.dayofmonth("onset_date")), 4).alias("mean_onset_day")
    )
    return named(out, ds).orderBy("mean_onset_day", "city")


# -- hidden hazards --------------------------------------------------------------


# Fixed values: (index at most, o3 above, co above) of the two rules.
HAZARD_RULES = {"strict": (100, 200, 2.5), "relaxed": (150, 100, 1.5)}


def _hazards(ds: Dataset, rule: str) -> DataFrame:
    """Days that look good and are not, by the rule that the caller names."""
    calm, o3, co = HAZARD_RULES[rule]
    return filled(ds).filter((F.col(AQI) <= calm) & ((F.col("o3") > o3) | (F.col("co") > co)))


def hazards(ds: Dataset, rule: str = "strict") -> DataFrame:
    out = _hazards(ds, rule).select(
        "city_id", "date", rounded(AQI, 1).alias("aqi"), rounded("o3", 1).alias("o3"), rounded("co", 3).alias("co")
    )
    return named(out, ds).orderBy("city", "date")


def hazard_counts(ds: Dataset, rule: str = "strict") -> DataFrame:
    counts = _hazards(ds, rule).groupBy("city_id").agg(F.count(F.lit(1)).alias("hazard_days"))
    return named(counts, ds).orderBy(F.desc("hazard_days"), "city")


# -- result-shaping frames -------------------------------------------------------


def streak_table(ds: Dataset, min_aqi: float = 401) -> DataFrame:
    """Longest run of every city and year with readings, 0 where none; a row for each."""
    every = filled(ds).groupBy("city_id", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("days")).drop("days")
    found = every.join(_yearly_streaks(ds, min_aqi), ["city_id", "year"], "left")
    return named(found.select("city_id", "year", F.coalesce("streak", F.lit(0)).alias("streak")), ds).orderBy("city", "year")


def season_delta(ds: Dataset, region: str = "North") -> DataFrame:
    rows = season_ratio(ds, region)
    return rows.withColumn("delta", rounded(F.col("winter_pm25") - F.col("summer_pm25"), 1)).orderBy(F.desc("delta"), "city")


def correlation_gap(ds: Dataset) -> DataFrame:
    gap = rounded(F.abs(F.col("corr_pm25") - F.col("corr_pm10")), 4)
    return dominant(ds).withColumn("gap", gap).orderBy(F.desc("gap"), "city")


def onset_table(ds: Dataset, above: float = 100) -> DataFrame:
    """Earliest onset as day of year, a row for each city and year that has one."""
    days = onset_by_city(ds, above).groupBy("city", "year").agg(F.min(F.dayofyear("onset_date")).alias("day"))
    return days.orderBy("city", "year")


def cooccurrence_complement(ds: Dataset) -> DataFrame:
    return cooccurrence(ds).withColumn("non_rate", rounded(100.0 - F.col("rate"), 2))


def _hazard_type() -> Column:
    o3, co = F.col("o3") >= 200, F.col("co") > 2.5
    return F.when(o3 & co, "Both").when(o3, "High O3").otherwise("High CO")


def hazard_months(ds: Dataset, rule: str = "strict") -> DataFrame:
    """Hazard days per city and month."""
    out = hazards(ds, rule).groupBy("city", F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("days"))
    return out.orderBy("city", "month")


def hazard_types(ds: Dataset, rule: str = "strict") -> DataFrame:
    kinds = ["High CO", "High O3", "Both"]
    wide = hazards(ds, rule).withColumn("kind", _hazard_type()).groupBy("city").pivot("kind", kinds).agg(F.count(F.lit(1)))
    return wide.select("city", *[F.coalesce(F.col(k), F.lit(0)).alias(k.lower().replace(" ", "_")) for k in kinds]).orderBy("city")
