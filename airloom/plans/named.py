"""The thirty named questions.

Each takes a `Dataset` and keyword parameters and returns a lazy DataFrame.
Facts are aggregated before city names are attached, so the join sees one row
per city and period.  Nulls are skipped, deviations are population deviations.
Every ORDER BY ends with the name, so results are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airloom.functions.dates import LONG_WINTER, ONSET_MONTHS, OZONE_SUMMER, POST_RAIN, PRE_RAIN, SUMMER, WINTER, in_months, is_weekend
from airloom.functions.numeric import count_when, mean_when, moments_corr, percent, ratio, rounded
from airloom.model import with_city
from airloom.operators.quantile import percentiles, percentiles_of
from airloom.operators.runs import calendar_runs
from airloom.operators.series import next_match, previous_match, previous_row, trailing
from airloom.sources.tables import Dataset

CITY = ["city_id"]
AQI = "aqi_daily"


def _stable(x: Column | str) -> Column:
    """An unrounded figure, snapped to six digits."""
    return rounded(x, 6)


def _desc(*names: str) -> list[Column]:
    return [F.col(n).desc_nulls_last() for n in names]


def _yearly(ds: Dataset, measure: str = AQI) -> DataFrame:
    return ds.readings.groupBy("city_id", F.year("date").alias("year")).agg(F.avg(measure).alias("mean"))


# -- runs ------------------------------------------------------------------


def longest_streak_per_year(ds: Dataset, min_aqi: float = 401, limit: int = 15) -> DataFrame:
    runs = calendar_runs(ds.readings, CITY, F.col(AQI) >= min_aqi, split_years=True)
    best = runs.groupBy("city_id", "year").agg(F.max("length").alias("longest_severe_streak"))
    named = with_city(best, ds.cities).select("city_name", "year", "longest_severe_streak")
    return named.orderBy(*_desc("longest_severe_streak"), "city_name", "year").limit(limit)


def polluted_spell_avg(ds: Dataset, above: float = 200) -> DataFrame:
    runs = calendar_runs(ds.readings, CITY, F.col(AQI) > above)
    mean = runs.groupBy("city_id").agg(rounded(F.avg("length"), 1).alias("avg_polluted_streak_days"))
    return with_city(mean, ds.cities).drop("city_id").orderBy(*_desc("avg_polluted_streak_days"), "city_name")


def longest_cluster(ds: Dataset, min_aqi: float = 401) -> DataFrame:
    runs = calendar_runs(ds.readings, CITY, F.col(AQI) >= min_aqi)
    best = runs.groupBy("city_id").agg(F.max("length").alias("longest_cluster"))
    return with_city(best, ds.cities).drop("city_id").orderBy(*_desc("longest_cluster"), "city_name")


# -- yearly and monthly levels --------------------------------------------


def state_improvement(ds: Dataset, back: int = 3, limit: int = 7) -> DataFrame:
    """Row-weighted yearly mean per state, latest year against the `back`-th latest."""
    city_year = ds.readings.groupBy("city_id", F.year("date").alias("year")).agg(
        F.sum(AQI).alias("total"), F.count(AQI).alias("days")
    )
    state_year = (
        with_city(city_year, ds.cities, "state")
        .groupBy("state", "year")
        .agg(ratio(F.sum("total"), F.sum("days")).alias("mean"))
    )
    recent = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("year")))
    levels = (
        state_year.withColumn("recent", recent)
        .groupBy("state")
        .agg(
            F.max(F.when(F.col("recent") == 1, F.col("mean"))).alias("latest"),
            F.max(F.when(F.col("recent") == back, F.col("mean"))).alias("old"),
            F.max("recent").alias("years"),
        )
        .filter(F.col("years") >= back)
    )
    out = levels.select(
        "state",
        _stable("latest").alias("latest_avg"),
        _stable("old").alias("old_avg"),
        _stable(F.col("old") - F.col("latest")).alias("improvement"),
    )
    return out.orderBy(*_desc("improvement"), "state").limit(limit)


def hotspots(ds: Dataset, very_poor: tuple[float, float] = (401, 500), severe: float = 501) -> DataFrame:
    counts = ds.readings.groupBy("city_id", F.year("date").alias("year")).agg(
        count_when(F.col(AQI).between(*very_poor)).alias("very_poor_days"),
        count_when(F.col(AQI) >= severe).alias("severe_days"),
    )
    total = F.col("very_poor_days") + F.col("severe_days")
    named = with_city(counts.filter(total > 0), ds.cities)
    return named.orderBy(total.desc(), "city_name", "year").select("city_name", "year", "very_poor_days", "severe_days")


def consistently_good(ds: Dataset, max_avg: float = 150) -> DataFrame:
    worst = _yearly(ds).groupBy("city_id").agg(F.max("mean").alias("worst")).filter(F.col("worst") <= max_avg)
    return with_city(worst, ds.cities).select("city_name").orderBy("city_name")


def _monthly(ds: Dataset, measure: str, out: str) -> DataFrame:
    means = ds.readings.groupBy("city_id", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        rounded(F.avg(measure), 2).alias(out)
    )
    return with_city(means, ds.cities).select("city_name", "year", "month", out).orderBy("city_name", "year", "month")


def monthly_aqi(ds: Dataset) -> DataFrame:
    return _monthly(ds, AQI, "avg_monthly_aqi")


def monthly_pm25(ds: Dataset) -> DataFrame:
    return _monthly(ds, "pm25", "avg_pm25")


def yearly_growth(ds: Dataset) -> DataFrame:
    before = F.lag("mean").over(Window.partitionBy("city_id").orderBy("year"))
    steps = _yearly(ds).withColumn("before", before).filter(F.col("before").isNotNull())
    out = with_city(steps, ds.cities).select(
        "city_name",
        "year",
        rounded("mean", 2).alias("current_avg_aqi"),
        rounded("before", 2).alias("prev_year_aqi"),
        rounded(percent(F.col("mean") - F.col("before"), F.col("before")), 2).alias("growth_rate_percent"),
    )
    return out.orderBy("city_name", "year")


def worst_month(ds: Dataset) -> DataFrame:
    months = ds.readings.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.avg(AQI).alias("mean")
    )
    worst = F.max_by(F.struct("month", "mean"), F.struct("mean", -F.col("month"))).alias("w")
    out = months.groupBy("year").agg(worst)
    return out.select("year", F.col("w.month").alias("month"), rounded("w.mean", 2).alias("worst_avg_aqi")).orderBy("year")


# -- seasons ---------------------------------------------------------------


def _contrast(ds: Dataset, measure: str, first: Column, second: Column, rows: DataFrame | None = None) -> DataFrame:
    """City means of one measure under two conditions."""
    base = ds.readings if rows is None else rows
    means = base.groupBy("city_id").agg(
        mean_when(first, measure).alias("first"), mean_when(second, measure).alias("second")
    )
    return with_city(means, ds.cities)


def season_pm25(ds: Dataset, region: str = "North", winter=WINTER, summer=SUMMER) -> DataFrame:
    season = F.when(in_months("date", winter), "Winter").when(in_months("date", summer), "Summer")
    chosen = ds.cities.filter(F.col("region") == region).select("city_id", "city_name")
    means = (
        ds.readings.filter(in_months("date", (*winter, *summer)))
        .join(chosen.select("city_id"), "city_id", "left_semi")
        .groupBy("city_id", season.alias("season"))
        .agg(rounded(F.avg("pm25"), 2).alias("avg_pm25"))
    )
    return means.join(chosen, "city_id").select("city_name", "season", "avg_pm25").orderBy("city_name", "season")


def weekday_weekend(ds: Dataset) -> DataFrame:
    means = _contrast(ds, AQI, ~is_weekend("date"), is_weekend("date"))
    return means.select(
        "city_name", _stable("first").alias("avg_weekday_aqi"), _stable("second").alias("avg_weekend_aqi")
    ).orderBy("city_name")


def rain_before_after(ds: Dataset, before=PRE_RAIN, after=POST_RAIN) -> DataFrame:
    out = _contrast(ds, AQI, in_months("date", before), in_months("date", after)).select(
        "city_name",
        rounded("first", 1).alias("pre_rainfall_aqi"),
        rounded("second", 1).alias("post_rainfall_aqi"),
        rounded(F.col("first") - F.col("second"), 1).alias("cleansing_impact_drop"),
    )
    return out.orderBy(*_desc("cleansing_impact_drop"), "city_name")


def seasonal_ozone(ds: Dataset, summer=OZONE_SUMMER, winter=LONG_WINTER) -> DataFrame:
    rows = ds.readings.filter(F.col("o3").isNotNull())
    out = _contrast(ds, "o3", in_months("date", summer), in_months("date", winter), rows).select(
        "city_name",
        rounded("first", 2).alias("avg_summer_o3"),
        rounded("second", 2).alias("avg_winter_o3"),
        rounded(F.col("first") - F.col("second"), 2).alias("summer_spike_difference"),
    )
    return out.orderBy(*_desc("summer_spike_difference"), "city_name")


def seasonal_drop(ds: Dataset, winter=WINTER, summer=SUMMER) -> DataFrame:
    out = _contrast(ds, AQI, in_months("date", winter), in_months("date", summer)).select(
        "city_name", rounded(F.col("first") - F.col("second"), 2).alias("seasonal_drop")
    )
    return out.orderBy(*_desc("seasonal_drop"), "city_name")


def winter_onset(ds: Dataset, above: float = 100, rows: int = 7, months=ONSET_MONTHS) -> DataFrame:
    """First day of the region's `rows`-row mean above the level.  The frame
    counts rows of August to December only."""
    kept = ds.readings.filter(F.col("pm25").isNotNull() & in_months("date", (8, *months)))
    daily = with_city(kept.select("city_id", "date", "pm25"), ds.cities, "region").groupBy("region", "date").agg(
        F.avg("pm25").alias("pm25")
    )
    smooth = trailing(daily, ["region"], rows - 1, {"mean": lambda w: F.avg("pm25").over(w)})
    hits = smooth.filter((F.round("mean", 9) > above) & in_months("date", months))
    out = hits.groupBy("region", F.year("date").alias("onset_year")).agg(F.min("date").alias("first_spike_date"))
    return out.select("onset_year", "region", "first_spike_date").orderBy(F.desc("onset_year"), "first_spike_date", "region")


# -- spread, correlation, trend --------------------------------------------


def spikes(ds: Dataset, k_filter: float = 4, k_report: float = 2) -> DataFrame:
    """Days above mean + k_filter deviations; the reported threshold uses k_report."""
    stats = ds.readings.groupBy("city_id").agg(F.avg(AQI).alias("mean"), F.stddev_pop(AQI).alias("dev"))
    days = ds.readings.select("city_id", "date", AQI).join(stats, "city_id")
    hits = days.filter(F.col(AQI) > F.col("mean") + k_filter * F.col("dev"))
    return (
        with_city(hits, ds.cities)
        .select(
            "city_name",
            "date",
            AQI,
            rounded("mean", 2).alias("mean_aqi"),
            rounded("dev", 2).alias("std_dev"),
            rounded(F.col("mean") + k_report * F.col("dev"), 2).alias("threshold"),
        )
        .orderBy("city_name", "date")
    )


def dominant_pollutant(ds: Dataset) -> DataFrame:
    pairs = ds.readings.groupBy("city_id").agg(
        _stable(moments_corr("pm25", AQI)).alias("corr_pm25"), _stable(moments_corr("pm10", AQI)).alias("corr_pm10")
    )
    label = (
        F.when(F.col("corr_pm25") > F.col("corr_pm10"), "PM2.5 dominates AQI")
        .when(F.col("corr_pm25") < F.col("corr_pm10"), "PM10 dominates AQI")
        .otherwise("Equal influence")
    )
    named = with_city(pairs, ds.cities).withColumn("dominant_pollutant", label)
    return named.select("city_name", "corr_pm25", "corr_pm10", "dominant_pollutant").orderBy("city_name")


def pm25_corr(ds: Dataset) -> DataFrame:
    pairs = ds.readings.groupBy("city_id").agg(_stable(moments_corr("pm25", AQI)).alias("corr_pm25_aqi"))
    return with_city(pairs, ds.cities).select("city_name", "corr_pm25_aqi").orderBy("city_name")


def rising_pm25_stable_aqi(ds: Dataset, tolerance: float = 10) -> DataFrame:
    """Second half against first half; the midpoint day belongs to the second half."""
    half = F.round(F.datediff(F.max("date"), F.min("date")) / 2).cast("int")
    midpoint = ds.readings.agg(F.date_add(F.min("date"), half).alias("midpoint")).scalar()
    halves = ds.readings.withColumn("later", F.col("date") >= midpoint)
    later, earlier = F.col("later"), ~F.col("later")
    diffs = halves.groupBy("city_id").agg(
        (mean_when(later, "pm25") - mean_when(earlier, "pm25")).alias("pm25"),
        (mean_when(later, AQI) - mean_when(earlier, AQI)).alias("aqi"),
    )
    kept = diffs.filter((F.col("pm25") > 0) & (F.abs("aqi") < tolerance))
    out = with_city(kept, ds.cities).select(
        "city_name", rounded("pm25", 2).alias("pm25_diff"), rounded("aqi", 2).alias("aqi_diff")
    )
    return out.orderBy(*_desc("pm25_diff"), "city_name")


def drastic_changes(ds: Dataset, jump: float = 50) -> DataFrame:
    steps = previous_row(ds.readings.select("city_id", "date", AQI), CITY, [AQI]).filter(F.col("prev_aqi_daily").isNotNull())
    counts = steps.groupBy("city_id").agg(
        F.count(F.lit(1)).alias("total_days_measured"),
        count_when(F.abs(F.col(AQI) - F.col("prev_aqi_daily")) > jump).alias("frequent_drastic_changes"),
    )
    return with_city(counts, ds.cities).drop("city_id").orderBy(*_desc("frequent_drastic_changes"), "city_name")


def volatility(ds: Dataset) -> DataFrame:
    dev = ds.readings.groupBy("city_id").agg(rounded(F.stddev_pop(AQI), 2).alias("aqi_volatility_score"))
    return with_city(dev, ds.cities).drop("city_id").orderBy(*_desc("aqi_volatility_score"), "city_name")


def region_gas_vs_pm(ds: Dataset) -> DataFrame:
    """Mean gas and particulate sums per region, nulls as 0, from city sums."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    sums = ds.readings.groupBy("city_id").agg(
        F.sum(zero("co") + zero("no2") + zero("o3")).alias("gas"),
        F.sum(zero("pm10") + zero("pm25")).alias("pm"),
        F.count(F.lit(1)).alias("n"),
    )
    means = (
        with_city(sums, ds.cities, "region")
        .groupBy("region")
        .agg((F.sum("gas") / F.sum("n")).alias("gas"), (F.sum("pm") / F.sum("n")).alias("pm"))
    )
    out = means.select(
        "region",
        rounded("gas", 2).alias("avg_chemical_pollution"),
        rounded("pm", 2).alias("avg_particulate_pollution"),
        rounded(ratio("gas", "pm"), 4).alias("gas_to_pm_ratio"),
        F.when(F.col("gas") > F.col("pm"), "Primarily Chemical (Gas)").otherwise("Primarily Particulate").alias("pollution_profile"),
    )
    return out.orderBy(*_desc("gas_to_pm_ratio"), "region")


def state_percentiles(ds: Dataset, ps: tuple[float, float] = (0.90, 0.95)) -> DataFrame:
    rows = with_city(ds.readings.select("city_id", AQI), ds.cities, "state")
    cut = percentiles(rows, ["state"], AQI, {"a": ps[0], "b": ps[1]})
    out = cut.select(
        "state", rounded("a", 1).alias("aqi_90th_percentile"), rounded("b", 1).alias("aqi_95th_percentile")
    )
    return out.orderBy(*_desc("aqi_95th_percentile"), "state")


def no2_ratio(ds: Dataset) -> DataFrame:
    both = ds.readings.filter(F.col("no2").isNotNull() & F.col(AQI).isNotNull())
    means = both.groupBy("city_id").agg(F.avg("no2").alias("no2"), F.avg(AQI).alias("aqi"))
    out = with_city(means, ds.cities).select(
        "city_name",
        rounded("no2", 2).alias("avg_no2"),
        rounded("aqi", 2).alias("avg_overall_aqi"),
        rounded(ratio("no2", "aqi"), 4).alias("traffic_pollution_ratio"),
    )
    return out.orderBy(*_desc("traffic_pollution_ratio"), "city_name")


def co_pm_cooccurrence(ds: Dataset, p: float = 0.75, months=LONG_WINTER) -> DataFrame:
    winter = ds.readings.filter(in_months("date", months) & F.col("co").isNotNull() & F.col("pm25").isNotNull())
    cuts = percentiles_of(winter, [], {"co": {"co_cut": p}, "pm25": {"pm_cut": p}})
    cut = winter.withColumn("cuts", cuts.select(F.struct("co_cut", "pm_cut").alias("c")).scalar())
    flagged = cut.withColumn("both", (F.col("co") > F.col("cuts.co_cut")) & (F.col("pm25") > F.col("cuts.pm_cut")))
    counts = flagged.groupBy("city_id").agg(
        F.count(F.lit(1)).alias("total_winter_days"), count_when(F.col("both")).alias("co_pm_simultaneous_spikes")
    )
    rate = percent(F.col("co_pm_simultaneous_spikes"), F.col("total_winter_days"))
    out = with_city(counts, ds.cities).withColumn("co_occurrence_rate_percent", rounded(rate, 2)).drop("city_id")
    return out.orderBy(*_desc("co_occurrence_rate_percent"), "city_name")


def hidden_hazard_days(ds: Dataset, max_aqi: float = 100, o3: float = 200, co: float = 2.5) -> DataFrame:
    hits = ds.readings.filter((F.col(AQI) <= max_aqi) & ((F.col("o3") > o3) | (F.col("co") > co)))
    label = F.when(F.col("o3") > o3, "High Ozone Hazard").when(F.col("co") > co, "High CO Hazard").otherwise("Moderate Gas Risk")
    out = with_city(hits, ds.cities).select(
        "city_name",
        "date",
        F.col(AQI).alias("reported_overall_aqi"),
        F.col("o3").alias("ozone_level"),
        F.col("co").alias("carbon_monoxide_level"),
        label.alias("hazard_type"),
    )
    return out.orderBy(F.desc("date"), "city_name")


# -- events ------------------------------------------------------------------


def _recovery(ds: Dataset, event: Column, target: Column) -> DataFrame:
    """Days from each event to the first later day where `target` holds.  Only
    events and targets enter the shuffle."""
    rows = ds.readings.select("city_id", "date", AQI).filter(event | target)
    found = next_match(rows, CITY, target, "recovery")
    hits = found.filter(event & F.col("recovery").isNotNull())
    return hits.select("city_id", F.datediff("recovery", "date").alias("days"))


def recovery_from_extreme(ds: Dataset, above: float = 300, good: float = 100) -> DataFrame:
    days = _recovery(ds, F.col(AQI) > above, F.col(AQI) <= good)
    out = days.groupBy("city_id").agg(
        F.count(F.lit(1)).alias("total_extreme_events"), rounded(F.avg("days"), 1).alias("avg_recovery_days")
    )
    return with_city(out, ds.cities).drop("city_id").orderBy("avg_recovery_days", "city_name")


def recovery_from_severe(ds: Dataset, severe: float = 401, good: float = 100) -> DataFrame:
    days = _recovery(ds, F.col(AQI) >= severe, F.col(AQI) <= good)
    out = days.groupBy("city_id").agg(rounded(F.avg("days"), 2).alias("avg_recovery_time"))
    return with_city(out, ds.cities).drop("city_id").orderBy("avg_recovery_time", "city_name")


def early_warning(ds: Dataset, severe: float = 401, critical: float = 200) -> DataFrame:
    event, warning = F.col(AQI) >= severe, F.col("pm25") >= critical
    rows = ds.readings.select("city_id", "date", AQI, "pm25").filter(event | warning)
    found = previous_match(rows, CITY, warning, "warned").filter(event & F.col("warned").isNotNull())
    out = found.groupBy("city_id").agg(rounded(F.avg(F.datediff("date", "warned")), 2).alias("avg_warning_days"))
    return with_city(out, ds.cities).drop("city_id").orderBy(*_desc("avg_warning_days"), "city_name")


# Number -> registry key and function.
NAMED = {
    1: ("q01_longest_streak_per_year", longest_streak_per_year),
    2: ("q02_state_improvement", state_improvement),
    3: ("q03_spikes", spikes),
    4: ("q04_hotspots", hotspots),
    5: ("q05_consistently_good", consistently_good),
    6: ("q06_monthly_aqi", monthly_aqi),
    7: ("q07_monthly_pm25", monthly_pm25),
    8: ("q08_yearly_growth", yearly_growth),
    9: ("q09_worst_month", worst_month),
    10: ("q10_north_season_pm25", season_pm25),
    11: ("q11_dominant_pollutant", dominant_pollutant),
    12: ("q12_pm25_corr", pm25_corr),
    13: ("q13_rising_pm25_stable_aqi", rising_pm25_stable_aqi),
    14: ("q14_weekday_weekend", weekday_weekend),
    15: ("q15_drastic_changes", drastic_changes),
    16: ("q16_volatility", volatility),
    17: ("q17_polluted_spell_avg", polluted_spell_avg),
    18: ("q18_rain_before_after", rain_before_after),
    19: ("q19_recovery_from_extreme", recovery_from_extreme),
    20: ("q20_region_gas_vs_pm", region_gas_vs_pm),
    21: ("q21_winter_onset", winter_onset),
    22: ("q22_state_percentiles", state_percentiles),
    23: ("q23_seasonal_ozone", seasonal_ozone),
    24: ("q24_no2_ratio", no2_ratio),
    25: ("q25_co_pm_cooccurrence", co_pm_cooccurrence),
    26: ("q26_hidden_hazard_days", hidden_hazard_days),
    27: ("q27_recovery_from_severe", recovery_from_severe),
    28: ("q28_early_warning", early_warning),
    29: ("q29_seasonal_drop", seasonal_drop),
    30: ("q30_longest_cluster", longest_cluster),
}


def run_named(ds: Dataset, number: int, **params) -> DataFrame:
    """One of the thirty questions by its number."""
    if number not in NAMED:
        raise ValueError("query number must be between 1 and 30")
    return NAMED[number][1](ds, **params)
