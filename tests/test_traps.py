"""Hand-made frames for the places where the rules are easy to get wrong."""

import datetime

import pytest
from pyspark.sql import functions as F

from airloom.functions.dates import valid_iso_date
from airloom.functions.numeric import half_up, rounded
from airloom.functions.scales import dashboard_category, health_category, health_weight
from airloom.models.health import health_documents
from airloom.operators.clean import calendar_pivot, gap_fill, unit_fix
from airloom.plans import dashboard, named, offline
from airloom.plans.dashboard import hour_label, hourly_to_daily


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_missing_day_breaks_calendar_run_but_not_row_run(make):
    ds = make({"A": [(f"2020-03-0{d}", 450) for d in (1, 2, 4, 5)]})
    assert [r.longest_cluster for r in named.longest_cluster(ds).collect()] == [2]
    assert [r.longest_cluster for r in offline.clusters(ds).collect()] == [4]


def test_year_end_cuts_yearly_runs_only(make):
    ds = make({"A": [(d, 450) for d in ("2019-12-30", "2019-12-31", "2020-01-01", "2020-01-02")]})
    assert sorted((r.year, r.longest_severe_streak) for r in named.longest_streak_per_year(ds).collect()) == [(2019, 2), (2020, 2)]
    assert named.longest_cluster(ds).first().longest_cluster == 4


def test_zero_variance_is_equal_influence(make):
    ds = make({"A": [(f"2020-01-0{d}", {"pm25": 5, "pm10": d, "aqi_daily": d}) for d in range(1, 6)]})
    row = named.dominant_pollutant(ds).first()
    assert (row.corr_pm25, row.corr_pm10, row.dominant_pollutant) == (None, 1.0, "Equal influence")


def test_unrecovered_day_is_dropped(make):
    ds = make({"A": [("2020-01-01", 350), ("2020-01-04", 90), ("2020-01-05", 400)]})
    row = named.recovery_from_extreme(ds).first()
    assert (row.total_extreme_events, row.avg_recovery_days) == (1, 3.0)


def test_episode_counts_once_day_counts_each(make):
    ds = make({"A": [("2020-01-01", 350), ("2020-01-02", 200), ("2020-01-03", 350), ("2020-01-04", 50)]})
    assert named.recovery_from_extreme(ds).first().avg_recovery_days == 2.0
    row = offline.recovery_episodes(ds).first()
    assert (row.avg_recovery_days, row.events) == (3.0, 1)


def test_episodes_equal_a_plain_scan(ragged):
    from airloom.sources.tables import Dataset

    df, raw = ragged
    cities = df.sparkSession.createDataFrame([(i, f"C{i}", "S", "R") for i in range(4)], "city_id int, city_name string, state string, region string")
    got = {r.city: (r.avg_recovery_days, r.events) for r in offline.recovery_episodes(Dataset(df, cities)).collect()}
    want = {}
    for c in range(4):
        values = [r[7] for r in sorted(r for r in raw if r[0] == c)]
        lengths, open_at = [], None
        for i, v in enumerate(values):
            if open_at is None and v > 300:
                open_at = i
            elif open_at is not None and v <= 100:
                lengths.append(i - open_at)
                open_at = None
        if lengths:
            want[f"C{c}"] = (sum(lengths) / len(lengths), len(lengths))
    assert got.keys() == want.keys()
    for c in got:
        assert got[c][1] == want[c][1] and abs(got[c][0] - want[c][0]) <= 0.0501


def test_health_scale_gaps_count_as_good(spark):
    df = spark.createDataFrame([(v,) for v in (50.0, 50.5, 51.0, 100.5, 501.0, -1.0)], "v double")
    got = rows(df.select(health_category("v"), health_weight("v")))
    assert got == [("Good", 0), ("Good", 0), ("Satisfactory", 1), ("Good", 0), ("Severe", 10), ("Good", 0)]


def test_dashboard_scale_bounds(spark):
    df = spark.createDataFrame([(v,) for v in (50, 51, 150, 200, 300, 301)], "v int")
    assert [r[0] for r in rows(df.select(dashboard_category("v")))] == ["Good", "Moderate", "Poor", "Unhealthy", "Severe", "Hazardous"]


def test_worst_month_tie_takes_the_earlier(make):
    ds = make({"A": [("2020-02-01", 100), ("2020-05-01", 100), ("2020-06-01", 50)]})
    assert named.worst_month(ds).first().month == 2


@pytest.mark.parametrize("last,count", [("2020-01-05", 5), ("2020-01-06", 6)])
def test_midpoint_day_belongs_to_the_second_half(make, last, count):
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(days=i) for i in range(count)]
    ds = make({"A": [(d.isoformat(), {"pm25": i, "aqi_daily": 100}) for i, d in enumerate(days)]})
    mid = (count - 1) / 2
    split = int(mid + 0.5)
    second, first = range(split, count), range(split)
    want = round(sum(second) / len(second) - sum(first) / len(first), 2)
    assert named.rising_pm25_stable_aqi(ds).first().pm25_diff == want


def test_rounding_half_up(spark):
    df = spark.createDataFrame([(2.25, -2.5), (2.2499999999999996, 2.5)], "a double, b double")
    assert rows(df.select(rounded("a", 1), half_up("b"))) == [(2.3, -2), (2.3, 3)]


def test_hour_ties_take_the_later_hour(spark):
    day = [("e", datetime.date(2020, 1, 1), h, v, 1) for h, v in ((7, 5.0), (9, 5.0), (11, 1.0), (13, 1.0), (20, 3.0), (23, 3.0))]
    row = hourly_to_daily(spark.createDataFrame(day, "entity string, date date, hour int, value double, n bigint")).first()
    assert (row.day_max_hour, row.day_min_hour, row.night_max_hour, row.night_min_hour) == (9, 13, 23, 23)


def test_hour_labels(spark):
    df = spark.createDataFrame([(h,) for h in (0, 5, 12, 23)], "h int")
    assert [r[0] for r in rows(df.select(hour_label("h")))] == ["12 AM", "5 AM", "12 PM", "11 PM"]


def test_date_check(spark):
    df = spark.createDataFrame([("2020-02-29",), ("2021-02-29",), ("2020-2-9",), ("x",)], "d string")
    assert [r[0] for r in rows(df.select(valid_iso_date("d")))] == [True, False, False, False]


def test_latest_load_wins_also_with_null(spark):
    feed = [("A", "aqi", "2020-01-01", 5.0, 1), ("A", "aqi", "2020-01-01", None, 2), ("A", "co", "2020-01-02", 1.0, 1)]
    df = spark.createDataFrame(feed, "city string, sensor string, day string, value double, load_seq int")
    got = {r.date.day: (r.aqi_daily, r.co) for r in calendar_pivot(df).collect()}
    assert got == {1: (None, None), 2: (None, 1.0)}


def test_gap_fill_takes_the_first_two_valid(spark, make):
    ds = make({"A": [("2020-01-01", {"o3": None, "aqi_daily": 1}), ("2020-01-02", {"o3": 7, "aqi_daily": 1})]})
    day = datetime.date(2020, 1, 1)
    sensors = spark.createDataFrame(
        [(0, day, "o3", i, v) for i, v in enumerate((-1.0, 4.0, None, 6.0, 9.0))], "city_id int, date date, param string, sensor_rank int, value double"
    )
    got = {r.date.day: r.o3 for r in gap_fill(ds.readings, sensors).collect()}
    assert got == {1: 5.0, 2: 7.0}


def test_unit_fix(spark):
    df = spark.createDataFrame([(100.0,), (1250.0,), (None,)], "co double")
    assert [r[0] for r in rows(unit_fix(df))] == [100.0, 1.3, None]


def test_parameters_are_checked(small):
    with pytest.raises(ValueError):
        named.run_named(small, 31)
    with pytest.raises(ValueError):
        dashboard.daily_range(small, 1, "2020-13-01", "2020-01-01")
    with pytest.raises(ValueError):
        dashboard.daily_range(small, 0, "2020-01-01", "2020-01-01")
    with pytest.raises(ValueError):
        dashboard.historical(small, 1, 13)
    with pytest.raises(ValueError):
        dashboard.compare_cities(small, [])


def test_health_days_sum_to_total(small):
    for r in health_documents(small).collect():
        assert sum(v["days"] for v in r.category_breakdown.values()) == r.total_days


def test_longest_run_is_at_least_any_yearly_run(small):
    whole = {r.city_name: r.longest_cluster for r in named.longest_cluster(small).collect()}
    assert all(whole[r.city_name] >= r.longest_severe_streak for r in named.longest_streak_per_year(small).collect())


def test_short_series_have_no_weeks_and_no_halves(make):
    ds = make({"A": [("2020-01-01", 10), ("2020-01-02", 20)]})
    assert dashboard.best_worst_week(ds).count() == 0 and dashboard.half_growth(ds).count() == 0
    row = dashboard.trend_statement(ds).first()
    assert (row.direction, row.latest) == ("remain stable or improve", 20)


def test_spikes_filter_and_report_use_different_factors(make):
    ds = make({"A": [(f"2020-01-{d:02d}", 10) for d in range(1, 31)] + [("2020-02-01", 400)]})
    row = named.spikes(ds).first()
    assert row.aqi_daily == 400 and abs(row.threshold - (row.mean_aqi + 2 * row.std_dev)) < 0.02
    assert ds.readings.filter(F.col("aqi_daily") > row.threshold).count() == 1
