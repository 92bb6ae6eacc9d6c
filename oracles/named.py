"""SQL twins of the thirty named questions (self-join forms where they exist)."""

from oracles.base import rd, sql

Q: dict[str, str] = {}


def islands(cond: str, part: str = "city_id", extra: str = "") -> str:
    return f"""select city_id{extra}, grp, cast(count(*) as bigint) as len from (
      select city_id{extra}, date - cast(row_number() over (partition by {part} order by date) as integer) as grp
      from (select *, cast(year(date) as integer) as year from readings) where {cond})
      group by city_id{extra}, grp"""


Q["q01_longest_streak_per_year"] = sql(f"""
with runs as ({islands('aqi_daily >= 401', 'city_id, year', ', year')})
select city_name, year, max(len) as longest_severe_streak from runs join cities using (city_id)
group by city_name, year order by longest_severe_streak desc, city_name, year limit 15""")

Q["q02_state_improvement"] = sql(f"""
with sy as (select state, year(date) as y, avg(aqi_daily) as m from readings join cities using (city_id) group by 1, 2),
r as (select *, row_number() over (partition by state order by y desc) as rn from sy)
select a.state, {rd('a.m', 6)} as latest_avg, {rd('b.m', 6)} as old_avg, {rd('b.m - a.m', 6)} as improvement
from r a join r b on a.state = b.state where a.rn = 1 and b.rn = 3
order by improvement desc, a.state limit 7""")


def spikes(k: float) -> str:
    return sql(f"""
with s as (select city_id, avg(aqi_daily) as m, stddev_pop(aqi_daily) as d from readings group by 1)
select city_name, date, aqi_daily, {rd('m', 2)} as mean_aqi, {rd('d', 2)} as std_dev, {rd('m + 2*d', 2)} as threshold
from readings join s using (city_id) join cities using (city_id) where aqi_daily > m + {k}*d""")


Q["q03_spikes"] = spikes(1.7)
Q["q03_spikes_default"] = spikes(4)

Q["q04_hotspots"] = sql("""
select * from (
  select city_name, cast(year(date) as integer) as year,
    cast(sum(case when aqi_daily between 401 and 500 then 1 else 0 end) as bigint) as very_poor_days,
    cast(sum(case when aqi_daily >= 501 then 1 else 0 end) as bigint) as severe_days
  from readings join cities using (city_id) group by 1, 2) where very_poor_days + severe_days > 0""")


def good(level: float) -> str:
    return sql(f"""
with y as (select city_id, year(date) as y, avg(aqi_daily) as m from readings group by 1, 2)
select city_name from y join cities using (city_id) group by city_id, city_name having max(m) <= {level}""")


Q["q05_consistently_good"] = good(260)
Q["q05_consistently_good_default"] = good(150)

for key, measure, out in (("q06_monthly_aqi", "aqi_daily", "avg_monthly_aqi"), ("q07_monthly_pm25", "pm25", "avg_pm25")):
    Q[key] = sql(f"""
select city_name, cast(year(date) as integer) as year, cast(month(date) as integer) as month,
  {rd(f'avg({measure})', 2)} as {out}
from readings join cities using (city_id) group by 1, 2, 3""")

Q["q08_yearly_growth"] = sql(f"""
with y as (select city_id, cast(year(date) as integer) as year, avg(aqi_daily) as m from readings group by 1, 2),
l as (select *, lag(m) over (partition by city_id order by year) as p from y)
select city_name, year, {rd('m', 2)} as current_avg_aqi, {rd('p', 2)} as prev_year_aqi,
  {rd('(m - p) / p * 100', 2)} as growth_rate_percent
from l join cities using (city_id) where p is not null""")

Q["q09_worst_month"] = sql(f"""
with m as (select cast(year(date) as integer) as year, cast(month(date) as integer) as month, avg(aqi_daily) as a from readings group by 1, 2),
r as (select *, row_number() over (partition by year order by a desc, month) as rn from m)
select year, month, {rd('a', 2)} as worst_avg_aqi from r where rn = 1""")


def season(region: str) -> str:
    return sql(f"""
select city_name, case when month(date) in (12,1,2) then 'Winter' else 'Summer' end as season, {rd('avg(pm25)', 2)} as avg_pm25
from readings join cities using (city_id)
where region = '{region}' and month(date) in (12,1,2,4,5,6) group by 1, 2""")


Q["q10_north_season_pm25"] = season("ASIA")
Q["q10_north_season_pm25_default"] = season("North")

CORR = "(avg({x} * aqi_daily) - avg({x}) * avg(aqi_daily)) / nullif(stddev_pop({x}) * stddev_pop(aqi_daily), 0)"
Q["q11_dominant_pollutant"] = sql(f"""
with c as (select city_name, {rd(CORR.format(x='pm25'), 6)} as corr_pm25, {rd(CORR.format(x='pm10'), 6)} as corr_pm10
  from readings join cities using (city_id) group by 1)
select *, case when corr_pm25 > corr_pm10 then 'PM2.5 dominates AQI' when corr_pm25 < corr_pm10 then 'PM10 dominates AQI'
  else 'Equal influence' end as dominant_pollutant from c""")
Q["q12_pm25_corr"] = sql(f"""
select city_name, {rd(CORR.format(x='pm25'), 6)} as corr_pm25_aqi from readings join cities using (city_id) group by 1""")

Q["q13_rising_pm25_stable_aqi"] = sql(f"""
with mid as (select min(date) + cast(round(date_diff('day', min(date), max(date)) / 2.0) as integer) as m from readings),
d as (select city_id,
    avg(case when date >= m then pm25 end) - avg(case when date < m then pm25 end) as p,
    avg(case when date >= m then aqi_daily end) - avg(case when date < m then aqi_daily end) as a
  from readings, mid group by 1)
select city_name, {rd('p', 2)} as pm25_diff, {rd('a', 2)} as aqi_diff from d join cities using (city_id)
where p > 0 and abs(a) < 10""")

Q["q14_weekday_weekend"] = sql(f"""
select city_name, {rd('avg(case when dayofweek(date) between 1 and 5 then aqi_daily end)', 6)} as avg_weekday_aqi,
  {rd('avg(case when dayofweek(date) in (0, 6) then aqi_daily end)', 6)} as avg_weekend_aqi
from readings join cities using (city_id) group by 1""")

Q["q15_drastic_changes"] = sql("""
with l as (select city_id, aqi_daily, lag(aqi_daily) over (partition by city_id order by date) as p from readings)
select city_name, count(*) as total_days_measured,
  cast(sum(case when abs(aqi_daily - p) > 50 then 1 else 0 end) as bigint) as frequent_drastic_changes
from l join cities using (city_id) where p is not null group by 1""")

Q["q16_volatility"] = sql(f"""
select city_name, {rd('stddev_pop(aqi_daily)', 2)} as aqi_volatility_score from readings join cities using (city_id) group by 1""")

Q["q17_polluted_spell_avg"] = sql(f"""
with runs as ({islands('aqi_daily > 200')})
select city_name, {rd('avg(len)', 1)} as avg_polluted_streak_days from runs join cities using (city_id) group by 1""")


def contrast(measure: str, a: str, b: str, names: tuple[str, ...], digits: int, where: str = "true") -> str:
    first, second, diff = names
    return sql(f"""
with c as (select city_name, avg(case when month(date) in ({a}) then {measure} end) as x,
    avg(case when month(date) in ({b}) then {measure} end) as y
  from readings join cities using (city_id) where {where} group by 1)
select city_name, {f"{rd('x', digits)} as {first}, {rd('y', digits)} as {second}," if first else ""}
  {rd('x - y', digits)} as {diff} from c""")


Q["q18_rain_before_after"] = contrast("aqi_daily", "4,5", "10,11", ("pre_rainfall_aqi", "post_rainfall_aqi", "cleansing_impact_drop"), 1)
Q["q23_seasonal_ozone"] = contrast("o3", "3,4,5,6", "11,12,1,2", ("avg_summer_o3", "avg_winter_o3", "summer_spike_difference"), 2, "o3 is not null")
Q["q29_seasonal_drop"] = contrast("aqi_daily", "12,1,2", "4,5,6", ("", "", "seasonal_drop"), 2)


def recovery(cond: str) -> str:
    """Theta self-join: first later day at or under 100."""
    return f"""select e.city_id, date_diff('day', e.date, min(a.date)) as days
      from readings e join readings a on e.city_id = a.city_id and a.date > e.date and a.aqi_daily <= 100
      where {cond} group by e.city_id, e.date"""


Q["q19_recovery_from_extreme"] = sql(f"""
with r as ({recovery('e.aqi_daily > 300')})
select city_name, count(*) as total_extreme_events, {rd('avg(days)', 1)} as avg_recovery_days
from r join cities using (city_id) group by 1""")
Q["q27_recovery_from_severe"] = sql(f"""
with r as ({recovery('e.aqi_daily >= 401')})
select city_name, {rd('avg(days)', 2)} as avg_recovery_time from r join cities using (city_id) group by 1""")

Q["q20_region_gas_vs_pm"] = sql(f"""
with g as (select region, avg(coalesce(co,0) + coalesce(no2,0) + coalesce(o3,0)) as gas, avg(coalesce(pm10,0) + coalesce(pm25,0)) as pm
  from readings join cities using (city_id) group by 1)
select region, {rd('gas', 2)} as avg_chemical_pollution, {rd('pm', 2)} as avg_particulate_pollution,
  {rd('gas / nullif(pm, 0)', 4)} as gas_to_pm_ratio,
  case when gas > pm then 'Primarily Chemical (Gas)' else 'Primarily Particulate' end as pollution_profile from g""")


def onset(level: float) -> str:
    return sql(f"""
with d as (select region, date, avg(pm25) as p from readings join cities using (city_id)
  where pm25 is not null and month(date) between 8 and 12 group by 1, 2),
m as (select region, date, avg(p) over (partition by region order by date rows between 6 preceding and current row) as a from d)
select cast(year(date) as integer) as onset_year, region, min(date) as first_spike_date from m
where round(a, 9) > {level} and month(date) in (9,10,11,12) group by 1, 2""")


Q["q21_winter_onset"] = onset(125)
Q["q21_winter_onset_default"] = onset(100)

Q["q22_state_percentiles"] = sql(f"""
select state, {rd('quantile_cont(aqi_daily, 0.9)', 1)} as aqi_90th_percentile, {rd('quantile_cont(aqi_daily, 0.95)', 1)} as aqi_95th_percentile
from readings join cities using (city_id) where aqi_daily is not null group by 1""")

Q["q24_no2_ratio"] = sql(f"""
with s as (select city_name, avg(no2) as n, avg(aqi_daily) as a from readings join cities using (city_id)
  where no2 is not null and aqi_daily is not null group by 1)
select city_name, {rd('n', 2)} as avg_no2, {rd('a', 2)} as avg_overall_aqi, {rd('n / nullif(a, 0)', 4)} as traffic_pollution_ratio from s""")

Q["q25_co_pm_cooccurrence"] = sql(f"""
with w as (select city_id, co, pm25 from readings where month(date) in (11,12,1,2) and co is not null and pm25 is not null),
t as (select quantile_cont(co, 0.75) as c, quantile_cont(pm25, 0.75) as p from w),
s as (select city_name, count(*) as total_winter_days,
    cast(sum(case when co > c and pm25 > p then 1 else 0 end) as bigint) as co_pm_simultaneous_spikes
  from w join cities using (city_id), t group by 1)
select *, {rd('co_pm_simultaneous_spikes * 100.0 / total_winter_days', 2)} as co_occurrence_rate_percent from s""")

Q["q26_hidden_hazard_days"] = sql("""
select city_name, date, aqi_daily as reported_overall_aqi, o3 as ozone_level, co as carbon_monoxide_level,
  case when o3 > 200 then 'High Ozone Hazard' when co > 2.5 then 'High CO Hazard' else 'Moderate Gas Risk' end as hazard_type
from readings join cities using (city_id) where aqi_daily <= 100 and (o3 > 200 or co > 2.5)""")

Q["q28_early_warning"] = sql(f"""
with p as (select s.city_id, s.date as d, max(a.date) as w
  from readings s join readings a on s.city_id = a.city_id and a.date < s.date and a.pm25 >= 200
  where s.aqi_daily >= 401 group by 1, 2)
select city_name, {rd("avg(date_diff('day', w, d))", 2)} as avg_warning_days from p join cities using (city_id) group by 1""")

Q["q30_longest_cluster"] = sql(f"""
with runs as ({islands('aqi_daily >= 401')})
select city_name, max(len) as longest_cluster from runs join cities using (city_id) group by 1""")
