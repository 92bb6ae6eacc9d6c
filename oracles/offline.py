"""SQL twins of the offline questions, the feature frames and the shaped results."""

from oracles.base import FILLED, rd, sql

Q: dict[str, str] = {}
ORDER = ("co", "no2", "o3", "pm10", "pm25", "aqi_daily")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def z(body: str) -> str:
    return sql(body, FILLED)


def runs(cond: str, part: str = "city") -> str:
    """Runs of neighbouring rows where the condition holds."""
    return f"""select {part}, cast(count(*) as bigint) as len from (
      select *, row_number() over (partition by {part} order by date) - row_number() over (partition by {part}, {cond} order by date) as g from z)
      where {cond} group by {part}, g"""


STREAKS = f"st as (select city, year, max(len) as streak from ({runs('(aqi_daily >= 401)', 'city, year')}) group by 1, 2)"
Q["p01_streaks"] = z(f"""
with {STREAKS}
select *, case when streak >= 10 then 'SEVERE' when streak >= 5 then 'HIGH' else 'MODERATE' end as risk
from st order by streak desc, city, year limit 15""")
Q["p01_streak_trend"] = z(f"""
with {STREAKS}, y as (select year, max(streak) as s from st group by 1)
select {rd('regr_slope(s, year)', 2)} as trend_slope, max(year) + 1 as next_year,
  cast(trunc(round(regr_intercept(s, year) + regr_slope(s, year) * (max(year) + 1), 6)) as integer) as predicted_streak from y""")

IMPROVED = f"""y as (select city, year, avg(aqi_daily) as m from z group by 1, 2),
r as (select *, row_number() over (partition by city order by year desc) as rn from y),
i as (select a.city, {rd('a.m', 1)} as latest_avg, {rd('b.m', 1)} as old_avg, {rd('b.m - a.m', 1)} as improvement
  from r a join r b on a.city = b.city where a.rn = 1 and b.rn = 3)"""
Q["p02_city_improvement"] = z(f"with {IMPROVED} select * from i")
Q["p02_improvement_extremes"] = z(f"""with {IMPROVED}
select (select city from i order by improvement desc, city limit 1) as best_improving,
       (select city from i order by improvement, city desc limit 1) as worst_declining""")

Q["p04_hotspots"] = z("""
select *, very_poor + severe as total_bad from (
  select city, year, cast(count(*) filter (aqi_daily between 401 and 500) as bigint) as very_poor,
    cast(count(*) filter (aqi_daily > 500) as bigint) as severe from z group by 1, 2)
where very_poor + severe > 0 order by total_bad desc, city, year limit 15""")

Q["p05_good_flags"] = z(f"""
with y as (select city, year, avg(aqi_daily) as m from z group by 1, 2)
select city, {rd('max(m)', 1)} as max_yearly_avg, {rd('avg(m)', 1)} as mean_avg, max(m) <= 150 as is_good from y group by 1""")

Q["p06_p07_top_cities"] = z("select city, count(*) as days from z group by 1 order by days desc, city limit 5")

YEARLY = "y as (select city, year, avg(aqi_daily) as m from z group by 1, 2)"
Q["p08_growth"] = z(f"""
with {YEARLY},
g as (select city, year, (m - lag(m) over w) * 100 / lag(m) over w as g from y window w as (partition by city order by year))
select city, {rd('avg(g)', 2)} as avg_growth, coalesce({rd('arg_max(g, year)', 2)}, 0.0) as latest_growth from g group by 1 having count(*) >= 2""")
Q["p08_projection"] = z(f"""
with {YEARLY},
f2 as (select city, regr_slope(m, year) as s, regr_intercept(m, year) as i, max(year) as l from y group by 1 having count(*) >= 3)
select city, cast(l + k as integer) as year, {rd('i + s * (l + k)', 4)} as projected_aqi from f2, (values (1), (2), (3)) t(k)""")

WORST = """m as (select year, month, avg(aqi_daily) as a from z group by 1, 2),
w as (select * from (select *, row_number() over (partition by year order by a desc, month) as rn from m) where rn = 1)"""
NAME = "list_extract([" + ", ".join(f"'{m}'" for m in MONTHS) + "], month)"
Q["p09_worst_months"] = z(f"with {WORST} select year, {NAME} as month, {rd('a', 1)} as avg_aqi from w")
Q["p09_month_table"] = z(
    "select year, "
    + ", ".join(f"coalesce({rd(f'avg(case when month = {i + 1} then aqi_daily end)', 2)}, 0.0) as {m}" for i, m in enumerate(MONTHS))
    + " from z group by 1"
)
Q["p09_most_frequent"] = z(f"""
with {WORST} select {NAME} as month, years from (select month, count(*) as years from w group by 1 order by years desc, month limit 1)""")


def season(where: str) -> str:
    return f"""s as (select city, avg(case when z.month in (12,1,2) then pm25 end) as w, avg(case when z.month in (4,5,6) then pm25 end) as u
  from z where {where} group by 1),
p as (select city, {rd('w', 1)} as winter_pm25, {rd('u', 1)} as summer_pm25, {rd('w / greatest(u, 0.01)', 2)} as ratio
  from s where w is not null and u is not null)"""


ASIA = "city in (select city_name from cities where region = 'ASIA')"
Q["p10_season_ratio"] = z(f"with {season(ASIA)} select * from p")
Q["p10_season_ratio_default"] = z(f"with {season("city in (select city_name from cities where region = 'North')")} select * from p")
Q["v2_season_delta"] = z(f"with {season(ASIA)} select *, {rd('winter_pm25 - summer_pm25', 1)} as delta from p")

DOM = f"""d as (select city, count(*) as n, corr(pm25, aqi_daily) as a, corr(pm10, aqi_daily) as b from z group by 1),
l as (select city, case when n >= 30 then {rd('a', 4)} end as corr_pm25, case when n >= 30 then {rd('b', 4)} end as corr_pm10,
  case when n < 30 then null when round(a - b, 9) > 0 then 'PM2.5' when round(a - b, 9) < 0 then 'PM10' else 'Equal' end as dominant, case when n >= 30 then 'ok' else 'insufficient data' end as status from d)"""
Q["p11_dominant"] = z(f"with {DOM} select * from l")
Q["v3_correlation_gap"] = z(f"with {DOM} select *, {rd('abs(corr_pm25 - corr_pm10)', 4)} as gap from l")

Q["p12_corr_matrix"] = z(" union all ".join(
    f"select '{a}' as a, '{b}' as b, " + ("1.0::double" if a == b else rd(f"corr({a}, {b})", 4)) + " as corr" + (" from z" if a != b else "")
    for a in ORDER for b in ORDER))

Q["p13_divergence"] = z(f"""
with y as (select city, year, avg(pm25) as p, avg(aqi_daily) as a from z group by 1, 2),
r as (select *, row_number() over (partition by city order by year) as rn, count(*) over (partition by city) as n from y),
d as (select city, avg(p) filter (rn > n // 2) - avg(p) filter (rn <= n // 2) as dp,
    avg(a) filter (rn > n // 2) - avg(a) filter (rn <= n // 2) as da from r where n >= 3 group by 1)
select city, {rd('dp', 1)} as pm25_increase, {rd('da', 1)} as aqi_change from d where dp > 0 and abs(da) < 10""")


def pair(measure: str, a: str, b: str, names: tuple[str, str, str], digits: int, diff: int | None = None) -> str:
    return z(f"""
with p as (select city, avg(case when {a} then {measure} end) as x, avg(case when {b} then {measure} end) as y from z group by 1)
select city, coalesce({rd('x', digits)}, 0.0) as {names[0]}, coalesce({rd('y', digits)}, 0.0) as {names[1]},
  coalesce({rd('x - y', diff or digits)}, 0.0) as {names[2]} from p""")


Q["p14_weekday_weekend"] = pair("aqi_daily", "isodow(date) <= 5", "isodow(date) >= 6", ("weekday_avg", "weekend_avg", "difference"), 1)
Q["p18_rain"] = pair("aqi_daily", "month in (4,5)", "month in (10,11)", ("pre_rainfall", "post_rainfall", "cleansing_impact"), 1)
Q["p23_ozone"] = pair("o3", "month in (3,4,5,6)", "month in (11,12,1,2)", ("summer_o3", "winter_o3", "summer_spike"), 2)
Q["p29_season_pair"] = pair("aqi_daily", "month in (12,1,2)", "month in (4,5,6)", ("winter_avg", "summer_avg", "seasonal_drop"), 1, 2)

Q["p15_volatility_rate"] = z(f"""
with l as (select city, abs(aqi_daily - lag(aqi_daily) over (partition by city order by date)) as c from z),
s as (select city, cast(count(*) filter (c > 50) as bigint) as drastic_changes, count(*) - 1 as total_days from l group by 1)
select *, {rd('drastic_changes * 100.0 / greatest(total_days, 1)', 1)} as volatility_rate from s""")

Q["p16_std_mean"] = z(f"select city, {rd('stddev_samp(aqi_daily)', 2)} as std_aqi, {rd('avg(aqi_daily)', 2)} as mean_aqi from z group by 1")

Q["p17_spells"] = z(f"""
with r as ({runs('(aqi_daily > 200)')}), c as (select distinct city from z)
select city, coalesce({rd('avg(len)', 1)}, 0.0) as avg_spell_days, count(len) as total_spells, coalesce(max(len), 0) as max_spell
from c left join r using (city) group by 1""")
Q["p30_clusters"] = z(f"""
with r as ({runs('(aqi_daily >= 401)')})
select city, max(len) as longest_cluster, count(*) as total_clusters, {rd('avg(len)', 1)} as avg_cluster from r group by 1""")

PLACED = "n as (select *, row_number() over (partition by city order by date) as pos from z)"


def episodes(cond: str, name: str) -> str:
    return z(f"""
with {PLACED},
r as (select e.city, e.pos, min(g.pos) as rec from n e join n g on e.city = g.city and g.pos > e.pos and g.aqi_daily <= 100
  where {cond} group by 1, 2),
k as (select city, rec - min(pos) as len from r group by city, rec)
select city, {rd('avg(len)', 1)} as {name}, count(*) as events from k group by 1""")


Q["p19_recovery_episodes"] = episodes("e.aqi_daily > 300", "avg_recovery_days")
Q["p27_recovery_episodes_severe"] = episodes("e.aqi_daily >= 401", "avg_recovery")

Q["p20_city_profile"] = z(f"""
with s as (select city, avg(co) + avg(no2) + avg(o3) as g, avg(pm10) + avg(pm25) as p from z group by 1)
select city, {rd('g', 2)} as avg_gas, {rd('p', 2)} as avg_particulate, {rd('g / greatest(p, 0.01)', 4)} as ratio,
  case when g > p then 'Gas-Dominant' else 'Particulate-Dominant' end as profile from s""")


def onset(level: float) -> str:
    return f"""a as (select city, date, year, month, avg(pm25) over (partition by city order by date rows between 6 preceding and current row) as m from z),
o as (select city, year, min(date) as onset_date from a where round(m, 9) > {level} and month in (9,10,11,12) group by 1, 2)"""


for suffix, level in (("", 160), ("_default", 100)):
    Q["p21_onset_city" + suffix] = z(f"""
with {onset(level)}
select city, year, onset_date, cast(month(onset_date) as integer) as onset_month, cast(day(onset_date) as integer) as onset_day from o""")
Q["p21_mean_onset_day"] = z(f"with {onset(160)} select city, {rd('avg(day(onset_date))', 4)} as mean_onset_day from o group by 1")
Q["v4_onset_table"] = z(f"with {onset(160)} select city, year, cast(min(dayofyear(onset_date)) as integer) as day from o group by 1, 2")

Q["p22_city_percentiles"] = z(f"""
select city, {rd('quantile_cont(aqi_daily, 0.9)', 1)} as p90, {rd('quantile_cont(aqi_daily, 0.95)', 1)} as p95 from z group by 1""")

Q["p24_no2_ratio"] = z(f"""
with s as (select city, avg(no2) as n, avg(aqi_daily) as a from z group by 1)
select city, {rd('n', 2)} as avg_no2, {rd('a', 2)} as avg_aqi, {rd('n / greatest(a, 1)', 4)} as traffic_ratio from s""")

COOC = f"""w as (select * from z where month in (11,12,1,2)),
t as (select quantile_cont(co, 0.75) as c, quantile_cont(pm25, 0.75) as p from w),
s as (select city, count(*) as total_winter_days, cast(count(*) filter (co > c and pm25 > p) as bigint) as co_pm_simultaneous from w, t group by 1),
o as (select *, {rd('co_pm_simultaneous * 100.0 / greatest(total_winter_days, 1)', 2)} as rate from s)"""
Q["p25_cooccurrence"] = z(f"with {COOC} select * from o")
Q["v5_cooccurrence_complement"] = z(f"with {COOC} select *, {rd('100.0 - rate', 2)} as non_rate from o")

STRICT = f"select city, date, {rd('aqi_daily', 1)} as aqi, {rd('o3', 1)} as o3, {rd('co', 3)} as co from z where aqi_daily <= 100 and (o3 > 200 or co > 2.5)"
HAZ = f"""h as (select * from z where aqi_daily <= 150 and (o3 > 100 or co > 1.5)),
hr as (select city, date, {rd('aqi_daily', 1)} as aqi, {rd('o3', 1)} as o3, {rd('co', 3)} as co from h)"""
KIND = "case when o3 >= 200 and co > 2.5 then 'both' when o3 >= 200 then 'high_o3' else 'high_co' end"
Q["p26_hazards_strict"] = z(STRICT)
Q["p26_hazards_relaxed"] = z(f"with {HAZ} select * from hr")
Q["p26_hazard_counts"] = z(f"with {HAZ} select city, count(*) as hazard_days from hr group by 1")
Q["v6_hazard_months"] = z(f"with {HAZ} select city, strftime(date, '%Y-%m') as month, count(*) as days from hr group by 1, 2")
Q["v6_hazard_types"] = z(f"with {HAZ} select city, " + ", ".join(
    f"cast(count(*) filter ({KIND} = '{k}') as bigint) as {k}" for k in ("high_co", "high_o3", "both")) + " from hr group by 1")

Q["p28_early_warning_29"] = z(f"""
with {PLACED},
w as (select s.city, s.pos, s.pos - max(a.pos) as gap from n s join n a on s.city = a.city and a.pos < s.pos and a.pos >= s.pos - 29 and a.pm25 >= 200
  where s.aqi_daily >= 401 group by 1, 2)
select city, {rd('avg(gap)', 1)} as avg_warning_days, count(*) as events from w group by 1""")

Q["v1_streak_table"] = z(f"with {STREAKS} select city, year, coalesce(max(streak), 0) as streak from (select distinct city, year from z) left join st using (city, year) group by 1, 2")

MEANS = ", ".join(f"{rd(f'avg({m})', 6)} as avg_{'aqi' if m == 'aqi_daily' else m}" for m in ORDER)
STD = f"{rd('stddev_samp(aqi_daily)', 6)} as std_aqi"
Q["f1_city_slice"] = z("select city, date, co, no2, o3, pm10, pm25, aqi_daily from z where city = 'NATION_7'")
Q["f2_city_list"] = z("select distinct city from z")
Q["f3_monthly_features"] = z(f"select city, year, month, {MEANS} from z group by 1, 2, 3")
Q["s6_kept_rollup"] = Q["f3_monthly_features"]
Q["f4_yearly_features"] = z(f"select city, year, {MEANS}, {STD} from z group by 1, 2")
Q["f5_city_features"] = z(f"""
select city, {MEANS}, {STD}, max(aqi_daily) as max_aqi, min(aqi_daily) as min_aqi,
  coalesce({rd('avg(aqi_daily) filter (month in (11,12,1,2)) / nullif(avg(aqi_daily) filter (month in (4,5,6)), 0)', 6)}, 1.0) as seasonal_ratio
from z group by 1""")
PROFILE = ("avg_aqi", "avg_pm25", "avg_pm10", "volatility", "max_spike")
Q["f6_city_profile"] = sql("""
with b as (select city_name as city, avg(aqi_daily) as avg_aqi, avg(pm25) as avg_pm25, avg(pm10) as avg_pm10,
    stddev_samp(aqi_daily) as volatility, max(aqi_daily) as max_spike from readings join cities using (city_id) group by 1)
select city, """ + ", ".join(rd(f"coalesce({c}, (select median({c}) from b))", 6) + f" as {c}" for c in PROFILE) + " from b")
