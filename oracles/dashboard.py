"""SQL twins of the dashboard queries and roll-ups."""

from oracles.base import rd, sql, up

Q: dict[str, str] = {}
SHOWN = {"aqi": "aqi_daily", "pm25": "pm25", "pm10": "pm10"}
DAYS = "days as (select city_name, city_id, date, " + ", ".join(
    f"coalesce({up(m)}, 0) as avg_{k}" for k, m in SHOWN.items()) + " from readings join cities using (city_id))"


def d(body: str) -> str:
    return sql(body, DAYS)


def category(x: str) -> str:
    steps = ((50, "Good"), (100, "Moderate"), (150, "Poor"), (200, "Unhealthy"), (300, "Severe"))
    return "case " + " ".join(f"when {x} <= {b} then '{n}'" for b, n in steps) + " else 'Hazardous' end"


Q["d1_daily_range"] = d("select date, " + ", ".join(
    f"avg_{k} as {p}_{k}" for k in SHOWN for p in ("avg", "max", "min")) + " from days where city_id = 7")
Q["d1_period_days"] = d("select date, " + ", ".join(
    f"avg_{k} as {p}_{k}" for k in SHOWN for p in ("avg", "max", "min")) + ", last_day(date) as last_of_month from days where city_id = 7 and date between date '2000-02-01' and date '2000-02-29'")

Q["d2_overview"] = sql(f"""
with mx as (select city_id, max(date) as m from readings group by 1),
l as (select r.* from readings r join mx on r.city_id = mx.city_id and r.date = mx.m),
a as (select r.city_id, avg(aqi_daily) as aqi_daily, avg(pm25) as pm25, avg(pm10) as pm10 from readings r join mx on r.city_id = mx.city_id
  and year(r.date) = year(mx.m) and month(r.date) = month(mx.m) group by 1)
select c.city_id, c.city_name, c.state, l.date as latest_date, """
    + ", ".join(f"coalesce({up(f'l.{m}')}, 0) as current_{k}" for k, m in SHOWN.items()) + ", "
    + ", ".join(f"coalesce({up(f'a.{m}')}, 0) as month_{k}" for k, m in SHOWN.items())
    + " from cities c left join l using (city_id) left join a using (city_id)")

Q["d3_historical"] = sql("select cast(year(date) as integer) as year, " + ", ".join(
    f"coalesce({up(f'avg({m})')}, 0) as avg_{k}" for k, m in SHOWN.items()) + " from readings where city_id = 7 and month(date) = 3 group by 1")
Q["d4_cities"] = sql("select city_id, city_name, state, region from cities")

FOLD = ", ".join(f"{up(f'avg(avg_{k})')} as avg_{k}, max(avg_{k}) as max_{k}, min(avg_{k}) as min_{k}" for k in SHOWN)
N = "n as (select *, row_number() over (partition by city_name order by date) as pos, count(*) over (partition by city_name) as n from days)"
Q["d6_weekly_rollup"] = d(f"with {N} select city_name, (pos - 1) // 7 as chunk, min(date) as start, max(date) as end, {FOLD} from n group by 1, 2")
Q["d7_monthly_rollup"] = d(f"select city_name, strftime(date, '%Y-%m') as month, {FOLD} from days group by 1, 2")


def stats(year: int, month: int | None = None) -> str:
    only = "" if month is None else f" and month(date) = {month}"
    return f"""mo as (select city_name, state, year(date) as y, month(date) as m, """ + ", ".join(
        f"coalesce({up(f'avg({m})')}, 0) as {k}" for k, m in SHOWN.items()) + f""" from readings join cities using (city_id)
  where year(date) in ({year}, {year - 1}){only} group by 1, 2, 3, 4),
ps as (select city_name, state, """ + ", ".join(f"{up(f'avg(case when y = {year} then {k} end)')} as current_{k}" for k in SHOWN) + f""",
  {up(f'avg(case when y = {year - 1} then aqi end)')} as previous_aqi from mo group by 1, 2 having count(*) filter (y = {year}) > 0)"""


GROWTH = f"coalesce({rd('(current_aqi - previous_aqi) * 100.0 / nullif(previous_aqi, 0)', 4)}, 0.0) as growth_percent"
RANKED = f"rk as (select *, row_number() over (order by current_aqi, city_name) as rank, coalesce(current_aqi - previous_aqi, 0) as change, {GROWTH} from ps)"
Q["d8_period_stats"] = sql(f"with {stats(2000)} select * from ps")
Q["d8_period_stats_month"] = sql(f"with {stats(2000, 5)} select * from ps")
Q["d8_period_summary"] = sql(f"""with {stats(2000)} select {up('avg(current_aqi)')} as avg_aqi,
  (select city_name from ps order by current_aqi desc, city_name desc limit 1) as worst,
  (select city_name from ps order by current_aqi, city_name desc limit 1) as best from ps""")
Q["d9_ranks_and_sorts"] = sql(f"with {stats(2000)}, {RANKED} select * from rk")
Q["d9_search"] = sql(f"with {stats(2000)}, {RANKED} select * from rk where contains(lower(city_name), 'state_3') or contains(lower(state), 'state_3')")
Q["d14_growth_percent"] = sql(f"with {stats(2000)} select city_name, {GROWTH} from ps")
Q["d16_city_distribution"] = sql(f"""with {stats(2000)}, p as (select {category('current_aqi')} as category, city_name, state, current_aqi as avg_aqi from ps)
select *, count(*) over (partition by category) as cities from p""")

Q["d15_ui_category"] = d(f"""
with l as (select *, row_number() over (partition by city_name order by date desc) as rn from days)
select c.city_name, coalesce(avg_aqi, 0) as current_aqi, {category('coalesce(avg_aqi, 0)')} as category
from cities c left join (select * from l where rn = 1) l using (city_name)""")

LABELS = ("Good", "Moderate", "Poor", "Unhealthy", "Severe", "Hazardous")
Q["d13_category_share"] = d(f"with k as (select city_name, {category('avg_aqi')} as label from days) select city_name, " + ", ".join(
    f"""{up(f"count(*) filter (label = '{x}') * 100.0 / count(*)")} as {x.lower()}""" for x in LABELS) + " from k group by 1")


def vol(dev: str, n: str) -> str:
    return f"case when {n} < 2 then 'Insufficient Data' when round({dev}, 9) > 50 then 'Volatile' when round({dev}, 9) > 25 then 'Moderate' else 'Stable' end"


def momentum(x: str) -> str:
    return f"case when {x} > 20 then 'Rapidly Worsening' when {x} > 5 then 'Worsening' when {x} < -20 then 'Rapidly Improving' when {x} < -5 then 'Improving' else 'Stable' end"


Q["d11_volatility_label"] = d(f"""
with s as (select city_name, stddev_pop(avg_aqi) as dev, count(*) as n from days group by 1)
select city_name, case when n < 2 then 0.0 else {rd('dev', 1)} end as stddev, {vol('dev', 'n')} as label from s""")
Q["d12_best_worst_month"] = d(f"""
with m as (select city_name, strftime(date, '%Y-%m') as month, {up('avg(avg_aqi)')} as mean from days group by 1, 2),
r as (select *, row_number() over (partition by city_name order by mean, month desc) as lo, row_number() over (partition by city_name order by mean desc, month desc) as hi from m)
select city_name, max(month) filter (lo = 1) as best_month, min(mean) as best_avg, max(month) filter (hi = 1) as worst_month, max(mean) as worst_avg from r group by 1""")


def dive(k: str) -> str:
    return f"""{N},
x as (select *, row_number() over (partition by city_name order by avg_{k} desc, pos) as hi, row_number() over (partition by city_name order by avg_{k}, pos) as lo from n),
dd as (select city_name, {up(f'avg(avg_{k})')} as avg, max(avg_{k}) as max, max(date) filter (hi = 1) as max_date, min(avg_{k}) as min,
  max(date) filter (lo = 1) as min_date, max(avg_{k}) filter (pos = n) as latest,
  max(avg_{k}) filter (pos = case when n > 7 then n - 7 else 1 end) as previous, stddev_pop(avg_{k}) as dev, max(n) as n from x group by 1)"""


DIVE_OUT = f"""select city_name, avg, {category('avg')} as category, max, max_date, min, min_date, latest, previous, {rd('dev', 1)} as stddev,
  {vol('dev', 'n')} as volatility, latest - previous as change, {momentum('latest - previous')} as momentum from dd where n >= 2"""
Q["d17_deep_dive"] = d(f"with {dive('aqi')} {DIVE_OUT}")
Q["d17_deep_dive_pm25"] = d(f"with {dive('pm25')} {DIVE_OUT}")
Q["d10_momentum"] = d(f"with {dive('aqi')} select city_name, latest - previous as change, {momentum('latest - previous')} as momentum from dd where n >= 2")
Q["d18_best_worst_week"] = d(f"""
with {N},
w as (select city_name, (pos - 1) // 7 as k, min(date) as s, max(date) as e, {up('avg(avg_aqi)')} as mean from n where n >= 7 group by 1, 2),
r as (select *, row_number() over (partition by city_name order by mean, k desc) as lo, row_number() over (partition by city_name order by mean desc, k desc) as hi from w)
select city_name, max(s) filter (lo = 1) as best_start, max(e) filter (lo = 1) as best_end, min(mean) as best_mean,
  max(s) filter (hi = 1) as worst_start, max(e) filter (hi = 1) as worst_end, max(mean) as worst_mean from r group by 1 having count(*) >= 2""")
HALF = f"""h as (select city_name, {up('avg(avg_aqi) filter (pos <= n // 2)')} as avg_first, {up('avg(avg_aqi) filter (pos > n // 2)')} as avg_second
  from n where n >= 4 group by 1)"""
Q["d19_half_growth"] = d(f"""with {N}, {HALF} select *, avg_second - avg_first as change,
  case when avg_first > 0 then {up('(avg_second - avg_first) * 100.0 / avg_first')} else 0 end as pct from h""")
Q["d20_trend_statement"] = d(f"""with {dive('aqi')}, {HALF}
select dd.city_name, case when avg_second - avg_first > 0 then 'continue rising' else 'remain stable or improve' end as direction,
  latest, {category('latest')} as category from dd left join h using (city_name) where dd.n >= 2""")
Q["d21_compare_cities"] = d("""
select date, max(avg_aqi) filter (city_id = 1) as city_1, max(avg_aqi) filter (city_id = 7) as city_7, max(avg_aqi) filter (city_id = 12) as city_12, max(avg_aqi) filter (city_id = 20) as city_20
from days where city_id in (1, 7, 12, 20) group by 1""")

HOURS = f"h as (select event_type as entity, cast(ts as date) as date, cast(hour(ts) as integer) as hour, {rd('avg(value)', 2)} as value, count(*) as n from events group by 1, 2, 3)"
PART = {"day": "hour >= 6 and hour < 18", "night": "not (hour >= 6 and hour < 18)"}
LABEL = "concat(case when {h} % 12 = 0 then 12 else {h} % 12 end, case when {h} < 12 then ' AM' else ' PM' end) as {n}"
Q["d22_hourly_to_daily"] = (
    f"with {HOURS}, dd as (select entity, date, {up('avg(value)')} as avg_value, max(value) as max_value, min(value) as min_value, {up('avg(n)')} as avg_n, max(n) as max_n, min(n) as min_n, "
    + ", ".join(
        f"{up(f'avg(value) filter ({c})')} as {p}_avg, max(value) filter ({c}) as {p}_max, min(value) filter ({c}) as {p}_min, "
        f"arg_max(hour, (value, hour)) filter ({c}) as {p}_max_hour, arg_min(hour, (value, -hour)) filter ({c}) as {p}_min_hour"
        for p, c in PART.items())
    + " from h group by 1, 2) select *, "
    + ", ".join("case when {h} is not null then ".format(h=f"{p}_{e}_hour") + LABEL.format(h=f"{p}_{e}_hour", n="").replace(" as ", "") + f" end as {p}_{e}_label" for p in PART for e in ("max", "min"))
    + " from dd")
