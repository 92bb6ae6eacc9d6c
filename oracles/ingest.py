"""SQL twins of the ingest and cleaning questions."""

from oracles.base import rd, sql

Q: dict[str, str] = {}
ORDER = ("co", "no2", "o3", "pm10", "pm25", "aqi_daily")
ALL = ", ".join(ORDER)
NAMED = f"nr as (select city_name as city, date, {ALL} from readings join cities using (city_id))"

Q["i1_calendar_pivot"] = sql("select city, date, " + ", ".join(
    f"case when day(date) = 1 then {m} + 1 else {m} end as {m}" for m in ORDER) + " from nr", NAMED)
Q["i2_monthly_attach"] = sql(f"""
select city, date, aqi_daily, {rd("avg(aqi_daily) over (partition by city, strftime(date, '%Y-%m'))", 1)} as aqi_monthly from nr""", NAMED)

SENSORS = f"""sv as (select c_nationkey as city_id, cast(o_orderdate as date) as date, l_linenumber as r,
    case when l_linenumber % 3 = 0 then -1.0 else sum(cast(l_quantity as bigint))::double / count(*) end as v
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2, 3),
cells as (select city_id, date, 'o3' as param from readings where o3 is null union all select city_id, date, 'pm25' from readings where pm25 is null),
rk as (select city_id, date, param, v, row_number() over (partition by city_id, date, param order by r) as k from cells join sv using (city_id, date) where v >= 0),
fills as (select city_id, date, param, {rd('avg(v)', 1)} as f from rk where k <= 2 group by 1, 2, 3)"""
Q["i3_gap_fill"] = sql(f"""
with {SENSORS}, w as (select city_id, date, max(f) filter (param = 'o3') as fo, max(f) filter (param = 'pm25') as fp from fills group by 1, 2)
select city_id, date, co, no2, coalesce(o3, fo) as o3, pm10, coalesce(pm25, fp) as pm25, aqi_daily from readings left join w using (city_id, date)""")
Q["i3_gap_fill_counts"] = sql(f"with {SENSORS} select param, count(*) as filled from fills group by 1")
Q["i4_union_sort"] = sql("select *, lower(city) as city_key from nr", NAMED)
INFLATED = f"inf as (select city_id, date, case when day(date) <= 10 then co * 1000 else co end as co, {', '.join(ORDER[1:])} from readings)"
Q["i5_unit_fix"] = sql(f"select city_id, date, case when co > 100 then {rd('co / 1000', 1)} else co end as co, {', '.join(ORDER[1:])} from inf", INFLATED)
Q["i5_unit_report"] = sql('select count(*) filter (co > 100) as fixed, count(*) as "rows" from inf', INFLATED)


def lines(part: str, source: str) -> str:
    """Row-index interpolation with window functions."""
    near = ", ".join(
        f"last_value({m} ignore nulls) over b as {m}_b, last_value(case when {m} is not null then pos end ignore nulls) over b as {m}_pb, "
        f"first_value({m} ignore nulls) over a as {m}_a, first_value(case when {m} is not null then pos end ignore nulls) over a as {m}_pa"
        for m in ORDER)
    out = ", ".join(
        f"coalesce({m}, {m}_b + ({m}_a - {m}_b) * (pos - {m}_pb) / nullif({m}_pa - {m}_pb, 0), {m}_b, {m}_a) as {m}" for m in ORDER)
    return f"""pz as (select *, row_number() over (partition by {part} order by date) as pos from {source}),
nb as (select *, {near} from pz window b as (partition by {part} order by pos rows between unbounded preceding and current row),
  a as (partition by {part} order by pos rows between current row and unbounded following)),
ip as (select {part}, date, {out} from nb)"""


SHOW = ", ".join(f"{rd(m, 6)} as {m}" for m in ORDER)
Q["i6_interpolate"] = sql(f"with {lines('city_id', 'readings')} select city_id, date, {SHOW} from ip")
EMPTY = """es as (select city_name as city, date, co, case when city_id not in (0, 1, 12) then no2 end as no2,
  case when city_id not in (8, 9) then o3 end as o3, pm10, pm25, aqi_daily from readings join cities using (city_id))"""
WHOLE = ", ".join(
    f"coalesce({m}, first_value({m} ignore nulls) over (order by city, date rows between current row and unbounded following), "
    f"last_value({m} ignore nulls) over (order by city, date rows between unbounded preceding and current row)) as {m}" for m in ORDER)
Q["i7_backfill_global"] = sql(f"with {EMPTY}, {lines('city', 'es')}, g as (select city, date, {WHOLE} from ip) select city, date, {SHOW} from g")
KNOWN = f"select city_id, date, {ALL} from readings join cities using (city_id) where region <> 'AFRICA'"
Q["i8_key_join"] = sql(KNOWN)
Q["s2_bulk_load"] = sql(KNOWN)
Q["i9_zero_fill"] = sql("select city_id, date, " + ", ".join(f"coalesce({m}, 0) as {m}" for m in ORDER) + " from readings")
Q["i10_null_report"] = sql(" union all ".join(
    f"select '{c}' as \"column\", count(*) filter ({c} is null) as nulls from readings" for c in ("city_id", "date", *ORDER)))
Q["i11_dataset_metadata"] = sql("""
select count(*) as data_rows, count(distinct city_id) as cities, concat(min(date)::varchar, ' to ', max(date)::varchar) as date_range from readings""")
Q["i12_key_checks"] = sql("""
select 'duplicate_city_day' as rule, count(*) as violations from (select 1 from readings group by city_id, date having count(*) > 1)
union all select 'duplicate_city_name', count(*) from (select 1 from cities group by city_name having count(*) > 1)
union all select 'orphan_city_id', count(*) from readings where city_id not in (select city_id from cities)""")
Q["s3_keyed_append"] = sql(f"select city_id, date, {ALL} from readings")

Q["i13_date_check"] = """
with t as (select o_orderkey % 4 as kind, cast(o_orderdate as date) as d from orders),
x as (select kind, case kind when 0 then strftime(d, '%Y-%m-%d') when 1 then strftime(d, '%Y/%m/%d') when 2 then strftime(d, '%Y') || '-02-30' else strftime(d, '%Y-%m') || '-31' end as s from t)
select kind, count(*) as texts, count(*) filter (regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(s as date) is not null) as valid from x group by 1"""
