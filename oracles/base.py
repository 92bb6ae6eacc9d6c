"""Common table expressions shared by the SQL twins."""

CITIES = """cities as (
  select n_nationkey as city_id, n_name as city_name,
         concat('STATE_', cast(n_nationkey % 10 as varchar(10))) as state, r_name as region
  from nation join region on n_regionkey = r_regionkey)"""

READINGS = """li as (
  select l_orderkey, sum(cast(round(l_extendedprice*100) as bigint)) as cents, count(*) as n,
         sum(cast(l_quantity as bigint)) as q,
         sum(case when l_linestatus = 'O' then cast(l_quantity as bigint) end) as qo, max(l_discount) as d
  from lineitem group by l_orderkey),
readings as (
  select c_nationkey as city_id, cast(o_orderdate as date) as date,
         cast(max(d) as double)*50 as co,
         cast(sum(n) as double)*8/count(*) as no2,
         cast(sum(qo) as double)*2/count(*) as o3,
         cast(sum(q) as double)*2/count(*) as pm10,
         cast(sum(cents) as double)/sum(n)/40000 as pm25,
         cast(sum(cast(round(o_totalprice*100) as bigint)) as double)/count(*)/100000 as aqi_daily
  from orders join customer on o_custkey = c_custkey left join li on l_orderkey = o_orderkey
  group by c_nationkey, cast(o_orderdate as date))"""

# Readings with nulls read as zero and the city name, for the offline questions.
FILLED = """z as (
  select city_name as city, date, cast(year(date) as integer) as year, cast(month(date) as integer) as month,
         coalesce(co,0) as co, coalesce(no2,0) as no2, coalesce(o3,0) as o3,
         coalesce(pm10,0) as pm10, coalesce(pm25,0) as pm25, coalesce(aqi_daily,0) as aqi_daily
  from readings join cities using (city_id))"""


def rd(x: str, digits: int) -> str:
    """Half-up decimal rounding, snapped first as in the library."""
    return f"cast(round(cast(round({x}, 9) as decimal(30,9)), {digits}) as double)"


def up(x: str) -> str:
    """Whole number, ties up."""
    return f"cast(floor(round({x}, 9) + 0.5) as bigint)"


def sql(body: str, *ctes: str) -> str:
    """A query over cities and readings; `body` may start with further CTEs."""
    parts = [CITIES, READINGS, *ctes]
    body = body.strip()
    if body.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + body[5:]
    return "with " + ",\n".join(parts) + "\n" + body
