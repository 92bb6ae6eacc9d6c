"""SQL twins of the health score, the projections, the training windows, the
question search and the latest value per entity."""

from oracles.base import FILLED, rd, sql
from oracles.dashboard import category
from oracles.offline import PROFILE, STREAKS
from oracles.offline import Q as OFFLINE

Q: dict[str, str] = {}

# The health scale, its tiers and its advice.
SCALE = ((0, 50, "Good", 0), (51, 100, "Satisfactory", 1), (101, 200, "Moderate", 2), (201, 300, "Poor", 4), (301, 400, "Very Poor", 7), (401, 500, "Severe", 10))
TIERS = (
    (1, "Low Risk", "Air quality is generally safe. No special precautions needed."),
    (3, "Moderate Risk", "Sensitive groups (children, elderly, asthma) should limit prolonged outdoor activity."),
    (5, "High Risk", "Everyone should reduce outdoor exertion. Sensitive groups should stay indoors."),
    (7, "Very High Risk", "Health warnings: serious respiratory effects for everyone. Avoid outdoor activity."),
    (1000, "Severe Risk", "EMERGENCY: Health alert for entire population. Stay indoors, use air purifiers."),
)
VALUES = ", ".join(f"({a}, {b}, '{n}', {w})" for a, b, n, w in SCALE)
DAYS = f"""sc(low, high, name, weight) as (values {VALUES}),
dy as (select city, coalesce(name, case when aqi_daily > 500 then 'Severe' else 'Good' end) as name,
  coalesce(weight, case when aqi_daily > 500 then 10 else 0 end) as weight
  from z left join sc on aqi_daily between low and high)"""
SLUG = {n: n.lower().replace(" ", "_") for _, _, n, _ in SCALE}
COUNTS = ", ".join(f"count(*) filter (name = '{n}') as {s}_days" for n, s in SLUG.items())
PCTS = ", ".join(rd(f"count(*) filter (name = '{n}') * 100.0 / count(*)", 1) + f" as {s}_pct" for n, s in SLUG.items())
SCORE = f"h as (select city, {rd('sum(weight)::double / count(*)', 2)} as health_score, count(*) as total_days, {COUNTS}, {PCTS} from dy group by 1)"
TIER = "case " + " ".join(f"when health_score <= {b} then '{t}'" for b, t, _ in TIERS) + " end as risk_tier"
ADVICE = "case " + " ".join(f"when health_score <= {b} then '{a}'" for b, _, a in TIERS) + " end as advisory"
Q["m6_health_score"] = sql(f"with {DAYS}, {SCORE} select *, {TIER}, {ADVICE} from h", FILLED)
Q["m7_health_summary"] = sql(f"with {DAYS}, {SCORE} select city, health_score, {TIER} from h", FILLED)

Q["m8_trend_projection"] = sql(f"""
with {STREAKS}, y as (select year, max(streak) as s from st group by 1),
f as (select regr_slope(s, year) as k, regr_intercept(s, year) as i, max(year) as l from y)
select cast(l + n as integer) as year, {rd('i + k * (l + n)', 4)} as projected_streak from f, (values (1), (2)) t(n)""", FILLED)

Q["m9_minmax_sequences"] = sql("""
with s as (select city, date, coalesce((aqi_daily - min(aqi_daily) over c) / nullif(max(aqi_daily) over c - min(aqi_daily) over c, 0), 0) as v,
    row_number() over (partition by city order by date) as pos, count(*) over c as n from z window c as (partition by city)),
w as (select *, list(v) over (partition by city order by pos rows between 30 preceding and 1 preceding) as f from s)
select city, date, cast(len(f) as integer) as length, round(f[1], 6) as first, round(f[30], 6) as last, round(list_sum(f) / 30, 6) as mean,
  round(v, 6) as target, case when pos - 30 <= floor((n - 30) * 0.8) then 'train' else 'validation' end as split
from w where pos > 30""", FILLED)

Q["m1_forecast_calendar"] = sql("""
select city, max(date) + 1 as first_day, max(date) + 365 as last_day, cast(365 as bigint) as days from z group by 1 having count(*) >= 60""", FILLED)
Q["m2_sql_threshold"] = sql(f"""
with t as (select city, avg(aqi_daily) + 2 * stddev_samp(aqi_daily) as thr from z group by 1)
select city, {rd('max(thr)', 1)} as sql_threshold, count(*) filter (aqi_daily > thr) as days_above from z join t using (city) group by 1""", FILLED)
Q["m4_standardised"] = (
    "select city, " + ", ".join(rd(f"({c} - avg({c}) over ()) / stddev_pop({c}) over ()", 6) + f" as {c}" for c in PROFILE)
    + f" from ({OFFLINE['f6_city_profile']})"
)

PAIRS = [(a, b) for a in PROFILE for b in PROFILE]
SCALED = (
    "zz as (select city, " + ", ".join(f"({c} - avg({c}) over ()) / coalesce(nullif(stddev_pop({c}) over (), 0), 1) as {c}" for c in PROFILE)
    + f" from ({OFFLINE['f6_city_profile']}))"
)
Q["m5_covariance"] = f"with {SCALED} " + " union all ".join(f"select '{a}' as a, '{b}' as b, {rd(f'covar_pop({a}, {b})', 6)} as covariance from zz" for a, b in PAIRS)
GAPS = f"""{SCALED},
ce as (select n_nationkey as centre, zz.* from zz join nation on n_name = city where n_nationkey in (0, 7, 14)),
ga as (select zz.city, centre, round({" + ".join(f"(zz.{c} - ce.{c}) * (zz.{c} - ce.{c})" for c in PROFILE)}, 9) as gap from zz, ce),
ne as (select city, arg_min(centre, (gap, centre)) as centre, {rd('min(gap)', 6)} as distance from ga group by 1)"""
Q["m4_assignment_given"] = f"with {GAPS} select * from ne"
Q["m4_inertia_given"] = f"with {GAPS} select centre, count(*) as members, {rd('sum(distance)', 4)} as inertia from ne group by 1"
Q["m6_health_map"] = sql(f"""with {DAYS},
n as (select city, count(*) as total from dy group by 1)
select city, name as category, count(*) as days, {rd('count(*) * 100.0 / max(total)', 1)} as percentage from dy join n using (city) group by 1, 2""", FILLED)
FLAGS = """cu as (select city, quantile_cont(-pm25, 0.05) as cut, avg(aqi_daily) + 2 * stddev_samp(aqi_daily) as thr from z group by 1),
fl as (select z.*, -pm25 - cut < 0 as hit, thr from z join cu using (city))"""
Q["m2_flag_report_given"] = sql(f"""with {FLAGS}
select city, count(*) as total_points, count(*) filter (hit) as anomalies_detected, {rd('count(*) filter (hit) * 100.0 / count(*)', 2)} as anomaly_rate,
  {rd('max(thr)', 1)} as sql_threshold, count(*) filter (hit and aqi_daily <= thr) as ml_extra_detections, 'ok' as status from fl group by 1""", FILLED)
Q["m2_first_flags_given"] = sql(f"""with {FLAGS}, k as (select city, date, row_number() over (partition by city order by date) as n from fl where hit)
select city, string_agg(cast(date as varchar), ',' order by date) as days from k where n <= 5 group by 1""", FILLED)
Q["m1_smoothing_given"] = "with recursive " + sql(f"""
with y as (select city, aqi_daily as v, row_number() over (partition by city order by date) - 1 as pos, count(*) over (partition by city) as n from z),
i as (select city, max(n) as n, avg(v) filter (pos < 7) as m, avg(v) filter (pos between 7 and 13) as m2, list(v order by pos) filter (pos < 7) as f from y group by 1 having max(n) >= 14),
r(city, pos, level, trend, sse, cycle) as (
  select city, cast(0 as bigint), m, (m2 - m) / 7, 0.0::double, list_transform(f, lambda x: x - m) from i
  union all
  select r.city, r.pos + 1, level + trend + 0.3 * e, trend + 0.3 * 0.1 * e, sse + e * e,
    list_concat(cycle[1:slot], [cycle[slot + 1] + 0.2 * (1 - 0.3) * e], cycle[slot + 2:])
  from (select r.*, r.pos % 7 as slot, y.v - (level + trend) - cycle[r.pos % 7 + 1] as e from r join y on y.city = r.city and y.pos = r.pos) r)
select city, r.pos as days, {rd('level', 4)} as level, {rd('trend', 4)} as trend, {rd('sse', 4)} as sse, {rd('level + trend + cycle[r.pos % 7 + 1]', 4)} as next
from r join i using (city) where r.pos = i.n""", FILLED)[5:]

Q["m1_best_smoothing_given"] = "with recursive " + sql(f"""
with y as (select city, aqi_daily as v, row_number() over (partition by city order by date) - 1 as pos, count(*) over (partition by city) as n from z),
p(k, a, b, g) as (values (1, 0.3::double, 0.1::double, 0.2::double), (2, 0.05, 0.02, 0.1), (3, 0.8, 0.0, 0.0), (4, 0.1, 0.0, 0.3)),
i as (select city, max(n) as n, avg(v) filter (pos < 7) as m, avg(v) filter (pos between 7 and 13) as m2, list(v order by pos) filter (pos < 7) as f from y group by 1 having max(n) >= 14),
r(city, k, a, b, g, pos, level, trend, sse, cycle) as (
  select city, k, a, b, g, cast(0 as bigint), m, (m2 - m) / 7, 0.0::double, list_transform(f, lambda x: x - m) from i, p
  union all
  select r.city, k, a, b, g, r.pos + 1, level + trend + a * e, trend + a * b * e, sse + e * e,
    list_concat(cycle[1:slot], [cycle[slot + 1] + g * (1 - a) * e], cycle[slot + 2:])
  from (select r.*, r.pos % 7 as slot, y.v - (level + trend) - cycle[r.pos % 7 + 1] as e from r join y on y.city = r.city and y.pos = r.pos) r)
select city, r.pos as days, a, b, g, {rd('level', 4)} as level, {rd('trend', 4)} as trend, {rd('sse', 4)} as sse, {rd('level + trend + cycle[r.pos % 7 + 1]', 4)} as next
from r join i using (city) where r.pos = i.n qualify row_number() over (partition by city order by sse, k) = 1""", FILLED)[5:]

# The words that the search leaves out, and its groups of synonyms.
STOP = (
    "what", "is", "the", "which", "do", "how", "are", "in", "of", "for", "to", "and", "on", "a", "an", "why", "where",
    "when", "who", "does", "did", "has", "have", "or", "with", "about",
)
GROUPS = {
    "pollution": ["aqi", "pm25", "pm10", "pollutant", "smog", "air quality", "gas", "particulate"],
    "winter": ["december", "january", "february", "cold"],
    "summer": ["april", "may", "june", "hot"],
    "city": ["cities", "region", "area", "state", "regions", "states"],
    "spike": ["increase", "rise", "high", "severe", "extreme", "burst", "anomaly", "hazard", "dangerous"],
    "drop": ["decrease", "fall", "low", "good", "improvement", "recovery", "stable", "clean"],
    "traffic": ["car", "no2", "vehicle", "vehicles"],
    "health": ["risk", "severe", "hazard", "emergency"],
}
WORDS = ", ".join(f"('{k}', '{w}')" for k, ws in GROUPS.items() for w in [k, *ws])
STOPS = ", ".join(f"'{w}'" for w in STOP)
TOKENS = r"string_split_regex(regexp_replace(lower({x}), '[^A-Za-z0-9_\s]', '', 'g'), '\s+')"
ASKED = "How does traffic tion increase in winter states?"
SECOND = "Which gas has an extreme spike, and is the air quality stable?"


def searched(asked: str) -> str:
    return f"""
with g(k, w) as (values {WORDS}),
q as (select distinct t from (select unnest({TOKENS.format(x=f"'{asked}'")}) as t) where t <> '' and t not in ({STOPS})),
qx as (select t from q union select b.w from q join g a on a.w = q.t join g b on a.k = b.k),
d as (select distinct doc_id, t from (select doc_id, unnest({TOKENS.format(x="text || ' ' || source")}) as t from documents) where t <> '' and t not in ({STOPS})),
dx as (select doc_id, t from d union select doc_id, b.w from d join g a on a.w = d.t join g b on a.k = b.k),
v as (select distinct t from dx),
mt as (select v.t, qx.t as st from v, qx where contains(v.t, qx.t) or contains(qx.t, v.t)),
h as (select doc_id, count(distinct st) as n from dx join mt using (t) group by 1),
s as (select doc_id, source, {rd(f"coalesce(n, 0)::double / (select count(*) from q) + case when contains(lower(text), lower('{asked}')) then 1 else 0 end", 6)} as score
  from documents left join h using (doc_id))
select * from s where score > 0.2"""


Q["r1_synonym_search"] = searched(ASKED)
Q["r1_indexed_search"] = searched(ASKED)
Q["r1_indexed_second_search"] = searched(SECOND)

LIVE = f"""
with r as (select event_type as entity, ts, value, row_number() over (partition by event_type order by ts desc, event_id desc) as n from events)
select entity, strftime(ts, '%Y-%m-%d %H:%M:%S') as time, value, {category('value')} as category from r where n = 1"""
Q["L1_live_category"] = LIVE
Q["L1_live_category_batch"] = LIVE
Q["L1_live_ended"] = f"""
with r as (
  select cast(user_id as varchar) as entity, ts, value, count(*) over (partition by user_id) as events, row_number() over (partition by user_id order by ts desc, event_id desc) as n
  from events)
select entity, strftime(ts, '%Y-%m-%d %H:%M:%S') as time, value, {category('value')} as category, events
from r where n = 1 and ts <= (select max(ts) from events) - interval 7 hour"""
