"""SQL twins of the registered queries, for a second engine to check against."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    from oracles import dashboard, ingest, models, named, offline

    twins = {**named.Q, **offline.Q, **dashboard.Q, **ingest.Q, **models.Q}
    twins["d5_named_query"] = named.Q["q29_seasonal_drop"]
    twins["s5_published"] = offline.Q["p16_std_mean"]
    twins["s4_stored_result"] = named.Q["q18_rain_before_after"]
    twins["s1_json_documents"] = (
        f"select city_id as id, city_name as name, state, current_aqi, month_aqi, month_pm25 from ({dashboard.Q['d2_overview']})"
    )
    return twins
