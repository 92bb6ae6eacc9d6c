"""Registered queries: name -> callable(spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airloom.models import anomaly, cluster, forecast, given, health, sequences
from airloom.operators.search import search
from airloom.operators.search_index import kept_index, search_index
from airloom.plans import dashboard, features, ingest, named, offline
from airloom.sources.tables import load, table
from airloom.streaming.ended import live_ended
from airloom.streaming.live import live_batch, run_live

Query = Callable[[SparkSession, str], DataFrame]


def on_dataset(plan: Callable[..., DataFrame], **params) -> Query:
    """A plan over (readings, cities) as a registered query."""
    return lambda spark, folder: plan(load(spark, folder), **params)


# Values used where the default selects nothing on the given tables.
FITTED = {
    "q03_spikes": {"k_filter": 1.7},
    "q05_consistently_good": {"max_avg": 260},
    "q10_north_season_pm25": {"region": "ASIA"},
    "q21_winter_onset": {"above": 125},
}


def named_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for key, plan in named.NAMED.values():
        out[key] = on_dataset(plan, **FITTED.get(key, {}))
        if key in FITTED:
            out[f"{key}_default"] = on_dataset(plan)
    return out


OFFLINE = {
    "p01_streaks": (offline.streaks, {}),
    "p01_streak_trend": (offline.streak_trend, {}),
    "p02_city_improvement": (offline.city_improvement, {}),
    "p02_improvement_extremes": (offline.improvement_extremes, {}),
    "p04_hotspots": (offline.hotspots, {}),
    "p05_good_flags": (offline.good_flags, {}),
    "p06_p07_top_cities": (offline.top_cities, {}),
    "p08_growth": (offline.growth, {}),
    "p08_projection": (offline.growth_projection, {}),
    "p09_worst_months": (offline.worst_months, {}),
    "p09_month_table": (offline.month_table, {}),
    "p09_most_frequent": (offline.most_frequent_worst_month, {}),
    "p10_season_ratio": (offline.season_ratio, {"region": "ASIA"}),
    "p10_season_ratio_default": (offline.season_ratio, {}),
    "p11_dominant": (offline.dominant, {}),
    "p12_corr_matrix": (offline.corr_matrix, {}),
    "p13_divergence": (offline.divergence, {}),
    "p14_weekday_weekend": (offline.weekday_weekend, {}),
    "p15_volatility_rate": (offline.volatility_rate, {}),
    "p16_std_mean": (offline.std_mean, {}),
    "p17_spells": (offline.spells, {}),
    "p18_rain": (offline.rain, {}),
    "p19_recovery_episodes": (offline.recovery_episodes, {}),
    "p20_city_profile": (offline.city_gas_profile, {}),
    "p21_onset_city": (offline.onset_by_city, {"above": 160}),
    "p21_onset_city_default": (offline.onset_by_city, {}),
    "p21_mean_onset_day": (offline.mean_onset_day, {"above": 160}),
    "p22_city_percentiles": (offline.city_percentiles, {}),
    "p23_ozone": (offline.ozone, {}),
    "p24_no2_ratio": (offline.no2_ratio, {}),
    "p25_cooccurrence": (offline.cooccurrence, {}),
    "p26_hazards_strict": (offline.hazards, {}),
    "p26_hazards_relaxed": (offline.hazards, {"rule": "relaxed"}),
    "p26_hazard_counts": (offline.hazard_counts, {"rule": "relaxed"}),
    "p27_recovery_episodes_severe": (offline.recovery_episodes_severe, {}),
    "p28_early_warning_29": (offline.early_warning_rows, {}),
    "p29_season_pair": (offline.season_pair, {}),
    "p30_clusters": (offline.clusters, {}),
    "f1_city_slice": (features.city_slice, {"city": "NATION_7"}),
    "f2_city_list": (features.city_list, {}),
    "f3_monthly_features": (features.monthly_features, {}),
    "f4_yearly_features": (features.yearly_features, {}),
    "f5_city_features": (features.city_features, {}),
    "f6_city_profile": (features.city_profile, {}),
    "v1_streak_table": (offline.streak_table, {}),
    "v2_season_delta": (offline.season_delta, {"region": "ASIA"}),
    "v3_correlation_gap": (offline.correlation_gap, {}),
    "v4_onset_table": (offline.onset_table, {"above": 160}),
    "v5_cooccurrence_complement": (offline.cooccurrence_complement, {}),
    "v6_hazard_months": (offline.hazard_months, {"rule": "relaxed"}),
    "v6_hazard_types": (offline.hazard_types, {"rule": "relaxed"}),
}


DASHBOARD = {
    "d1_daily_range": (dashboard.daily_range, {"city_id": 7}),
    "d1_period_days": (dashboard.period_days, {"city_id": 7, "year": 2000, "month": 2}),
    "d2_overview": (dashboard.overview, {}),
    "d3_historical": (dashboard.historical, {"city_id": 7, "month": 3}),
    "d4_cities": (dashboard.cities, {}),
    "d5_named_query": (named.run_named, {"number": 29}),
    "d6_weekly_rollup": (dashboard.weekly_rollup, {}),
    "d7_monthly_rollup": (dashboard.monthly_rollup, {}),
    "d8_period_stats": (dashboard.period_stats, {"year": 2000}),
    "d8_period_stats_month": (dashboard.period_stats, {"year": 2000, "month": 5}),
    "d8_period_summary": (dashboard.period_summary, {"year": 2000}),
    "d9_ranks_and_sorts": (dashboard.ranks, {"year": 2000, "sort": "improving"}),
    "d9_search": (dashboard.ranks, {"year": 2000, "search": "State_3", "sort": "worst"}),
    "d10_momentum": (dashboard.momentum_labels, {}),
    "d11_volatility_label": (dashboard.volatility_labels, {}),
    "d12_best_worst_month": (dashboard.best_worst_month, {}),
    "d13_category_share": (dashboard.category_share, {}),
    "d14_growth_percent": (dashboard.period_growth, {"year": 2000}),
    "d15_ui_category": (dashboard.overview_category, {}),
    "d16_city_distribution": (dashboard.city_distribution, {"year": 2000}),
    "d17_deep_dive": (dashboard.deep_dive, {}),
    "d17_deep_dive_pm25": (dashboard.deep_dive, {"metric_name": "pm25"}),
    "d18_best_worst_week": (dashboard.best_worst_week, {}),
    "d19_half_growth": (dashboard.half_growth, {}),
    "d20_trend_statement": (dashboard.trend_statement, {}),
    "d21_compare_cities": (dashboard.compare_cities, {"city_ids": [1, 7, 12, 20]}),
}


def hourly_to_daily(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return dashboard.hourly_to_daily(dashboard.hourly_records(events, "event_type", "ts", "value"))


INGEST = {
    "i2_monthly_attach": (ingest.monthly_attach, {}),
    "i5_unit_fix": (ingest.unit_fix, {}),
    "i5_unit_report": (ingest.unit_report, {}),
    "i6_interpolate": (ingest.interpolate, {}),
    "i7_backfill_global": (ingest.backfill_global, {}),
    "i8_key_join": (ingest.key_join, {}),
    "i9_zero_fill": (ingest.zero_fill, {}),
    "i10_null_report": (ingest.null_report, {}),
    "i11_dataset_metadata": (ingest.metadata, {}),
    "i12_key_checks": (ingest.key_checks, {}),
}

SMOOTHING = [(0.3, 0.1, 0.2), (0.05, 0.02, 0.1), (0.8, 0.0, 0.0), (0.1, 0.0, 0.3)]

MODELS = {
    "m1_forecast": (forecast.forecasts, {}),
    "m1_forecast_summary": (forecast.forecast_summary, {"metric": "pm25"}),
    "m1_forecast_monthly": (forecast.forecast_monthly, {}),
    "m1_forecast_calendar": (forecast.forecast_calendar, {}),
    "m1_smoothing_given": (given.smoothing, {"alpha": 0.3, "beta": 0.1, "gamma": 0.2, "season": 7, "block": 366}),
    "m1_best_smoothing_given": (given.best_smoothing, {"parameters": SMOOTHING, "season": 7, "block": 366}),
    "m2_flag_report_given": (given.flag_report, {}),
    "m2_first_flags_given": (given.first_flags, {}),
    "m4_assignment_given": (given.assignment, {"centre_ids": [0, 7, 14]}),
    "m4_inertia_given": (given.inertia, {"centre_ids": [0, 7, 14]}),
    "m5_covariance": (given.covariance, {}),
    "m6_health_map": (health.health_map, {}),
    "m2_sql_threshold": (anomaly.thresholds, {}),
    "m2_isolation_forest": (anomaly.anomaly_report, {}),
    "m2_anomaly_days": (anomaly.anomaly_days, {}),
    "m3_anomaly_summary": (anomaly.anomaly_summary, {}),
    "v7_score_shape": (anomaly.score_shape, {}),
    "m4_standardised": (cluster.standardised_profile, {}),
    "m4_kmeans": (cluster.clusters, {}),
    "m4_elbow": (cluster.elbow, {}),
    "m5_pca2": (cluster.components, {}),
    "m6_health_score": (health.health_score, {}),
    "m7_health_summary": (health.health_summary, {}),
    "m8_trend_projection": (offline.streak_projection, {}),
    "m9_minmax_sequences": (sequences.window_summary, {}),
}

QUESTION = "How does traffic tion increase in winter states?"


def synonym_search(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "documents"), QUESTION)


SECOND_QUESTION = "Which gas has an extreme spike, and is the air quality stable?"


def indexed_search(question: str) -> Query:
    """A question to the kept index of the texts: only the first one builds it."""
    return lambda spark, folder: search_index(kept_index(spark, folder, "documents", "doc_id", "text", "source"), question)


def live_category_batch(spark: SparkSession, folder: str) -> DataFrame:
    return live_batch(table(spark, folder, "events"))


# Queries that read further tables or write files on their way.
DIRECT: dict[str, Query] = {
    "d22_hourly_to_daily": hourly_to_daily,
    "r1_synonym_search": synonym_search,
    "r1_indexed_search": indexed_search(QUESTION),
    "r1_indexed_second_search": indexed_search(SECOND_QUESTION),
    "L1_live_category": run_live,
    "L1_live_category_batch": live_category_batch,
    "L1_live_ended": live_ended,
    "i1_calendar_pivot": ingest.calendar_pivot,
    "i3_gap_fill": ingest.gap_fill,
    "i3_gap_fill_counts": ingest.gap_fill_counts,
    "i4_union_sort": ingest.union_sort,
    "s1_json_documents": ingest.json_documents,
    "s2_bulk_load": ingest.bulk_load,
    "s3_keyed_append": ingest.keyed_append,
    "s6_kept_rollup": ingest.kept_rollup,
    "s5_published": ingest.published,
    "i13_date_check": ingest.date_check,
    "s4_stored_result": ingest.stored_result,
}


def _from(table: dict) -> dict[str, Query]:
    return {key: on_dataset(plan, **params) for key, (plan, params) in table.items()}


def all_queries() -> dict[str, Query]:
    return {
        **named_queries(),
        **_from(OFFLINE),
        **_from(DASHBOARD),
        **_from(INGEST),
        **_from(MODELS),
        **DIRECT,
    }


__all__ = ["Query", "all_queries", "on_dataset"]
