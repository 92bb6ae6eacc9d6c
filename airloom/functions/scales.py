"""Category scales for index values and the labels built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airloom.functions.numeric import col

# Health scale (low, high, name, weight).  The ranges are whole
# numbers; a value between two ranges belongs to none and counts as Good.
HEALTH_SCALE = (
    (0, 50, "Good", 0),
    (51, 100, "Satisfactory", 1),
    (101, 200, "Moderate", 2),
    (201, 300, "Poor", 4),
    (301, 400, "Very Poor", 7),
    (401, 500, "Severe", 10),
)

# Dashboard scale (upper bound, name); above the last: Hazardous.
DASHBOARD_SCALE = ((50, "Good"), (100, "Moderate"), (150, "Poor"), (200, "Unhealthy"), (300, "Severe"))
DASHBOARD_TOP = "Hazardous"

# Health score tiers (upper bound, tier, advice).
RISK_TIERS = (
    (1, "Low Risk", "Air quality is generally safe. No special precautions needed."),
    (3, "Moderate Risk", "Sensitive groups (children, elderly, asthma) should limit prolonged outdoor activity."),
    (5, "High Risk", "Everyone should reduce outdoor exertion. Sensitive groups should stay indoors."),
    (7, "Very High Risk", "Health warnings: serious respiratory effects for everyone. Avoid outdoor activity."),
)
TOP_TIER = ("Severe Risk", "EMERGENCY: Health alert for entire population. Stay indoors, use air purifiers.")


def _ladder(value: Column, steps, top) -> Column:
    """First label whose upper bound is not exceeded."""
    out = None
    for bound, label in steps:
        out = F.when(value <= bound, label) if out is None else out.when(value <= bound, label)
    return out.otherwise(top)


def dashboard_category(value: Column | str) -> Column:
    return _ladder(col(value), DASHBOARD_SCALE, DASHBOARD_TOP)


def health_category(value: Column | str) -> Column:
    value = col(value)
    out = F.when(value > HEALTH_SCALE[-1][1], HEALTH_SCALE[-1][2])
    for low, high, name, _ in HEALTH_SCALE:
        out = out.when(value.between(low, high), name)
    return out.otherwise(HEALTH_SCALE[0][2])


def health_weight(value: Column | str) -> Column:
    value = col(value)
    out = F.when(value > HEALTH_SCALE[-1][1], HEALTH_SCALE[-1][3])
    for low, high, _, weight in HEALTH_SCALE:
        out = out.when(value.between(low, high), weight)
    return out.otherwise(HEALTH_SCALE[0][3])


def risk_tier(score: Column | str) -> Column:
    return _ladder(col(score), [(b, t) for b, t, _ in RISK_TIERS], TOP_TIER[0])


def risk_advice(score: Column | str) -> Column:
    return _ladder(col(score), [(b, a) for b, _, a in RISK_TIERS], TOP_TIER[1])


# The cuts and labels of the two functions below.


def momentum(diff: Column | str) -> Column:
    diff = col(diff)
    return (
        F.when(diff > 20, "Rapidly Worsening")
        .when(diff > 5, "Worsening")
        .when(diff < -20, "Rapidly Improving")
        .when(diff < -5, "Improving")
        .otherwise("Stable")
    )


def volatility_label(deviation: Column | str, n: Column | str) -> Column:
    deviation, n = col(deviation), col(n)
    return (
        F.when(n < 2, "Insufficient Data")
        .when(deviation > 50, "Volatile")
        .when(deviation > 25, "Moderate")
        .otherwise("Stable")
    )
