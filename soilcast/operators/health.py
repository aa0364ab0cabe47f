"""Plant health metrics and recommendations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from soilcast.operators.linear import current_reading
from soilcast.operators.windows import last_watering, recent_stats

# Fixed texts of the recommendations, in the order they are considered.
HEALTH_TEXTS = [
    (90, "Excellent plant health! Continue current care routine."),
    (70, "Good plant health with room for optimization."),
    (None, "Plant health needs attention. Review watering schedule."),
]
URGENCY_TEXTS = {
    "CRITICAL": "URGENT: Water immediately to prevent plant stress!",
    "HIGH": "Water soon to maintain optimal moisture levels.",
    "MEDIUM": "Plan to water in the next day or two.",
}
VARIABILITY_TEXT = "High moisture variability detected. Consider more consistent watering."
VARIABILITY_LIMIT = 0.15
# Placeholder frequency analysis (fixed values).
FREQUENCY = {"average_days_between_watering": 7, "consistency_score": 0.8, "recommendation": "Maintain current schedule"}


def health_score_raw(current: Column, avg7: Column) -> Column:
    """(40 m + 30 avg7 + 30 (1 - |m - 0.5|)) * 100, never clamped (it is always >= 1500)."""
    return (current * 40 + avg7 * 30 + (F.lit(1.0) - F.abs(current - F.lit(0.5))) * 30) * 100


def health_metrics(readings: DataFrame) -> DataFrame:
    """Per sensor: score (clamped to [0, 100]) and raw score, current moisture, 7-day mean, days since the
    last watering, stability (sample std), time in [0.3, 0.7], and the placeholder frequency analysis."""
    cur = current_reading(readings)
    j = cur.join(recent_stats(readings), "sensor_id").join(
        last_watering(readings).select("sensor_id", "days_since_watering"), "sensor_id")
    raw = health_score_raw(F.col("current_moisture"), F.col("average_moisture_7d"))
    return j.select(
        "sensor_id",
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)).alias("health_score"),
        raw.alias("health_score_raw"),
        "current_moisture", "average_moisture_7d",
        F.col("days_since_watering").alias("days_since_last_watering"),
        "moisture_stability", "time_in_optimal_range",
        F.struct(F.lit(FREQUENCY["average_days_between_watering"]).alias("average_days_between_watering"),
                 F.lit(FREQUENCY["consistency_score"]).alias("consistency_score"),
                 F.lit(FREQUENCY["recommendation"]).alias("recommendation")).alias("watering_frequency_analysis"),
    )


def recommendations(score: Column, urgency: Column, stability: Column) -> Column:
    """Array of texts: health band, then urgency advice, then variability advice (nulls dropped)."""
    band = (F.when(score >= HEALTH_TEXTS[0][0], HEALTH_TEXTS[0][1])
            .when(score >= HEALTH_TEXTS[1][0], HEALTH_TEXTS[1][1]).otherwise(HEALTH_TEXTS[2][1]))
    urg = F.when(urgency == "CRITICAL", URGENCY_TEXTS["CRITICAL"]).when(urgency == "HIGH", URGENCY_TEXTS["HIGH"]) \
        .when(urgency == "MEDIUM", URGENCY_TEXTS["MEDIUM"])
    var = F.when(stability > VARIABILITY_LIMIT, F.lit(VARIABILITY_TEXT))
    return F.filter(F.array(band, urg, var), lambda x: x.isNotNull())
