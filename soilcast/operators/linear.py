"""Linear-trend forecast and curve, from the newest 48 readings of each sensor."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from soilcast import schema as S
from soilcast.functions.status import threshold_colour, threshold_status
from soilcast.functions.timefn import add_hours
from soilcast.operators.windows import linear_rate, order_cols


def current_reading(readings: DataFrame) -> DataFrame:
    """Newest time and moisture per sensor (aggregate with partial aggregation, skew-safe)."""
    key = F.struct(*order_cols(readings))
    return readings.groupBy("sensor_id").agg(F.max("event_time").alias("current_time"),
                                             F.max_by("soil_moisture", key).alias("current_moisture"),
                                             F.count(F.lit(1)).alias("n_readings"))


def linear_forecast(readings: DataFrame, threshold: float = S.WATERING_THRESHOLD, n: int = S.LINEAR_TAIL,
                    horizon: int = S.HORIZON_HOURS) -> DataFrame:
    """hours = clamp((current - threshold) / rate, 1, horizon); HIGH 0.7 below 12 h, MEDIUM 0.6 below 48 h,
    else LOW 0.5; predicted moisture = threshold."""
    j = current_reading(readings).join(linear_rate(readings, n), "sensor_id")
    hours = F.least(F.greatest((F.col("current_moisture") - threshold) / F.col("decay_rate"), F.lit(1.0)),
                    F.lit(float(horizon)))
    j = j.withColumn("hours_from_now", hours)
    h = F.col("hours_from_now")
    return j.select(
        "sensor_id", "current_time", "current_moisture", "decay_rate", "hours_from_now",
        F.lit(threshold).alias("predicted_moisture"),
        F.when(h < 12, "HIGH").when(h < 48, "MEDIUM").otherwise("LOW").alias("urgency"),
        F.when(h < 12, 0.7).when(h < 48, 0.6).otherwise(0.5).alias("confidence"),
        add_hours(F.col("current_time"), F.floor(h).cast("int")).alias("predicted_time"),
        F.format_string("Linear trend prediction based on %d recent readings", F.col("rate_readings")).alias("message"))


def linear_curve(readings: DataFrame, n: int = S.LINEAR_TAIL, horizon: int = S.HORIZON_HOURS) -> DataFrame:
    """337 points max(0, current - h * rate); confidence max(0.2, 0.6 (1 - h / (3 horizon)))."""
    j = current_reading(readings).join(linear_rate(readings, n), "sensor_id")
    x = j.select("sensor_id", "current_time", "current_moisture", "decay_rate",
                 F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("h"))
    m = F.greatest(F.lit(0.0), F.col("current_moisture") - F.col("h") * F.col("decay_rate"))
    conf = F.greatest(F.lit(0.2), F.lit(0.6) * (F.lit(1.0) - F.col("h") / F.lit(3.0 * horizon)))
    return x.select("sensor_id", F.col("h").cast("int").alias("hours_from_now"),
                    add_hours(F.col("current_time"), F.col("h")).alias("timestamp"),
                    m.alias("predicted_moisture"), threshold_status(m).alias("status"), threshold_colour(m).alias("color"),
                    conf.alias("confidence"), F.lit("linear_fallback").alias("model_type"))
