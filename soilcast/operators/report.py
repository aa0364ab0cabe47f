"""Result shaping: curve crossings, chart curves, unions, labels and the sensor summary join."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def curve_crossing(curve: DataFrame) -> DataFrame:
    """First curve point whose status is CRITICAL, per sensor."""
    return curve.where(F.col("status") == "CRITICAL").groupBy("sensor_id").agg(
        F.min("hours_from_now").alias("critical_hour"),
        F.min_by("timestamp", F.col("hours_from_now")).alias("critical_time"))


def chart_curve(curve: DataFrame, cutoff: float = 0.2, horizon: int = 336) -> DataFrame:
    """Curve points before the first one below ``cutoff`` (take-while, strict <), per sensor."""
    from pyspark.sql import Window
    first_low = F.min(F.when(F.col("predicted_moisture") < cutoff, F.col("hours_from_now"))) \
        .over(Window.partitionBy("sensor_id"))
    return curve.withColumn("_stop", F.coalesce(first_low, F.lit(horizon + 1))) \
        .where(F.col("hours_from_now") < F.col("_stop")).drop("_stop")


def observed_and_predicted(readings: DataFrame, curve: DataFrame, cutoff: float = 0.2) -> DataFrame:
    """Observed readings and the truncated predicted curve as one chart frame; predicted series are labelled
    '<id> (Predicted)'."""
    obs = readings.select(F.col("sensor_id").alias("series"), F.col("event_time").alias("timestamp"),
                          F.col("soil_moisture").alias("moisture"), F.lit("observed").alias("kind"))
    pred = chart_curve(curve, cutoff).select(F.concat(F.col("sensor_id"), F.lit(" (Predicted)")).alias("series"),
                                             "timestamp", F.col("predicted_moisture").alias("moisture"),
                                             F.lit("predicted").alias("kind"))
    return obs.unionByName(pred)


def watering_date_label(status, critical_time, predicted_time):
    """'TODAY (Critical)' for a CRITICAL status, else the critical date, else the predicted date, else
    'Not needed'."""
    return (F.when(F.col(status).contains("CRITICAL"), F.lit("TODAY (Critical)"))
            .when(F.col(critical_time).isNotNull(), F.date_format(critical_time, "yyyy-MM-dd"))
            .when(F.col(predicted_time).isNotNull(), F.date_format(predicted_time, "yyyy-MM-dd"))
            .otherwise(F.lit("Not needed")))


def sensor_summary(sensors: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every known sensor left-joined to its prediction; unmatched sensors show N/A and 'API Error'."""
    j = sensors.select("sensor_id").distinct().join(predictions, "sensor_id", "left")
    ok = F.col("status").isNotNull()
    return j.select(
        F.col("sensor_id"),
        F.when(ok, F.format_string("%.3f", F.col("current_moisture"))).otherwise(F.lit("N/A")).alias("current_moisture_text"),
        F.when(ok, F.col("status")).otherwise(F.lit("API Error")).alias("status_text"),
        F.when(ok, F.format_string("%.0f%%", F.col("confidence_score") * 100)).otherwise(F.lit("N/A")).alias("confidence_text"),
        F.when(ok, watering_date_label("status", "critical_watering_date", "predicted_watering_date"))
         .otherwise(F.lit("N/A")).alias("watering_date_text"),
    )


def known_sensor_check(requests: DataFrame, readings: DataFrame) -> DataFrame:
    """Each requested id with found / not-found; the known ids are a distinct aggregate (semi/anti join)."""
    known = readings.select("sensor_id").distinct().withColumn("_known", F.lit(True))
    j = requests.join(known, "sensor_id", "left")
    found = F.coalesce(F.col("_known"), F.lit(False))
    return j.select("sensor_id", found.alias("found"),
                    F.when(~found, F.format_string("Sensor %s not found", F.col("sensor_id"))).alias("detail"))
