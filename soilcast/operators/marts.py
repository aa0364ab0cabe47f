"""Aggregations: hourly mart, per-sensor inventory, health check, trend, metadata, argmax rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from soilcast import schema as S
from soilcast.functions.timefn import hour_bucket


def anomaly_flag(m, threshold: float = S.ANOMALY_THRESHOLD):
    """Row-level anomaly: moisture below the threshold; null moisture is not flagged."""
    return F.coalesce(m < F.lit(threshold), F.lit(False))


def hourly_rollup(readings: DataFrame, anomaly_threshold: float = S.ANOMALY_THRESHOLD) -> DataFrame:
    """Per (sensor, hour): avg/min/max of temperature, humidity and moisture, reading and anomaly counts.

    One hash aggregate with map-side partial aggregation: a hot sensor contributes one partial row per
    (task, hour) to the shuffle, never its raw rows.
    """
    return (
        readings.groupBy("sensor_id", hour_bucket(F.col("event_time")).alias("hour_bucket"))
        .agg(
            F.avg("temperature_c").alias("avg_temp_c"),
            F.min("temperature_c").alias("min_temp_c"),
            F.max("temperature_c").alias("max_temp_c"),
            F.avg("humidity_pct").alias("avg_humidity"),
            F.min("humidity_pct").alias("min_humidity"),
            F.max("humidity_pct").alias("max_humidity"),
            F.avg("soil_moisture").alias("avg_moisture"),
            F.min("soil_moisture").alias("min_moisture"),
            F.max("soil_moisture").alias("max_moisture"),
            F.count(F.lit(1)).alias("reading_count"),
            F.count_if(anomaly_flag(F.col("soil_moisture"), anomaly_threshold)).alias("anomaly_count"),
        )
    )


def sensor_inventory(readings: DataFrame) -> DataFrame:
    """Per sensor: total readings, first/last time, min/max moisture."""
    return readings.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("total_readings"),
        F.min("event_time").alias("date_range_start"),
        F.max("event_time").alias("date_range_end"),
        F.min("soil_moisture").alias("moisture_range_min"),
        F.max("soil_moisture").alias("moisture_range_max"),
    )


def distinct_sensors(readings: DataFrame) -> DataFrame:
    return readings.select("sensor_id").distinct()


def health_check(readings: DataFrame, probe_rows: int = 1) -> DataFrame:
    """Service health: the probe reads the newest ``probe_rows`` rows (as the reference does), so
    ``sensors_available`` is 0 or 1 there; ``sensors_total`` is the true distinct count."""
    probe = readings.select("sensor_id", "event_time").orderBy(F.col("event_time").desc()).limit(probe_rows)
    p = probe.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sensor_id").alias("sensors_available"))
    total = readings.agg(F.count_distinct("sensor_id").alias("sensors_total"))
    # both sides are one-row aggregates: the cross join is a 1 x 1 broadcast
    return p.crossJoin(F.broadcast(total)).select(
        F.when(F.col("n") > 0, "healthy").otherwise("degraded").alias("status"),
        (F.col("n") > 0).alias("database_connected"),
        F.col("sensors_available"),
        F.col("sensors_total"),
    )


def sensor_trend(readings: DataFrame) -> DataFrame:
    """Per sensor: count, min/max moisture, earliest and latest reading, and whether the newest is higher."""
    order = F.struct("event_time", "event_id") if "event_id" in readings.columns else F.col("event_time")
    g = readings.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.min("soil_moisture").alias("min_moisture"),
        F.max("soil_moisture").alias("max_moisture"),
        F.min_by("soil_moisture", order).alias("first_moisture"),
        F.max_by("soil_moisture", order).alias("last_moisture"),
    )
    return g.withColumn("rising", F.col("last_moisture") > F.col("first_moisture"))


def analysis_metadata(readings: DataFrame, ml_min: int = S.ML_MIN_READINGS) -> DataFrame:
    """Per sensor: data points, analysis period and selected method."""
    return readings.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("data_points"),
        F.min("event_time").alias("period_start"),
        F.max("event_time").alias("period_end"),
    ).withColumn("prediction_method", choose_method(F.col("data_points"), ml_min))


def choose_method(n, ml_min: int = S.ML_MIN_READINGS):
    """n >= 50 -> ml (training always succeeds then), else exponential."""
    return F.when(n >= ml_min, F.lit("ml")).otherwise(F.lit("exponential"))


def driest_wettest(readings: DataFrame) -> DataFrame:
    """Per sensor: the first (earliest) row holding the maximum and the minimum moisture."""
    tie = F.col("event_id") if "event_id" in readings.columns else F.lit(0)
    wet_key = F.struct((-F.col("soil_moisture")).alias("m"), F.col("event_time").alias("t"), tie.alias("i"))
    dry_key = F.struct(F.col("soil_moisture").alias("m"), F.col("event_time").alias("t"), tie.alias("i"))
    return readings.where(F.col("soil_moisture").isNotNull()).groupBy("sensor_id").agg(
        F.min_by("event_time", wet_key).alias("wettest_time"),
        F.max("soil_moisture").alias("wettest_moisture"),
        F.min_by("event_time", dry_key).alias("driest_time"),
        F.min("soil_moisture").alias("driest_moisture"),
        F.max("event_time").alias("last_time"),
    )
