"""Registered queries: scans, projections, filters, aggregations."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from soilcast.functions import status as ST
from soilcast.operators import mart_state, marts, staging
from soilcast.plans.catalog import ORACLE, query, r9, readings, with_readings
from soilcast.session import scratch_path
from soilcast.sources import readings as src

REBASE_AS_OF = "2024-02-01 00:00:00"
ONE_SENSOR = "SENSOR-00007"


@query("scan_readings", with_readings(
    "SELECT sensor_id, event_time, temperature_c, humidity_pct, soil_moisture FROM readings"))
def q_scan_readings(spark, sf):
    return src.scan_readings(readings(spark, sf))


@query("latest_readings", with_readings(
    "SELECT sensor_id, event_time, temperature_c, humidity_pct, soil_moisture, event_id FROM readings "
    "ORDER BY event_time DESC, event_id DESC LIMIT 5000"))
def q_latest_readings(spark, sf):
    return src.latest_readings(readings(spark, sf), 5000)


@query("sensor_readings", with_readings(
    f"SELECT * FROM readings WHERE sensor_id = '{ONE_SENSOR}'"))
def q_sensor_readings(spark, sf):
    return src.sensor_readings(readings(spark, sf), ONE_SENSOR)


@query("hourly_rollup", with_readings("""
SELECT sensor_id, date_trunc('hour', event_time) AS hour_bucket,
       round(avg(temperature_c), 9) AS avg_temp_c, min(temperature_c) AS min_temp_c, max(temperature_c) AS max_temp_c,
       round(avg(humidity_pct), 9) AS avg_humidity, min(humidity_pct) AS min_humidity, max(humidity_pct) AS max_humidity,
       round(avg(soil_moisture), 9) AS avg_moisture, min(soil_moisture) AS min_moisture, max(soil_moisture) AS max_moisture,
       count(*) AS reading_count, CAST(count_if(soil_moisture < 0.15) AS BIGINT) AS anomaly_count
FROM readings GROUP BY 1, 2"""))
def q_hourly_rollup(spark, sf):
    df = marts.hourly_rollup(readings(spark, sf))
    return df.withColumns({c: r9(c) for c in ["avg_temp_c", "avg_humidity", "avg_moisture"]})


@query("sensor_inventory", with_readings("""
SELECT sensor_id, count(*) AS total_readings, min(event_time) AS date_range_start, max(event_time) AS date_range_end,
       min(soil_moisture) AS moisture_range_min, max(soil_moisture) AS moisture_range_max
FROM readings GROUP BY sensor_id"""))
def q_sensor_inventory(spark, sf):
    return marts.sensor_inventory(readings(spark, sf))


@query("distinct_sensors", with_readings("SELECT DISTINCT sensor_id FROM readings"))
def q_distinct_sensors(spark, sf):
    return marts.distinct_sensors(readings(spark, sf))


@query("health_check", with_readings("""
SELECT CASE WHEN p.n > 0 THEN 'healthy' ELSE 'degraded' END AS status, p.n > 0 AS database_connected,
       p.sensors_available, t.sensors_total
FROM (SELECT count(*) AS n, count(DISTINCT sensor_id) AS sensors_available
      FROM (SELECT sensor_id FROM readings ORDER BY event_time DESC LIMIT 1)) p,
     (SELECT count(DISTINCT sensor_id) AS sensors_total FROM readings) t"""))
def q_health_check(spark, sf):
    return marts.health_check(readings(spark, sf))


@query("sensor_trend", with_readings("""
SELECT sensor_id, count(*) AS n_readings, min(soil_moisture) AS min_moisture, max(soil_moisture) AS max_moisture,
       arg_min(soil_moisture, (event_time, event_id)) AS first_moisture,
       arg_max(soil_moisture, (event_time, event_id)) AS last_moisture,
       arg_max(soil_moisture, (event_time, event_id)) > arg_min(soil_moisture, (event_time, event_id)) AS rising
FROM readings GROUP BY sensor_id"""))
def q_sensor_trend(spark, sf):
    return marts.sensor_trend(readings(spark, sf))


@query("analysis_metadata", with_readings("""
SELECT sensor_id, count(*) AS data_points, min(event_time) AS period_start, max(event_time) AS period_end,
       CASE WHEN count(*) >= 50 THEN 'ml' ELSE 'exponential' END AS prediction_method
FROM readings GROUP BY sensor_id"""))
def q_analysis_metadata(spark, sf):
    return marts.analysis_metadata(readings(spark, sf))


@query("choose_method", with_readings("""
SELECT sensor_id, count(*) AS n_readings, CASE WHEN count(*) >= 50 THEN 'ml' ELSE 'exponential' END AS method
FROM readings GROUP BY sensor_id"""))
def q_choose_method(spark, sf):
    r = readings(spark, sf)
    return r.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n_readings")).withColumn(
        "method", marts.choose_method(F.col("n_readings")))


@query("driest_wettest", with_readings("""
SELECT sensor_id,
       arg_min(event_time, (-soil_moisture, event_time, event_id)) AS wettest_time, max(soil_moisture) AS wettest_moisture,
       arg_min(event_time, (soil_moisture, event_time, event_id)) AS driest_time, min(soil_moisture) AS driest_moisture,
       max(event_time) AS last_time
FROM readings WHERE soil_moisture IS NOT NULL GROUP BY sensor_id"""))
def q_driest_wettest(spark, sf):
    return marts.driest_wettest(readings(spark, sf))


@query("staging_readings", with_readings("""
SELECT event_time, sensor_id, CAST(temperature_c AS DOUBLE) AS temperature_c, CAST(humidity_pct AS DOUBLE) AS humidity_pct,
       CAST(soil_moisture AS DOUBLE) AS soil_moisture, json_extract_string(payload, '$.timestamp') AS original_timestamp
FROM readings WHERE event_time >= (SELECT max(event_time) FROM readings) - INTERVAL 30 DAY"""))
def q_staging_readings(spark, sf):
    return staging.staging_readings(readings(spark, sf))


@query("payload_scalar", with_readings(
    "SELECT event_id, sensor_id, json_extract_string(payload, '$.k') AS payload_value FROM readings"))
def q_payload_scalar(spark, sf):
    return staging.payload_scalar(readings(spark, sf), "$.k", "payload_value")


@query("adapter_format", with_readings(
    "SELECT sensor_id, event_time AS created_at, soil_moisture AS moisture, CAST(1.0 AS DOUBLE) AS moisture_range, event_id "
    "FROM readings ORDER BY sensor_id, created_at, event_id"))
def q_adapter_format(spark, sf):
    return staging.adapter_format(readings(spark, sf))


@query("readings_records", with_readings("""
SELECT sensor_id, event_time AS "timestamp", temperature_c AS temperature, humidity_pct AS humidity, soil_moisture, event_id
FROM readings ORDER BY event_time DESC, event_id DESC LIMIT 1000"""))
def q_readings_records(spark, sf):
    return staging.readings_records(src.latest_readings(readings(spark, sf), 1000))


@query("delete_by_prefix", with_readings(
    "SELECT * FROM readings WHERE NOT (sensor_id LIKE 'SENSOR-%')"))
def q_delete_by_prefix(spark, sf):
    return staging.delete_by_prefix(readings(spark, sf), "SENSOR-")


@query("rebase_time", with_readings(f"""
SELECT event_id, sensor_id,
       event_time + to_microseconds(epoch_us(TIMESTAMP '{REBASE_AS_OF}') - (SELECT epoch_us(max(event_time)) FROM readings)) AS event_time,
       soil_moisture
FROM readings"""))
def q_rebase_time(spark, sf):
    r = readings(spark, sf).select("event_id", "sensor_id", "event_time", "soil_moisture")
    return staging.rebase_time(r, REBASE_AS_OF)


@query("anomaly_flag", with_readings(
    "SELECT event_id, sensor_id, soil_moisture, coalesce(soil_moisture < 0.15, false) AS is_anomaly FROM readings"))
def q_anomaly_flag(spark, sf):
    r = readings(spark, sf)
    return r.select("event_id", "sensor_id", "soil_moisture", marts.anomaly_flag(F.col("soil_moisture")).alias("is_anomaly"))


@query("threshold_status", with_readings("""
SELECT event_id, sensor_id, soil_moisture,
       CASE WHEN soil_moisture <= 0.2 THEN 'CRITICAL' WHEN soil_moisture <= 0.3 THEN 'NEEDS_WATERING' ELSE 'HEALTHY' END AS curve_status,
       CASE WHEN soil_moisture <= 0.2 THEN 'red' WHEN soil_moisture <= 0.3 THEN 'orange' ELSE 'green' END AS colour,
       CASE WHEN soil_moisture <= 0.2 THEN 'CRITICAL' WHEN soil_moisture <= 0.3 THEN 'WARNING' ELSE 'OK' END AS service_status
FROM readings"""))
def q_threshold_status(spark, sf):
    r = readings(spark, sf)
    m = F.col("soil_moisture")
    return r.select("event_id", "sensor_id", "soil_moisture",
                    ST.threshold_status(m, style="curve").alias("curve_status"),
                    ST.threshold_colour(m).alias("colour"),
                    ST.threshold_status(m, style="service").alias("service_status"))


@query("validate_series", with_readings("""
SELECT sensor_id, n_readings,
       CASE WHEN reason IS NULL THEN 'valid' ELSE 'rejected' END AS status, reason
FROM (
  SELECT sensor_id, count(*) AS n_readings,
         CASE WHEN count(*) < 10 THEN 'Insufficient data points. Need at least 10 readings for analysis.'
              WHEN count_if(event_time IS NULL OR soil_moisture IS NULL OR isnan(soil_moisture)) > 0
                   THEN 'Data contains NaN values. Please clean the data first.'
              WHEN count_if(NOT (soil_moisture BETWEEN 0.0 AND 1.0)) > 0 THEN '''moisture'' values must be between 0 and 1'
         END AS reason
  FROM readings GROUP BY sensor_id)"""))
def q_validate_series(spark, sf):
    return staging.validate_series(readings(spark, sf))


@query("mart_from_batches", ORACLE["hourly_rollup"])
def q_mart_from_batches(spark, sf):
    """The hourly mart as a written table kept current from two interleaved batches, the late one delivered twice: each
    merged into the state, and the days it touches refreshed in the mart."""
    base = scratch_path(spark, f"mart-{uuid.uuid4().hex}")
    state, mart = f"{base}/state", f"{base}/mart"
    for name, odd, deliveries in (("early", 1, 1), ("late", 0, 2)):
        batch = readings(spark, sf).where(F.pmod(F.col("event_id"), F.lit(2)) == odd)
        for _ in range(deliveries):
            mart_state.apply_batch(batch, state, name)
        mart_state.refresh_mart(spark, state, mart, name)
    df = mart_state.read_mart(spark, mart)
    return df.withColumns({c: r9(c) for c in ["avg_temp_c", "avg_humidity", "avg_moisture"]})
