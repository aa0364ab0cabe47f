"""Registered queries: window operators and per-sensor series statistics."""
from __future__ import annotations

from soilcast.operators import windows as W
from soilcast.plans.catalog import query, r9, readings, with_readings

DELTAS_CTE = """deltas AS (
  SELECT event_id, sensor_id, event_time, soil_moisture,
         lag(soil_moisture) OVER w AS prev_moisture,
         soil_moisture - lag(soil_moisture) OVER w AS moisture_diff,
         (epoch_us(event_time) - epoch_us(lag(event_time) OVER w)) / 3.6e9 AS time_diff_hours
  FROM readings WINDOW w AS (PARTITION BY sensor_id ORDER BY event_time, event_id))"""

EVENTS_CTE = """wevents AS (
  SELECT * FROM deltas WHERE moisture_diff > 0.15 AND time_diff_hours < 6 AND prev_moisture < 0.7)"""


@query("ordered_readings", with_readings("SELECT * FROM readings ORDER BY sensor_id, event_time, event_id"))
def q_ordered_readings(spark, sf):
    return W.ordered_readings(readings(spark, sf))


@query("sensor_analytics", with_readings("""
SELECT event_id, sensor_id, event_time, temperature_c, humidity_pct, soil_moisture,
       round(avg(soil_moisture) OVER (PARTITION BY sensor_id ORDER BY event_time, event_id
                                      ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 9) AS moisture_24h_avg,
       lag(soil_moisture, 1) OVER (PARTITION BY sensor_id ORDER BY event_time, event_id) AS prev_moisture
FROM readings ORDER BY sensor_id, event_time, event_id"""))
def q_sensor_analytics(spark, sf):
    return W.sensor_analytics(readings(spark, sf)).withColumn("moisture_24h_avg", r9("moisture_24h_avg"))


@query("reading_deltas", with_readings(
    "SELECT event_id, sensor_id, event_time, soil_moisture, prev_moisture, round(moisture_diff, 12) AS moisture_diff, "
    "time_diff_hours FROM deltas", DELTAS_CTE))
def q_reading_deltas(spark, sf):
    return W.reading_deltas(readings(spark, sf)).withColumn("moisture_diff", r9("moisture_diff", 12))


@query("watering_events", with_readings(
    "SELECT event_id, sensor_id, event_time, soil_moisture, prev_moisture, round(moisture_diff, 12) AS moisture_diff, "
    "time_diff_hours FROM wevents", DELTAS_CTE, EVENTS_CTE))
def q_watering_events(spark, sf):
    return W.watering_events(readings(spark, sf)).withColumn("moisture_diff", r9("moisture_diff", 12))


LAST_WATERING_SQL = with_readings("""
SELECT b.sensor_id, e.sensor_id IS NOT NULL AS detected, e.event_time AS watering_time,
       round(CASE WHEN e.sensor_id IS NOT NULL THEN least(0.95, 0.5 + e.moisture_diff * 2) ELSE 0.4 END, 9) AS confidence,
       e.prev_moisture AS moisture_before, e.soil_moisture AS moisture_after, round(e.moisture_diff, 12) AS increase_amount,
       CASE WHEN e.sensor_id IS NOT NULL THEN 'Machine learning pattern recognition' ELSE 'ML-based estimation' END AS method,
       CASE WHEN e.sensor_id IS NULL THEN round((epoch_us(b.last_time) - epoch_us(b.wettest_time)) / 3.6e9 / 24.0, 9) END
         AS estimated_days_since_watering,
       CASE WHEN e.sensor_id IS NULL THEN printf('No clear watering events detected. Estimated %.1f days since last watering.',
            (epoch_us(b.last_time) - epoch_us(b.wettest_time)) / 3.6e9 / 24.0) END AS message,
       round(CASE WHEN e.sensor_id IS NOT NULL THEN (epoch_us(b.last_time) - epoch_us(e.event_time)) / 3.6e9 / 24.0
            ELSE (epoch_us(b.last_time) - epoch_us(b.wettest_time)) / 3.6e9 / 24.0 END, 9) AS days_since_watering
FROM (SELECT sensor_id, arg_min(event_time, (-soil_moisture, event_time, event_id)) AS wettest_time,
             max(event_time) AS last_time
      FROM readings WHERE soil_moisture IS NOT NULL GROUP BY sensor_id) b
LEFT JOIN (SELECT * FROM wevents QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY event_time DESC, event_id DESC) = 1) e
  ON b.sensor_id = e.sensor_id""", DELTAS_CTE, EVENTS_CTE)


@query("last_watering", LAST_WATERING_SQL)
def q_last_watering(spark, sf):
    df = W.last_watering(readings(spark, sf))
    return df.withColumns({"confidence": r9("confidence"), "increase_amount": r9("increase_amount", 12),
                           "estimated_days_since_watering": r9("estimated_days_since_watering"),
                           "days_since_watering": r9("days_since_watering")})


@query("recent_stats", with_readings("""
SELECT r.sensor_id, count(*) AS recent_n, round(avg(soil_moisture), 9) AS average_moisture_7d,
       round(stddev_samp(soil_moisture), 9) AS moisture_stability,
       round(avg(CAST(soil_moisture BETWEEN 0.3 AND 0.7 AS DOUBLE)), 9) AS time_in_optimal_range
FROM readings r JOIN (SELECT sensor_id, max(event_time) AS newest FROM readings GROUP BY sensor_id) n USING (sensor_id)
WHERE r.event_time >= n.newest - INTERVAL 7 DAY
GROUP BY r.sensor_id"""))
def q_recent_stats(spark, sf):
    df = W.recent_stats(readings(spark, sf))
    return df.withColumns({c: r9(c) for c in ["average_moisture_7d", "moisture_stability", "time_in_optimal_range"]})


@query("tail_n", with_readings("""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY event_time DESC, event_id DESC) AS rn FROM readings)
WHERE rn <= 24"""))
def q_tail_n(spark, sf):
    return W.tail_n(readings(spark, sf), 24)


@query("train_split", with_readings("""
SELECT sensor_id, event_time, event_id, soil_moisture, rn, n, split_idx, rn <= split_idx AS is_train,
       rn <= split_idx AND rn > 24 AS is_target
FROM (SELECT *, CAST(floor(n * 0.7) AS BIGINT) AS split_idx FROM (
  SELECT sensor_id, event_time, event_id, soil_moisture,
         row_number() OVER (PARTITION BY sensor_id ORDER BY event_time, event_id) AS rn,
         count(*) OVER (PARTITION BY sensor_id) AS n
  FROM readings))"""))
def q_train_split(spark, sf):
    return W.train_split(readings(spark, sf))


HISTORY_SQL = """hist AS (
  SELECT sensor_id, event_time, event_id, rn, soil_moisture AS target,
         CAST(hour(event_time) AS DOUBLE) AS hour_of_day,
         CAST(isodow(event_time) - 1 AS DOUBLE) AS day_of_week,
         CAST((month(event_time) % 12) // 3 AS DOUBLE) AS season,
         CASE WHEN newest_rise IS NULL THEN 1.0 ELSE (rn - newest_rise) / 24.0 END AS days_since_last_water,
         hist_mean, hist_std, hist_min, hist_slope, hist_rises,
         CAST(20 AS DOUBLE) AS temperature, CAST(50 AS DOUBLE) AS humidity, CAST(12 AS DOUBLE) AS light_hours,
         CAST(1.0 AS DOUBLE) AS season_factor
  FROM (
    SELECT *,
           avg(soil_moisture) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS hist_mean,
           stddev_pop(soil_moisture) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS hist_std,
           min(soil_moisture) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS hist_min,
           (lag(soil_moisture, 1) OVER w - lag(soil_moisture, 24) OVER w) / 24.0 AS hist_slope,
           CAST(sum(CASE WHEN delta > 0.3 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS hist_rises,
           max(CASE WHEN delta > 0.2 THEN rn END) OVER (w ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING) AS newest_rise
    FROM (SELECT *, row_number() OVER w AS rn, soil_moisture - lag(soil_moisture) OVER w AS delta
          FROM readings WINDOW w AS (PARTITION BY sensor_id ORDER BY event_time, event_id))
    WINDOW w AS (PARTITION BY sensor_id ORDER BY event_time, event_id))
  WHERE rn > 24)"""


@query("history_features", with_readings("""
SELECT sensor_id, event_time, event_id, rn, target, hour_of_day, day_of_week, season,
       round(days_since_last_water, 9) AS days_since_last_water, round(hist_mean, 9) AS hist_mean,
       round(hist_std, 9) AS hist_std, hist_min, round(hist_slope, 9) AS hist_slope, hist_rises,
       temperature, humidity, light_hours, season_factor
FROM hist""", HISTORY_SQL))
def q_history_features(spark, sf):
    df = W.history_features(readings(spark, sf))
    return df.withColumns({c: r9(c) for c in ["days_since_last_water", "hist_mean", "hist_std", "hist_slope"]})


@query("days_since_rise", with_readings(
    "SELECT sensor_id, event_time, event_id, rn, round(days_since_last_water, 9) AS days_since_last_water FROM hist",
    HISTORY_SQL))
def q_days_since_rise(spark, sf):
    return W.days_since_rise(readings(spark, sf)).withColumn("days_since_last_water", r9("days_since_last_water"))


RATE_PARTS = """SELECT sensor_id, count(*) AS k,
         arg_min(soil_moisture, (event_time, event_id)) AS older, arg_max(soil_moisture, (event_time, event_id)) AS newer,
         (epoch_us(max(event_time)) - epoch_us(min(event_time))) / 3.6e9 AS span_h
  FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY event_time {d}, event_id {d}) AS rn FROM readings)
  WHERE rn <= 48 GROUP BY sensor_id"""


@query("drying_rate", with_readings("""
SELECT r.sensor_id,
       round(CASE WHEN r.k >= 2 AND r.span_h > 0 THEN greatest(0.0, (r.older - r.newer) / r.span_h) ELSE 0.0 END, 9) AS drying_rate_recent,
       round(CASE WHEN c.k >= 2 AND c.span_h > 0 THEN greatest(0.0, (c.newer - c.older) / c.span_h) ELSE 0.0 END, 9) AS drying_rate_compat
FROM recent r JOIN compat c USING (sensor_id)""",
    "recent AS (" + RATE_PARTS.format(d="DESC") + ")", "compat AS (" + RATE_PARTS.format(d="ASC") + ")"))
def q_drying_rate(spark, sf):
    df = W.drying_rate(readings(spark, sf))
    return df.withColumns({c: r9(c) for c in ["drying_rate_recent", "drying_rate_compat"]})


@query("linear_rate", with_readings("""
SELECT sensor_id, k AS rate_readings,
       round(CASE WHEN k >= 2 THEN greatest(0.001, (older - newer) / greatest(span_h, 1.0)) ELSE 0.005 END, 9) AS decay_rate
FROM recent""", "recent AS (" + RATE_PARTS.format(d="DESC") + ")"))
def q_linear_rate(spark, sf):
    return W.linear_rate(readings(spark, sf)).withColumn("decay_rate", r9("decay_rate"))
