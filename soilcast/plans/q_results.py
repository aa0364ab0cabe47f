"""Registered queries: health, recommendations, predictions, submissions, messages, joins and chart frames
(SURVEY 2.1, 2.2, 2.3, 2.6, 2.8)."""
from __future__ import annotations

from pyspark.sql import functions as F

from soilcast.operators import decay, forest, health, model_store, report, staging
from soilcast.plans import predict as P
from soilcast.plans.catalog import READINGS_CTE, query, r9, readings, with_readings
from soilcast.plans.q_forecast import CROSS_CTE, CURVE_CTE, DECAY_CTES
from soilcast.plans.q_series import DELTAS_CTE, EVENTS_CTE
from soilcast.sources import messages as M
from soilcast.sources import submissions as SUB
from soilcast.sources.readings import readings_from_events, table

P6 = 6

# ---- SQL building blocks of the exponential-path analysis (need a `readings` relation) -------------------------
HEALTH_CTES = [
    DELTAS_CTE, EVENTS_CTE,
    """lastw AS (
  SELECT b.sensor_id,
         CASE WHEN e.sensor_id IS NOT NULL THEN (epoch_us(b.last_time) - epoch_us(e.event_time)) / 3.6e9 / 24.0
              ELSE (epoch_us(b.last_time) - epoch_us(b.wettest_time)) / 3.6e9 / 24.0 END AS days_since_watering
  FROM (SELECT sensor_id, arg_min(event_time, (-soil_moisture, event_time, event_id)) AS wettest_time,
               max(event_time) AS last_time
        FROM readings WHERE soil_moisture IS NOT NULL GROUP BY sensor_id) b
  LEFT JOIN (SELECT * FROM wevents QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY event_time DESC, event_id DESC) = 1) e
    ON b.sensor_id = e.sensor_id)""",
    """rstats AS (
  SELECT r.sensor_id, avg(soil_moisture) AS average_moisture_7d, stddev_samp(soil_moisture) AS moisture_stability,
         avg(CAST(soil_moisture BETWEEN 0.3 AND 0.7 AS DOUBLE)) AS time_in_optimal_range
  FROM readings r JOIN (SELECT sensor_id, max(event_time) AS newest FROM readings GROUP BY sensor_id) n USING (sensor_id)
  WHERE r.event_time >= n.newest - INTERVAL 7 DAY GROUP BY r.sensor_id)""",
    """cur AS (
  SELECT sensor_id, count(*) AS samples_used, max(event_time) AS current_time,
         arg_max(soil_moisture, (event_time, event_id)) AS current_moisture
  FROM readings GROUP BY sensor_id)""",
    """hm AS (
  SELECT c.*, (c.current_moisture * 40 + s.average_moisture_7d * 30 + (1.0 - abs(c.current_moisture - 0.5)) * 30) * 100 AS health_score_raw,
         s.average_moisture_7d, s.moisture_stability, s.time_in_optimal_range, l.days_since_watering AS days_since_last_watering
  FROM cur c JOIN rstats s USING (sensor_id) JOIN lastw l USING (sensor_id))""",
    """hm2 AS (SELECT *, least(100.0, greatest(0.0, health_score_raw)) AS health_score FROM hm)""",
]

EXP_RESULT_CTES = [
    CROSS_CTE, CURVE_CTE,
    """crit AS (SELECT sensor_id, arg_min("timestamp", hours_from_now) AS critical_time FROM dcurve
             WHERE predicted_moisture <= 0.2 GROUP BY sensor_id)""",
    """res AS (
  SELECT h.*, CASE WHEN h.current_moisture <= 0.2 THEN 'CRITICAL' WHEN h.current_moisture <= 0.3 THEN 'HIGH' END AS immediate,
         x.hours_from_now AS x_hours, x.confidence AS fit_conf, x.A, x.tau, x."offset", x.t_now,
         CASE WHEN x.hours_from_now < 12 THEN 'HIGH' WHEN x.hours_from_now < 48 THEN 'MEDIUM' ELSE 'LOW' END AS x_urgency
  FROM hm2 h JOIN cross_h x USING (sensor_id) WHERE h.samples_used >= 10)""",
    """res2 AS (
  SELECT *, coalesce(immediate, x_urgency) AS urgency,
         CASE WHEN immediate IS NOT NULL THEN 0.0 ELSE x_hours END AS hours_from_now,
         CASE WHEN immediate IS NOT NULL THEN current_moisture ELSE A * exp(-(t_now + x_hours) / tau) + "offset" END AS predicted_moisture,
         CASE WHEN immediate IS NOT NULL THEN current_time
              ELSE current_time + to_hours(CAST(least(floor(x_hours + 1e-6), 335) AS INTEGER)) END AS predicted_watering_date,
         CASE WHEN immediate = 'CRITICAL' THEN 0.99 WHEN immediate = 'HIGH' THEN 0.95 ELSE fit_conf END AS confidence_score,
         fit_conf AS model_accuracy
  FROM res)""",
    """res3 AS (
  SELECT *, CASE WHEN urgency = 'CRITICAL' THEN 'CRITICAL' WHEN urgency = 'HIGH' THEN 'WARNING' ELSE 'OK' END AS status,
         CASE WHEN urgency = 'CRITICAL' THEN predicted_watering_date
              WHEN urgency = 'HIGH' THEN predicted_watering_date + INTERVAL 12 HOUR END AS critical_watering_date,
         concat_ws(' | ',
           CASE WHEN health_score >= 90 THEN 'Excellent plant health! Continue current care routine.'
                WHEN health_score >= 70 THEN 'Good plant health with room for optimization.'
                ELSE 'Plant health needs attention. Review watering schedule.' END,
           CASE WHEN urgency = 'CRITICAL' THEN 'URGENT: Water immediately to prevent plant stress!'
                WHEN urgency = 'HIGH' THEN 'Water soon to maintain optimal moisture levels.'
                WHEN urgency = 'MEDIUM' THEN 'Plan to water in the next day or two.' END,
           CASE WHEN moisture_stability > 0.15 THEN 'High moisture variability detected. Consider more consistent watering.' END)
           AS recommendations_text
  FROM res2)""",
]


def analysis_sql(body: str, readings_cte: str = READINGS_CTE, pre: tuple = ()) -> str:
    ctes = [readings_cte, *pre, *DECAY_CTES, *HEALTH_CTES, *EXP_RESULT_CTES]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def rec_text(c):
    return F.array_join(c, " | ")


# ---- health and recommendations ------------------------------------------------------------------------------

@query("health_metrics", analysis_sql("""
SELECT sensor_id, round(health_score, 6) AS health_score, round(health_score_raw, 6) AS health_score_raw, current_moisture,
       round(average_moisture_7d, 9) AS average_moisture_7d, round(days_since_last_watering, 9) AS days_since_last_watering,
       round(moisture_stability, 9) AS moisture_stability, round(time_in_optimal_range, 9) AS time_in_optimal_range,
       7 AS average_days_between_watering, 0.8 AS consistency_score, 'Maintain current schedule' AS frequency_recommendation
FROM hm2"""))
def q_health_metrics(spark, sf):
    h = health.health_metrics(readings(spark, sf))
    return h.select("sensor_id", r9("health_score", P6).alias("health_score"), r9("health_score_raw", P6).alias("health_score_raw"),
                    "current_moisture", r9("average_moisture_7d").alias("average_moisture_7d"),
                    r9("days_since_last_watering").alias("days_since_last_watering"),
                    r9("moisture_stability").alias("moisture_stability"), r9("time_in_optimal_range").alias("time_in_optimal_range"),
                    F.col("watering_frequency_analysis.average_days_between_watering").alias("average_days_between_watering"),
                    F.col("watering_frequency_analysis.consistency_score").cast("decimal(2,1)").alias("consistency_score"),
                    F.col("watering_frequency_analysis.recommendation").alias("frequency_recommendation"))


def _recommendations(results):
    return results.select("sensor_id", "urgency", r9("health_score", P6).alias("health_score"),
                          rec_text(F.col("recommendations")).alias("recommendations_text"))


@query("recommendations")
def q_recommendations(spark, sf):
    return _recommendations(P.analyze(readings(spark, sf)).results)


@query("recommendations_exponential", analysis_sql(
    "SELECT sensor_id, urgency, round(health_score, 6) AS health_score, recommendations_text FROM res3"))
def q_recommendations_exponential(spark, sf):
    return _recommendations(P.analyze(readings(spark, sf), use_forest=False, method="exponential").results)


# ---- predictions ---------------------------------------------------------------------------------------------

@query("predict_batch")
def q_predict_batch(spark, sf):
    return P.predict_batch(readings(spark, sf)).withColumn("recommendations", rec_text(F.col("recommendations")))


@query("predict_one")
def q_predict_one(spark, sf):
    from soilcast.plans.q_surface import ONE_SENSOR
    p = P.predict_one(readings(spark, sf), ONE_SENSOR)
    return p.withColumn("recommendations", rec_text(F.col("recommendations"))) \
        .withColumn("predicted_decay_curve", F.to_json("predicted_decay_curve")) \
        .withColumn("watering_frequency_analysis", F.to_json("watering_frequency_analysis"))


@query("sensor_status")
def q_sensor_status(spark, sf):
    return P.sensor_status(readings(spark, sf))


SUMMARY_SQL = analysis_sql("""
SELECT k.sensor_id,
       CASE WHEN r.sensor_id IS NOT NULL THEN printf('%.3f', r.current_moisture) ELSE 'N/A' END AS current_moisture_text,
       coalesce(r.status, 'API Error') AS status_text,
       CASE WHEN r.sensor_id IS NOT NULL THEN printf('%.0f%%', r.confidence_score * 100) ELSE 'N/A' END AS confidence_text,
       CASE WHEN r.sensor_id IS NULL THEN 'N/A' WHEN r.status LIKE '%CRITICAL%' THEN 'TODAY (Critical)'
            WHEN r.critical_watering_date IS NOT NULL THEN strftime(r.critical_watering_date, '%Y-%m-%d')
            WHEN r.predicted_watering_date IS NOT NULL THEN strftime(r.predicted_watering_date, '%Y-%m-%d')
            ELSE 'Not needed' END AS watering_date_text
FROM (SELECT DISTINCT sensor_id FROM readings) k LEFT JOIN res3 r USING (sensor_id)""")


def _all_exponential(spark, sf):
    """Every sensor over its whole series, on the path that SQL can follow."""
    return P.predict_batch(readings(spark, sf), use_forest=False, method="exponential")


@query("sensor_summary")
def q_sensor_summary(spark, sf):
    r = readings(spark, sf)
    return report.sensor_summary(r, P.predict_batch(r))


@query("sensor_summary_exponential", SUMMARY_SQL)
def q_sensor_summary_exponential(spark, sf):
    return report.sensor_summary(readings(spark, sf), _all_exponential(spark, sf))


def _date_labels(results):
    return results.select(
        "sensor_id", "status", "predicted_watering_date", "critical_watering_date",
        report.watering_date_label("status", "critical_watering_date", "predicted_watering_date")
        .alias("watering_date_text"))


@query("watering_date_label")
def q_watering_date_label(spark, sf):
    return _date_labels(P.analyze(readings(spark, sf)).forecasts)


@query("watering_date_label_exponential", analysis_sql("""
SELECT sensor_id, status, predicted_watering_date, critical_watering_date,
       CASE WHEN status LIKE '%CRITICAL%' THEN 'TODAY (Critical)'
            WHEN critical_watering_date IS NOT NULL THEN strftime(critical_watering_date, '%Y-%m-%d')
            WHEN predicted_watering_date IS NOT NULL THEN strftime(predicted_watering_date, '%Y-%m-%d')
            ELSE 'Not needed' END AS watering_date_text
FROM res3"""))
def q_watering_date_label_exponential(spark, sf):
    return _date_labels(_all_exponential(spark, sf))


# ---- submissions ---------------------------------------------------------------------------------------------

def _submissions(spark, sf):
    return SUB.submissions_from_readings(readings(spark, sf))


SUB_BASE = [
    READINGS_CTE.replace("readings AS (", "rd AS (", 1),
    """sub AS (
  SELECT *, sensor_id || '/' || strftime(date_trunc('week', event_time), '%Y-%m-%d') AS submission_id,
         count(*) OVER (PARTITION BY sensor_id, date_trunc('week', event_time)) AS n_sub
  FROM rd)""",
]


@query("submitted_series", "WITH " + ",\n".join(SUB_BASE) + """
SELECT submission_id, CASE WHEN sensor_id LIKE 'EXT-%' THEN 'external-sensor' ELSE sensor_id END AS sensor_id,
       event_time, soil_moisture,
       row_number() OVER (PARTITION BY submission_id ORDER BY event_time, event_id) - 1 AS event_id
FROM sub ORDER BY submission_id, event_time""")
def q_submitted_series(spark, sf):
    return SUB.submitted_series(_submissions(spark, sf))


@query("validate_submission", "WITH " + ",\n".join(SUB_BASE) + """
SELECT submission_id, CASE WHEN sensor_id LIKE 'EXT-%' THEN 'external-sensor' ELSE sensor_id END AS sensor_id,
       CAST(count(*) AS INTEGER) AS n_readings,
       CASE WHEN count(*) < 10 THEN 'rejected' ELSE 'valid' END AS status,
       CASE WHEN count(*) < 10 THEN 'At least 10 data points required for accurate prediction' END AS reason
FROM sub GROUP BY submission_id, sensor_id""")
def q_validate_submission(spark, sf):
    return SUB.validate_submission(_submissions(spark, sf))


SUB_READINGS = """readings AS (
  SELECT submission_id AS sensor_id, event_time, soil_moisture,
         row_number() OVER (PARTITION BY submission_id ORDER BY event_time, event_id) - 1 AS event_id
  FROM sub WHERE n_sub >= 10)"""


@query("predict_submission", "WITH " + ",\n".join([*SUB_BASE, SUB_READINGS, *DECAY_CTES, *HEALTH_CTES, *EXP_RESULT_CTES]) + """
SELECT r.sensor_id AS submission_id,
       CASE WHEN r.sensor_id LIKE 'EXT-%' THEN 'external-sensor' ELSE split_part(r.sensor_id, '/', 1) END AS sensor_id,
       r.current_moisture,
       CASE WHEN r.current_moisture <= 0.2 THEN 'CRITICAL' WHEN r.current_moisture <= 0.3 THEN 'WARNING' ELSE 'OK' END AS status,
       r.predicted_watering_date, c.critical_time AS critical_watering_date,
       round(r.hours_from_now / 24.0, 6) AS drying_rate_per_hour, round(r.model_accuracy, 6) AS model_accuracy,
       r.samples_used, round(r.model_accuracy, 6) AS confidence_score, round(r.health_score, 6) AS health_score,
       round(r.average_moisture_7d, 9) AS average_moisture_7d, round(r.days_since_last_watering, 9) AS days_since_last_watering,
       round(r.moisture_stability, 9) AS moisture_stability, r.recommendations_text
FROM res3 r LEFT JOIN crit c USING (sensor_id)""")
def q_predict_submission(spark, sf):
    p = P.predict_submission(_submissions(spark, sf))
    return p.select("submission_id", "sensor_id", "current_moisture", "status", "predicted_watering_date",
                    "critical_watering_date", r9("drying_rate_per_hour", P6).alias("drying_rate_per_hour"),
                    r9("model_accuracy", P6).alias("model_accuracy"), "samples_used",
                    r9("confidence_score", P6).alias("confidence_score"), r9("health_score", P6).alias("health_score"),
                    r9("average_moisture_7d").alias("average_moisture_7d"),
                    r9("days_since_last_watering").alias("days_since_last_watering"),
                    r9("moisture_stability").alias("moisture_stability"),
                    rec_text(F.col("recommendations")).alias("recommendations_text"))


# ---- messages ------------------------------------------------------------------------------------------------

def _messages(spark, sf):
    return M.messages_from_readings(readings_from_events(table(spark, sf, "events"), keep_type=True))


MSG_SQL = with_readings("""
SELECT m.event_id, r.sensor_id, r.event_time,
       CASE WHEN e.event_type = 'error' THEN NULL ELSE r.temperature_c END AS temperature_c,
       CASE WHEN e.event_type = 'error' THEN NULL ELSE r.humidity_pct END AS humidity_pct,
       r.soil_moisture
FROM readings r JOIN events e USING (event_id) JOIN (SELECT event_id FROM events) m USING (event_id)""")


@query("ingest_messages", MSG_SQL)
def q_ingest_messages(spark, sf):
    return M.ingest_messages(_messages(spark, sf)).select("event_id", "sensor_id", "event_time", "temperature_c",
                                                          "humidity_pct", "soil_moisture")


@query("key_fallback", with_readings("""
SELECT r.event_id, e.event_type,
       CASE WHEN e.event_type = 'error' THEN NULL ELSE r.temperature_c END AS temperature_c,
       CASE WHEN e.event_type = 'error' THEN NULL ELSE r.humidity_pct END AS humidity_pct,
       e.event_type = 'click' AS used_short_key
FROM readings r JOIN events e USING (event_id)"""))
def q_key_fallback(spark, sf):
    r = readings_from_events(table(spark, sf, "events"), keep_type=True)
    x = M.messages_from_readings(r, keep=["event_type"]).select("event_id", "event_type", M.fields(F.col("body")).alias("m"))
    return x.select("event_id", "event_type",
                    M.key_fallback(F.col("m"), "temperature_c", "temperature").try_cast("double").alias("temperature_c"),
                    M.key_fallback(F.col("m"), "humidity_pct", "humidity").try_cast("double").alias("humidity_pct"),
                    (~M.has_key(F.col("m"), "temperature_c")).alias("used_short_key"))


@query("parse_iso_time", with_readings("""
SELECT event_id, sensor_id, event_time AS parsed_time,
       strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') || CASE WHEN sensor_id LIKE 'EXT-%' THEN 'Z' ELSE '' END AS iso_text
FROM readings"""))
def q_parse_iso_time(spark, sf):
    from soilcast.functions.timefn import parse_iso
    r = readings(spark, sf)
    iso = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    t = r.select("event_id", "sensor_id", F.when(F.col("sensor_id").startswith("EXT-"), F.concat(iso, F.lit("Z")))
                 .otherwise(iso).alias("iso_text"))
    return t.select("event_id", "sensor_id", parse_iso(F.col("iso_text")).alias("parsed_time"), "iso_text")


# ---- joins ---------------------------------------------------------------------------------------------------

@query("known_sensor_check", with_readings("""
SELECT q.sensor_id, k.sensor_id IS NOT NULL AS found,
       CASE WHEN k.sensor_id IS NULL THEN 'Sensor ' || q.sensor_id || ' not found' END AS detail
FROM (SELECT DISTINCT 'SENSOR-' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS sensor_id FROM events) q
LEFT JOIN (SELECT DISTINCT sensor_id FROM readings) k USING (sensor_id)"""))
def q_known_sensor_check(spark, sf):
    ev = table(spark, sf, "events")
    req = ev.select(F.concat(F.lit("SENSOR-"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("sensor_id")).distinct()
    return report.known_sensor_check(req, readings(spark, sf))


@query("offset_join", with_readings("""
SELECT r.event_id, r.sensor_id, r.event_time + to_microseconds(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(m.newest)) AS event_time
FROM readings r, (SELECT max(event_time) AS newest FROM readings) m"""))
def q_offset_join(spark, sf):
    r = readings(spark, sf)
    newest = r.agg(F.max("event_time").alias("newest"))          # one row: a broadcast of proven size 1
    j = r.crossJoin(F.broadcast(newest))
    off = F.timestamp_diff("MICROSECOND", F.col("newest"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return j.select("event_id", "sensor_id", F.timestamp_add("MICROSECOND", off, F.col("event_time")).alias("event_time"))


# ---- chart frames --------------------------------------------------------------------------------------------

@query("chart_curve", with_readings("""
SELECT sensor_id, hours_from_now, "timestamp", round(predicted_moisture, 6) AS predicted_moisture FROM (
  SELECT *, coalesce(min(CASE WHEN predicted_moisture < 0.2 THEN hours_from_now END) OVER (PARTITION BY sensor_id), 337) AS stop
  FROM dcurve) WHERE hours_from_now < stop""", *DECAY_CTES, CURVE_CTE))
def q_chart_curve(spark, sf):
    c = report.chart_curve(decay.decay_curve(decay.decay_fit(readings(spark, sf))))
    return c.select("sensor_id", "hours_from_now", "timestamp", r9("predicted_moisture", P6).alias("predicted_moisture"))


@query("observed_and_predicted", with_readings("""
SELECT sensor_id AS series, event_time AS "timestamp", round(soil_moisture, 6) AS moisture, 'observed' AS kind FROM readings
UNION ALL
SELECT sensor_id || ' (Predicted)', "timestamp", round(predicted_moisture, 6), 'predicted' FROM (
  SELECT *, coalesce(min(CASE WHEN predicted_moisture < 0.2 THEN hours_from_now END) OVER (PARTITION BY sensor_id), 337) AS stop
  FROM dcurve) WHERE hours_from_now < stop""", *DECAY_CTES, CURVE_CTE))
def q_observed_and_predicted(spark, sf):
    r = readings(spark, sf)
    o = report.observed_and_predicted(r, decay.decay_curve(decay.decay_fit(r)))
    return o.withColumn("moisture", r9("moisture", P6))


# ---- forest (rows-only checks) -------------------------------------------------------------------------------

def _ml_series(spark, sf):
    r = readings(spark, sf)
    n = r.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 50)
    return r.join(n.select("sensor_id"), "sensor_id", "left_semi")


@query("forest_train")
def q_forest_train(spark, sf):
    r = readings(spark, sf)
    rows = forest.forest_training_rows(r)
    return forest.forest_scores(rows, model_store.forest_of(r)).select("sensor_id", "event_time", "target", "prediction")


@query("forest_curve")
def q_forest_curve(spark, sf):
    s = _ml_series(spark, sf)
    return forest.forest_curve(forest.forest_seeds(s), model_store.forest_of(readings(spark, sf)))


@query("forest_forecast")
def q_forest_forecast(spark, sf):
    s = _ml_series(spark, sf)
    return forest.forest_forecast(forest.forest_curve(forest.forest_seeds(s), model_store.forest_of(readings(spark, sf))))


def _urgency_status(forecasts):
    from soilcast.functions.status import urgency_status
    return forecasts.select("sensor_id", "urgency", urgency_status(F.col("urgency")).alias("status"))


@query("urgency_status")
def q_urgency_status(spark, sf):
    return _urgency_status(P.analyze(readings(spark, sf)).forecasts)


@query("urgency_status_exponential", analysis_sql("SELECT sensor_id, urgency, status FROM res3"))
def q_urgency_status_exponential(spark, sf):
    return _urgency_status(P.analyze(readings(spark, sf), use_forest=False, method="exponential").forecasts)
