"""Registered queries on cases derived from ``events`` by the same rule in Spark and in SQL: falling series, series
that fail each check, degenerate series, malformed messages, payloads with a time; and the parts of the full
prediction that do not depend on the forest."""
from __future__ import annotations

from pyspark.sql import functions as F

from soilcast.functions import status as ST
from soilcast.operators import decay, forest, health, linear, report, staging
from soilcast.operators.marts import choose_method
from soilcast.operators.windows import drying_rate
from soilcast.plans import predict as P
from soilcast.plans.catalog import READINGS_CTE, query, r9, readings, with_readings
from soilcast.plans.q_forecast import CROSS_CTE, CURVE_CTE, DECAY_CTES
from soilcast.plans.q_results import HEALTH_CTES, P6
from soilcast.plans.q_series import HISTORY_SQL
from soilcast.sources import messages as M

BASE_CTE = READINGS_CTE.replace("readings AS (", "base AS (", 1)


def _sql(readings_cte: str, body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([BASE_CTE, readings_cte, *ctes]) + "\n" + body


def _user(c: str = "sensor_id"):
    return F.regexp_extract(c, "([0-9]+)$", 1).cast("int")


USER = "CAST(regexp_extract(sensor_id, '([0-9]+)$', 1) AS INTEGER)"

# ---- falling series: soil that dries towards the table's newest time ---------------------------------------------

FALLING = f"""readings AS (
  SELECT * EXCLUDE (back, newest) REPLACE (
    newest - to_microseconds(back) AS event_time,
    0.05 + 0.3 * exp(back / 3.6e9 / CAST(250 + 25 * ({USER} % 20) AS DOUBLE)) AS soil_moisture) FROM (
    SELECT *, max(event_time) OVER () AS newest,
           (epoch_us(max(event_time) OVER ()) - epoch_us(event_time)) // 12 AS back FROM base))"""


def falling(spark, sf):
    """Times drawn together by 12; 0.05 + 0.3 exp(age / tau), tau 250 to 725 hours."""
    r = readings(spark, sf)
    newest = r.agg(F.max("event_time").alias("_newest"))                       # one row
    back = F.floor(F.timestamp_diff("MICROSECOND", F.col("event_time"), F.col("_newest")) / 12)
    tau = (F.lit(250) + 25 * (_user() % 20)).cast("double")
    return r.crossJoin(F.broadcast(newest)).withColumn("_back", back).withColumn(
        "event_time", F.timestamp_add("MICROSECOND", -F.col("_back"), F.col("_newest"))).withColumn(
        "soil_moisture", F.lit(0.05) + F.lit(0.3) * F.exp(F.col("_back") / F.lit(3.6e9) / tau)).drop("_newest", "_back")


@query("falling_crossing", _sql(FALLING, """
SELECT sensor_id, round(current_moisture, 6) AS current_moisture, round(hours_from_now, 4) AS hours_from_now,
       CASE WHEN hours_from_now < 12 THEN 'HIGH' WHEN hours_from_now < 48 THEN 'MEDIUM' ELSE 'LOW' END AS urgency
FROM cross_h""", *DECAY_CTES, CROSS_CTE))
def q_falling_crossing(spark, sf):
    c = decay.decay_crossing(decay.decay_fit(falling(spark, sf)))
    return c.select("sensor_id", r9("current_moisture", P6).alias("current_moisture"),
                    r9("hours_from_now", 4).alias("hours_from_now"), "urgency")


@query("falling_curve_crossing", _sql(FALLING, """
SELECT sensor_id, min(hours_from_now) AS critical_hour, arg_min("timestamp", hours_from_now) AS critical_time
FROM dcurve WHERE predicted_moisture <= 0.2 GROUP BY sensor_id""", *DECAY_CTES, CURVE_CTE))
def q_falling_curve_crossing(spark, sf):
    return report.curve_crossing(decay.decay_curve(decay.decay_fit(falling(spark, sf))))


@query("falling_chart_curve", _sql(FALLING, """
SELECT sensor_id, hours_from_now, round(predicted_moisture, 5) AS predicted_moisture FROM (
  SELECT *, coalesce(min(CASE WHEN predicted_moisture < 0.2 THEN hours_from_now END) OVER (PARTITION BY sensor_id), 337) AS stop
  FROM dcurve) WHERE hours_from_now < stop""", *DECAY_CTES, CURVE_CTE))
def q_falling_chart_curve(spark, sf):
    c = report.chart_curve(decay.decay_curve(decay.decay_fit(falling(spark, sf))))
    return c.select("sensor_id", "hours_from_now", r9("predicted_moisture", 5).alias("predicted_moisture"))


# ---- series that fail each check -----------------------------------------------------------------------------------

FAULTY = f"""readings AS (
  SELECT * REPLACE (CASE WHEN {USER} % 6 = 1 AND event_id % 9 = 0 THEN NULL
                         WHEN {USER} % 6 = 2 AND event_id % 9 = 0 THEN 'NaN'::DOUBLE
                         WHEN {USER} % 6 = 3 AND event_id % 9 = 0 THEN soil_moisture + 1.0
                         ELSE soil_moisture END AS soil_moisture)
  FROM base WHERE {USER} % 6 <> 4 OR event_id % 40 = 0)"""


def faulty(spark, sf):
    r = readings(spark, sf)
    u, ninth, m = _user() % 6, F.col("event_id") % 9 == 0, F.col("soil_moisture")
    m = (F.when((u == 1) & ninth, F.lit(None).cast("double")).when((u == 2) & ninth, F.lit(float("nan")))
         .when((u == 3) & ninth, m + 1.0).otherwise(m))
    return r.where((u != 4) | (F.col("event_id") % 40 == 0)).withColumn("soil_moisture", m)


REASON_SQL = """
SELECT sensor_id, n_readings, reason FROM (
  SELECT sensor_id, count(*) AS n_readings,
         CASE WHEN count(*) < 10 THEN 'Insufficient data points. Need at least 10 readings for analysis.'
              WHEN count_if(event_time IS NULL OR soil_moisture IS NULL OR isnan(soil_moisture)) > 0
                   THEN 'Data contains NaN values. Please clean the data first.'
              WHEN count_if(NOT (soil_moisture BETWEEN 0.0 AND 1.0)) > 0 THEN '''moisture'' values must be between 0 and 1'
         END AS reason
  FROM readings GROUP BY sensor_id)"""


@query("validate_faulty_series", _sql(FAULTY, REASON_SQL))
def q_validate_faulty(spark, sf):
    return staging.validate_series(faulty(spark, sf)).select("sensor_id", "n_readings", "reason")


@query("predict_rejects", _sql(FAULTY, REASON_SQL + " WHERE reason IS NOT NULL"))
def q_predict_rejects(spark, sf):
    """Sensors a prediction run leaves out, with the reason, beside those it analyses."""
    a = P.analyze(faulty(spark, sf), use_forest=False, method="exponential")
    return a.rejects.select("sensor_id", "n_readings", "reason")


# ---- submissions that fail each check -------------------------------------------------------------------------------

FAULTY_SUBMISSIONS = """faulty AS (
  SELECT submission_id, sensor_id, position, USER_NO % 6 AS u, n_sub,
         NOT (USER_NO % 6 = 1 AND position = n_sub - 1) AS has_time,
         CASE WHEN USER_NO % 6 IN (2, 3) AND position = 3 THEN soil_moisture + 1.0
              WHEN USER_NO % 6 = 5 AND position = 4 THEN NULL ELSE soil_moisture END AS m,
         USER_NO % 6 IN (3, 4) AND position = 2 AS bad_time
  FROM (SELECT *, CAST(right(sensor_id, 5) AS INTEGER) AS USER_NO,
               row_number() OVER (PARTITION BY submission_id ORDER BY event_time, event_id) - 1 AS position FROM sub))"""


def faulty_submissions(spark, sf):
    """Weekly submissions: by user number modulo 6 whole, short of a timestamp, out of range, both out of range and
    with a bad timestamp, with a bad timestamp, with a null reading."""
    from soilcast.sources.submissions import submissions_from_readings

    s = submissions_from_readings(readings(spark, sf))
    n = s.groupBy("submission_id").agg(F.count(F.lit(1)).alias("n_sub"))
    s = s.join(n, "submission_id")
    u = F.regexp_extract("submission_id", r"(\d+)/", 1).cast("int") % 6
    last, pos, m = F.col("position") == F.col("n_sub") - 1, F.col("position"), F.col("soil_moisture")
    gone = (u == 1) & last
    return s.withColumn("has_time", ~gone).withColumn("ts_text", F.when(gone, F.lit(None).cast("string")).when(
        u.isin(3, 4) & (pos == 2), F.lit("30/09/2025 10:00")).otherwise(F.col("ts_text"))).withColumn(
        "soil_moisture", F.when(u.isin(2, 3) & (pos == 3), m + 1.0).when((u == 5) & (pos == 4), F.lit(None).cast("double"))
        .otherwise(m)).drop("n_sub")


def _faulty_submission_sql() -> str:
    from soilcast.plans.q_results import SUB_BASE

    return "WITH " + ",\n".join([*SUB_BASE, FAULTY_SUBMISSIONS]) + """
SELECT submission_id, n_readings, CASE WHEN reason IS NULL THEN 'valid' ELSE 'rejected' END AS status, reason FROM (
  SELECT submission_id, CAST(count(*) AS INTEGER) AS n_readings,
         CASE WHEN count(*) <> count_if(has_time) THEN 'Number of moisture readings must match number of timestamps'
              WHEN count(*) < 10 THEN 'At least 10 data points required for accurate prediction'
              WHEN count_if(m IS NULL OR m < 0.0 OR m > 1.0) > 0 THEN 'Moisture readings must be between 0.0 and 1.0'
              WHEN count_if(bad_time) > 0 THEN 'Invalid timestamp format. Use ISO format (e.g., ''2025-09-30T10:00:00'')' END AS reason
  FROM faulty GROUP BY submission_id)"""


@query("validate_faulty_submission", _faulty_submission_sql())
def q_validate_faulty_submission(spark, sf):
    from soilcast.sources.submissions import validate_submission

    return validate_submission(faulty_submissions(spark, sf)).select("submission_id", "n_readings", "status", "reason")


# ---- degenerate series: all times equal, all values equal, ten rows -------------------------------------------------

DEGENERATE = f"""readings AS (
  SELECT * REPLACE (CASE WHEN {USER} % 4 = 1 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE event_time END AS event_time,
                    CASE WHEN {USER} % 4 = 2 THEN 0.5 ELSE soil_moisture END AS soil_moisture) FROM base)"""


def degenerate(spark, sf):
    r, u = readings(spark, sf), _user() % 4
    return r.withColumn("event_time", F.when(u == 1, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
                        .otherwise(F.col("event_time"))) \
        .withColumn("soil_moisture", F.when(u == 2, F.lit(0.5)).otherwise(F.col("soil_moisture")))


@query("decay_fit_degenerate", _sql(DEGENERATE, """
SELECT sensor_id, least(count(*), 168) AS n_points, true AS fitted,
       arg_max(soil_moisture, (event_time, event_id)) AS current_moisture
FROM readings GROUP BY sensor_id HAVING count(*) >= 10"""))
def q_decay_fit_degenerate(spark, sf):
    f = decay.decay_fit(degenerate(spark, sf))
    ok = F.col("fitted") & F.col("A").isNotNull() & F.col("offset").isNotNull() & F.col("confidence").between(0.3, 0.95)
    return f.select("sensor_id", "n_points", ok.alias("fitted"), "current_moisture")


# ---- the forest's inputs and what a prediction says without it --------------------------------------------------------

@query("forest_training_rows", with_readings("""
SELECT sensor_id, event_time, event_id, rn, n, target, hour_of_day, day_of_week, season,
       round(days_since_last_water, 9) AS days_since_last_water, round(hist_mean, 9) AS hist_mean,
       round(hist_std, 9) AS hist_std, hist_min, round(hist_slope, 9) AS hist_slope, hist_rises
FROM hist JOIN (SELECT sensor_id, count(*) AS n FROM readings GROUP BY sensor_id) USING (sensor_id)
WHERE n >= 50 AND rn <= floor(n * 0.7)""", HISTORY_SQL))
def q_forest_training_rows(spark, sf):
    f = forest.forest_training_rows(readings(spark, sf))
    return f.select("sensor_id", "event_time", "event_id", "rn", "n", "target", "hour_of_day", "day_of_week", "season",
                    *[r9(c).alias(c) for c in ("days_since_last_water", "hist_mean", "hist_std")], "hist_min",
                    r9("hist_slope").alias("hist_slope"), "hist_rises")


@query("forest_seeds", with_readings("""
SELECT sensor_id, CAST(row_number() OVER (PARTITION BY sensor_id ORDER BY event_time, event_id) - 1 AS INTEGER) AS place,
       soil_moisture AS value, max(event_time) OVER (PARTITION BY sensor_id) AS current_time,
       first(soil_moisture) OVER (PARTITION BY sensor_id ORDER BY event_time DESC, event_id DESC) AS current_moisture
FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY event_time DESC, event_id DESC) AS back FROM readings)
WHERE back <= 24"""))
def q_forest_seeds(spark, sf):
    s = forest.forest_seeds(readings(spark, sf))
    return s.select("sensor_id", F.posexplode("history").alias("place", "value"), "current_time", "current_moisture")


RATES_SQL = """rates AS (
  SELECT sensor_id,
    CASE WHEN kn >= 2 AND hn > 0 THEN greatest(0.0, (older_n - newer_n) / hn) ELSE 0.0 END AS drying_rate_recent,
    CASE WHEN ko >= 2 AND ho > 0 THEN greatest(0.0, (newer_o - older_o) / ho) ELSE 0.0 END AS drying_rate_compat
  FROM (SELECT sensor_id,
    count(*) FILTER (back <= 48) AS kn, count(*) FILTER (fore <= 48) AS ko,
    (epoch_us(max(event_time) FILTER (back <= 48)) - epoch_us(min(event_time) FILTER (back <= 48))) / 3.6e9 AS hn,
    (epoch_us(max(event_time) FILTER (fore <= 48)) - epoch_us(min(event_time) FILTER (fore <= 48))) / 3.6e9 AS ho,
    arg_min(soil_moisture, fore) FILTER (back <= 48) AS older_n, arg_max(soil_moisture, fore) FILTER (back <= 48) AS newer_n,
    arg_min(soil_moisture, fore) FILTER (fore <= 48) AS older_o, arg_max(soil_moisture, fore) FILTER (fore <= 48) AS newer_o
    FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY event_time, event_id) AS fore,
                 row_number() OVER (PARTITION BY sensor_id ORDER BY event_time DESC, event_id DESC) AS back FROM readings)
    GROUP BY sensor_id))"""


@query("predict_base", with_readings("""
SELECT h.sensor_id, h.samples_used, CASE WHEN h.samples_used >= 50 THEN 'ml' ELSE 'exponential' END AS method,
       h.current_moisture,
       CASE WHEN h.current_moisture <= 0.2 THEN 'CRITICAL' WHEN h.current_moisture <= 0.3 THEN 'HIGH' END AS immediate,
       round(h.health_score_raw, 6) AS health_score_raw, round(h.average_moisture_7d, 9) AS average_moisture_7d,
       round(h.days_since_last_watering, 9) AS days_since_last_watering,
       round(r.drying_rate_recent, 9) AS drying_rate_recent, round(r.drying_rate_compat, 9) AS drying_rate_compat
FROM hm2 h JOIN rates r USING (sensor_id) WHERE h.samples_used >= 10""", *HEALTH_CTES, RATES_SQL))
def q_predict_base(spark, sf):
    """Everything a prediction says of each valid sensor, with the method it chooses, but for the forecast itself."""
    r = readings(spark, sf)
    valid = staging.validate_series(r).where(F.col("status") == "valid").select(
        "sensor_id", F.col("n_readings").alias("samples_used"))
    b = valid.withColumn("method", choose_method(F.col("samples_used"))) \
        .join(linear.current_reading(r).select("sensor_id", "current_moisture"), "sensor_id") \
        .withColumn("immediate", ST.immediate_urgency(F.col("current_moisture"))) \
        .join(health.health_metrics(r).drop("current_moisture"), "sensor_id").join(drying_rate(r), "sensor_id")
    return b.select("sensor_id", "samples_used", "method", "current_moisture", "immediate",
                    r9("health_score_raw", P6).alias("health_score_raw"),
                    *[r9(c).alias(c) for c in ("average_moisture_7d", "days_since_last_watering", "drying_rate_recent",
                                               "drying_rate_compat")])


# ---- messages and payloads --------------------------------------------------------------------------------------------

def malformed(spark, sf):
    """Bodies by event_id % 8: good, trailing text, two objects, repeated key, not a number, no sensor, bad time, not
    base64."""
    r = readings(spark, sf)
    k = F.col("event_id") % 8
    ts = F.when(k == 6, F.lit("yesterday")).otherwise(F.date_format("event_time", "yyyyMMdd'T'HHmmss"))
    sensor = F.when(k == 5, F.lit("")).otherwise(F.concat(F.lit('"sensor_id": "x", "sensor_id": "'), F.col("sensor_id"), F.lit('", ')))
    measure = F.when(k == 4, F.lit('"wet"')).otherwise(F.lit("0.25"))
    obj = F.concat(F.lit("{"), sensor, F.lit('"timestamp": "'), ts, F.lit('", "soil_moisture": '), measure, F.lit("}"))
    text = F.when(k == 1, F.concat(obj, F.lit(" end"))).when(k == 2, F.concat(obj, obj)).otherwise(obj)
    body = F.base64(F.encode(text, "UTF-8"))
    return r.select("event_id", F.when(k == 7, F.concat(F.lit("%"), body)).otherwise(body).alias("body"))


@query("parse_malformed", with_readings("""
SELECT event_id,
       CASE WHEN event_id % 8 IN (0, 3, 4, 6) THEN sensor_id END AS sensor_id,
       CASE WHEN event_id % 8 IN (0, 3, 4, 5) THEN date_trunc('second', event_time) END AS event_time,
       CASE WHEN event_id % 8 IN (0, 3, 5, 6) THEN CAST(0.25 AS DOUBLE) END AS soil_moisture,
       CASE WHEN event_id % 8 IN (1, 2, 7) THEN 'body is not base64 UTF-8 JSON object'
            WHEN event_id % 8 = 5 THEN 'missing sensor_id' WHEN event_id % 8 = 6 THEN 'missing or invalid timestamp'
            WHEN event_id % 8 = 4 THEN 'a measure is not a number' END AS reject_reason
FROM readings"""))
def q_parse_malformed(spark, sf):
    return M.parse_messages(malformed(spark, sf)).select("event_id", "sensor_id", "event_time", "soil_moisture",
                                                         "reject_reason")


@query("staging_payload_time", with_readings("""
SELECT sensor_id, event_time, soil_moisture,
       CASE WHEN event_id % 3 > 0 THEN strftime(event_time, '%Y-%m-%dT%H:%M:%S') END AS original_timestamp
FROM readings WHERE event_time >= (SELECT max(event_time) FROM readings) - INTERVAL 30 DAY"""))
def q_staging_payload_time(spark, sf):
    iso = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss")
    payload = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit('{"timestamp": "'), iso, F.lit('"}'))).otherwise(
        F.col("payload"))
    s = staging.staging_readings(readings(spark, sf).withColumn("payload", payload))
    return s.select("sensor_id", "event_time", "soil_moisture", "original_timestamp")
