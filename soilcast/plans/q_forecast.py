"""Registered queries: decay fit / crossing / curve, linear forecast / curve, urgency."""
from __future__ import annotations

from pyspark.sql import functions as F

from soilcast.functions import status as ST
from soilcast.operators import decay, linear
from soilcast.plans.catalog import query, r9, readings, with_readings

P6 = 6


def _pass_sql(k: int, grid: str) -> str:
    """SQL of one tau pass: sums per (sensor, tau), five box candidates, argmin per sensor."""
    return f"""g{k} AS ({grid}),
s{k} AS (
  SELECT p.sensor_id, g.tau, CAST(count(*) AS DOUBLE) AS n, sum(exp(-p.t / g.tau)) AS se,
         sum(exp(-p.t / g.tau) * exp(-p.t / g.tau)) AS see, sum(p.y) AS sy, sum(exp(-p.t / g.tau) * p.y) AS sey,
         sum(p.y * p.y) AS syy
  FROM fitpts p JOIN g{k} g USING (sensor_id) GROUP BY p.sensor_id, g.tau),
u{k} AS (
  SELECT *, see * n - se * se AS det, (n * sey - se * sy) / (see * n - se * se) AS au,
         (see * sy - se * sey) / (see * n - se * se) AS ou FROM s{k}),
c{k} AS (
  SELECT sensor_id, tau, a, o, syy - 2 * a * sey - 2 * o * sy + a * a * see + 2 * a * o * se + n * o * o AS sse FROM (
    SELECT *, au AS a, ou AS o FROM u{k} WHERE det > 0 AND au BETWEEN 0.0 AND 2.0 AND ou BETWEEN 0.0 AND 1.0
    UNION ALL SELECT *, 0.0 AS a, least(greatest((sy - 0.0 * se) / n, 0.0), 1.0) AS o FROM u{k}
    UNION ALL SELECT *, 2.0 AS a, least(greatest((sy - 2.0 * se) / n, 0.0), 1.0) AS o FROM u{k}
    UNION ALL SELECT *, least(greatest((sey - 0.0 * se) / see, 0.0), 2.0) AS a, 0.0 AS o FROM u{k}
    UNION ALL SELECT *, least(greatest((sey - 1.0 * se) / see, 0.0), 2.0) AS a, 1.0 AS o FROM u{k})),
b{k} AS (
  SELECT sensor_id, tau, a, o, sse FROM c{k}
  QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY round(sse, 10), a, tau, o) = 1)"""


def _refine(k: int, step: float) -> str:
    return (f"SELECT sensor_id, tau FROM (SELECT sensor_id, tau + (j - 20) * CAST({step!r} AS DOUBLE) AS tau "
            f"FROM b{k - 1}, range(41) r(j)) WHERE tau BETWEEN 10.0 AND 500.0")


DECAY_CTES = [
    """tailr AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY event_time DESC, event_id DESC) AS rn
                 FROM readings) WHERE rn <= 168)""",
    """pts AS (
  SELECT sensor_id, (epoch_us(event_time) - epoch_us(min(event_time) OVER s)) / 3.6e9 AS t, soil_moisture AS y,
         min(event_time) OVER s AS start_time, max(event_time) OVER s AS current_time,
         arg_max(soil_moisture, (event_time, event_id)) OVER s AS current_moisture, count(*) OVER s AS n_points
  FROM tailr WINDOW s AS (PARTITION BY sensor_id))""",
    "fitpts AS (SELECT * FROM pts WHERE n_points >= 10)",
    _pass_sql(1, "SELECT sensor_id, CAST(10.0 AS DOUBLE) + CAST(i AS DOUBLE) * CAST(10.0 AS DOUBLE) AS tau "
                 "FROM (SELECT DISTINCT sensor_id FROM fitpts), range(50) r(i)"),
    _pass_sql(2, _refine(2, 0.5)),
    _pass_sql(3, _refine(3, 0.025)),
    _pass_sql(4, _refine(4, 0.00125)),
    """fit AS (
  SELECT p.sensor_id, any_value(b.a) AS A, any_value(b.tau) AS tau, any_value(b.o) AS "offset",
         sum(pow(p.y - (b.a * exp(-p.t / b.tau) + b.o), 2)) AS sse, sum(pow(p.y - p.ybar, 2)) AS sst,
         any_value(p.n_points) AS n_points, any_value(p.start_time) AS start_time, any_value(p.current_time) AS current_time,
         any_value(p.current_moisture) AS current_moisture, max(p.t) AS t_now
  FROM (SELECT *, avg(y) OVER (PARTITION BY sensor_id) AS ybar FROM fitpts) p JOIN b4 b USING (sensor_id)
  GROUP BY p.sensor_id)""",
    """fitq AS (
  SELECT *, CASE WHEN sst > 0 THEN 1.0 - sse / sst END AS r_squared,
         CASE WHEN sst > 0 THEN greatest(0.3, least(0.95, 1.0 - sse / sst)) WHEN sse = 0 THEN 0.95 ELSE 0.3 END AS confidence
  FROM fit)""",
]


def decay_sql(body: str, *more: str) -> str:
    return with_readings(body, *DECAY_CTES, *more)


def _fit_out(df):
    return df.select("sensor_id", "n_points", r9("A", P6).alias("A"), r9("tau", P6).alias("tau"),
                     r9("offset", P6).alias("offset"), (r9("r_squared", P6) + F.lit(0.0)).alias("r_squared"),
                     r9("confidence", P6).alias("confidence"), "fitted", "start_time", "current_time",
                     "current_moisture", r9("t_now").alias("t_now"))


@query("decay_fit", decay_sql("""
SELECT sensor_id, n_points, round(A, 6) AS A, round(tau, 6) AS tau, round("offset", 6) AS "offset",
       round(r_squared, 6) + 0.0 AS r_squared, round(confidence, 6) AS confidence, true AS fitted,
       start_time, current_time, current_moisture, round(t_now, 9) AS t_now
FROM fitq"""))
def q_decay_fit(spark, sf):
    return _fit_out(decay.decay_fit(readings(spark, sf)))


@query("fit_quality", decay_sql("""
SELECT sensor_id, round(sse, 6) + 0.0 AS sse, round(sst, 6) + 0.0 AS sst, round(r_squared, 6) + 0.0 AS r_squared,
       round(confidence, 6) AS confidence FROM fitq"""))
def q_fit_quality(spark, sf):
    pts = decay.decay_points(readings(spark, sf)).where(F.col("n_points") >= 10)
    fit = decay.decay_fit(readings(spark, sf))
    # residual sums are recomputed by fit_quality; expose them through a second aggregate
    from pyspark.sql import Window
    j = pts.join(fit.select("sensor_id", "A", "tau", "offset", "r_squared", "confidence"), "sensor_id") \
        .withColumn("ybar", F.avg("y").over(Window.partitionBy("sensor_id")))
    yhat = decay.decay_value(F.col("A"), F.col("tau"), F.col("offset"), F.col("t"))
    g = j.groupBy("sensor_id").agg(F.sum((F.col("y") - yhat) ** 2).alias("sse"),
                                   F.sum((F.col("y") - F.col("ybar")) ** 2).alias("sst"),
                                   F.first("r_squared").alias("r_squared"), F.first("confidence").alias("confidence"))
    return g.select("sensor_id", (r9("sse", P6) + 0.0).alias("sse"), (r9("sst", P6) + 0.0).alias("sst"),
                    (r9("r_squared", P6) + 0.0).alias("r_squared"), r9("confidence", P6).alias("confidence"))


CROSS_CTE = """cross_h AS (
  SELECT *, CASE WHEN A > 0 AND "offset" < 0.3
                 THEN least(greatest(tau * ln(A / (0.3 - "offset")) - t_now, 0.0), 336.0) ELSE 336.0 END AS hours_from_now
  FROM fitq)"""


@query("decay_crossing", decay_sql("""
SELECT sensor_id, current_time, current_moisture, round(hours_from_now, 6) AS hours_from_now,
       round(A * exp(-(t_now + hours_from_now) / tau) + "offset", 6) AS predicted_moisture,
       CASE WHEN hours_from_now < 12 THEN 'HIGH' WHEN hours_from_now < 48 THEN 'MEDIUM' ELSE 'LOW' END AS urgency,
       current_time + to_hours(CAST(least(floor(hours_from_now + 1e-6), 335) AS INTEGER)) AS predicted_time,
       round(confidence, 6) AS confidence
FROM cross_h""", CROSS_CTE))
def q_decay_crossing(spark, sf):
    c = decay.decay_crossing(decay.decay_fit(readings(spark, sf)))
    return c.select("sensor_id", "current_time", "current_moisture", r9("hours_from_now", P6).alias("hours_from_now"),
                    r9("predicted_moisture", P6).alias("predicted_moisture"), "urgency", "predicted_time",
                    r9("confidence", P6).alias("confidence"))


CURVE_CTE = """dcurve AS (
  SELECT sensor_id, CAST(h AS INTEGER) AS hours_from_now, current_time + to_hours(CAST(h AS INTEGER)) AS "timestamp",
         least(greatest(A * exp(-(t_now + h) / tau) + "offset", 0.0), 1.0) AS predicted_moisture,
         greatest(0.3, confidence * (1.0 - h / 672.0)) AS confidence
  FROM fitq, range(337) r(h))"""


@query("decay_curve", decay_sql("""
SELECT sensor_id, hours_from_now, "timestamp", round(predicted_moisture, 6) AS predicted_moisture,
       CASE WHEN predicted_moisture <= 0.2 THEN 'CRITICAL' WHEN predicted_moisture <= 0.3 THEN 'NEEDS_WATERING' ELSE 'HEALTHY' END AS status,
       CASE WHEN predicted_moisture <= 0.2 THEN 'red' WHEN predicted_moisture <= 0.3 THEN 'orange' ELSE 'green' END AS color,
       round(confidence, 6) AS confidence, 'exponential_decay' AS model_type
FROM dcurve""", CURVE_CTE))
def q_decay_curve(spark, sf):
    c = decay.decay_curve(decay.decay_fit(readings(spark, sf)))
    return c.withColumns({"predicted_moisture": r9("predicted_moisture", P6), "confidence": r9("confidence", P6)})


@query("curve_crossing", decay_sql("""
SELECT sensor_id, min(hours_from_now) AS critical_hour, arg_min("timestamp", hours_from_now) AS critical_time
FROM dcurve WHERE predicted_moisture <= 0.2 GROUP BY sensor_id""", CURVE_CTE))
def q_curve_crossing(spark, sf):
    from soilcast.operators.report import curve_crossing
    return curve_crossing(decay.decay_curve(decay.decay_fit(readings(spark, sf))))


LIN_CTES = [
    """rparts AS (
  SELECT sensor_id, count(*) AS k, arg_min(soil_moisture, (event_time, event_id)) AS older,
         arg_max(soil_moisture, (event_time, event_id)) AS newer,
         (epoch_us(max(event_time)) - epoch_us(min(event_time))) / 3.6e9 AS span_h
  FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY event_time DESC, event_id DESC) AS rn FROM readings)
  WHERE rn <= 48 GROUP BY sensor_id)""",
    """cur AS (
  SELECT sensor_id, max(event_time) AS current_time, arg_max(soil_moisture, (event_time, event_id)) AS current_moisture
  FROM readings GROUP BY sensor_id)""",
    """lin AS (
  SELECT c.*, r.k AS rate_readings,
         CASE WHEN r.k >= 2 THEN greatest(0.001, (r.older - r.newer) / greatest(r.span_h, 1.0)) ELSE 0.005 END AS decay_rate
  FROM cur c JOIN rparts r USING (sensor_id))""",
    """linf AS (
  SELECT *, least(greatest((current_moisture - 0.3) / decay_rate, 1.0), 336.0) AS hours_from_now FROM lin)""",
]


@query("linear_forecast", with_readings("""
SELECT sensor_id, current_time, current_moisture, round(decay_rate, 9) AS decay_rate,
       round(hours_from_now, 6) AS hours_from_now, CAST(0.3 AS DOUBLE) AS predicted_moisture,
       CASE WHEN hours_from_now < 12 THEN 'HIGH' WHEN hours_from_now < 48 THEN 'MEDIUM' ELSE 'LOW' END AS urgency,
       CAST(CASE WHEN hours_from_now < 12 THEN 0.7 WHEN hours_from_now < 48 THEN 0.6 ELSE 0.5 END AS DOUBLE) AS confidence,
       current_time + to_hours(CAST(floor(hours_from_now) AS INTEGER)) AS predicted_time,
       printf('Linear trend prediction based on %d recent readings', rate_readings) AS message
FROM linf""", *LIN_CTES))
def q_linear_forecast(spark, sf):
    df = linear.linear_forecast(readings(spark, sf))
    return df.withColumns({"decay_rate": r9("decay_rate"), "hours_from_now": r9("hours_from_now", P6)})


@query("linear_curve", with_readings("""
SELECT sensor_id, CAST(h AS INTEGER) AS hours_from_now, current_time + to_hours(CAST(h AS INTEGER)) AS "timestamp",
       round(greatest(0.0, current_moisture - h * decay_rate), 9) AS predicted_moisture,
       CASE WHEN greatest(0.0, current_moisture - h * decay_rate) <= 0.2 THEN 'CRITICAL'
            WHEN greatest(0.0, current_moisture - h * decay_rate) <= 0.3 THEN 'NEEDS_WATERING' ELSE 'HEALTHY' END AS status,
       CASE WHEN greatest(0.0, current_moisture - h * decay_rate) <= 0.2 THEN 'red'
            WHEN greatest(0.0, current_moisture - h * decay_rate) <= 0.3 THEN 'orange' ELSE 'green' END AS color,
       round(greatest(0.2, 0.6 * (1.0 - h / 1008.0)), 9) AS confidence, 'linear_fallback' AS model_type
FROM lin, range(337) r(h)""", *LIN_CTES))
def q_linear_curve(spark, sf):
    df = linear.linear_curve(readings(spark, sf))
    return df.withColumns({"predicted_moisture": r9("predicted_moisture"), "confidence": r9("confidence")})


@query("urgency_level", with_readings("""
SELECT sensor_id, round(hours_from_now, 6) AS hours_from_now,
       CASE WHEN hours_from_now < 12 THEN 'HIGH' WHEN hours_from_now < 48 THEN 'MEDIUM' ELSE 'LOW' END AS urgency,
       CASE WHEN hours_from_now < 12 THEN 'WARNING' ELSE 'OK' END AS status
FROM linf""", *LIN_CTES))
def q_urgency_level(spark, sf):
    df = linear.linear_forecast(readings(spark, sf))
    u = ST.urgency_level(F.col("hours_from_now"))
    return df.select("sensor_id", r9("hours_from_now", P6).alias("hours_from_now"), u.alias("urgency"),
                     ST.urgency_status(u).alias("status"))


@query("immediate_need", with_readings("""
SELECT sensor_id, current_time, current_moisture, method, urgency,
       CASE WHEN urgency IS NULL THEN NULL ELSE CAST(0.0 AS DOUBLE) END AS hours_from_now,
       CAST(CASE WHEN method = 'ml' AND urgency = 'CRITICAL' THEN 0.95 WHEN method = 'ml' AND urgency = 'HIGH' THEN 0.9
            WHEN urgency = 'CRITICAL' THEN 0.99 WHEN urgency = 'HIGH' THEN 0.95 END AS DOUBLE) AS confidence,
       CASE WHEN method = 'ml' AND urgency = 'CRITICAL' THEN 'Immediate watering required - critically dry!'
            WHEN method = 'ml' AND urgency = 'HIGH' THEN 'Watering recommended now'
            WHEN urgency = 'CRITICAL' THEN 'Plant needs immediate watering - critically dry!'
            WHEN urgency = 'HIGH' THEN 'Plant needs watering now' END AS message
FROM (SELECT sensor_id, max(event_time) AS current_time, arg_max(soil_moisture, (event_time, event_id)) AS current_moisture,
             CASE WHEN count(*) >= 50 THEN 'ml' ELSE 'exponential' END AS method,
             CASE WHEN arg_max(soil_moisture, (event_time, event_id)) <= 0.2 THEN 'CRITICAL'
                  WHEN arg_max(soil_moisture, (event_time, event_id)) <= 0.3 THEN 'HIGH' END AS urgency
      FROM readings GROUP BY sensor_id)"""))
def q_immediate_need(spark, sf):
    from soilcast.operators.marts import choose_method
    cur = linear.current_reading(readings(spark, sf))
    ml = F.col("method") == "ml"
    u = ST.immediate_urgency(F.col("current_moisture"))
    x = cur.withColumn("method", choose_method(F.col("n_readings"))).withColumn("urgency", u)
    return x.select("sensor_id", "current_time", "current_moisture", "method", "urgency",
                    F.when(F.col("urgency").isNotNull(), F.lit(0.0)).alias("hours_from_now"),
                    ST.immediate_confidence(F.col("urgency"), ml).alias("confidence"),
                    ST.immediate_message(F.col("urgency"), ml).alias("message"))
