"""Per-sensor prediction as one Spark plan: validation -> method -> {decay | forest | linear} forecast and
curve -> health -> recommendations -> result rows. Every step is keyed by sensor_id; sensors are never looped
over on the driver."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from soilcast import schema as S
from soilcast.functions import status as ST
from soilcast.functions.timefn import add_hours
from soilcast.operators import decay, forest, health, linear, model_store, staging
from soilcast.operators.marts import choose_method
from soilcast.operators.windows import drying_rate
from soilcast.session import cut_lineage
from soilcast.sources.readings import latest_readings


@dataclass
class Analysis:
    results: DataFrame      # one row per analysed sensor: forecast + health + drying rates + recommendations
    curves: DataFrame       # 337 rows per analysed sensor
    rejects: DataFrame      # sensors that failed validation, with the reason
    forecasts: DataFrame    # one row per analysed sensor: the forecast and status only (a leaner plan)


def _series(readings: DataFrame) -> DataFrame:
    cols = ["sensor_id", "event_time", "soil_moisture"] + (["event_id"] if "event_id" in readings.columns else [])
    return readings.select(*cols)


def analyze(readings: DataFrame, compat_limit: int | None = None, use_forest: bool | None = None,
            forest_params: dict | None = None, method: str | None = None, only: str | None = None,
            model_key: str | None = None) -> Analysis:
    """Analyse every sensor of ``readings``: its whole series by default, or (``compat_limit``) the newest
    rows over all sensors together as the service's single query does. ``method`` forces one method for
    every sensor (operator-level use); by default n >= 50 selects the forest. ``forest_params``: arguments of
    ``forest_train`` (trees, depth, bins). ``only``: score one sensor, with the model of all: only its rows are
    read, besides one scan for the model's key, or none where ``model_key`` names the model. The forest comes from the
    model store and is trained only if it is not there.

    The input is read once: the four series columns are written with a reliable checkpoint, and every aggregate,
    tail and window starts from that narrow copy. Invalid sensors drop out by a join with the one-row-per-sensor
    checks."""
    src = latest_readings(readings, compat_limit) if compat_limit else readings
    spark = src.sparkSession
    fleet = _series(src)
    every = cut_lineage(fleet if only is None else fleet.where(F.col("sensor_id") == F.lit(only)))
    checks = staging.validate_series(every)
    if only is None:
        checks = cut_lineage(checks)
    else:
        checks = spark.createDataFrame(checks.collect(), checks.schema)      # no or one row
    valid = checks.where(F.col("status") == "valid").select("sensor_id", F.col("n_readings").alias("samples_used"))
    rejects = checks.where(F.col("status") == "rejected")
    s = every.join(valid.select("sensor_id"), "sensor_id", "left_semi")

    meta = valid.withColumn("method", F.lit(method) if method else choose_method(F.col("samples_used")))
    cur = linear.current_reading(s).drop("n_readings")
    base = meta.join(cur, "sensor_id").withColumn("immediate", ST.immediate_urgency(F.col("current_moisture")))

    exp_ids = meta.where(F.col("method") == "exponential").select("sensor_id")
    ml_ids = meta.where(F.col("method") == "ml").select("sensor_id")

    one = [r.method for r in meta.select("method").collect()] if only is not None else []     # no or one row
    if use_forest is None:
        use_forest = "ml" in one if only is not None else bool(ml_ids.limit(1).count())    # one row a sensor, written
    parts, curve_parts = [], []
    if not (use_forest and one == ["ml"]):
        # exponential sensors: decay fit (always fitted with >= 10 points), crossing and curve
        fit = decay.decay_fit(s.join(exp_ids, "sensor_id", "left_semi"))
        cross = decay.decay_crossing(fit)
        parts.append(cross.select(
            "sensor_id", "hours_from_now", "predicted_moisture", "urgency", "confidence", "predicted_time", "message",
            F.lit("exponential").alias("method_effective"), F.col("confidence").alias("model_confidence"),
            F.col("critical_time").alias("curve_critical_time")))
        curve_parts.append(decay.decay_curve(fit))
    if use_forest:
        ml_series = s.join(ml_ids, "sensor_id", "left_semi")
        arrays = model_store.forest_of(every if only is None else fleet, forest_params, model_key)
        fcurve = forest.forest_curve(forest.forest_seeds(ml_series), arrays)
        ffc = forest.forest_forecast(fcurve)
        parts.append(ffc.select(
            "sensor_id", "hours_from_now", "predicted_moisture", "urgency", "confidence",
            "predicted_time", "message", F.lit("ml").alias("method_effective"),
            F.lit(forest.ML_CONFIDENCE).alias("model_confidence"), F.col("critical_time").alias("curve_critical_time")))
        curve_parts.append(fcurve)
    curves = reduce(DataFrame.unionByName, curve_parts)

    # a sensor has one method, so one part at most; joined, not united first (see ``series_frame`` on unions)
    j = base
    for k, part in enumerate(parts):
        j = j.join(part.select("sensor_id", F.struct(*part.columns[1:]).alias(f"_part{k}")), "sensor_id", "left")
    j = j.select(*base.columns, *[F.coalesce(*[F.col(f"_part{k}.{c}") for k in range(len(parts))]).alias(c)
                                  for c in parts[0].columns[1:]])
    imm = F.col("immediate")
    ml = F.col("method") == "ml"
    urgency = F.coalesce(imm, F.col("urgency"))
    pred_time = F.when(imm.isNotNull(), F.col("current_time")).otherwise(F.col("predicted_time"))
    res = j.select(
        "sensor_id", "samples_used", "method", "method_effective", "current_time", "current_moisture",
        urgency.alias("urgency"),
        F.when(imm.isNotNull(), F.lit(0.0)).otherwise(F.col("hours_from_now")).alias("hours_from_now"),
        F.when(imm.isNotNull(), F.col("current_moisture")).otherwise(F.col("predicted_moisture")).alias("predicted_moisture"),
        F.when(imm.isNotNull(), ST.immediate_confidence(imm, ml)).otherwise(F.col("confidence")).alias("confidence_score"),
        F.when(imm.isNotNull(), ST.immediate_message(imm, ml)).otherwise(F.col("message")).alias("message"),
        pred_time.alias("predicted_watering_date"),
        F.coalesce(F.col("model_confidence"), F.lit(0.0)).alias("model_accuracy"),
        "curve_critical_time",
    )
    res = res.withColumn("status", ST.urgency_status(F.col("urgency"))).withColumn(
        "critical_watering_date",
        F.when(F.col("urgency") == "CRITICAL", F.col("predicted_watering_date"))
         .when(F.col("urgency") == "HIGH", add_hours(F.col("predicted_watering_date"), 12)))
    forecasts = res
    hm = health.health_metrics(s)
    res = res.join(hm.drop("current_moisture"), "sensor_id").join(drying_rate(s), "sensor_id")
    res = res.withColumn("recommendations", health.recommendations(F.col("health_score"), F.col("urgency"),
                                                                   F.col("moisture_stability")))
    return Analysis(results=res, curves=curves, rejects=rejects, forecasts=forecasts)


RESULT_COLUMNS = ["sensor_id", "current_moisture", "status", "predicted_watering_date", "critical_watering_date",
                  "drying_rate_compat", "drying_rate_recent", "model_accuracy", "samples_used", "confidence_score",
                  "urgency", "hours_from_now", "predicted_moisture", "method", "method_effective", "message",
                  "health_score", "health_score_raw", "average_moisture_7d", "days_since_last_watering",
                  "moisture_stability", "time_in_optimal_range", "recommendations"]


def predict_batch(readings: DataFrame, **kw) -> DataFrame:
    """One result row per valid sensor (drying_rate_per_hour is the service's compat value)."""
    a = analyze(readings, **kw)
    return a.results.select(*RESULT_COLUMNS).withColumn("drying_rate_per_hour", F.col("drying_rate_compat"))


CURVE_POINT = ["hours_from_now", "timestamp", "predicted_moisture", "status", "confidence", "model_type"]


def predict_one(readings: DataFrame, sensor_id: str, **kw) -> DataFrame:
    """The batch row of one sensor (its model is that of all sensors, so the two agree), with its curve points in
    order of hours and its watering-frequency analysis."""
    a = analyze(readings, only=sensor_id, **kw)
    curve = a.curves.where(F.col("sensor_id") == F.lit(sensor_id)).groupBy("sensor_id").agg(
        F.sort_array(F.collect_list(F.struct(*CURVE_POINT))).alias("predicted_decay_curve"))   # 337 points
    one = a.results.select(*RESULT_COLUMNS, "watering_frequency_analysis").withColumn(
        "drying_rate_per_hour", F.col("drying_rate_compat"))
    return one.join(curve, "sensor_id", "left")


def sensor_status(readings: DataFrame, **kw) -> DataFrame:
    """Current moisture, status from the forecast urgency, newest reading time (no health metrics needed)."""
    a = analyze(readings, **kw)
    return a.forecasts.select("sensor_id", "current_moisture", "status", F.col("current_time").alias("last_reading"))


# ---- submitted series ---------------------------------------------------------------------------------------

def predict_submission(submissions: DataFrame, key: str = "submission_id", **kw) -> DataFrame:
    """Prediction for submitted series, as arrays or rows (many at once): status from the current moisture, critical date = first
    CRITICAL curve point, drying_rate_per_hour = hours/24 (compat), four health keys, empty curve."""
    from soilcast.sources.submissions import series_rows, submission_rows, validate_submission

    rows = cut_lineage(submission_rows(submissions, key))
    checked = cut_lineage(validate_submission(rows, key).where(F.col("status") == "valid").select(key, "sensor_id"))
    series = series_rows(rows, key).join(checked.select(key), key, "left_semi").select(
        F.col(key).alias("sensor_id"), "event_time", "soil_moisture", "event_id")
    a = analyze(series, **kw)
    r = a.results.withColumn("critical_time", F.col("curve_critical_time"))
    ids = checked.select(F.col(key).alias("_k"), F.col("sensor_id").alias("request_sensor_id"))
    r = r.join(ids, r["sensor_id"] == ids["_k"])
    return r.select(
        F.col("_k").alias(key), F.col("request_sensor_id").alias("sensor_id"), "current_moisture",
        ST.threshold_status(F.col("current_moisture"), style="service").alias("status"),
        "predicted_watering_date", F.col("critical_time").alias("critical_watering_date"),
        (F.col("hours_from_now") / 24.0).alias("drying_rate_per_hour"),
        F.col("model_accuracy"), "samples_used", F.col("model_accuracy").alias("confidence_score"),
        "health_score", "average_moisture_7d", "days_since_last_watering", "moisture_stability",
        "recommendations", F.array().cast("array<struct<timestamp:timestamp_ntz,moisture:double>>").alias("predicted_decay_curve"),
    )
