"""Submitted series. A request comes as two parallel arrays (readings, ISO timestamps) with an optional sensor id; it is
exploded at once, and everything after that works on rows (submission, position), one per array place, so that a request
may be of any length. A place that only one of the two arrays has is a row too (``has_reading`` / ``has_time``), and a
request with two empty arrays is one row with neither. Submission ids are unique; a sensor id is constant within one."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from soilcast import schema as S
from soilcast.functions.timefn import parse_iso, week_start

# Fixed texts of the submission checks, in the order they are applied.
SUBMISSION_REASONS = [
    "Number of moisture readings must match number of timestamps",
    "At least 10 data points required for accurate prediction",
    "Moisture readings must be between 0.0 and 1.0",
    "Invalid timestamp format. Use ISO format (e.g., '2025-09-30T10:00:00')",
]

ROW_COLUMNS = ["sensor_id", "position", "has_reading", "soil_moisture", "has_time", "ts_text"]


def submission_rows(subs: DataFrame, key: str = "submission_id") -> DataFrame:
    """Arrays -> rows (key, sensor_id, position, has_reading, soil_moisture, has_time, ts_text). A null array counts as an
    empty one. Rows pass through unchanged."""
    if set(ROW_COLUMNS) <= set(subs.columns):
        return subs.select(key, *ROW_COLUMNS)
    m = F.coalesce(F.col("moisture_readings"), F.array().cast("array<double>"))
    ts = F.coalesce(F.col("timestamps"), F.array().cast("array<string>"))
    z = subs.select(key, "sensor_id", F.size(m).alias("_m"), F.size(ts).alias("_t"),
                    F.posexplode_outer(F.arrays_zip(m.alias("m"), ts.alias("t"))).alias("position", "_p"))
    return z.select(
        key, "sensor_id", F.col("position").cast("long").alias("position"),
        F.coalesce(F.col("position") < F.col("_m"), F.lit(False)).alias("has_reading"), F.col("_p.m").alias("soil_moisture"),
        F.coalesce(F.col("position") < F.col("_t"), F.lit(False)).alias("has_time"), F.col("_p.t").alias("ts_text"))


def submissions_from_readings(readings: DataFrame) -> DataFrame:
    """Test submissions built from readings, as rows: one per sensor and ISO week, positions in order of time. Positions
    are numbered in chunks of a series, so a long week is spread over tasks."""
    from soilcast.operators.windows import series_frame

    ext = F.col("sensor_id").startswith("EXT-")
    iso = F.date_format(F.col("event_time"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    r = readings.select(
        F.concat(F.col("sensor_id"), F.lit("/"), F.date_format(week_start(F.col("event_time")), "yyyy-MM-dd")).alias("_id"),
        F.when(~ext, F.col("sensor_id")).alias("_owner"), "event_time", "event_id", "soil_moisture",
        F.when(ext, F.concat(iso, F.lit("Z"))).otherwise(iso).alias("ts_text"))
    c = series_frame(r.withColumnRenamed("_id", "sensor_id"), 0)
    return c.select(F.col("sensor_id").alias("submission_id"), F.col("_owner").alias("sensor_id"),
                    (F.col("rn") - 1).cast("long").alias("position"), F.lit(True).alias("has_reading"), "soil_moisture",
                    F.lit(True).alias("has_time"), "ts_text")


def _reason() -> Column:
    """First failing check: lengths equal; >= 10 points; every reading in [0, 1]; every timestamp parseable."""
    return (F.when(F.col("_n") != F.col("_nt"), F.lit(SUBMISSION_REASONS[0]))
            .when(F.col("_n") < S.MIN_READINGS, F.lit(SUBMISSION_REASONS[1]))
            .when(F.col("_range") > 0, F.lit(SUBMISSION_REASONS[2]))
            .when(F.col("_format") > 0, F.lit(SUBMISSION_REASONS[3])))


def validate_submission(subs: DataFrame, key: str = "submission_id") -> DataFrame:
    """Per submission (arrays or rows): reading count, status and the first failing check. Four counts a submission,
    combined map-side, decide all checks: no task ever holds a request."""
    m = F.col("soil_moisture")
    g = submission_rows(subs, key).groupBy(key).agg(
        F.any_value("sensor_id", True).alias("sensor_id"),
        F.count_if("has_reading").alias("_n"), F.count_if("has_time").alias("_nt"),
        F.count_if(F.col("has_reading") & F.coalesce(~m.between(0.0, 1.0), F.lit(True))).alias("_range"),
        F.count_if(F.col("has_time") & parse_iso(F.col("ts_text")).isNull()).alias("_format"))
    r = g.withColumn("reason", _reason())
    return r.select(key, F.coalesce(F.col("sensor_id"), F.lit(S.DEFAULT_SUBMISSION_ID)).alias("sensor_id"),
                    F.col("_n").cast("int").alias("n_readings"),
                    F.when(F.col("reason").isNull(), "valid").otherwise("rejected").alias("status"), "reason")


def series_rows(subs: DataFrame, key: str = "submission_id") -> DataFrame:
    """(key, sensor_id, event_time, soil_moisture, event_id = position), in no order."""
    z = submission_rows(subs, key).where(F.col("position").isNotNull())
    return z.select(key, F.coalesce(F.col("sensor_id"), F.lit(S.DEFAULT_SUBMISSION_ID)).alias("sensor_id"),
                    parse_iso(F.col("ts_text")).alias("event_time"), "soil_moisture", F.col("position").alias("event_id"))


def submitted_series(subs: DataFrame, key: str = "submission_id") -> DataFrame:
    """``series_rows`` sorted by submission and time."""
    return series_rows(subs, key).orderBy(key, "event_time", "event_id")
