"""Projections, filters and validation over readings."""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, functions as F

from soilcast import schema as S


def as_of_column(readings: DataFrame, as_of=None) -> Column:
    """The analysis instant: a given timestamp, else the table's newest event_time (scalar subquery,
    evaluated once per query, never a per-row join)."""
    if as_of is None:
        return readings.select(F.max("event_time")).scalar()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.isoformat(sep=" ")
    # a string literal cast to TIMESTAMP_NTZ keeps the wall time whatever the session time zone
    return F.lit(str(as_of)).cast("timestamp_ntz")


def staging_readings(readings: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Casts the measures to double, extracts ``$.timestamp`` from the payload and keeps the last ``days``
    days before ``as_of``. When the table carries ``event_date`` (as written by ``readings_table``), the
    matching date predicate prunes whole partitions."""
    start = F.timestamp_add("DAY", F.lit(-days), as_of_column(readings, as_of))
    out = readings.where(F.col("event_time") >= start)
    if "event_date" in readings.columns:
        out = out.where(F.col("event_date") >= F.to_date(start))
    payload = F.col("payload") if "payload" in readings.columns else F.lit(None).cast("string")
    return out.select(
        "event_time", "sensor_id",
        F.col("temperature_c").cast("double").alias("temperature_c"),
        F.col("humidity_pct").cast("double").alias("humidity_pct"),
        F.col("soil_moisture").cast("double").alias("soil_moisture"),
        F.get_json_object(payload, "$.timestamp").alias("original_timestamp"),
    )


def payload_scalar(readings: DataFrame, path: str = "$.k", name: str = "payload_value") -> DataFrame:
    """JSON scalar extraction from the payload text."""
    return readings.select("event_id", "sensor_id", F.get_json_object("payload", path).alias(name))


def adapter_format(readings: DataFrame, sensor_id: str | None = None) -> DataFrame:
    """(created_at, moisture, moisture_range = 1.0) of one sensor (or every sensor, keyed), sorted by time."""
    src = readings if sensor_id is None else readings.where(F.col("sensor_id") == F.lit(sensor_id))
    keys = [] if sensor_id is not None else ["sensor_id"]
    order = keys + ["created_at"] + (["event_id"] if "event_id" in readings.columns else [])
    cols = keys + [F.col("event_time").alias("created_at"), F.col("soil_moisture").alias("moisture"),
                   F.lit(1.0).alias("moisture_range")] + (["event_id"] if "event_id" in readings.columns else [])
    return src.select(*cols).orderBy(*order)


def readings_records(readings: DataFrame, as_json: bool = False) -> DataFrame:
    """Rows renamed for display; optionally one JSON record per row for a JSON sink."""
    out = readings.withColumnsRenamed({"event_time": "timestamp", "temperature_c": "temperature",
                                       "humidity_pct": "humidity"})
    if as_json:
        return out.select(F.to_json(F.struct(*out.columns)).alias("record"))
    return out


def delete_by_prefix(readings: DataFrame, prefix: str = "SENSOR-") -> DataFrame:
    """Survivors of ``DELETE ... WHERE sensor_id LIKE '<prefix>%'`` (rewrite them with ``writers.rewrite``)."""
    return readings.where(~F.col("sensor_id").startswith(prefix))


def rebase_time(readings: DataFrame, as_of, column: str = "event_time") -> DataFrame:
    """Shift every time so the newest becomes ``as_of``, keeping gaps. One offset for the whole frame:
    the max is a scalar subquery, so no row leaves its partition."""
    newest = readings.select(F.max(column)).scalar()
    offset = F.timestamp_diff("MICROSECOND", newest, as_of_column(readings, as_of))
    return readings.withColumn(column, F.timestamp_add("MICROSECOND", offset, F.col(column)))


# Fixed texts of the series checks, in the order they are applied (first failure wins).
SERIES_REASONS = [
    "DataFrame must contain columns: ['timestamp', 'moisture']",
    "Insufficient data points. Need at least 10 readings for analysis.",
    "Data contains NaN values. Please clean the data first.",
    "'timestamp' column must be datetime type",
    "'moisture' values must be between 0 and 1",
]


def validate_series(series: DataFrame, time_col: str = "event_time", value_col: str = "soil_moisture",
                    min_rows: int = S.MIN_READINGS) -> DataFrame:
    """Per-sensor validation in one aggregate: status 'valid' / 'rejected' with the first failing reason.

    Column presence and type are schema facts, checked once on ``series.schema``."""
    fields = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    has_cols = time_col in fields and value_col in fields
    if not has_cols:
        return series.select("sensor_id").groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n_readings")).select(
            "sensor_id", "n_readings", F.lit("rejected").alias("status"), F.lit(SERIES_REASONS[0]).alias("reason"))
    time_ok = fields[time_col] in ("timestamp", "timestamp_ntz")
    m, t = F.col(value_col), F.col(time_col)
    g = series.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.count_if(t.isNull() | m.isNull() | F.isnan(m)).alias("n_null"),
        F.count_if(~m.between(0.0, 1.0)).alias("n_out"),
    )
    reason = (F.when(F.col("n_readings") < min_rows, F.lit(SERIES_REASONS[1]))
              .when(F.col("n_null") > 0, F.lit(SERIES_REASONS[2]))
              .when(F.lit(not time_ok), F.lit(SERIES_REASONS[3]))
              .when(F.col("n_out") > 0, F.lit(SERIES_REASONS[4])))
    return g.select("sensor_id", "n_readings",
                    F.when(reason.isNull(), "valid").otherwise("rejected").alias("status"),
                    reason.alias("reason"))


def recent_slice(readings: DataFrame, days: float, as_of=None) -> DataFrame:
    """Readings within ``days`` before ``as_of`` (default: the table's newest time)."""
    start = F.timestamp_add("MINUTE", F.lit(int(-days * 1440)), as_of_column(readings, as_of))
    return readings.where(F.col("event_time") >= start)

