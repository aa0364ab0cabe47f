"""Reading sources: the raw readings table, the driver's events table mapped to readings, top-n scans."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from soilcast import schema as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def readings_from_events(events: DataFrame, keep_type: bool = False) -> DataFrame:
    """Map the driver's ``events`` table to readings (same rule in the oracle SQL).

    sensor_id: 'EXT-' when user_id % 10 = 9 else 'SENSOR-', then user_id padded to 5 digits;
    soil_moisture = value / (value + 50); temperature = 10 + 0.25 k; humidity = 40 + 0.5 k; k = props.k.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    prefix = F.when(F.col("user_id") % 10 == 9, F.lit("EXT-")).otherwise(F.lit("SENSOR-"))
    return events.select(
        F.col("event_id"),
        F.concat(prefix, F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("sensor_id"),
        F.col("ts").alias("event_time"),
        (F.lit(10.0) + F.lit(0.25) * k).alias("temperature_c"),
        (F.lit(40.0) + F.lit(0.5) * k).alias("humidity_pct"),
        (F.col("value") / (F.col("value") + F.lit(50.0))).alias("soil_moisture"),
        F.col("props").alias("payload"),
        *([F.col("event_type")] if keep_type else []),
    )


def load_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a test-data folder (the driver's events table, mapped)."""
    return readings_from_events(table(spark, sf_dir, "events"))


def scan_readings(readings: DataFrame) -> DataFrame:
    """The five reading columns; column pruning reaches the parquet scan."""
    return readings.select(*S.READING_COLUMNS)


def read_readings_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Raw readings from a written table (parquet by default, any Spark source by ``fmt``, e.g. jdbc)."""
    return scan_readings(spark.read.format(fmt).options(**options).load(path))


def latest_readings(readings: DataFrame, n: int = 5000) -> DataFrame:
    """Newest ``n`` readings over all sensors (ORDER BY event_time DESC LIMIT n) → TakeOrderedAndProject:
    every task keeps its own top n, so only n rows per task reach the final merge."""
    cols = S.READING_COLUMNS + (["event_id"] if "event_id" in readings.columns else [])
    order = [F.col("event_time").desc()] + ([F.col("event_id").desc()] if "event_id" in readings.columns else [])
    return readings.select(*cols).orderBy(*order).limit(n)


def sensor_readings(readings: DataFrame, sensor_id: str) -> DataFrame:
    """Rows of one sensor; the equality predicate is pushed to the parquet scan."""
    return readings.where(F.col("sensor_id") == F.lit(sensor_id))
