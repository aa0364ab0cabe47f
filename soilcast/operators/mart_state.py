"""The hourly mart as a mergeable state: partial aggregates per (sensor, hour) and batch, finalised when read.

A batch adds its own partials and nothing else, so batches may come late, in any order and more than once. The state is a
Parquet table partitioned by (hour_date, batch_id); writing a batch replaces that batch's partitions only, through
Spark's dynamic partition overwrite, which commits a job's files together. Readings without a time count under
``NO_DAY``. The anomaly threshold is part of the state: keep one state per threshold."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from soilcast import schema as S
from soilcast.functions.timefn import hour_bucket
from soilcast.operators.marts import anomaly_flag

MEASURES = {"temperature_c": "temp_c", "humidity_pct": "humidity", "soil_moisture": "moisture"}   # and the mart's names
NO_DAY = "0001-01-01"
STATE_SCHEMA = "sensor_id string, hour_bucket timestamp_ntz, readings long, anomalies long, " + ", ".join(
    f"{m}_sum double, {m}_n long, {m}_min double, {m}_max double" for m in MEASURES) + ", hour_date date, batch_id string"
MART_COLUMNS = ["sensor_id", "hour_bucket", *[f"{f}_{n}" for n in MEASURES.values() for f in ("avg", "min", "max")],
                "reading_count", "anomaly_count"]


def _day(hour):
    return F.coalesce(F.to_date(hour), F.lit(NO_DAY).cast("date"))


def partials(readings: DataFrame, anomaly_threshold: float = S.ANOMALY_THRESHOLD) -> DataFrame:
    """Mergeable aggregates per (sensor, hour): one hash aggregate, combined map-side, so a hot sensor sends one row per
    task and hour."""
    agg = [F.count(F.lit(1)).alias("readings"),
           F.count_if(anomaly_flag(F.col("soil_moisture"), anomaly_threshold)).alias("anomalies")]
    for m in MEASURES:
        agg += [F.sum(m).alias(f"{m}_sum"), F.count(m).alias(f"{m}_n"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    hour = hour_bucket(F.col("event_time")).alias("hour_bucket")
    return readings.groupBy("sensor_id", hour).agg(*agg).withColumn("hour_date", _day(F.col("hour_bucket")))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """All partials; no rows when nothing was applied yet. The schema is given, so ids such as 007 stay text."""
    try:
        return spark.read.schema(STATE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE_SCHEMA)


def apply_batch(readings: DataFrame, path: str, batch_id: str,
                anomaly_threshold: float = S.ANOMALY_THRESHOLD) -> None:
    """Put a batch of readings into the state under its id. Applied again, with the same rows or corrected ones, it
    takes the place of what it was; other batches keep their files. A day that an earlier delivery of the batch touched gets a
    marker row without readings, so that a day missing from the correction is emptied too."""
    spark = readings.sparkSession
    new = partials(readings, anomaly_threshold).withColumn("batch_id", F.lit(batch_id))
    earlier = read_state(spark, path).where(F.col("batch_id") == batch_id).select("hour_date", "batch_id").distinct()
    marks = earlier.select("*", F.lit(0).cast("long").alias("readings"))
    new.unionByName(marks, allowMissingColumns=True) \
        .repartitionByRange("hour_date", "sensor_id", "hour_bucket").sortWithinPartitions("sensor_id", "hour_bucket") \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour_date", "batch_id").parquet(path)


def finalise(state: DataFrame) -> DataFrame:
    """Partials of any number of batches -> mart rows with ``hour_date``. A mean of no values is null."""
    agg = []
    for m, name in MEASURES.items():
        agg += [F.try_divide(F.sum(f"{m}_sum"), F.sum(f"{m}_n")).alias(f"avg_{name}"),
                F.min(f"{m}_min").alias(f"min_{name}"), F.max(f"{m}_max").alias(f"max_{name}")]
    return state.groupBy("hour_date", "sensor_id", "hour_bucket").agg(
        *agg, F.sum("readings").alias("reading_count"),
        F.coalesce(F.sum("anomalies"), F.lit(0).cast("long")).alias("anomaly_count"))


def mart_view(spark: SparkSession, path: str, first_day=None, last_day=None) -> DataFrame:
    """The mart of all batches so far, with the columns of ``marts.hourly_rollup``; days bound the directories read."""
    state = read_state(spark, path)
    if first_day is not None:
        state = state.where(F.col("hour_date") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        state = state.where(F.col("hour_date") <= F.lit(last_day).cast("date"))
    return finalise(state).where(F.col("reading_count") > 0).select(*MART_COLUMNS)


def refresh_mart(spark: SparkSession, path: str, mart_path: str, batch_id: str) -> None:
    """Bring a written mart up to date after ``apply_batch``: the days the batch touches (now or in an earlier delivery) are
    finalised from the state and replaced, other days keep their files. Read it with ``read_mart``."""
    state = read_state(spark, path)
    days = state.where(F.col("batch_id") == batch_id).select("hour_date").distinct()
    finalise(state.join(days, "hour_date", "left_semi")) \
        .repartitionByRange("hour_date", "sensor_id", "hour_bucket").sortWithinPartitions("sensor_id", "hour_bucket") \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour_date").parquet(mart_path)


def read_mart(spark: SparkSession, mart_path: str) -> DataFrame:
    """The written mart without the marker rows of emptied days."""
    return spark.read.parquet(mart_path).where(F.col("reading_count") > 0).select(*MART_COLUMNS)
