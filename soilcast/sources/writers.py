"""Table writers: the raw readings table (day partitions, clustered by sensor), appends, the hourly mart,
and prefix deletes by rewrite. All paths are shared-storage paths; nothing is staged on a local disk."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from soilcast.operators.marts import hourly_rollup


def with_event_date(readings: DataFrame) -> DataFrame:
    return readings.withColumn("event_date", F.to_date("event_time"))


def write_readings_table(readings: DataFrame, path: str, mode: str = "overwrite",
                         max_records_per_file: int | None = None) -> None:
    """Partition by day of event_time, cluster (sort) by sensor and time inside each file, so date predicates
    prune directories and sensor predicates skip row groups by parquet min/max. Range partitioning on
    (day, sensor, time) splits a hot day or a hot sensor over many tasks, where hashing by day would give
    a whole day to one task."""
    df = with_event_date(readings)
    w = df.repartitionByRange("event_date", "sensor_id", "event_time").sortWithinPartitions("sensor_id", "event_time") \
        .write.mode(mode).partitionBy("event_date")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.parquet(path)


ROWS_PER_FILE = 5_000_000   # a few hundred MB of readings


def append_batch(readings: DataFrame, path: str, batch_size: int = ROWS_PER_FILE, batch_id: str | None = None) -> int:
    """Append readings to the table; ``batch_size`` caps rows per output file. Rows are range-partitioned by day,
    sensor and time first, so a day's rows sit in few files. Returns the number of rows written, counted by the
    write itself (an observed metric).

    With ``batch_id`` the table is laid out by (event_date, batch_id), and a repeated batch replaces its own directories,
    so a retry adds nothing. An id names one content, and a table takes ids from its first batch on or never."""
    from pyspark.sql import Observation

    obs = Observation("append")
    df = with_event_date(readings).repartitionByRange("event_date", "sensor_id", "event_time") \
        .observe(obs, F.count(F.lit(1)).alias("rows")).sortWithinPartitions("sensor_id", "event_time")
    if batch_id is None:
        w = df.write.mode("append").partitionBy("event_date")
    else:
        w = df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch_id")
    w.option("maxRecordsPerFile", batch_size).parquet(path)
    return int(obs.get["rows"])


def write_mart_table(staged: DataFrame, path: str, whole_days_only: bool = False) -> int:
    """Rebuild the hourly mart, partitioned by the day of the bucket. By default the table is replaced as a whole, so
    it always equals a one-shot build of ``staged``. ``whole_days_only`` keeps other days and replaces only days after
    the first one present, which a moving cut-off may have left incomplete."""
    from pyspark.sql import Observation

    obs = Observation("mart")
    mart = hourly_rollup(staged).withColumn("hour_date", F.to_date("hour_bucket"))
    if whole_days_only:
        first = staged.agg(F.to_date(F.min("event_time")).alias("_first"))            # one row
        mart = mart.join(F.broadcast(first), F.col("hour_date") > F.col("_first")).drop("_first")
    # observed above the range exchange: the partitioner's sampling job must not count rows
    mart.repartitionByRange("hour_date", "sensor_id", "hour_bucket").observe(obs, F.count(F.lit(1)).alias("rows")) \
        .sortWithinPartitions("sensor_id", "hour_bucket").write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic" if whole_days_only else "static") \
        .partitionBy("hour_date").parquet(path)
    return int(obs.get["rows"])


def rewrite_without_prefix(spark: SparkSession, path: str, new_path: str, prefix: str) -> int:
    """DELETE ... WHERE sensor_id LIKE '<prefix>%' for a parquet table: write the survivors to ``new_path``
    (a new table version) and return how many rows were removed."""
    from pyspark.sql import Observation

    src = spark.read.parquet(path)
    obs = Observation("delete")
    hit = F.col("sensor_id").startswith(prefix)
    kept = src.observe(obs, F.count_if(hit).alias("deleted")).where(~hit)
    kept.write.mode("overwrite").partitionBy("event_date").parquet(new_path)
    return int(obs.get["deleted"])
