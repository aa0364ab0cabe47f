"""Structured Streaming: message ingest with rejects, watermarked hourly roll-up, optional de-duplication."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from soilcast import schema as S
from soilcast.functions.timefn import hour_bucket, utc_micros
from soilcast.sources.messages import parse_messages

MESSAGE_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("body", T.StringType())])


def message_stream(spark: SparkSession, path: str | None = None, fmt: str = "parquet", schema: T.StructType = MESSAGE_SCHEMA,
                   **options) -> DataFrame:
    """Messages as a stream: a file source by default (Kafka etc. via ``fmt`` and options)."""
    r = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        return from_kafka(r.load())            # brokers and topic come as options; there is no path
    return r.schema(schema).load(path)


def from_kafka(records: DataFrame) -> DataFrame:
    """Kafka's columns as messages: the value is the body's text, the offset names the event (within its topic and
    partition, which are kept)."""
    return records.select(F.col("offset").alias("event_id"), F.col("value").cast("string").alias("body"),
                          "topic", "partition")


class IngestQueries:
    """The two streaming queries of an ingest (readings table and reject sink)."""

    def __init__(self, table, rejects):
        self.table, self.rejects = table, rejects

    def awaitTermination(self, timeout: float | None = None) -> None:
        for q in (self.table, self.rejects):
            q.awaitTermination(timeout)

    def stop(self) -> None:
        for q in (self.table, self.rejects):
            q.stop()


def stream_ingest(messages: DataFrame, table_path: str, reject_path: str, checkpoint: str,
                  dedup: bool = False, watermark: str = "2 hours", trigger: dict | None = None) -> IngestQueries:
    """Valid messages are appended to the readings table (day partitions); rejects, with their reason, to the
    reject sink. Each sink is Spark's file sink with its own checkpoint: files are committed through the
    sink's metadata log, so a retried micro-batch (lost executor, restart) never duplicates rows."""
    parsed = parse_messages(messages)
    trig = trigger or {"availableNow": True}
    ok = parsed.where(F.col("reject_reason").isNull()).drop("reject_reason") \
        .withColumn("event_date", F.to_date("event_time"))
    if dedup:                                  # valid rows only: rejects have no sensor or time to compare by
        ok = stream_dedup(ok, watermark)
    bad = parsed.where(F.col("reject_reason").isNotNull())
    q1 = ok.writeStream.format("parquet").partitionBy("event_date").outputMode("append") \
        .option("checkpointLocation", f"{checkpoint.rstrip('/')}/table").trigger(**trig).start(table_path)
    q2 = bad.writeStream.format("parquet").outputMode("append") \
        .option("checkpointLocation", f"{checkpoint.rstrip('/')}/rejects").trigger(**trig).start(reject_path)
    return IngestQueries(q1, q2)


def _event_ts(df: DataFrame) -> DataFrame:
    """Watermarks need TIMESTAMP: the instant whose UTC wall time is the NTZ event time, whatever the session zone."""
    return df.withColumn("_event_ts", F.timestamp_micros(utc_micros(F.col("event_time"))))


def stream_dedup(parsed: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Drop redelivered messages (same sensor and time) within the watermark (off by default)."""
    return _event_ts(parsed).withWatermark("_event_ts", watermark) \
        .dropDuplicatesWithinWatermark(["sensor_id", "event_time"]).drop("_event_ts")


def stream_hourly_rollup(readings: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """The hourly mart kept current: 1-hour tumbling windows per sensor; state is dropped once the watermark
    passes a window, so it stays bounded."""
    w = F.window("_event_ts", "1 hour")
    bucket = hour_bucket(F.col("event_time")).alias("hour_bucket")      # a function of the window, in wall time
    g = _event_ts(readings).withWatermark("_event_ts", watermark).groupBy("sensor_id", w, bucket).agg(
        F.avg("temperature_c").alias("avg_temp_c"), F.min("temperature_c").alias("min_temp_c"),
        F.max("temperature_c").alias("max_temp_c"),
        F.avg("humidity_pct").alias("avg_humidity"), F.min("humidity_pct").alias("min_humidity"),
        F.max("humidity_pct").alias("max_humidity"),
        F.avg("soil_moisture").alias("avg_moisture"), F.min("soil_moisture").alias("min_moisture"),
        F.max("soil_moisture").alias("max_moisture"),
        F.count(F.lit(1)).alias("reading_count"),
        F.count_if(F.coalesce(F.col("soil_moisture") < S.ANOMALY_THRESHOLD, F.lit(False))).alias("anomaly_count"))
    return g.drop("window")
