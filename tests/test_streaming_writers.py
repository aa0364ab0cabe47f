"""Streaming ingest and roll-up, table writers, pipeline run."""
import datetime as dt
import os

from pyspark.sql import functions as F

from conftest import SF001
from soilcast.operators.marts import hourly_rollup
from soilcast.plans.pipeline import pipeline_run
from soilcast.sources import messages as M
from soilcast.sources import writers as WR
from soilcast.sources.readings import load_readings, readings_from_events, table
from soilcast.streaming import stream as ST


def _messages(spark):
    return M.messages_from_readings(readings_from_events(table(spark, SF001, "events"), keep_type=True))


def test_stream_ingest_matches_batch(spark, scratch):
    inp = os.path.join(scratch, "in")
    msgs = _messages(spark)
    bad = spark.createDataFrame([(10 ** 9, "???")], "event_id long, body string")
    msgs.unionByName(bad).repartition(4).write.parquet(inp)
    q = ST.stream_ingest(ST.message_stream(spark, inp), os.path.join(scratch, "table"), os.path.join(scratch, "rej"),
                         os.path.join(scratch, "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(scratch, "table"))
    exp = M.ingest_messages(msgs)
    cols = ["event_id", "sensor_id", "event_time", "temperature_c", "humidity_pct", "soil_moisture"]
    assert got.count() == exp.count() == 1000
    assert got.select(cols).exceptAll(exp.select(cols)).count() == 0
    rej = spark.read.parquet(os.path.join(scratch, "rej")).collect()
    assert len(rej) == 1 and rej[0].reject_reason == M.REJECT_REASONS["decode"]
    # a restart with the same checkpoint adds nothing (exactly-once file sink bookkeeping)
    q2 = ST.stream_ingest(ST.message_stream(spark, inp), os.path.join(scratch, "table"), os.path.join(scratch, "rej"),
                          os.path.join(scratch, "ckpt"))
    q2.awaitTermination(300)
    assert spark.read.parquet(os.path.join(scratch, "table")).count() == 1000


def test_stream_hourly_rollup_equals_batch(spark, scratch):
    r = load_readings(spark, SF001)
    src = os.path.join(scratch, "readings")
    r.write.parquet(src)
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = os.path.join(scratch, "mart")
    q = (ST.stream_hourly_rollup(stream).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start(out))
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    batch = hourly_rollup(r)
    n = got.count()
    # append mode emits every window the watermark has passed; each emitted row equals the batch row
    assert n > 0
    assert got.select(batch.columns).exceptAll(batch).count() == 0
    newest = r.agg(F.max("event_time")).collect()[0][0]
    missing = batch.join(got.select("sensor_id", "hour_bucket"), ["sensor_id", "hour_bucket"], "left_anti")
    assert missing.where(F.col("hour_bucket") < F.lit(newest) - F.expr("INTERVAL 3 HOURS")).count() == 0


def test_stream_dedup(spark, scratch):
    r = load_readings(spark, SF001).limit(50)
    src = os.path.join(scratch, "dups")
    msgs = M.messages_from_readings(r.withColumn("event_type", F.lit("view")))
    msgs.unionByName(msgs).write.parquet(src)
    parsed = M.parse_messages(ST.message_stream(spark, src))
    d = ST.stream_dedup(parsed)
    out = os.path.join(scratch, "dedup_out")
    q = d.writeStream.format("parquet").option("checkpointLocation", os.path.join(scratch, "ck2")) \
        .trigger(availableNow=True).start(out)
    q.awaitTermination(300)
    assert spark.read.parquet(out).count() == 50


def test_writers_and_pipeline(spark, scratch):
    r = load_readings(spark, SF001)
    path = os.path.join(scratch, "raw")
    WR.write_readings_table(r, path)
    t = spark.read.parquet(path)
    assert "event_date" in t.columns and t.count() == 1000
    assert WR.append_batch(r.limit(10), path, batch_size=3) == 10
    assert spark.read.parquet(path).count() == 1010
    n_mart = WR.write_mart_table(spark.read.parquet(path), os.path.join(scratch, "mart"))
    assert n_mart == hourly_rollup(spark.read.parquet(path)).count()
    deleted = WR.rewrite_without_prefix(spark, path, os.path.join(scratch, "raw_v2"), "SENSOR-")
    v2 = spark.read.parquet(os.path.join(scratch, "raw_v2"))
    assert deleted + v2.count() == 1010 and v2.where(F.col("sensor_id").startswith("SENSOR-")).count() == 0
    res = pipeline_run(spark, _messages(spark), os.path.join(scratch, "p_raw"), os.path.join(scratch, "p_rej"),
                       os.path.join(scratch, "p_mart"))
    assert res["status"] == "success" and res["records_processed"] == 1000 and res["records_rejected"] == 0
    assert res["mart_rows"] == hourly_rollup(r).count()


def test_ten_different_bad_messages_all_reach_the_rejects(spark, scratch):
    inp = os.path.join(scratch, "in")
    spark.createDataFrame([(i, f"?{i}") for i in range(10)], "event_id long, body string").write.parquet(inp)
    ST.stream_ingest(ST.message_stream(spark, inp), os.path.join(scratch, "t"), os.path.join(scratch, "r"),
                     os.path.join(scratch, "c"), dedup=True).awaitTermination(300)
    assert spark.read.parquet(os.path.join(scratch, "r")).count() == 10


def test_hourly_rollup_is_the_same_in_any_zone(spark, scratch):
    """Wall times around the New York clock change, and half-hour Kolkata: stream equals batch."""
    rows = [(i, "S", dt.datetime(2024, 3, 10, h, m), 20.0, 50.0, 0.5, None) for i, (h, m) in enumerate(
        [(1, 30), (2, 10), (2, 30), (2, 40), (3, 30), (4, 10), (12, 0)])]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", z)
            from soilcast.schema import READINGS
            r = spark.createDataFrame(rows, READINGS)
            src, out = os.path.join(scratch, z, "src"), os.path.join(scratch, z, "out")
            r.write.parquet(src)
            ST.stream_hourly_rollup(spark.readStream.schema(r.schema).parquet(src)).writeStream.format("parquet") \
                .outputMode("append").option("checkpointLocation", os.path.join(scratch, z, "c")) \
                .trigger(availableNow=True).start(out).awaitTermination(300)
            got, batch = spark.read.parquet(out), hourly_rollup(r)
            emitted = got.select(batch.columns)
            assert emitted.exceptAll(batch).count() == 0
            late = batch.where(F.col("hour_bucket") < F.lit("2024-03-10 09:00:00").cast("timestamp_ntz"))
            assert late.exceptAll(emitted).count() == 0 and late.count() == 4
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_kafka_shaped_records(spark):
    rec = _messages(spark).limit(20).select(
        F.lit(None).cast("binary").alias("key"), F.encode("body", "UTF-8").alias("value"), F.lit("t").alias("topic"),
        F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.current_timestamp().alias("timestamp"),
        F.lit(0).alias("timestampType"))
    got = M.parse_messages(ST.from_kafka(rec))
    assert got.where("reject_reason is null").count() == 20 and {"topic", "partition"} <= set(got.columns)


def test_mart_rebuilds_equal_a_one_shot_build(spark, scratch):
    from soilcast.operators.staging import staging_readings
    r = load_readings(spark, SF001)
    path = os.path.join(scratch, "mart")
    newest = r.agg(F.max("event_time")).first()[0]
    steps = [newest - dt.timedelta(hours=h) for h in (18, 12, 6, 0)]
    for as_of in steps:
        staged = staging_readings(r, as_of, 5)
        WR.write_mart_table(staged, path)
        got, one = spark.read.parquet(path), hourly_rollup(staged)
        assert got.count() == one.count() and got.select(one.columns).exceptAll(one).count() == 0
    days = os.path.join(scratch, "days")
    for as_of in steps:
        WR.write_mart_table(staging_readings(r, as_of, 5), days, whole_days_only=True)
    got = spark.read.parquet(days)
    full = hourly_rollup(r).join(got.select("hour_date").distinct(), F.to_date("hour_bucket") == F.col("hour_date")).drop("hour_date")
    assert got.select(full.columns).exceptAll(full).count() == 0 and got.count() == full.count()
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_rerunning_the_pipeline_adds_nothing(spark, scratch):
    msgs = _messages(spark).unionByName(spark.createDataFrame([(10 ** 9, "???")], "event_id long, body string"))
    paths = [os.path.join(scratch, x) for x in ("raw", "rej", "mart")]
    first = pipeline_run(spark, msgs, *paths)
    again = pipeline_run(spark, msgs, *paths)
    assert first == again and first["records_rejected"] == 1
    assert spark.read.parquet(paths[0]).count() == 1000 and spark.read.parquet(paths[1]).count() == 1
    assert sorted(os.listdir(scratch)) == ["mart", "raw", "rej"]
    other = pipeline_run(spark, msgs.limit(5), *paths, batch_id="second")
    assert other["records_processed"] + other["records_rejected"] == 5
    assert spark.read.parquet(paths[0]).count() + spark.read.parquet(paths[1]).count() == 1006
