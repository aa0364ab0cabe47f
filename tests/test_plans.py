"""Physical-plan properties: pushdown and pruning reach the scan, tails use WindowGroupLimit, one shuffle in
the decay fit."""
import os

from pyspark.sql import functions as F

from conftest import SF001
from soilcast.operators import decay, staging, windows
from soilcast.sources import writers as WR
from soilcast.sources.readings import load_readings, read_readings_table, sensor_readings


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_partition_pruning_reach_scan(spark, scratch):
    path = os.path.join(scratch, "raw")
    WR.write_readings_table(load_readings(spark, SF001), path)
    t = spark.read.parquet(path)
    p = _plan(sensor_readings(t, "SENSOR-00007"))
    assert "PushedFilters: [IsNotNull(sensor_id), EqualTo(sensor_id,SENSOR-00007)]" in p
    st = staging.staging_readings(t, as_of="2024-01-31 00:00:00", days=3)
    p = _plan(st)
    assert "PartitionFilters: [isnotnull(event_date" in p and "event_date#" in p
    assert st.count() == t.where(F.col("event_time") >= F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")).count()
    # only the five reading columns are read by the scan projection
    p = _plan(read_readings_table(spark, path))
    scan = [ln for ln in p.split("\n") if "FileScan parquet" in ln][0]
    assert "ReadSchema: struct<sensor_id:string,event_time:timestamp_ntz" in scan
    assert "payload" not in scan.split("]")[0] and "event_id" not in scan.split("]")[0]


def test_tail_uses_window_group_limit(spark):
    p = _plan(windows.tail_n(load_readings(spark, SF001), 24))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_halo_union_is_dealt_by_chunk(spark):
    """Rows that come dealt by sensor leave both sides of the halo union so; the window must not rely on the union for it."""
    r = load_readings(spark, SF001)
    dealt = r.join(r.groupBy("sensor_id").count().where("count > 1").hint("merge"), "sensor_id", "left_semi")
    lines = _plan(windows.reading_deltas(dealt)).split("\n")
    at = next(i for i, x in enumerate(lines) if x.split("- ")[-1].strip() == "Union")
    above = next(x for x in reversed(lines[:at]) if "Project" not in x)
    assert "Exchange hashpartitioning(sensor_id" in above and "_chunk" in above


def test_decay_passes_read_checkpointed_points_only(spark):
    fit = decay.decay_fit(load_readings(spark, SF001))
    fit.collect()
    p = _plan(fit)
    # the raw table is read once, by the checkpoint of the bounded tails; the passes start from that leaf
    # (their exchanges move at most 168 points per sensor, never the input)
    assert "FileScan" not in p and "Scan ExistingRDD" in p


def test_analysis_reads_its_input_once(spark, monkeypatch):
    """The series columns are read by one scan; everything else starts from their checkpoint."""
    from soilcast.plans import predict as P

    scans = []
    real = P.cut_lineage
    monkeypatch.setattr(P, "cut_lineage", lambda df: scans.append(_plan(df).count("FileScan parquet")) or real(df))
    a = P.analyze(load_readings(spark, SF001), use_forest=False, method="exponential")
    # the second cut is of the checks, which also start from the checkpoint
    assert scans == [1, 0] and "FileScan parquet" not in _plan(a.results)
