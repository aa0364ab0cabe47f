"""The mergeable hourly mart: batches in any order, repeated or corrected, equal the one-shot build."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from soilcast.operators import mart_state as MS
from soilcast.operators.marts import hourly_rollup
from soilcast.schema import READINGS
from soilcast.sources import writers as WR
from soilcast.sources.readings import load_readings

AVGS = ["avg_temp_c", "avg_humidity", "avg_moisture"]


@pytest.fixture(scope="module")
def recent(spark):
    """The newest five days of readings."""
    r = load_readings(spark, SF001)
    newest = r.agg(F.max("event_time")).first()[0]
    return r.where(F.col("event_time") > F.lit(newest - dt.timedelta(days=5))).cache()


def same(got, exp):
    rounded = [x.select(exp.columns).withColumns({c: F.round(c, 9) for c in AVGS}) for x in (got, exp)]
    assert got.count() == exp.count()
    assert rounded[0].exceptAll(rounded[1]).count() == 0


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs
            if f.endswith(".parquet")}


def batch(r, i, n=3):
    return r.where(F.pmod(F.col("event_id"), F.lit(n)) == i)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1, 0, 2)])
def test_any_order_and_repeats_equal_one_build(spark, scratch, recent, order):
    r = recent
    for i in order:
        MS.apply_batch(batch(r, i), scratch, f"00{i}")
    same(MS.mart_view(spark, scratch), hourly_rollup(r))


def test_corrected_batch_replaces_what_it_was(spark, scratch, recent):
    r = recent
    MS.apply_batch(batch(r, 0), scratch, "a")
    MS.apply_batch(batch(r, 1), scratch, "b")
    cut = r.agg(F.expr("percentile_approx(event_time, 0.5)")).first()[0]
    fixed = batch(r, 1).where(F.col("event_time") > F.lit(cut))          # half of its days are gone
    MS.apply_batch(fixed, scratch, "b")
    same(MS.mart_view(spark, scratch), hourly_rollup(batch(r, 0).unionByName(fixed)))
    MS.apply_batch(r.limit(0), scratch, "b")                             # withdrawn as a whole
    same(MS.mart_view(spark, scratch), hourly_rollup(batch(r, 0)))


def test_refresh_rewrites_only_touched_days(spark, scratch, recent):
    state, mart = os.path.join(scratch, "state"), os.path.join(scratch, "mart")
    r = recent
    MS.apply_batch(r, state, "all")
    MS.refresh_mart(spark, state, mart, "all")
    same(MS.read_mart(spark, mart), hourly_rollup(r))
    day = r.agg(F.to_date(F.max("event_time"))).first()[0]
    late = spark.createDataFrame([(10 ** 9, "SENSOR-LATE", dt.datetime.combine(day, dt.time(5)), 1.0, 2.0, 0.1, None)], READINGS)
    before_state, before = files(state), files(mart)
    MS.apply_batch(late, state, "late")
    MS.refresh_mart(spark, state, mart, "late")
    same(MS.read_mart(spark, mart), hourly_rollup(r.unionByName(late)))
    changed = {f for f in set(before) | set(files(mart)) if before.get(f) != files(mart).get(f)}
    assert changed and all(f"hour_date={day}" in f for f in changed)
    assert before_state.items() <= files(state).items()                  # no file of another batch was touched
    MS.apply_batch(late.limit(0), state, "late")
    MS.refresh_mart(spark, state, mart, "late")
    same(MS.read_mart(spark, mart), hourly_rollup(r))


def test_day_range_reads_only_its_directories(spark, scratch, recent):
    r = recent
    MS.apply_batch(r, scratch, "x")
    day = r.agg(F.to_date(F.max("event_time"))).first()[0]
    v = MS.mart_view(spark, scratch, first_day=day, last_day=day)
    same(v, hourly_rollup(r.where(F.to_date("event_time") == F.lit(day))))
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hour_date" in plan


def test_nulls_empty_state_and_a_day_emptied_in_the_mart(spark, scratch):
    assert MS.mart_view(spark, os.path.join(scratch, "none")).count() == 0
    t = dt.datetime(2024, 1, 1, 3)
    rows = [(1, None, t, None, None, None, None), (2, "S", None, 1.0, None, 0.1, None), (3, "S", t, float("nan"), 2.0, None, None),
            (4, "S", t, 3.0, 2.0, 0.2, None), (4, "S", t, 3.0, 2.0, 0.2, None)]
    r = spark.createDataFrame(rows, "event_id long, sensor_id string, event_time timestamp_ntz, temperature_c double, "
                                    "humidity_pct double, soil_moisture double, payload string")
    state, mart = os.path.join(scratch, "state"), os.path.join(scratch, "mart")
    for i in (0, 1):
        MS.apply_batch(batch(r, i, 2), state, f"b/{i} %")                # ids of any text
    same(MS.mart_view(spark, state), hourly_rollup(r))
    MS.refresh_mart(spark, state, mart, "b/0 %")
    MS.apply_batch(r.limit(0), state, "b/0 %")
    MS.apply_batch(r.limit(0), state, "b/1 %")
    MS.refresh_mart(spark, state, mart, "b/0 %")
    MS.refresh_mart(spark, state, mart, "b/1 %")
    assert MS.read_mart(spark, mart).count() == 0 and MS.mart_view(spark, state).count() == 0


def test_named_append_is_idempotent(spark, scratch, recent):
    r = recent
    assert WR.append_batch(batch(r, 0, 2), scratch, batch_id="even") == batch(r, 0, 2).count()
    WR.append_batch(batch(r, 1, 2), scratch, batch_id="odd")
    before = {f for f in files(scratch) if "batch_id=even" in f}
    WR.append_batch(batch(r, 1, 2), scratch, batch_id="odd")             # a retry
    t = spark.read.parquet(scratch)
    assert t.count() == r.count() and t.select(r.columns).exceptAll(r).count() == 0
    assert before == {f for f in files(scratch) if "batch_id=even" in f}
