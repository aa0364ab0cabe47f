"""Chunked (halo) windows equal whole-series windows, with a hot sensor that has dense and sparse days."""
import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import Window, functions as F

from soilcast.operators import windows as W
from soilcast.schema import READINGS


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    monkeypatch.setattr(W, "CHUNK_ROWS", 7)


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows, eid = [], 0
    t0 = dt.datetime(2024, 1, 1)
    # hot sensor: 3 dense days (150 rows each) between sparse days (0-3 rows), plus two small sensors
    for day in range(12):
        n = 150 if day in (2, 3, 7) else rnd.randint(0, 3)
        for i in range(n):
            rows.append((eid, "HOT", t0 + dt.timedelta(days=day, seconds=rnd.randint(0, 86399)), 20.0, 50.0, rnd.random(), None))
            eid += 1
    for s in ("A", "B"):
        for i in range(40):
            rows.append((eid, s, t0 + dt.timedelta(hours=7 * i), 20.0, 50.0, rnd.random(), None))
            eid += 1
    return spark.createDataFrame(rows, READINGS)


def _plain(df, halo):
    w = Window.partitionBy("sensor_id").orderBy("event_time", "event_id")
    return df.select("event_id", F.row_number().over(w).alias("rn"),
                     F.avg("soil_moisture").over(w.rowsBetween(-halo, 0)).alias("avg"),
                     F.lag("soil_moisture", halo).over(w).alias("lagh"))


@pytest.mark.parametrize("halo", [1, 5, 24])
def test_chunked_equals_whole_series(spark, skewed, halo):
    c = W.series_frame(skewed, halo)
    w = W.chunk_window(skewed)
    got = c.select("event_id", "rn", W.HALO, F.avg("soil_moisture").over(w.rowsBetween(-halo, 0)).alias("avg"),
                   F.lag("soil_moisture", halo).over(w).alias("lagh")).where(~F.col(W.HALO)).drop(W.HALO)
    exp = _plain(skewed, halo)
    assert got.count() == exp.count() == skewed.count()
    diff = got.join(exp, "event_id").where(
        (got["rn"] != exp["rn"]) | (F.abs(got["avg"] - exp["avg"]) > 1e-12)
        | ~got["lagh"].eqNullSafe(exp["lagh"]))
    assert diff.count() == 0
    # halo copies stay bounded: at most `halo` per chunk
    per_chunk = c.where(F.col(W.HALO)).groupBy("sensor_id", W.CHUNK).count().agg(F.max("count")).collect()[0][0]
    assert per_chunk <= halo


def test_history_features_on_hot_sensor(spark, skewed):
    f = W.history_features(skewed)
    assert f.count() == skewed.groupBy("sensor_id").count().select(F.sum(F.greatest(F.col("count") - 24, F.lit(0)))).collect()[0][0]


def test_operators_chunked_equal_plain(spark, skewed, monkeypatch):
    """The registered window operators give the same rows with and without chunking."""
    cols = ["event_id", "moisture_24h_avg", "prev_moisture"]
    chunked = W.sensor_analytics(skewed).select(*cols).collect()
    feats_c = W.history_features(skewed).drop("rn").collect()
    split_c = W.train_split(skewed).collect()
    monkeypatch.setattr(W, "CHUNK_ROWS", 10 ** 9)
    plain = W.sensor_analytics(skewed).select(*cols).collect()
    feats_p = W.history_features(skewed).drop("rn").collect()
    split_p = W.train_split(skewed).collect()
    key = lambda r: r[0]
    for a, b in zip(sorted(chunked, key=key), sorted(plain, key=key)):
        assert a[0] == b[0] and a[2] == b[2] and abs(a[1] - b[1]) < 1e-12
    assert sorted(map(tuple, feats_c)) == sorted(map(tuple, feats_p))
    assert sorted(map(tuple, split_c)) == sorted(map(tuple, split_p))


from hypothesis import HealthCheck, given, settings, strategies as st  # noqa: E402


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(days=st.lists(st.integers(0, 40), min_size=1, max_size=8), halo=st.integers(1, 30), seed=st.integers(0, 999))
def test_chunked_property(spark, days, halo, seed):
    """Random per-day densities (including empty and sparse days) and halo sizes: chunked == whole-series."""
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 3, 1)
    rows = [(i, "S", t0 + dt.timedelta(days=d, seconds=rnd.randint(0, 86399)), 20.0, 50.0, rnd.random(), None)
            for i, (d, _) in enumerate((d, k) for d, n in enumerate(days) for k in range(n))]
    if not rows:
        return
    df = spark.createDataFrame(rows, READINGS)
    c = W.series_frame(df, halo)
    w = W.chunk_window(df)
    got = {r.event_id: (r.rn, r.lagh, r.s) for r in c.select(
        "event_id", "rn", W.HALO, F.lag("soil_moisture", halo).over(w).alias("lagh"),
        F.sum("soil_moisture").over(w.rowsBetween(-halo, 0)).alias("s")).where(~F.col(W.HALO)).collect()}
    exp = {r.event_id: (r.rn, r.lagh) for r in _plain(df, halo).collect()}
    assert set(got) == set(exp)
    for k, (rn, lagh, _) in got.items():
        assert (rn, lagh) == exp[k]


def test_history_features_environment_columns(spark, skewed):
    """The one extension hook: environment columns replace the constants 20 / 50 / 12 / 1.0 when given."""
    df = skewed.withColumn("light", F.lit(9.5))
    f = W.history_features(df, env_cols={"temperature": "temperature_c", "humidity": "humidity_pct",
                                         "light_hours": "light"}).select(*W.FEATURE_NAMES[-4:]).distinct().collect()
    assert [tuple(r) for r in f] == [(20.0, 50.0, 9.5, 1.0)]
    g = W.history_features(skewed).select(*W.FEATURE_NAMES[-4:]).distinct().collect()
    assert [tuple(r) for r in g] == [(20.0, 50.0, 12.0, 1.0)]


def test_recent_stats_do_not_depend_on_the_order_of_rows(spark):
    rnd = random.Random(7)
    rows = [(k, "S1", dt.datetime(2025, 1, 1) + dt.timedelta(minutes=k), rnd.random() * 10 ** -rnd.randint(0, 5)) for k in range(3000)]
    rows += [(9000 + k, "S2", dt.datetime(2025, 1, 1) + dt.timedelta(hours=k), 0.1) for k in range(50)]
    rows += [(9100, "S3", dt.datetime(2025, 1, 1), 0.4), (9101, "S4", dt.datetime(2025, 1, 1), None)]
    seen = set()
    for parts in (1, 3, 7):
        rnd.shuffle(rows)
        df = spark.createDataFrame(rows, "event_id long, sensor_id string, event_time timestamp_ntz, soil_moisture double")
        got = {r.sensor_id: tuple(r)[1:] for r in W.recent_stats(df.repartition(parts)).collect()}
        seen.add(str(sorted(got.items())))
    assert len(seen) == 1
    values = [r[3] for r in rows if r[1] == "S1"]
    assert got["S1"][1] == pytest.approx(math.fsum(values) / 3000, rel=1e-15)
    assert got["S1"][2] == pytest.approx(statistics.stdev(values), rel=1e-12)
    assert got["S2"][1] == pytest.approx(0.1) and got["S2"][2] == 0.0
    assert got["S3"] == (1, 0.4, None, 1.0) and got["S4"] == (1, None, None, None)
