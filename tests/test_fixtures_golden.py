"""Golden values of the reference's own fixtures (README worked example, test series)."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import series_df
from soilcast.operators import decay, health, linear, windows
from soilcast.plans import predict as P
from soilcast.schema import SUBMISSION

SUB_READINGS = [0.98, 0.90, 0.84, 0.82, 0.77, 0.65, 0.58, 0.52, 0.45, 0.38]
SUB_TIMES = [f"2025-09-{d:02d}T10:00:00" for d in range(1, 11)]


@pytest.fixture(scope="module")
def submission(spark):
    return spark.createDataFrame([("golden", "my-garden-sensor", SUB_READINGS, SUB_TIMES)],
                                 "submission_id string, sensor_id string, moisture_readings array<double>, timestamps array<string>")


def test_readme_submission(spark, submission):
    r = P.predict_submission(submission).collect()[0]
    last = dt.datetime(2025, 9, 10, 10)
    assert r.sensor_id == "my-garden-sensor"
    assert r.status == "OK"
    assert r.drying_rate_per_hour == pytest.approx(3.9803443044, abs=2e-4)
    assert r.predicted_watering_date == last + dt.timedelta(hours=95)
    assert r.critical_watering_date == last + dt.timedelta(hours=200)
    assert r.average_moisture_7d == pytest.approx(0.62625)
    assert r.moisture_stability == pytest.approx(0.17303488500464703)
    assert r.days_since_last_watering == pytest.approx(9.0)
    assert r.health_score == 100
    assert r.samples_used == 10
    assert r.model_accuracy == pytest.approx(0.95)
    assert list(r.recommendations) == [
        "Excellent plant health! Continue current care routine.",
        "High moisture variability detected. Consider more consistent watering."]
    assert r.predicted_decay_curve == []


def test_readme_decay_parameters(spark, submission):
    from soilcast.sources.submissions import submitted_series
    s = submitted_series(submission).select(F.col("submission_id").alias("sensor_id"), "event_time", "soil_moisture", "event_id")
    f = decay.decay_fit(s).collect()[0]
    assert f.A == pytest.approx(1.015809, abs=1e-4)
    assert f.tau == pytest.approx(255.4227, abs=0.01)
    assert f.offset == pytest.approx(0.0, abs=1e-9)
    assert f.r_squared == pytest.approx(0.961434, abs=1e-5)
    assert f.confidence == pytest.approx(0.95)


LIN48 = list(np.linspace(0.6, 0.25, 48))
CRIT12 = [0.35, 0.32, 0.29, 0.26, 0.23, 0.20, 0.18, 0.16, 0.14, 0.12, 0.10, 0.08]


@pytest.mark.parametrize("name,values,exp", [
    ("greenhouse_sensor_1", LIN48, dict(A=0.620778, tau=57.7645, r2=0.988562, urgency="HIGH", crit_h=19, avg7=0.425,
                                        std=0.104255, tir=0.854167, days=1.958333, raw=4525, rate=0.007447)),
    ("critical_sensor", CRIT12, dict(A=0.338588, tau=10.0, r2=0.966981, urgency="CRITICAL", crit_h=0, avg7=0.2025,
                                     std=0.08833, tir=0.166667, days=0.458333, raw=2667.5, rate=0.024545)),
])
def test_reference_series(spark, name, values, exp):
    df = series_df(spark, name, values)
    fit = decay.decay_fit(df).collect()[0]
    assert fit.A == pytest.approx(exp["A"], abs=2e-4)
    assert fit.tau == pytest.approx(exp["tau"], abs=0.02)
    assert fit.r_squared == pytest.approx(exp["r2"], abs=1e-4)
    assert fit.confidence == pytest.approx(0.95)
    a = P.analyze(df)
    res = a.results.collect()[0]
    assert res.method == "exponential"
    assert res.urgency == exp["urgency"]
    assert res.hours_from_now == 0.0
    crit = a.curves.where(F.col("status") == "CRITICAL").agg(F.min("hours_from_now")).collect()[0][0]
    assert crit == exp["crit_h"]
    h = health.health_metrics(df).collect()[0]
    assert h.average_moisture_7d == pytest.approx(exp["avg7"], abs=1e-6)
    assert h.moisture_stability == pytest.approx(exp["std"], abs=1e-5)
    assert h.time_in_optimal_range == pytest.approx(exp["tir"], abs=1e-6)
    assert h.days_since_last_watering == pytest.approx(exp["days"], abs=1e-6)
    assert h.health_score_raw == pytest.approx(exp["raw"])
    assert h.health_score == 100
    rate = windows.linear_rate(df).collect()[0]
    assert rate.decay_rate == pytest.approx(exp["rate"], abs=1e-6)


def test_fleet_aggregation(spark):
    """3 sensors x 24 hours, newest 0.50 falling 0.01 per hour back in time."""
    from soilcast.operators.marts import sensor_trend
    dfs = [series_df(spark, s, [0.5 - 0.01 * i for i in range(23, -1, -1)]) for s in ["greenhouse_1", "greenhouse_2", "outdoor_1"]]
    df = dfs[0].unionByName(dfs[1]).unionByName(dfs[2])
    t = {r.sensor_id: r for r in sensor_trend(df).collect()}
    assert len(t) == 3
    for r in t.values():
        assert r.n_readings == 24 and 0 <= r.min_moisture and r.max_moisture <= 1
        assert r.rising and r.last_moisture == pytest.approx(0.5) and r.first_moisture == pytest.approx(0.27)


def test_curves_shape(spark):
    df = series_df(spark, "s", LIN48[:30])
    fit = decay.decay_fit(df)
    c = decay.decay_curve(fit).orderBy("hours_from_now").collect()
    assert len(c) == 337
    m = [r.predicted_moisture for r in c]
    assert all(a >= b - 1e-15 for a, b in zip(m, m[1:]))
    lc = linear.linear_curve(df).orderBy("hours_from_now").collect()
    assert len(lc) == 337 and all(a.predicted_moisture >= b.predicted_moisture for a, b in zip(lc, lc[1:]))


def test_submission_with_ml_path(spark):
    """A submission with >= 50 readings takes the forest path (pooled over such submissions)."""
    t60 = [(dt.datetime(2025, 9, 1) + dt.timedelta(hours=i)).isoformat() for i in range(60)]
    m60 = [round(0.9 - 0.009 * i + (0.25 if i in (20, 40) else 0.0), 4) for i in range(60)]
    subs = spark.createDataFrame([("long", None, m60, t60), ("golden", "my-garden-sensor", SUB_READINGS, SUB_TIMES)],
                                 "submission_id string, sensor_id string, moisture_readings array<double>, timestamps array<string>")
    out = {r.submission_id: r for r in P.predict_submission(subs).collect()}
    assert set(out) == {"long", "golden"}
    assert out["long"].samples_used == 60 and out["long"].sensor_id == "external-sensor"
    assert out["long"].model_accuracy == pytest.approx(0.85)
    assert out["golden"].predicted_watering_date == dt.datetime(2025, 9, 10, 10) + dt.timedelta(hours=95)
