"""Forest roll-out and the full prediction plan (rows-only operators)."""
import numpy as np
from pyspark.sql import functions as F

from conftest import SF001
from soilcast.operators import forest
from soilcast.plans import predict as P
from soilcast.sources.readings import load_readings


def test_forest_arrays_match_spark_model(spark):
    r = load_readings(spark, SF001)
    rows = forest.forest_training_rows(r)
    model = forest.forest_train(rows, num_trees=10, max_depth=6)
    arr = forest.forest_arrays(model)
    from pyspark.ml.feature import VectorAssembler
    pdf = model.transform(VectorAssembler(inputCols=forest.FEATURE_NAMES, outputCol="features").transform(rows)) \
        .select(*forest.FEATURE_NAMES, "prediction").toPandas()
    mine = forest.predict_arrays(arr, pdf[forest.FEATURE_NAMES].values.astype(float))
    assert np.allclose(mine, pdf["prediction"].values, atol=1e-12)
    curve = forest.forest_curve(forest.forest_seeds(r), arr)
    c = curve.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"), F.min("predicted_moisture").alias("lo"),
                                       F.max("predicted_moisture").alias("hi")).collect()
    assert all(x.n == 337 and 0 <= x.lo and x.hi <= 1 for x in c)


def test_predict_batch_covers_every_sensor_once(spark):
    r = load_readings(spark, SF001)
    a = P.analyze(r, forest_params={"num_trees": 10, "max_depth": 6})
    res = a.results.select("sensor_id").collect()
    rej = a.rejects.select("sensor_id").collect()
    ids = {x.sensor_id for x in res} | {x.sensor_id for x in rej}
    assert len(res) + len(rej) == len(ids) == r.select("sensor_id").distinct().count()
    row = a.results.collect()[0]
    assert row.status in ("CRITICAL", "WARNING", "OK") and row.health_score == 100
    assert a.curves.groupBy("sensor_id").count().where(F.col("count") != 337).count() == 0


def test_forest_forecast_equals_brute_force(spark):
    """The one-aggregate forecast equals a plain scan of each materialised curve."""
    from soilcast.operators.report import curve_crossing
    r = load_readings(spark, SF001)
    arr = forest.forest_arrays(forest.forest_train(forest.forest_training_rows(r), num_trees=10, max_depth=6))
    c = forest.forest_curve(forest.forest_seeds(r), arr).cache()
    fc = {x.sensor_id: x for x in forest.forest_forecast(c).collect()}
    cc = {x.sensor_id: x.critical_time for x in curve_crossing(c).collect()}
    pdf = c.toPandas()
    for sid, g in pdf.groupby("sensor_id"):
        g = g.sort_values("hours_from_now")
        hit = g[(g.hours_from_now >= 1) & (g.predicted_moisture <= 0.3)]
        row = fc[sid]
        if len(hit):
            assert row.hours_from_now == hit.iloc[0].hours_from_now
            assert row.predicted_moisture == hit.iloc[0].predicted_moisture
            assert row.urgency == ("HIGH" if row.hours_from_now < 12 else "MEDIUM" if row.hours_from_now < 48 else "LOW")
        else:
            assert row.urgency == "NONE" and row.hours_from_now == 336.0
            assert row.predicted_moisture == g.iloc[-1].predicted_moisture
        assert row.critical_time == cc.get(sid)
    c.unpersist()


def test_compat_global_limit(spark):
    """Q8: the service analyses the newest N rows over all sensors together; sensors left with < 10 rows
    are dropped to the rejects."""
    from soilcast.sources.readings import latest_readings
    r = load_readings(spark, SF001)
    a = P.analyze(r, compat_limit=300, use_forest=False, method="exponential")
    newest = latest_readings(r, 300)
    per = {x.sensor_id: x["count"] for x in newest.groupBy("sensor_id").count().collect()}
    res = {x.sensor_id: x.samples_used for x in a.results.collect()}
    rej = {x.sensor_id for x in a.rejects.collect()}
    assert res == {k: v for k, v in per.items() if v >= 10}
    assert rej == {k for k, v in per.items() if v < 10}


def test_readings_records_json(spark):
    import json
    from soilcast.operators.staging import readings_records
    from soilcast.sources.readings import latest_readings
    rec = readings_records(latest_readings(load_readings(spark, SF001), 5), as_json=True).collect()
    obj = json.loads(rec[0].record)
    assert {"sensor_id", "timestamp", "temperature", "humidity", "soil_moisture"} <= set(obj)


def test_one_sensor_alone_equals_its_batch_row(spark):
    r = load_readings(spark, SF001)
    small = {"num_trees": 20, "max_depth": 8}
    batch = {x.sensor_id: x for x in P.predict_batch(r, forest_params=small).collect()}
    for sid in sorted(batch)[:4]:
        one = P.predict_one(r, sid, forest_params=small).collect()
        assert len(one) == 1
        for c in batch[sid].asDict():
            assert one[0][c] == batch[sid][c], (sid, c)
        curve = one[0].predicted_decay_curve
        assert [p.hours_from_now for p in curve] == list(range(337))
        assert one[0].watering_frequency_analysis.average_days_between_watering == 7


CORES = """
import sys
sys.path.insert(0, sys.argv[1])
from soilcast.session import local_session
from soilcast.plans import predict as P
from soilcast.sources.readings import load_readings
s = local_session(cores=int(sys.argv[2]))
r = P.predict_batch(load_readings(s, sys.argv[3])).collect()
print("ROWS", sorted(str((x.sensor_id, x.urgency, x.hours_from_now, x.predicted_moisture, x.status)) for x in r))
"""


def test_the_answer_does_not_depend_on_the_cores():
    """The full forest on two and on four cores, each in a session of its own."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = [subprocess.run([sys.executable, "-c", CORES, root, str(n), SF001], capture_output=True, text=True,
                          timeout=900).stdout.split("ROWS", 1)[1] for n in (2, 4)]
    assert out[0] == out[1]


def test_degenerate_sensors_do_not_stop_the_others(spark):
    import datetime as dt
    from soilcast.operators import decay
    from soilcast.schema import READINGS
    t0, rows = dt.datetime(2025, 1, 1), []
    for i in range(40):
        rows += [(i, "same-time", t0, 20.0, 50.0, 0.5 - i * 0.001, None),
                 (i + 100, "constant", t0 + dt.timedelta(hours=i), 20.0, 50.0, 0.5, None),
                 (i + 200, "healthy", t0 + dt.timedelta(hours=i), 20.0, 50.0, 0.6 - i * 0.005, None)]
    rows += [(i + 300, "ten", t0 + dt.timedelta(hours=i), 20.0, 50.0, 0.6 - i * 0.01, None) for i in range(10)]
    df = spark.createDataFrame(rows, READINGS)
    got = {x.sensor_id: x for x in P.predict_batch(df).collect()}
    assert set(got) == {"same-time", "constant", "healthy", "ten"}
    assert all(x.hours_from_now is not None for x in got.values())
    fit = {x.sensor_id: x for x in decay.decay_fit(df).collect()}
    assert fit["same-time"].A is not None and fit["constant"].confidence in (0.3, 0.95)
    assert decay.decay_curve(decay.decay_fit(df)).count() == 4 * 337
