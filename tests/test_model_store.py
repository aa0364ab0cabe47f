"""Model store: content-addressed forests, looked up before training; queries that use them."""
import pytest
from pyspark.sql import functions as F

from soilcast.operators import forest, model_store
from soilcast.plans import predict as P
from soilcast.sources.readings import load_readings
from tests.conftest import SF001

SMALL = {"num_trees": 5, "max_depth": 4}


@pytest.fixture()
def fleet(spark):
    """Twelve sensors of 60 and two of 20 readings from the events table."""
    r = load_readings(spark, SF001).withColumn("sensor_id", F.concat(F.lit("S"), (F.col("event_id") % 14).cast("string")))
    return r.where((F.col("event_id") % 14 < 12) | (F.col("event_id") < 280))


def test_key_follows_content_not_order(spark, fleet):
    key = model_store.model_key(fleet, SMALL)
    assert model_store.model_key(fleet.orderBy(F.rand(3)).repartition(5), SMALL) == key
    assert model_store.model_key(fleet, {**SMALL, "num_trees": 6}) != key
    assert model_store.model_key(fleet.where("event_id <> 7"), SMALL) != key
    moved = fleet.withColumn("soil_moisture", F.when(F.col("event_id") == 7, 0.123).otherwise(F.col("soil_moisture")))
    assert model_store.model_key(moved, SMALL) != key
    nulled = fleet.withColumn("soil_moisture", F.when(F.col("event_id") != 7, F.col("soil_moisture")))
    assert model_store.model_key(nulled, SMALL) != key
    assert model_store.model_key(fleet.unionByName(fleet), SMALL) != key


def test_a_second_call_trains_nothing_and_gives_the_same_rows(spark, fleet, monkeypatch):
    model_store.forget(spark, model_store.model_key(fleet, SMALL))
    trained = []
    real = forest.forest_train
    monkeypatch.setattr(forest, "forest_train", lambda *a, **k: trained.append(1) or real(*a, **k))
    first = sorted(map(str, P.predict_batch(fleet, forest_params=SMALL).drop("recommendations").collect()))
    assert trained == [1]
    model_store._decoded.clear()          # read back from the store, not from this process
    again = sorted(map(str, P.predict_batch(fleet, forest_params=SMALL).drop("recommendations").collect()))
    one = P.predict_one(fleet, "S3", forest_params=SMALL).first()
    key = model_store.model_key(fleet, SMALL)
    named = P.predict_one(fleet.where("sensor_id = 'S3'"), "S3", forest_params=SMALL, model_key=key).first()
    assert trained == [1] and again == first
    assert one == named and any(f"predicted_moisture={one.predicted_moisture}" in x for x in first if "'S3'" in x)


def test_an_entry_is_whole_or_absent(spark, fleet):
    key = model_store.model_key(fleet, {**SMALL, "max_depth": 3})
    model_store.forget(spark, key)
    arrays = model_store.forest_of(fleet, {**SMALL, "max_depth": 3})
    model_store._decoded.clear()
    back = model_store.stored(spark, key)
    assert all((arrays[k] == back[k]).all() for k in arrays if k != "depth") and arrays["depth"] == back["depth"]
    model_store._decoded.clear()
    said = model_store._read_manifest(spark, key)
    fs, p = model_store._files(spark, f"{model_store.store_folder(spark)}/{key}/manifest.json")
    fs.delete(p, False)
    assert model_store.stored(spark, key) is None            # no manifest, no model
    model_store._write_manifest(spark, key, {**said, "n_nodes": said["n_nodes"] + 1})
    assert model_store.stored(spark, key) is None            # a node table that is not whole
    model_store.forget(spark, key)


def test_scores_equal_the_fitted_model(spark, fleet):
    from pyspark.ml.feature import VectorAssembler

    rows = forest.forest_training_rows(fleet)
    model = forest.forest_train(rows, **SMALL)
    mine = forest.forest_scores(rows, forest.forest_arrays(model)).select("sensor_id", "event_id", "prediction")
    theirs = model.transform(VectorAssembler(inputCols=forest.FEATURE_NAMES, outputCol="features").transform(rows)) \
        .select("sensor_id", "event_id", "prediction")
    a, b = (sorted((r[0], r[1], round(r[2], 9)) for r in x.collect()) for x in (mine, theirs))
    assert a == b and a


def test_bags_are_those_of_spark_and_histograms_few(spark, fleet):
    """A partition per few rows: the model is Spark's own, and no pass has more tasks than merged partitions."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = forest.forest_training_rows(fleet).persist()
    keys, n, sc = ["sensor_id", "event_time", "event_id"], rows.count(), spark.sparkContext
    most = max(forest.HISTOGRAM_PARTS, sc.defaultParallelism)

    def tasks(group, job):
        """The model and the most tasks of a stage that fills histograms."""
        sc.setJobGroup(group, group)
        try:
            model, at = job(), sc.statusTracker()
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        stages = [at.getStageInfo(i) for j in at.getJobIdsForGroup(group) for i in at.getJobInfo(j).stageIds]
        return model, max(x.numTasks for x in stages if x and x.name.startswith("mapPartitions at RandomForest"))

    for rows_per_partition in (n // 3, n // (2 * most)):
        parts = -(-n // rows_per_partition)
        data = VectorAssembler(inputCols=forest.FEATURE_NAMES, outputCol="features").transform(
            rows.repartition(parts, *keys).sortWithinPartitions(*keys)).select("features", F.col("target").alias("label"))
        own = RandomForestRegressor(numTrees=5, seed=42, maxDepth=4, maxBins=64, featureSubsetStrategy="all")
        own, _ = tasks(f"own-{parts}", lambda: own.fit(data))
        mine, widest = tasks(f"mine-{parts}", lambda: forest.forest_train(rows, rows_per_partition=rows_per_partition, **SMALL))
        a, b = ([r.prediction for r in m.transform(data).collect()] for m in (mine, own))
        close = sum(abs(x - y) < 1e-9 for x, y in zip(a, b)) / len(a)
        assert widest == min(parts, most) and mine.getNumTrees == 5
        assert close == 1 if parts <= most else close > 0.8      # of splits with equal gain another may be taken
    rows.unpersist()


def test_training_leaves_no_tables_behind(spark, fleet):
    """The series and the training rows are Parquet tables that go with the training."""
    from pathlib import Path

    params = {**SMALL, "max_depth": 2}
    key = model_store.model_key(fleet, params)
    model_store.forget(spark, key)
    model_store.forest_of(fleet, params)
    top = Path(model_store.store_folder(spark).removeprefix("file:")).parent
    assert not [*top.glob("series-*"), *top.glob("forest-*")]
    model_store.forget(spark, key)


def test_a_thread_of_the_caller_trains_too(spark, fleet):
    """Such a thread has no active session; it failed when the trees were read back."""
    from concurrent.futures import ThreadPoolExecutor

    key = model_store.model_key(fleet, SMALL)
    model_store.forget(spark, key)
    with ThreadPoolExecutor(1) as thread:
        arrays = thread.submit(model_store.forest_of, fleet, SMALL).result()
    assert len(arrays["roots"]) == SMALL["num_trees"]
    model_store.forget(spark, key)


def test_queries_use_the_real_method(spark):
    """Summary, dates, advice and urgency are those of predict_batch."""
    from soilcast.plans import catalog

    catalog.load_all()
    q = catalog.QUERIES
    batch = {r.sensor_id: r for r in q["predict_batch"](spark, SF001).collect()}
    assert {r.method for r in batch.values()} >= {"ml"}
    for r in q["urgency_status"](spark, SF001).collect():
        assert (r.urgency, r.status) == (batch[r.sensor_id].urgency, batch[r.sensor_id].status)
    for r in q["recommendations"](spark, SF001).collect():
        assert r.recommendations_text == batch[r.sensor_id].recommendations
    for r in q["watering_date_label"](spark, SF001).collect():
        b = batch[r.sensor_id]
        assert (r.predicted_watering_date, r.critical_watering_date) == (b.predicted_watering_date, b.critical_watering_date)
    for r in q["sensor_summary"](spark, SF001).collect():
        assert r.sensor_id not in batch or r.status_text == batch[r.sensor_id].status


def test_every_submission_reason_occurs(spark):
    from soilcast.plans import catalog
    from soilcast.sources.submissions import SUBMISSION_REASONS

    catalog.load_all()
    got = {r.reason for r in catalog.QUERIES["validate_faulty_submission"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {None, *SUBMISSION_REASONS}
