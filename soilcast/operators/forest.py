"""Regression forest: pooled Spark ML training on window-built features, and a batched 336-hour roll-out.

Training rows are every ml sensor's readings that have 24 predecessors inside the first 70 % of its series
(``history_features`` + ``train_split``). The fitted trees are read back from the model's own parquet data
(size bounded by numTrees x 2^(maxDepth+1), independent of the data), broadcast as flat numpy arrays, and
``mapInPandas`` rolls out all sensors of a partition together, one vectorised step per hour: features from
the last 24 values (predictions appended), every tree traversed at once."""
from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from soilcast import schema as S
from soilcast.functions.status import threshold_colour, threshold_status, urgency_level
from soilcast.functions.timefn import add_hours
from soilcast.operators.windows import FEATURE_NAMES, history_features, order_cols, tail_n
from soilcast.session import scratch_path

MAX_DEPTH = 12          # trees grow until pure or this deep; an argument of forest_train and analyze
ROWS_PER_PARTITION = 20_000   # training rows per partition: part of the model, as bagging is seeded per partition
MAX_PARTITIONS = 10_000       # beyond 200 million rows the partitions grow instead; also part of the model
HISTOGRAM_PARTS = 24          # partitions that the forest grows from, or as many as there are cores if they are more
MAX_BINS = 64
COLLECT_S = 20         # seconds between two collections of the driver's garbage while the forest grows
MAX_MEMORY_MB = 1024   # upper bound of the histogram memory per task and pass (more nodes split per pass)


def histogram_memory_mb(spark) -> int:
    """maxMemoryInMB for the forest: half the heap share of one concurrent task, at most MAX_MEMORY_MB."""
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        heap_mb = sc._jvm.java.lang.Runtime.getRuntime().maxMemory() / 2 ** 20
        cores = sc.defaultParallelism
    else:
        heap_mb = sc._jvm.org.apache.spark.util.Utils.memoryStringToMb(spark.conf.get("spark.executor.memory", "1g"))
        cores = int(spark.conf.get("spark.executor.cores", "1"))
    return int(min(MAX_MEMORY_MB, max(32, heap_mb / (2 * cores))))
ML_CONFIDENCE = 0.85
NONE_CONFIDENCE = 0.6


def forest_training_rows(readings: DataFrame, ml_min: int = S.ML_MIN_READINGS, fraction: float = S.TRAIN_FRACTION,
                         history: int = S.HISTORY) -> DataFrame:
    """Feature rows of ml sensors (n >= 50) whose target lies in the first int(0.7 n) readings."""
    counts = readings.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"))
    feats = history_features(readings, history=history).join(counts, "sensor_id")
    return feats.where((F.col("n") >= ml_min) & (F.col("rn") <= F.floor(F.col("n") * F.lit(fraction))))


def forest_train(training_rows: DataFrame, num_trees: int = S.FOREST_TREES, seed: int = S.FOREST_SEED,
                 max_depth: int = MAX_DEPTH, max_bins: int = MAX_BINS,
                 rows_per_partition: int = ROWS_PER_PARTITION):
    """Spark ML RandomForestRegressor over the 13 features (all features at every split, bootstrap)."""
    from pyspark import StorageLevel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    # Bootstrap samples are drawn per partition, so the number, content and order of partitions are part of the
    # model: they follow from the rows alone (count, keys), never from the machine.
    spark = training_rows.sparkSession
    keys = ["sensor_id", *order_cols(training_rows)]
    rows = training_rows.select(*keys, "target", *FEATURE_NAMES)
    # a Parquet table, for the duration of the (eager) fit: unlike a cached one it lets go of the windows' shuffles
    path = scratch_path(spark, f"forest-rows-{uuid.uuid4().hex}")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    parts = min(MAX_PARTITIONS, max(1, -(-rows.count() // rows_per_partition)))
    data = VectorAssembler(inputCols=FEATURE_NAMES, outputCol="features").transform(
        rows.repartition(parts, *keys).sortWithinPartitions(*keys, "target")) \
        .select("features", F.col("target").alias("label")).persist(StorageLevel.MEMORY_AND_DISK)
    # cached node ids would be trees x 4 bytes a row, kept twice and checkpointed; a walk down the trees takes less than that
    rf = RandomForestRegressor(numTrees=num_trees, seed=seed, maxDepth=max_depth, maxBins=max_bins,
                               featureSubsetStrategy="all", labelCol="label", featuresCol="features",
                               maxMemoryInMB=histogram_memory_mb(spark), cacheNodeIds=False)
    try:
        with _collecting(spark):
            return _fit(rf, data)
    finally:
        data.unpersist()
        _delete(spark, path)


def _fit(rf, data: DataFrame):
    """``rf.fit(data)``, step by step as ``RandomForest.run`` does it, with one step between bagging and growing: the
    bagged partitions are merged, without a shuffle, to HISTOGRAM_PARTS or as many as the cluster has cores. Every pass of
    the growing writes a histogram per tree node and partition to the shuffle; with a partition per 20,000 rows that is
    rows times nodes. Bags are drawn before the merge, so they are those of ``rf.fit``; sums of labels are added in
    another order, so that of splits of equal gain another may be taken where partitions are merged."""
    spark = data.sparkSession
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    ml, none = jvm.org.apache.spark.ml, jvm.scala.Option.empty()
    impl = ml.tree.impl

    def module(package, name):
        return getattr(getattr(package, f"{name}$"), "MODULE$")

    rf._transfer_params_to_java()
    est = rf._java_obj
    strategy = est.getOldStrategy(ml.util.MetadataUtils.getCategoricalFeatures(data._jdf.schema().apply(rf.getFeaturesCol())),
                                  0, jvm.org.apache.spark.mllib.tree.configuration.Algo.Regression(), est.getOldImpurity())
    getattr(strategy, "bootstrap_$eq")(rf.getBootstrap())
    subset, trees, seed = rf.getFeatureSubsetStrategy(), rf.getNumTrees(), rf.getSeed()
    points = module(ml.util, "DatasetUtils").extractInstances(est, data._jdf, none)
    facts = impl.DecisionTreeMetadata.buildMetadata(points, strategy, trees, subset)
    splits = module(impl, "RandomForest").findSplits(points, facts, seed)
    bagged = impl.BaggedPoint.convertToBaggedRDD(
        impl.TreePoint.convertToTreeRDD(points, splits, facts), rf.getSubsamplingRate(), trees, rf.getBootstrap(),
        getattr(impl.BaggedPoint, "convertToBaggedRDD$default$5")(), seed)      # no weights: 1.0 a row
    most = max(HISTOGRAM_PARTS, sc.defaultParallelism)
    if bagged.getNumPartitions() > most:
        bagged = bagged.coalesce(most, False, none, None)
    bagged.persist(jvm.org.apache.spark.storage.StorageLevel.MEMORY_AND_DISK())
    known = sc._jsc.broadcast(splits)
    try:
        bagged.count()
        data.unpersist()
        grown = impl.RandomForest.runBagged(bagged, facts, known, strategy, trees, subset, seed, none, True, none, 0)
    finally:
        bagged.unpersist(False)
        known.destroy()
    kind = ml.regression.DecisionTreeRegressionModel
    array = sc._gateway.new_array(kind, trees)
    for i, tree in enumerate(grown):
        array[i] = tree
    return rf._copyValues(rf._create_model(ml.regression.RandomForestRegressionModel(
        rf.uid, array, len(FEATURE_NAMES))))


@contextmanager
def _collecting(spark, every_s: float = COLLECT_S):
    """Spark removes the shuffle files of finished passes when the driver's garbage collection finds them unused, which a
    roomy heap puts off until after the fit; meanwhile it is asked for every ``every_s`` seconds."""
    over = threading.Event()

    def run():
        while not over.wait(every_s):
            spark.sparkContext._jvm.System.gc()

    spark.sparkContext._jvm.System.gc()
    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()


NODE_SCHEMA = "treeID int, id int, prediction double, left int, right int, feature int, threshold double"


def forest_arrays(model, keep_nodes: str | None = None, spark=None) -> dict:
    """Flat node arrays of all trees. The model is saved under the shared checkpoint folder and its node table
    read back with Spark; its size is bounded by the model parameters. ``keep_nodes``: a folder for that table.
    ``spark``: the caller's session; a thread that Spark did not start has no active one of its own."""
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.active()
    path = scratch_path(spark, f"forest-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("prediction"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.try_element_at(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(1)).alias("threshold"))
    if keep_nodes:
        nodes.write.parquet(keep_nodes)
        nodes = spark.read.schema(NODE_SCHEMA).parquet(keep_nodes)
    arrays = arrays_of_nodes(nodes, int(model.getOrDefault("maxDepth")))
    _delete(spark, path)                       # the node table now lives in the driver; drop the saved copy
    return arrays


def arrays_of_nodes(node_table: DataFrame, depth: int) -> dict:
    """Flat node arrays of a table of ``NODE_SCHEMA``; ``depth`` bounds the trees' depth."""
    nodes = node_table.toPandas()
    nodes = nodes.sort_values(["treeID", "id"]).reset_index(drop=True)
    sizes = nodes.groupby("treeID").size().sort_index()
    offsets = np.concatenate([[0], np.cumsum(sizes.values)[:-1]])
    off = np.repeat(offsets, sizes.values)
    leaf = nodes["left"].values < 0
    left = np.where(leaf, np.arange(len(nodes)), nodes["left"].values + off)
    right = np.where(leaf, np.arange(len(nodes)), nodes["right"].values + off)
    return {
        "roots": offsets.astype(np.int64),
        "feature": np.where(leaf, 0, nodes["feature"].fillna(0).values).astype(np.int64),
        "threshold": np.where(leaf, 0.0, nodes["threshold"].fillna(0.0).values).astype(np.float64),
        "left": left.astype(np.int64), "right": right.astype(np.int64),
        "value": nodes["prediction"].values.astype(np.float64), "leaf": leaf,
        "depth": depth,   # leaves self-loop, so the bound is enough
    }


def _delete(spark, path: str) -> None:
    """Remove a scratch folder of this job from the shared checkpoint storage (Hadoop FileSystem API)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def predict_arrays(arr: dict, x: np.ndarray) -> np.ndarray:
    """Mean of all trees' leaf values for feature rows ``x`` (B x 13), every tree traversed at once."""
    b = x.shape[0]
    node = np.broadcast_to(arr["roots"], (b, len(arr["roots"]))).copy()
    rows = np.arange(b)[:, None]
    feat, thr, left, right = arr["feature"], arr["threshold"], arr["left"], arr["right"]
    for _ in range(arr["depth"]):            # leaves point to themselves, so extra levels are no-ops
        node = np.where(x[rows, feat[node]] <= thr[node], left[node], right[node])
    return arr["value"][node].mean(axis=1)


def forest_scores(rows: DataFrame, model_arrays: dict) -> DataFrame:
    """``rows`` (with the 13 features) and their ``prediction`` by stored trees."""
    _ship_by_value()
    bc = rows.sparkSession.sparkContext.broadcast(model_arrays)

    def run(batches):
        for pdf in batches:
            if not pdf.empty:
                pdf["prediction"] = predict_arrays(bc.value, pdf[FEATURE_NAMES].values.astype(float))
                yield pdf

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("prediction", T.DoubleType())]))


def features_from_history(hist: np.ndarray, hour, dow, season, extra_days, env=S.ENV_DEFAULTS,
                          days_rise=S.DAYS_SINCE_RISE, feature_rise=S.FEATURE_RISE) -> np.ndarray:
    """The 13 model features of B histories (B x 24), as ``history_features`` builds them with windows."""
    b, n = hist.shape
    d = np.diff(hist, axis=1)                      # n - 1 consecutive changes
    rises = d > days_rise
    idx = np.where(rises, np.arange(1, n)[None, :], 0).max(axis=1)
    days = np.where(rises.any(axis=1), (n - idx) / 24.0, n / 24.0) + extra_days
    cols = [np.full(b, hour, float), np.full(b, dow, float), np.full(b, season, float), days,
            hist.mean(axis=1), hist.std(axis=1), hist.min(axis=1), (hist[:, -1] - hist[:, 0]) / 24.0,
            (d > feature_rise).sum(axis=1).astype(float)] + [np.full(b, v, float) for v in env]
    return np.column_stack(cols)


CURVE_SCHEMA = T.StructType([
    T.StructField("sensor_id", T.StringType()), T.StructField("current_time", T.TimestampNTZType()),
    T.StructField("hours_from_now", T.IntegerType()), T.StructField("predicted_moisture", T.DoubleType())])


def _rollout_fn(bc, horizon: int):
    def run(batches):
        arr = bc.value
        for pdf in batches:
            if pdf.empty:
                continue
            hist = np.stack(pdf["history"].map(np.asarray).values).astype(float)
            t0 = pd.to_datetime(pdf["current_time"]).values
            b = len(pdf)
            out = np.empty((b, horizon + 1))
            out[:, 0] = pdf["current_moisture"].values
            # calendar features of every (sensor, step) at once
            ts = pd.DatetimeIndex((t0[:, None] + np.arange(horizon + 1)[None, :] * np.timedelta64(1, "h")).reshape(-1))
            hour = ts.hour.values.reshape(b, -1).astype(float)
            dow = ts.dayofweek.values.reshape(b, -1).astype(float)
            season = ((ts.month.values % 12) // 3).reshape(b, -1).astype(float)
            for h in range(1, horizon + 1):
                base = features_from_history(hist, 0, 0, 0, h / 24.0)
                base[:, 0], base[:, 1], base[:, 2] = hour[:, h], dow[:, h], season[:, h]
                p = np.clip(predict_arrays(arr, base), 0.0, 1.0)
                out[:, h] = p
                hist = np.concatenate([hist[:, 1:], p[:, None]], axis=1)
            yield pd.DataFrame({
                "sensor_id": np.repeat(pdf["sensor_id"].values, horizon + 1),
                "current_time": np.repeat(pdf["current_time"].values, horizon + 1),
                "hours_from_now": np.tile(np.arange(horizon + 1, dtype=np.int32), b),
                "predicted_moisture": out.reshape(-1)})
    return run


def forest_seeds(readings: DataFrame, history: int = S.HISTORY) -> DataFrame:
    """One row per sensor: its newest ``history`` values in time order (a bounded array), newest time/value."""
    t = tail_n(readings, history)
    key = F.struct(*order_cols(readings))
    g = t.groupBy("sensor_id").agg(
        F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in order_cols(readings)], F.col("soil_moisture")))).alias("s"),
        F.max("event_time").alias("current_time"), F.max_by("soil_moisture", key).alias("current_moisture"))
    return g.select("sensor_id", F.transform("s", lambda x: x["soil_moisture"]).alias("history"),
                    "current_time", "current_moisture")


def _ship_by_value() -> None:
    """Pickle this module's roll-out functions by value, so Python workers need no installed copy of the
    package (a cluster would still ship it with --py-files; this keeps the task self-contained)."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def forest_curve(seeds: DataFrame, model_arrays: dict, horizon: int = S.HORIZON_HOURS,
                 confidence: float = ML_CONFIDENCE) -> DataFrame:
    """337 points per sensor: h = 0 is the newest reading, h >= 1 the recursive forest prediction."""
    _ship_by_value()
    spark = seeds.sparkSession
    bc = spark.sparkContext.broadcast(model_arrays)
    from soilcast.operators.decay import spread

    j = spread(seeds).mapInPandas(_rollout_fn(bc, horizon), CURVE_SCHEMA)
    m = F.col("predicted_moisture")
    conf = F.greatest(F.lit(0.3), F.lit(confidence) * (F.lit(1.0) - F.col("hours_from_now") / F.lit(2.0 * horizon)))
    return j.select("sensor_id", "hours_from_now", add_hours(F.col("current_time"), F.col("hours_from_now")).alias("timestamp"),
                    m.alias("predicted_moisture"), threshold_status(m).alias("status"), threshold_colour(m).alias("color"),
                    conf.alias("confidence"), F.lit("ml_random_forest").alias("model_type"))


def forest_forecast(curve: DataFrame, threshold: float = S.WATERING_THRESHOLD, horizon: int = S.HORIZON_HOURS,
                    critical: float = S.CRITICAL_THRESHOLD) -> DataFrame:
    """First h >= 1 whose prediction is at or below the threshold; none -> NONE at the horizon. One aggregate
    over the curve (min_by with a conditional ordering), so the roll-out is evaluated once; it also yields
    the curve's first CRITICAL point."""
    h, m = F.col("hours_from_now"), F.col("predicted_moisture")
    hit = F.when((h >= 1) & (m <= threshold), h)
    crit = F.when(m <= critical, h)
    g = curve.groupBy("sensor_id").agg(
        F.min(hit).alias("h"), F.min_by("predicted_moisture", hit).alias("_hit_m"),
        F.min_by("timestamp", hit).alias("_hit_ts"),
        F.max_by("predicted_moisture", h).alias("_last_m"), F.max("timestamp").alias("_last_ts"),
        F.min_by("timestamp", crit).alias("critical_time"))
    found = F.col("h").isNotNull()
    hours = F.when(found, F.col("h").cast("double")).otherwise(F.lit(float(horizon)))
    return g.select(
        "sensor_id", hours.alias("hours_from_now"),
        F.when(found, F.col("_hit_m")).otherwise(F.col("_last_m")).alias("predicted_moisture"),
        F.when(found, urgency_level(F.col("h"))).otherwise(F.lit("NONE")).alias("urgency"),
        F.when(found, F.lit(ML_CONFIDENCE)).otherwise(F.lit(NONE_CONFIDENCE)).alias("confidence"),
        F.when(found, F.col("_hit_ts")).otherwise(F.col("_last_ts")).alias("predicted_time"),
        F.when(found, F.lit("ML prediction based on 24h history"))
         .otherwise(F.lit("No watering needed in next 14 days (ML prediction)")).alias("message"),
        "critical_time")
