"""Stored forests: a trained model is kept under a key of what it was trained from, and looked up before training.

The key is a SHA-256 over the number of series rows, two order-free hashes of them, the training parameters and the
version of the training rule, so equal input gives the same key on any machine and in any order of rows, and a change of
either is another model. An entry is a folder ``<store>/<key>`` in the shared checkpoint storage with the node table of
all trees (Parquet, written under a name of its own) and a manifest that names it, written last by a rename: a reader
sees a whole model or none, two trainers at once leave one manifest of equal models, and a job that dies in between
leaves no entry. Computing the key is one narrow scan with a map-side aggregate; nothing is shuffled but one row a task.
"""
from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from soilcast.operators import forest, staging
from soilcast.operators.windows import order_cols
from soilcast.session import scratch_path

RULE = 1                 # raise when training rows or features change: older entries are then never found
IN_PROCESS = 4           # decoded models the driver keeps
_decoded: dict[str, dict] = {}


def store_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "models")


def series_columns(readings: DataFrame) -> list[str]:
    return ["sensor_id", *order_cols(readings), "soil_moisture"]


def model_key(readings: DataFrame, params: dict | None = None) -> str:
    """Key of the model of ``readings`` under ``params`` (arguments of ``forest_train``)."""
    cols = [F.col(c) for c in series_columns(readings)]
    h = F.xxhash64(*cols, *[c.isNull() for c in cols])
    r = readings.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    said = {"rule": RULE, "rows": r.n, "sum": str(r.s), "xor": str(r.x), "columns": series_columns(readings),
            "params": dict(sorted((params or {}).items()))}
    return hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _read_manifest(spark: SparkSession, key: str) -> dict | None:
    fs, p = _files(spark, f"{store_folder(spark)}/{key}/manifest.json")
    if not fs.exists(p):
        return None
    return json.loads("".join(r.value for r in spark.read.text(p.toString()).collect()))     # one short line


def _write_manifest(spark: SparkSession, key: str, said: dict) -> None:
    at = f"{store_folder(spark)}/{key}"
    fs, temp = _files(spark, f"{at}/_manifest-{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps(said, sort_keys=True).encode()))
    out.close()
    _, final = _files(spark, f"{at}/manifest.json")
    if not fs.rename(temp, final):
        fs.delete(temp, False)      # another trainer of the same model was first


def stored(spark: SparkSession, key: str) -> dict | None:
    """The node arrays of the model under ``key``, or None. An entry whose node table is not whole counts as none."""
    if f"{store_folder(spark)}/{key}" in _decoded:
        return _decoded[f"{store_folder(spark)}/{key}"]
    said = _read_manifest(spark, key)
    if said is None:
        return None
    arrays = forest.arrays_of_nodes(spark.read.schema(forest.NODE_SCHEMA).parquet(
        f"{store_folder(spark)}/{key}/{said['nodes']}"), said["depth"])
    if len(arrays["value"]) != said["n_nodes"]:
        return None
    return _keep(spark, key, arrays)


def _keep(spark: SparkSession, key: str, arrays: dict) -> dict:
    while len(_decoded) >= IN_PROCESS:
        _decoded.pop(next(iter(_decoded)))
    _decoded[f"{store_folder(spark)}/{key}"] = arrays
    return arrays


def put(spark: SparkSession, key: str, model) -> dict:
    """Stores a fitted model; returns its node arrays."""
    name = f"nodes-{uuid.uuid4().hex}"
    arrays = forest.forest_arrays(model, keep_nodes=f"{store_folder(spark)}/{key}/{name}", spark=spark)
    _write_manifest(spark, key, {"nodes": name, "n_nodes": len(arrays["value"]), "depth": arrays["depth"]})
    return _keep(spark, key, arrays)


def forget(spark: SparkSession, key: str) -> None:
    """Removes an entry."""
    _decoded.pop(f"{store_folder(spark)}/{key}", None)
    fs, p = _files(spark, f"{store_folder(spark)}/{key}")
    fs.delete(p, True)


def forest_of(readings: DataFrame, params: dict | None = None, key: str | None = None) -> dict:
    """Node arrays of the model of ``readings``: that of all valid sensors with enough readings. Trains only if the store
    has none. ``key``: the model's key where the caller knows it (then ``readings`` is not scanned if it is stored)."""
    spark = readings.sparkSession
    key = key or model_key(readings, params)
    arrays = stored(spark, key)
    if arrays is None:
        # read by several branches of the training rows, then dropped: Parquet takes a fraction of a checkpoint's disk
        series = readings.select(*series_columns(readings))
        path = scratch_path(spark, f"series-{uuid.uuid4().hex}")
        series.write.parquet(path)
        series = spark.read.schema(series.schema).parquet(path)
        valid = staging.validate_series(series).where(F.col("status") == "valid").select("sensor_id")
        rows = forest.forest_training_rows(series.join(valid, "sensor_id", "left_semi"))
        try:
            arrays = put(spark, key, forest.forest_train(rows, **(params or {})))
        finally:
            forest._delete(spark, path)
    return arrays
