"""Session helpers: a configured local session for tests/bench, and the shared checkpoint folder."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHOSEN_DIR = "soilcast.checkpoint.dir"   # the folder chosen where none is named; Spark lets no one set its own key later


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "soilcast") -> SparkSession:
    """Local session used by tests and bench. On a cluster, build the session with the cluster's own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables: the one ``spark.checkpoint.dir`` names, else the one
    the context already checkpoints to. A named folder is taken at its word, also one without a scheme: whether a path
    is a shared mount cannot be told from its spelling. With neither, a ``local[n]`` session gets a fresh scratch folder
    and any other (its executors may see no folder of the driver) a folder in the warehouse, which they share.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(CHOSEN_DIR, None)
    if not path:
        if sc.getCheckpointDir():
            return sc.getCheckpointDir()
        if sc.master == "local" or sc.master.startswith("local["):
            path = tempfile.mkdtemp(prefix="soilcast-ckpt-", dir=os.environ.get("SOILCAST_SCRATCH", "/tmp"))
        else:
            path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_soilcast-{uuid.uuid4().hex}"
        spark.conf.set(CHOSEN_DIR, path)
    sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for intermediate tables and models."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}"


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder. The frame is persisted for the duration of the
    write: an un-cached reliable checkpoint would compute the plan twice (once for the action, once for the
    checkpoint files). The result keeps the frame's partitioning and survives executor loss."""
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()
