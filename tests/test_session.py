"""The shared folder of a session, by master and settings (stand-ins: no cluster is started)."""
import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from soilcast.session import ensure_checkpoint_dir


def session(master, conf, own=None):
    conf = {"spark.sql.warehouse.dir": "file:/shared/warehouse", **conf}
    hadoop = SimpleNamespace(get=lambda k, d=None: "file:///")
    sc = SimpleNamespace(master=master, used=[], getCheckpointDir=lambda: own,
                         _jsc=SimpleNamespace(hadoopConfiguration=lambda: hadoop))
    sc.setCheckpointDir = sc.used.append
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(
        get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,3000]", "local[4]"])
@pytest.mark.parametrize("path", ["/mnt/shared/ck", "file:///mnt/shared/ck", "hdfs://nn/ck"])
def test_a_named_folder_is_used_as_named(master, path):
    s = session(master, {"spark.checkpoint.dir": path}, own="file:/other")
    assert ensure_checkpoint_dir(s) == path and s.sparkContext.used == [path]


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[3,2,3000]"])
def test_without_a_named_folder(master):
    s = session(master, {}, own="file:/shared/own")
    assert ensure_checkpoint_dir(s) == "file:/shared/own" and s.sparkContext.used == []
    s = session(master, {})
    path = ensure_checkpoint_dir(s)
    assert path.startswith("file:/shared/warehouse/") and ensure_checkpoint_dir(s) == path
    assert s.sparkContext.used == [path, path]


BARE = """
import sys
from pyspark.sql import SparkSession
from soilcast.session import cut_lineage, ensure_checkpoint_dir, scratch_path
spark = SparkSession.builder.master("local[1]").config(map={"spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1",
    "spark.sql.warehouse.dir": sys.argv[1]}).getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
first = ensure_checkpoint_dir(spark)
assert ensure_checkpoint_dir(spark) == first and scratch_path(spark, "models") == f"{first}/models"
assert cut_lineage(spark.range(10)).count() == 10
"""


def test_a_real_session_without_a_named_folder(tmp_path):
    """Spark refuses to set ``spark.checkpoint.dir`` in a running session; an empty settings folder leaves it unnamed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "conf").mkdir()
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path / "conf"), "SOILCAST_SCRATCH": str(tmp_path), "PYTHONPATH": root}
    run = subprocess.run([sys.executable, "-c", BARE, str(tmp_path / "tables")], env=env, cwd=tmp_path, timeout=240,
                         capture_output=True, text=True)
    assert run.returncode == 0, run.stderr[-2000:]
