"""Queries that write to the shared folder, in a session whose master is no local one and whose folder is named without a
scheme (the master is given by name only: no cluster is started). Each ends, with the rows of its SQL."""
import datetime as dt
import json
import math
import os
import subprocess
import sys

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

QUERIES = ["decay_curve", "decay_fit_degenerate", "decay_crossing", "decay_fit", "falling_chart_curve",
           "falling_crossing", "fit_quality", "falling_curve_crossing", "mart_from_batches",
           "observed_and_predicted", "predict_rejects", "recommendations_exponential", "predict_submission"]

RUN = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__ as E
top, names = sys.argv[1], sys.argv[2:]
spark = SparkSession.builder.master("local[4]").config(map={"spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1",
    "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": f"{top}/tables",
    "spark.checkpoint.dir": f"{top}/shared"}).getOrCreate()
spark.sparkContext.master = "spark://host:7077"
failed = {}
for name in names:
    try:
        E.queries()[name](spark, top).write.parquet(f"{top}/out/{name}")
    except Exception as e:
        failed[name] = f"{type(e).__name__}: {e}"[:500]
with open(f"{top}/failed.json", "w") as f:
    json.dump(failed, f)
"""


def _events(path):
    """Seven sensors, 60 readings six hours apart: drying, with a rise now and then."""
    rows = []
    for i, user in enumerate([1, 2, 3, 4, 8, 9, 15]):
        for j in range(60):
            m = 0.15 + 0.5 * math.exp(-(j % 17) / (6.0 + i)) + 0.01 * math.sin(7 * j + i)
            rows.append({"event_id": 60 * i + j, "ts": dt.datetime(2024, 1, 3, i) + dt.timedelta(hours=6 * j, seconds=j),
                         "user_id": user, "event_type": "view", "value": 50 * m / (1 - m), "props": json.dumps({"k": j % 40})})
    pq.write_table(pa.Table.from_pylist(rows), path)


@pytest.fixture(scope="module")
def ran(tmp_path_factory):
    top = tmp_path_factory.mktemp("shared_folder")
    _events(top / "events.parquet")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", RUN, str(top), *QUERIES], env={**os.environ, "PYTHONPATH": root}, cwd=top,
                         timeout=900, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr[-2000:]
    return top, json.loads((top / "failed.json").read_text())


def _rows(con, sql, columns):
    """In the order of the columns that are not double; numbers as they are."""
    rows = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    return sorted(rows, key=lambda r: [repr(v) for v in r if not isinstance(v, float)])


@pytest.mark.parametrize("name", QUERIES)
def test_a_query_off_local_masters_with_a_folder_named_without_a_scheme(ran, name):
    import __spark_entry__ as E

    top, failed = ran
    assert name not in failed, failed[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{top}/events.parquet'")
    sql = E.oracle_sql()[name]
    columns = [f'"{r[0]}"' for r in con.execute(f"DESCRIBE {sql}").fetchall()]
    want = _rows(con, sql, columns)
    got = _rows(con, f"SELECT * FROM '{top}/out/{name}/*.parquet'", columns)
    assert want and len(got) == len(want)
    for g, w in zip(got, want):
        assert [x for x in g if not isinstance(x, float)] == [x for x in w if not isinstance(x, float)]
        assert [x for x in g if isinstance(x, float)] == pytest.approx([x for x in w if isinstance(x, float)], abs=2e-4, nan_ok=True)
