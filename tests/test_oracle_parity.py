"""Registered queries against their DuckDB oracles (small scale; the full sweep runs with SOILCAST_FULL=1)."""
import os

import pytest

from conftest import SF001
from oracle_harness import compare, duck

FAST = ["hourly_rollup", "sensor_analytics", "history_features", "last_watering", "recent_stats", "drying_rate",
        "validate_series", "decay_fit", "decay_crossing", "health_metrics", "predict_submission", "sensor_summary_exponential",
        "ingest_messages", "known_sensor_check"]


def _keys():
    import __spark_entry__ as E
    if os.environ.get("SOILCAST_FULL"):
        return sorted(E.oracle_sql())
    return FAST


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("key", _keys())
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, key, SF001, con)
    assert r.get("names_ok"), r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r.get("values_ok"), r


def test_entry_contract(spark):
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    df = E.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 5


@pytest.mark.parametrize("key", ["hourly_rollup", "parse_iso_time", "rebase_time", "predict_submission"])
def test_results_do_not_depend_on_session_time_zone(spark, con, key):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = compare(spark, key, SF001, con)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert r.get("values_ok"), r


SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
                 "timestamp_ntz": "TIMESTAMP", "date": "DATE", "decimal(2,1)": "DECIMAL(2,1)"}


def test_column_types_match_oracle(spark, con):
    """Every registered oracle returns the same column types as its Spark query."""
    import __spark_entry__ as E
    bad = {}
    for k, sql in sorted(E.oracle_sql().items()):
        st = {f.name: f.dataType.simpleString() for f in E.queries()[k](spark, SF001).schema.fields}
        rel = con.sql(sql)
        dt = dict(zip(rel.columns, [str(t) for t in rel.types]))
        diff = {c: (t, dt.get(c)) for c, t in st.items() if SPARK_TO_DUCK.get(t, t) != dt.get(c)}
        if diff:
            bad[k] = diff
    assert not bad, bad
