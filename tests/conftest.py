import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from soilcast.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="soilcast-tests")
    yield s


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)


T0 = dt.datetime(2025, 9, 30, 12, 0, 0)


def series_df(spark, sensor, values, step_hours=1.0, start=T0):
    """A fixture series: ``values`` at ``step_hours`` spacing ending at ``start`` (oldest first)."""
    n = len(values)
    rows = [(i, sensor, start - dt.timedelta(hours=step_hours * (n - 1 - i)), 20.0, 50.0, float(v), None)
            for i, v in enumerate(values)]
    from soilcast.schema import READINGS
    return spark.createDataFrame(rows, READINGS)
