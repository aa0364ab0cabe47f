"""Registered queries: one Spark builder per operator key and, where SQL can say it, an equivalent DuckDB
oracle. Builders take (spark, sf_dir) and read the test-data tables; every numeric result that depends on
floating-point summation order is rounded identically on both sides."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from soilcast.sources.readings import load_readings, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DIGITS = 9
FLAGSHIP = "predict_batch"


def r9(c, digits: int = DIGITS):
    return F.round(c if not isinstance(c, str) else F.col(c), digits)


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# Readings derived from the driver's events table (same rule as sources.readings.readings_from_events).
READINGS_CTE = """readings AS (
  SELECT event_id,
         CASE WHEN user_id % 10 = 9 THEN 'EXT-' ELSE 'SENSOR-' END || lpad(CAST(user_id AS VARCHAR), 5, '0') AS sensor_id,
         ts AS event_time,
         CAST(10 AS DOUBLE) + CAST(0.25 AS DOUBLE) * CAST(json_extract_string(props, '$.k') AS INTEGER) AS temperature_c,
         CAST(40 AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(json_extract_string(props, '$.k') AS INTEGER) AS humidity_pct,
         value / (value + CAST(50 AS DOUBLE)) AS soil_moisture,
         props AS payload
  FROM events)"""


def with_readings(body: str, *ctes: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {READINGS_CTE}{extra}\n{body}"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_readings(spark, sf_dir)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# Importing the query modules fills QUERIES / ORACLE.
def load_all() -> None:
    from soilcast.plans import q_cases, q_forecast, q_results, q_series, q_surface  # noqa: F401
