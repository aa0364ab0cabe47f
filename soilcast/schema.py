"""Schemas and fixed parameters of the predictor."""
from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the reference's for equal results.
WATERING_THRESHOLD = 0.3
CRITICAL_THRESHOLD = 0.2
ANOMALY_THRESHOLD = 0.15
EVENT_RISE = 0.15            # watering event: rise above this
EVENT_MAX_GAP_HOURS = 6.0    # ... within this many hours
EVENT_PREV_MAX = 0.7         # ... and previous reading below this
DAYS_SINCE_RISE = 0.2        # rise used by the days-since-watering estimate
FEATURE_RISE = 0.3           # rise counted as a watering in the model features
HISTORY = 24                 # readings of history per model feature row
MIN_READINGS = 10
ML_MIN_READINGS = 50
TRAIN_FRACTION = 0.7
HORIZON_HOURS = 336
DECAY_TAIL = 168
LINEAR_TAIL = 48
RECENT_DAYS = 7
OPTIMAL_LOW, OPTIMAL_HIGH = 0.3, 0.7
ENV_DEFAULTS = (20.0, 50.0, 12.0, 1.0)   # temperature, humidity, light hours, season factor
FOREST_TREES = 100
FOREST_SEED = 42
DEFAULT_SUBMISSION_ID = "external-sensor"
DECAY_BOUNDS = {"A": (0.0, 2.0), "tau": (10.0, 500.0), "offset": (0.0, 1.0)}

READINGS = T.StructType([
    T.StructField("event_id", T.LongType(), True),
    T.StructField("sensor_id", T.StringType(), False),
    T.StructField("event_time", T.TimestampNTZType(), False),
    T.StructField("temperature_c", T.DoubleType(), True),
    T.StructField("humidity_pct", T.DoubleType(), True),
    T.StructField("soil_moisture", T.DoubleType(), True),
    T.StructField("payload", T.StringType(), True),
])

READING_COLUMNS = ["sensor_id", "event_time", "temperature_c", "humidity_pct", "soil_moisture"]

# Message body as published: sensor_id, timestamp, temperature_c|temperature, humidity_pct|humidity, soil_moisture.
MESSAGE_FIELDS = ["sensor_id", "timestamp", "temperature_c", "temperature", "humidity_pct", "humidity", "soil_moisture"]

SUBMISSION = T.StructType([
    T.StructField("sensor_id", T.StringType(), True),
    T.StructField("moisture_readings", T.ArrayType(T.DoubleType()), True),
    T.StructField("timestamps", T.ArrayType(T.StringType()), True),
])
