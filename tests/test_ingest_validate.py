"""Message parsing, key fallback, submission and series validation."""
import base64
import json

import pytest
from pyspark.sql import functions as F

from conftest import series_df
from soilcast.operators.staging import SERIES_REASONS, validate_series
from soilcast.sources import messages as M
from soilcast.sources.submissions import SUBMISSION_REASONS, submitted_series, validate_submission


def b64(obj):
    text = obj if isinstance(obj, str) else json.dumps(obj)
    return base64.b64encode(text.encode()).decode()


def test_messages_keys_and_rejects(spark):
    rows = [
        (1, b64({"sensor_id": "a", "timestamp": "2025-09-30T10:00:00Z", "temperature_c": 21.5, "humidity_pct": 40, "soil_moisture": 0.4})),
        (2, b64({"sensor_id": "b", "timestamp": "2025-09-30T10:00:00", "temperature": 19, "humidity": 55, "soil_moisture": 0.5})),
        (3, b64({"sensor_id": "c", "timestamp": "2025-09-30T10:00:00", "temperature_c": None, "temperature": 19, "soil_moisture": 0.5})),
        (4, b64({"timestamp": "2025-09-30T10:00:00", "soil_moisture": 0.5})),
        (5, b64({"sensor_id": "e", "timestamp": "yesterday", "soil_moisture": 0.5})),
        (6, "%%% not base64 %%%"),
        (7, b64("[1, 2, 3]")),
    ]
    df = spark.createDataFrame(rows, "event_id long, body string")
    out = {r.event_id: r for r in M.parse_messages(df).collect()}
    assert out[1].temperature_c == 21.5 and out[1].humidity_pct == 40.0 and str(out[1].event_time) == "2025-09-30 10:00:00"
    assert out[2].temperature_c == 19.0 and out[2].humidity_pct == 55.0
    assert out[3].temperature_c is None            # explicit null in the first key wins
    assert out[3].humidity_pct is None             # both keys absent
    assert out[4].reject_reason == M.REJECT_REASONS["sensor"]
    assert out[5].reject_reason == M.REJECT_REASONS["time"]
    assert out[6].reject_reason == M.REJECT_REASONS["decode"]
    assert out[7].reject_reason == M.REJECT_REASONS["decode"]
    assert M.ingest_messages(df).count() == 3 and M.message_rejects(df).count() == 4


def test_validate_series_reasons(spark):
    ok = series_df(spark, "ok", [0.5] * 12)
    few = series_df(spark, "few", [0.5] * 9)
    out = series_df(spark, "out", [0.5] * 11 + [1.2])
    nul = series_df(spark, "nul", [0.5] * 11 + [float("nan")])
    res = {r.sensor_id: r for r in validate_series(ok.unionByName(few).unionByName(out).unionByName(nul)).collect()}
    assert res["ok"].status == "valid" and res["ok"].reason is None
    assert res["few"].reason == SERIES_REASONS[1]
    assert res["out"].reason == SERIES_REASONS[4]
    assert res["nul"].reason == SERIES_REASONS[2]
    bad_cols = validate_series(ok.drop("soil_moisture")).collect()[0]
    assert bad_cols.reason == SERIES_REASONS[0]


def test_validate_submission_reasons(spark):
    t = [f"2025-09-{d:02d}T10:00:00" for d in range(1, 11)]
    rows = [("ok", None, [0.5] * 10, t), ("len", "x", [0.5] * 9, t), ("few", "x", [0.5] * 9, t[:9]),
            ("rng", "x", [0.5] * 9 + [1.5], t), ("ts", "x", [0.5] * 10, t[:9] + ["10/09/2025"])]
    df = spark.createDataFrame(rows, "submission_id string, sensor_id string, moisture_readings array<double>, timestamps array<string>")
    res = {r.submission_id: r for r in validate_submission(df).collect()}
    assert res["ok"].status == "valid" and res["ok"].sensor_id == "external-sensor"
    assert res["len"].reason == SUBMISSION_REASONS[0]
    assert res["few"].reason == SUBMISSION_REASONS[1]
    assert res["rng"].reason == SUBMISSION_REASONS[2]
    assert res["ts"].reason == SUBMISSION_REASONS[3]
    rows = submitted_series(df.where(F.col("submission_id") == "ok")).collect()
    assert [r.event_id for r in rows] == list(range(10))


def test_a_long_week_is_one_submission(spark):
    """A sensor-week of more than 10,000 readings stays one request, whole and in time order."""
    from soilcast.sources.submissions import submissions_from_readings
    df = spark.range(12_000).select(
        F.col("id").alias("event_id"), F.lit("SENSOR-1").alias("sensor_id"),
        F.timestamp_add("SECOND", (F.col("id") * 40).cast("int"), F.lit("2025-09-01 00:00:00").cast("timestamp_ntz"))
        .alias("event_time"), F.lit(0.5).alias("soil_moisture"))
    rows = submissions_from_readings(df)
    assert rows.select("submission_id").distinct().count() == 1
    got = rows.orderBy("position").collect()
    assert [r.position for r in got] == list(range(12_000))
    assert [r.ts_text for r in got] == sorted(r.ts_text for r in got)
    assert [tuple(r) for r in validate_submission(rows).collect()] == [("SENSOR-1/2025-09-01", "SENSOR-1", 12_000, "valid", None)]


def test_checks_of_a_submission_are_mergeable_counts(spark):
    """No array is collected: one aggregate with partial (map-side) counts and one exchange of one row a task."""
    from soilcast.sources.submissions import submissions_from_readings
    df = spark.range(100).select(F.col("id").alias("event_id"), F.lit("S").alias("sensor_id"),
                                 F.current_timestamp().cast("timestamp_ntz").alias("event_time"), F.lit(0.5).alias("soil_moisture"))
    rows = submissions_from_readings(df)
    plan = validate_submission(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "count_if" in plan.lower() or "count(" in plan


def test_unequal_and_empty_arrays_as_rows(spark):
    from soilcast.sources.submissions import submission_rows
    df = spark.createDataFrame([("a", "s", [0.1, 0.2, 0.3], ["2025-09-30"]), ("b", None, [], [])],
                               "submission_id string, sensor_id string, moisture_readings array<double>, timestamps array<string>")
    got = sorted(map(tuple, submission_rows(df).collect()), key=repr)
    assert got == sorted([("a", "s", 0, True, 0.1, True, "2025-09-30"), ("a", "s", 1, True, 0.2, False, None),
                          ("a", "s", 2, True, 0.3, False, None), ("b", None, None, False, None, False, None)], key=repr)


def test_null_arrays_are_rejected(spark):
    from soilcast.sources.submissions import SUBMISSION_REASONS, validate_submission
    ok = ["2025-09-30T10:00:00"] * 10
    df = spark.createDataFrame([("a", None, None, ok), ("b", None, [0.5] * 10, None), ("c", None, None, None)],
                               "submission_id string, sensor_id string, moisture_readings array<double>, timestamps array<string>")
    got = {r.submission_id: (r.n_readings, r.status, r.reason) for r in validate_submission(df).collect()}
    assert got == {"a": (0, "rejected", SUBMISSION_REASONS[0]), "b": (10, "rejected", SUBMISSION_REASONS[0]),
                   "c": (0, "rejected", SUBMISSION_REASONS[1])}


def test_parse_iso_forms_equal_python(spark):
    import datetime as dt
    from soilcast.functions.timefn import parse_iso
    texts = ["2025-09-30T10", "2025-09-30 10:00", "20250930T100000", "2025-09-30T10:00:00+02", "2025-09-30", "x", "",
             "2025-09-30T10:00:00.123456789Z", "2025-09-30T10:00:00-05:30", "2025-13-01", "2025-02-30T00:00",
             "2024-03-10T02:30:00", "2025-09-30T10:00:00.5"]
    want = []
    for t in texts:
        try:
            v = dt.datetime.fromisoformat(t)
            want.append(v.astimezone(dt.timezone.utc).replace(tzinfo=None) if v.tzinfo else v)
        except ValueError:
            want.append(None)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
            assert [r.p for r in df.select("i", parse_iso(F.col("t")).alias("p")).orderBy("i").collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_malformed_messages(spark):
    import base64
    from soilcast.sources import messages as M
    good = '{"sensor_id":"a","timestamp":"2025-09-30T10","soil_moisture":%s}'
    cases = [(good % "0.5", None), (good % '"0.5"', None), (good % "null", None), (good % '"NaN"', "measure"),
             (good % '"abc"', "measure"), (good % "0.5" + " x", "decode"), (good % "0.5" + "}", "decode"),
             (good % "0.5" + "," + good % "0.5", "decode"), (b'{"sensor_id":"\xff"}', "decode"), ("[1]", "decode"),
             ("null", "decode"), ("", "decode"), ('{"timestamp":"2025-09-30"}', "sensor"), ('{"sensor_id":"a"}', "time")]
    enc = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    rows = [(i, enc(t)) for i, (t, _) in enumerate(cases)] + [(90, "%%%"), (91, None)]
    got = {r.event_id: r for r in M.parse_messages(spark.createDataFrame(rows, "event_id long, body string")).collect()}
    for i, (_, why) in enumerate(cases):
        assert got[i].reject_reason == (why and M.REJECT_REASONS[why]), cases[i]
    assert {got[90].reject_reason, got[91].reject_reason} == {M.REJECT_REASONS["decode"]}
    twice = enc('{"sensor_id":"a","sensor_id":"b","timestamp":"2025-09-30"}')
    assert M.parse_messages(spark.createDataFrame([(1, twice)], "event_id long, body string")).first().sensor_id == "b"


def test_parse_iso_offsets(spark):
    from soilcast.functions.timefn import parse_iso
    df = spark.createDataFrame([("2025-09-30T10:00:00",), ("2025-09-30T10:00:00Z",), ("2025-09-30T12:30:00+02:30",),
                                ("2025-09-30T05:00:00.250000-05:00",), ("2025-09-30 10:00:00",), ("30/09/2025",)], "t string")
    got = [r.p for r in df.select(parse_iso(F.col("t")).alias("p")).collect()]
    import datetime as dt
    ten = dt.datetime(2025, 9, 30, 10, 0)
    assert got[:3] == [ten, ten, ten] and got[3] == dt.datetime(2025, 9, 30, 10, 0, 0, 250000)
    assert got[4] == ten and got[5] is None


def test_messages_are_parsed_once(spark):
    """The filter on the reject reason does not bring a second decoding or parse into the plan."""
    df = M.ingest_messages(spark.createDataFrame([(1, "e30=")], "event_id long, body string").repartition(2))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("try_to_binary(") + plan.count("unbase64(") <= 2


@pytest.mark.parametrize("text, reason", [
    ("", "decode"), ("[]", "decode"), ("null", "decode"), ('{"sensor_id": "s"} {', "decode"), ('{"x": NaN}', "decode"),
    ("{}", "sensor"), ('{"sensor_id": null}', "sensor"), ('{"sensor_id": "s", "timestamp": null}', "time"),
    ('{"sensor_id": "s", "timestamp": "2024-01-01", "timestamp": "2024"}', "time"),
    ('{"sensor_id": "s", "timestamp": "2024-01-01", "humidity": "NaN"}', "measure"),
    ('{"sensor_id": "s", "timestamp": "2024-01-01", "humidity_pct": null, "humidity": "wet"}', None),
    ('{"sensor_id": 7, "timestamp": "2024", "timestamp": "2024-01-01T05"}', None)])
def test_odd_bodies(spark, text, reason):
    body = base64.b64encode(text.encode()).decode()
    row = M.parse_messages(spark.createDataFrame([(1, body)], "event_id long, body string")).first()
    assert row.reject_reason == (reason and M.REJECT_REASONS[reason])
