"""Sensor messages: base64(UTF-8 JSON object) bodies -> reading rows, with alternative keys and rejects."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from soilcast.functions.timefn import parse_iso

# Message keys: the first *present* key wins (an explicit null in it wins too).
KEY_PAIRS = {"temperature_c": ("temperature_c", "temperature"), "humidity_pct": ("humidity_pct", "humidity")}
REJECT_REASONS = {
    "decode": "body is not base64 UTF-8 JSON object",
    "sensor": "missing sensor_id",
    "time": "missing or invalid timestamp",
    "measure": "a measure is not a number",
}


def _num(v: Column) -> Column:
    return v.try_cast("double")


def messages_from_readings(readings: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Test messages built from readings: full keys, short keys for event type 'click', and an explicit null
    first key for 'error' (so the value under the short key must be ignored)."""
    iso = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    ts = F.when(F.col("sensor_id").startswith("EXT-"), F.concat(iso, F.lit("Z"))).otherwise(iso)
    num = lambda c: F.col(c).cast("string")
    head = F.concat(F.lit('{"sensor_id": "'), F.col("sensor_id"), F.lit('", "timestamp": "'), ts, F.lit('"'))
    full = F.concat(head, F.lit(', "temperature_c": '), num("temperature_c"), F.lit(', "humidity_pct": '),
                    num("humidity_pct"), F.lit(', "soil_moisture": '), num("soil_moisture"), F.lit("}"))
    short = F.concat(head, F.lit(', "temperature": '), num("temperature_c"), F.lit(', "humidity": '),
                     num("humidity_pct"), F.lit(', "soil_moisture": '), num("soil_moisture"), F.lit("}"))
    nulls = F.concat(head, F.lit(', "temperature_c": null, "temperature": '), num("temperature_c"),
                     F.lit(', "humidity_pct": null, "humidity": '), num("humidity_pct"),
                     F.lit(', "soil_moisture": '), num("soil_moisture"), F.lit("}"))
    body = F.when(F.col("event_type") == "click", short).when(F.col("event_type") == "error", nulls).otherwise(full)
    return readings.select("event_id", *(keep or []), F.base64(F.encode(body, "UTF-8")).alias("body"))


def decode_body(body: Column) -> Column:
    """base64 -> UTF-8 text; null when the body is not valid base64 or not valid UTF-8."""
    raw = F.try_to_binary(body, F.lit("base64")).cast("string")
    return F.when(F.is_valid_utf8(raw), raw)


def _objects(text: Column) -> Column:
    """All objects of a text, each as a map of its keys and their values' texts, in one parse. As elements of an array: text
    before or after an object does not parse. A repeated key stays in the map as often as it comes."""
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>",
                       {"allowNonNumericNumbers": "false"})


def _only(objects: Column) -> Column:
    return F.when(F.size(objects) == 1, F.get(objects, F.lit(0)))


def fields(body: Column) -> Column:
    """The JSON object of a body as a map of texts; null unless the body is exactly one object."""
    return _only(_objects(decode_body(body)))


def has_key(m: Column, key: str) -> Column:
    return F.map_contains_key(m, key)


def value(m: Column, key: str) -> Column:
    """Text under a key, null without it. Of a repeated key the last value counts."""
    from_end = F.array_position(F.reverse(F.map_keys(m)), key).cast("int")
    return F.element_at(F.map_values(m), -F.nullif(from_end, F.lit(0)))


def key_fallback(m: Column, first: str, second: str) -> Column:
    """Value under the first key when the key is present (even if null), else under the second."""
    return F.when(has_key(m, first), value(m, first)).otherwise(value(m, second))


def _once(df: DataFrame, keep: list[str], **new: Column) -> DataFrame:
    """``keep`` and new columns, out of a one-row generator: later filters and projections are not merged into it, which
    would evaluate the columns again for each use."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in new.items()]))))


def _not_number(text: Column) -> Column:
    x = text.try_cast("double")
    return text.isNotNull() & (x.isNull() | F.isnan(x))


def parse_messages(messages: DataFrame) -> DataFrame:
    """Decode and parse every message once; keeps the decoded text as ``payload`` and a ``reject_reason``."""
    rest = [c for c in messages.columns if c != "body"]
    x = _once(messages, rest, payload=decode_body(F.col("body")))
    x = _once(x, [*rest, "payload"], _objects=_objects(F.col("payload")))
    x = x.select(*rest, "payload", _only(F.col("_objects")).alias("_m"))
    mm = F.col("_m")
    x = _once(x, [*rest, "payload"], _bad=mm.isNull(), sensor_id=value(mm, "sensor_id"),
              event_time=parse_iso(value(mm, "timestamp")), _t=key_fallback(mm, *KEY_PAIRS["temperature_c"]),
              _h=key_fallback(mm, *KEY_PAIRS["humidity_pct"]), _s=value(mm, "soil_moisture"))
    return x.select(
        *rest, "sensor_id", "event_time",
        _num(F.col("_t")).alias("temperature_c"), _num(F.col("_h")).alias("humidity_pct"),
        _num(F.col("_s")).alias("soil_moisture"), "payload",
        F.when(F.col("_bad"), F.lit(REJECT_REASONS["decode"]))
         .when(F.col("sensor_id").isNull(), F.lit(REJECT_REASONS["sensor"]))
         .when(F.col("event_time").isNull(), F.lit(REJECT_REASONS["time"]))
         .when(_not_number(F.col("_t")) | _not_number(F.col("_h")) | _not_number(F.col("_s")),
               F.lit(REJECT_REASONS["measure"])).alias("reject_reason"))


def ingest_messages(messages: DataFrame) -> DataFrame:
    """Valid messages as reading rows (the batch form of the stream)."""
    return parse_messages(messages).where(F.col("reject_reason").isNull()).drop("reject_reason")


def message_rejects(messages: DataFrame) -> DataFrame:
    return parse_messages(messages).where(F.col("reject_reason").isNotNull())
