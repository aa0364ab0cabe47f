"""Per-sensor window operators. All share one spec, W = partition by sensor_id order by (event_time,
event_id), so Catalyst plans one shuffle + one sort for every window column of a query."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from soilcast import schema as S
from soilcast.functions.timefn import hour_bucket, hours_between, season, weekday


def order_cols(df: DataFrame) -> list[str]:
    return ["event_time", "event_id"] if "event_id" in df.columns else ["event_time"]


def series_window(df: DataFrame, key: str = "sensor_id"):
    return Window.partitionBy(key).orderBy(*order_cols(df))


CHUNK = "_chunk"
HALO = "_halo"
CHUNK_ROWS = 100_000   # rows of a sensor per chunk: a longer series is spread over several tasks


def series_frame(df: DataFrame, halo: int, chunk_rows: int | None = None) -> DataFrame:
    """Split every sensor's series into chunks of about ``chunk_rows`` rows for windows with a bounded look-back.

    Returns the rows of ``df`` with ``_chunk``, a global 1-based ``rn`` per sensor, the sensor's total ``_total``
    and ``_halo = false``, plus, for every chunk, copies (``_halo = true``) of the ``halo`` newest rows that
    precede it. A window partitioned by (sensor_id, _chunk) and ordered by time then sees, for each non-halo
    row, exactly the preceding rows a whole-series window would see up to ``halo`` back.

    Rows are counted per (sensor, hour) with map-side combination; running counts over these cells cut the chunks, so
    a sensor with few rows is one chunk without halo copies, and a hot sensor is spread over many. Halos are a
    per-chunk top-n (WindowGroupLimit). Rows without a time sort first, as in a plain window."""
    o = order_cols(df)
    cell = F.coalesce(hour_bucket(F.col("event_time")), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    d = df.withColumn("_cell", cell)
    wc = Window.partitionBy("sensor_id").orderBy("_cell")
    cells = d.groupBy("sensor_id", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.select("sensor_id", "_cell", "_n", F.coalesce(
        F.sum("_n").over(wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    cells = cells.withColumn(CHUNK, F.floor(F.col("_off") / F.lit(chunk_rows or CHUNK_ROWS)))
    d = d.join(cells.select("sensor_id", "_cell", CHUNK), ["sensor_id", "_cell"]).drop("_cell")
    wk = Window.partitionBy("sensor_id").orderBy(CHUNK)
    cs = cells.groupBy("sensor_id", CHUNK).agg(F.sum("_n").alias("_n"), F.min("_off").alias("_off"))
    cs = cs.select("*", F.row_number().over(wk).alias("_ci"), F.sum("_n").over(Window.partitionBy("sensor_id")).alias("_total"))
    # chunks whose halo can reach back into chunk i: those starting within `halo` rows after chunk i ends
    reach = F.count(F.lit(1)).over(Window.partitionBy("sensor_id").orderBy("_off").rangeBetween(0, max(0, halo - 1)))
    cs = cs.withColumn("_reach", reach).withColumn(
        "_span", F.coalesce(F.lead("_reach", 1).over(wk), F.lit(0))).drop("_reach")
    local = Window.partitionBy("sensor_id", CHUNK).orderBy(*o)
    main = d.join(cs, ["sensor_id", CHUNK]).withColumn("rn", F.col("_off") + F.row_number().over(local))
    keep = df.columns + [CHUNK, "rn", "_total"]
    if halo <= 0:
        return main.select(*keep, F.lit(False).alias(HALO))
    # halo candidates: the newest `halo` rows of each chunk that another follows, sent to the next chunks
    back = Window.partitionBy("sensor_id", CHUNK).orderBy(*[F.col(c).desc() for c in o])
    tail = d.join(cs.where(F.col("_span") > 0), ["sensor_id", CHUNK]) \
        .withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= halo) \
        .withColumn("rn", F.col("_off") + F.col("_n") - F.col("_back") + 1)
    sent = tail.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_span")))) \
        .withColumn("_target", F.col("_ci") + F.col("_k"))
    tgt = cs.select("sensor_id", F.col("_ci").alias("_target"), F.col(CHUNK).alias("_tchunk"),
                    F.col("_off").alias("_toff"))
    halo_rows = sent.join(tgt, ["sensor_id", "_target"]).where(F.col("_toff") <= F.col("rn") + halo - 1) \
        .withColumn(CHUNK, F.col("_tchunk"))
    both = main.select(*keep, F.lit(False).alias(HALO)).unionByName(halo_rows.select(*keep, F.lit(True).alias(HALO)))
    # Where both sides come dealt by sensor_id, Spark 4.1 plans their union as dealt so, and its run does not always keep
    # to it ("Can't zip RDDs with unequal numbers of partitions"); a hot sensor's chunks would also meet in one task.
    return both.repartition("sensor_id", CHUNK)


def chunk_window(df: DataFrame):
    return Window.partitionBy("sensor_id", CHUNK).orderBy(*order_cols(df))


def ordered_readings(readings: DataFrame) -> DataFrame:
    """Sort by sensor and time; event_id makes the order total (a stable sort)."""
    return readings.orderBy("sensor_id", *order_cols(readings))


def sensor_analytics(readings: DataFrame, span: int = 24) -> DataFrame:
    """Trailing average over the current and 23 preceding rows, and the previous moisture."""
    c = series_frame(readings, span - 1)
    w = chunk_window(readings)
    return c.select(
        *[x for x in ["event_id", "sensor_id", "event_time", "temperature_c", "humidity_pct", "soil_moisture"]
          if x in readings.columns], HALO,
        F.avg("soil_moisture").over(w.rowsBetween(-(span - 1), 0)).alias("moisture_24h_avg"),
        F.lag("soil_moisture", 1).over(w).alias("prev_moisture"),
    ).where(~F.col(HALO)).drop(HALO).orderBy("sensor_id", *order_cols(readings))


def reading_deltas(readings: DataFrame) -> DataFrame:
    """Moisture difference and hours since the previous reading of the same sensor."""
    c = series_frame(readings, 1)
    w = chunk_window(readings)
    return c.select(
        *[x for x in ["event_id", "sensor_id", "event_time", "soil_moisture"] if x in readings.columns], HALO,
        F.lag("soil_moisture", 1).over(w).alias("prev_moisture"),
        (F.col("soil_moisture") - F.lag("soil_moisture", 1).over(w)).alias("moisture_diff"),
        hours_between(F.lag("event_time", 1).over(w), F.col("event_time")).alias("time_diff_hours"),
    ).where(~F.col(HALO)).drop(HALO)


def watering_events(readings: DataFrame, rise: float = S.EVENT_RISE, max_gap_hours: float = S.EVENT_MAX_GAP_HOURS,
                    prev_max: float = S.EVENT_PREV_MAX) -> DataFrame:
    """Rows that look like a watering: a rise above ``rise`` within ``max_gap_hours`` from a reading below
    ``prev_max``."""
    d = reading_deltas(readings)
    return d.where((F.col("moisture_diff") > rise) & (F.col("time_diff_hours") < max_gap_hours)
                   & (F.col("prev_moisture") < prev_max))


def last_watering(readings: DataFrame, **event_params) -> DataFrame:
    """Per sensor: the newest watering event, or, when none exists, an estimate from the (first) wettest
    reading. Both sides are aggregates keyed by sensor_id, joined on it."""
    from soilcast.operators.marts import driest_wettest

    ev = watering_events(readings, **event_params)
    key = F.struct("event_time", "event_id") if "event_id" in readings.columns else F.col("event_time")
    newest = ev.groupBy("sensor_id").agg(
        F.max_by(F.struct(F.col("event_time").alias("t"), F.col("prev_moisture").alias("before"),
                          F.col("soil_moisture").alias("after"), F.col("moisture_diff").alias("rise")), key).alias("e"))
    base = driest_wettest(readings)
    j = base.join(newest, "sensor_id", "left")
    detected = F.col("e").isNotNull()
    est_days = hours_between(F.col("wettest_time"), F.col("last_time")) / 24.0
    days_since = F.when(detected, hours_between(F.col("e.t"), F.col("last_time")) / 24.0).otherwise(est_days)
    return j.select(
        "sensor_id",
        detected.alias("detected"),
        F.col("e.t").alias("watering_time"),
        F.when(detected, F.least(F.lit(0.95), F.lit(0.5) + F.col("e.rise") * 2)).otherwise(F.lit(0.4)).alias("confidence"),
        F.col("e.before").alias("moisture_before"),
        F.col("e.after").alias("moisture_after"),
        F.col("e.rise").alias("increase_amount"),
        F.when(detected, F.lit("Machine learning pattern recognition")).otherwise(F.lit("ML-based estimation")).alias("method"),
        F.when(detected, F.lit(None).cast("double")).otherwise(est_days).alias("estimated_days_since_watering"),
        F.when(~detected, F.format_string("No clear watering events detected. Estimated %.1f days since last watering.",
                                          est_days)).alias("message"),
        days_since.alias("days_since_watering"),
    )


def tail_n(readings: DataFrame, n: int, newest: bool = True) -> DataFrame:
    """Newest (or oldest) ``n`` rows per sensor, numbered 1.. from that end. The rank filter becomes a
    WindowGroupLimit, so each task ships at most ``n`` rows per sensor to the shuffle: a hot sensor costs
    no more shuffle than any other."""
    o = order_cols(readings)
    w = Window.partitionBy("sensor_id").orderBy(*[F.col(c).desc() if newest else F.col(c).asc() for c in o])
    return readings.withColumn("rn", F.row_number().over(w).cast("bigint")).where(F.col("rn") <= n)


def train_split(readings: DataFrame, fraction: float = S.TRAIN_FRACTION, history: int = S.HISTORY) -> DataFrame:
    """First int(fraction * n) rows by time are training rows; rows with >= ``history`` predecessors among
    them are model targets."""
    c = series_frame(readings, 0).where(~F.col(HALO))       # global row numbers; no look-back needed
    out = c.select("sensor_id", *order_cols(readings), "soil_moisture", F.col("rn").cast("bigint").alias("rn"),
                   F.col("_total").cast("bigint").alias("n"))
    split = F.floor(F.col("n") * F.lit(fraction)).cast("bigint")
    return out.select("*", split.alias("split_idx"),
                      (F.col("rn") <= split).alias("is_train"),
                      ((F.col("rn") <= split) & (F.col("rn") > history)).alias("is_target"))


def history_features(readings: DataFrame, history: int = S.HISTORY, feature_rise: float = S.FEATURE_RISE,
                     days_rise: float = S.DAYS_SINCE_RISE, env: tuple | None = None,
                     env_cols: dict | None = None) -> DataFrame:
    """Model features of every reading that has ``history`` predecessors, from those predecessors only.

    13 features: hour, weekday (Mon = 0), season, days since watering, mean / population std / min of the
    previous 24 values, (h[-1] - h[-24]) / 24, count of rises > 0.3 inside the history, then temperature,
    humidity, light hours and season factor (constants unless ``env_cols`` names columns)."""
    c = series_frame(readings, history)
    w = chunk_window(readings)
    hist = w.rowsBetween(-history, -1)
    inner = w.rowsBetween(-(history - 1), -1)
    m = F.col("soil_moisture")
    delta = m - F.lag(m, 1).over(w)
    base = c.withColumn("rn", F.col("rn").cast("bigint")).withColumn("_delta", delta)
    newest_rise = F.max(F.when(F.col("_delta") > days_rise, F.col("rn"))).over(inner)
    env = env or S.ENV_DEFAULTS
    env_cols = env_cols or {}
    env_names = ["temperature", "humidity", "light_hours", "season_factor"]
    feats = base.select(
        "sensor_id", *order_cols(readings), "rn", HALO, m.alias("target"),
        F.hour("event_time").cast("double").alias("hour_of_day"),
        weekday(F.col("event_time")).cast("double").alias("day_of_week"),
        season(F.col("event_time")).cast("double").alias("season"),
        F.when(newest_rise.isNull(), F.lit(history / 24.0))
         .otherwise((F.col("rn") - newest_rise) / 24.0).alias("days_since_last_water"),
        F.avg(m).over(hist).alias("hist_mean"),
        F.stddev_pop(m).over(hist).alias("hist_std"),
        F.min(m).over(hist).alias("hist_min"),
        ((F.lag(m, 1).over(w) - F.lag(m, history).over(w)) / float(history)).alias("hist_slope"),
        F.sum(F.when(F.col("_delta") > feature_rise, 1).otherwise(0)).over(inner).cast("double").alias("hist_rises"),
        *[(F.col(env_cols[nm]).cast("double") if nm in env_cols else F.lit(float(v))).alias(nm)
          for nm, v in zip(env_names, env)],
    )
    return feats.where((F.col("rn") > history) & ~F.col(HALO)).drop(HALO)


FEATURE_NAMES = ["hour_of_day", "day_of_week", "season", "days_since_last_water", "hist_mean", "hist_std",
                 "hist_min", "hist_slope", "hist_rises", "temperature", "humidity", "light_hours", "season_factor"]


def days_since_rise(readings: DataFrame, history: int = S.HISTORY, days_rise: float = S.DAYS_SINCE_RISE) -> DataFrame:
    """Per reading with a full history: distance from the end of the previous ``history`` values to their
    newest rise above 0.2, in days ((n - i) / 24); none -> n / 24."""
    f = history_features(readings, history=history, days_rise=days_rise)
    return f.select("sensor_id", *order_cols(readings), "rn", "days_since_last_water")


def recent_stats(readings: DataFrame, days: int = S.RECENT_DAYS, low: float = S.OPTIMAL_LOW,
                 high: float = S.OPTIMAL_HIGH) -> DataFrame:
    """Over readings within ``days`` of the sensor's own newest (inclusive): mean, sample std, share in
    [low, high]. The per-sensor newest is an aggregate joined back (partial aggregation and AQE skew-join
    keep a hot sensor splittable), not an unbounded window. The sums behind mean and std are split ones, so a sensor
    alone gets the bits of its batch row, in whatever order its rows are added."""
    newest = readings.groupBy("sensor_id").agg(
        F.max("event_time").alias("_newest"), F.max_by("soil_moisture", F.struct(*order_cols(readings))).alias("_pivot"))
    r = readings.join(newest, "sensor_id").where(
        F.col("event_time") >= F.timestamp_add("DAY", F.lit(-days), F.col("_newest")))
    m = F.col("soil_moisture")
    d = m - F.coalesce(F.col("_pivot"), F.lit(0.0))     # from a value of these rows: equal readings have spread 0
    g = r.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("recent_n"), F.count(m).alias("_n"),
        *split_sum(m, "_m"), *split_sum(d, "_d"), *split_sum(d * d, "_dd"),
        F.avg(m.between(low, high).cast("double")).alias("time_in_optimal_range"),
    )
    n, total, apart, squares = F.col("_n"), *(F.col(f"{x}_hi") + F.col(f"{x}_lo") for x in ("_m", "_d", "_dd"))
    spread = F.greatest(F.lit(0.0), squares - F.try_divide(apart * apart, n))
    return g.select("sensor_id", "recent_n", F.try_divide(total, n).alias("average_moisture_7d"),
                    F.when(n > 1, F.sqrt(F.try_divide(spread, n - 1))).alias("moisture_stability"),
                    "time_in_optimal_range")


def split_sum(x: Column, name: str) -> list[Column]:
    """Two sums, ``<name>_hi`` and ``<name>_lo``, that together are the sum of ``x`` whatever the order of the rows, but
    for rounding far below a double's last bit: values from -1 to 1 are cut at 2^-30, and sums of the upper parts are
    exact up to 2^23 rows. Larger values are summed as they are."""
    small = F.abs(x) <= 1.0
    hi = F.when(small, F.rint(x * 2.0 ** 30) / 2.0 ** 30).otherwise(x)
    return [F.sum(hi).alias(f"{name}_hi"), F.sum(F.when(small, x - hi).otherwise(F.lit(0.0))).alias(f"{name}_lo")]


def _rate_parts(tail: DataFrame) -> DataFrame:
    key = F.struct("event_time", "event_id") if "event_id" in tail.columns else F.col("event_time")
    return tail.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("k"),
        F.min_by("soil_moisture", key).alias("older"),
        F.max_by("soil_moisture", key).alias("newer"),
        hours_between(F.min("event_time"), F.max("event_time")).alias("span_h"),
    )


def drying_rate(readings: DataFrame, n: int = S.LINEAR_TAIL) -> DataFrame:
    """Service drying rate, two ways: ``drying_rate_recent`` over the newest ``n`` readings (older minus
    newer), and ``drying_rate_compat`` over the oldest ``n`` (newer minus older), as a newest-first frame's
    tail gives it. Each is max(0, change / hours), 0 when the span is 0 or fewer than 2 rows."""
    def rate(parts: DataFrame, sign: int, name: str) -> DataFrame:
        change = (F.col("older") - F.col("newer")) * sign
        return parts.select("sensor_id", F.when((F.col("k") >= 2) & (F.col("span_h") > 0),
                                                F.greatest(F.lit(0.0), change / F.col("span_h")))
                            .otherwise(F.lit(0.0)).alias(name))
    recent = rate(_rate_parts(tail_n(readings, n, newest=True)), 1, "drying_rate_recent")
    compat = rate(_rate_parts(tail_n(readings, n, newest=False)), -1, "drying_rate_compat")
    return recent.join(compat, "sensor_id")


def linear_rate(readings: DataFrame, n: int = S.LINEAR_TAIL, floor_rate: float = 0.001,
                default_rate: float = 0.005) -> DataFrame:
    """max(0.001, (first - last) / max(hours, 1)) over the newest ``n`` readings in time order."""
    p = _rate_parts(tail_n(readings, n, newest=True))
    rate = F.when(F.col("k") >= 2, F.greatest(F.lit(floor_rate), (F.col("older") - F.col("newer"))
                                               / F.greatest(F.col("span_h"), F.lit(1.0)))).otherwise(F.lit(default_rate))
    return p.select("sensor_id", F.col("k").alias("rate_readings"), rate.alias("decay_rate"))

