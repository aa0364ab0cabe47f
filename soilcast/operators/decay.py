"""Exponential decay m = A exp(-t / tau) + offset, fitted for every sensor at once.

For a fixed tau the model is linear in (A, offset), so the least-squares fit separates (variable projection,
Golub & Pereyra 1973): one aggregate per (sensor, tau) collects n, Σe, Σe², Σy, Σey, Σy² with e = exp(-t/tau),
the box-constrained (A, offset) follows in closed form, and tau is searched coarse-to-fine: 10..500 by 10, then
41 values around the best at steps 0.5, 0.025 and 0.00125. Each pass is one join of the sensor's points with
its own tau grid and one aggregate keyed by sensor. Points are the newest 168 readings of a sensor (a bounded
group, cut out of the input by a partial top-n before any shuffle and checkpointed once), so every exchange of
the passes moves at most 168 x 50 rows per sensor, never the input."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from soilcast import schema as S
from soilcast.functions.status import threshold_colour, threshold_status, urgency_level
from soilcast.functions.timefn import add_hours, hours_between
from soilcast.operators.windows import tail_n

A_MIN, A_MAX = S.DECAY_BOUNDS["A"]
TAU_MIN, TAU_MAX = S.DECAY_BOUNDS["tau"]
O_MIN, O_MAX = S.DECAY_BOUNDS["offset"]
COARSE = (10.0, 500.0, 10.0)
REFINE_STEPS = (0.5, 0.025, 0.00125)
REFINE_HALF = 20
SSE_DIGITS = 10
BIG = 1.0e300


def decay_points(readings: DataFrame, tail: int = S.DECAY_TAIL) -> DataFrame:
    """(sensor_id, t hours since the first of the newest ``tail`` readings, y) plus per-sensor facts."""
    t = spread(tail_n(readings, tail))
    w = Window.partitionBy("sensor_id")
    key = F.struct("event_time", "event_id") if "event_id" in readings.columns else F.col("event_time")
    p = t.select("sensor_id", "event_time", F.col("soil_moisture").alias("y"),
                 F.min("event_time").over(w).alias("start_time"),
                 F.max("event_time").over(w).alias("current_time"),
                 F.max_by("soil_moisture", key).over(w).alias("current_moisture"),
                 F.count(F.lit(1)).over(w).alias("n_points"))
    return p.select("sensor_id", hours_between(F.col("start_time"), F.col("event_time")).alias("t"), "y",
                    "start_time", "current_time", "current_moisture", "n_points")


def spread(df: DataFrame, key: str = "sensor_id") -> DataFrame:
    """Hash-partition a bounded per-sensor frame into ``spark.sql.shuffle.partitions`` parts, the session's own
    measure of its data. The grid search is CPU-bound on few bytes: without a number, AQE would coalesce it into
    a task or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def _best_per_tau(sums: DataFrame) -> DataFrame:
    """Closed-form box-constrained (A, offset) for each (sensor, tau) from the sums. Candidates are computed as
    columns first and their SSEs from column references, which keeps expression trees (and planning) small."""
    n, se, see, sy, sey, syy = (F.col(c) for c in ["n", "se", "see", "sy", "sey", "syy"])
    det = see * n - se * se
    a_u = F.try_divide(n * sey - se * sy, det)      # det = 0 when all times are equal: no interior solution
    o_u = F.try_divide(see * sy - se * sey, det)
    x = sums.select("sensor_id", "tau", "n", "se", "see", "sy", "sey", "syy",
                    a_u.alias("au"), o_u.alias("ou"), det.alias("det"))
    ok_u = F.coalesce((F.col("det") > 0) & F.col("au").between(A_MIN, A_MAX) & F.col("ou").between(O_MIN, O_MAX),
                      F.lit(False))
    cand = [  # (A, offset) of the interior solution and of the four box edges
        (F.when(ok_u, F.col("au")).otherwise(F.lit(0.0)), F.when(ok_u, F.col("ou")).otherwise(F.lit(0.0))),
        (F.lit(A_MIN), _clamp((sy - A_MIN * se) / n, O_MIN, O_MAX)),
        (F.lit(A_MAX), _clamp((sy - A_MAX * se) / n, O_MIN, O_MAX)),
        (_clamp((sey - O_MIN * se) / see, A_MIN, A_MAX), F.lit(O_MIN)),
        (_clamp((sey - O_MAX * se) / see, A_MIN, A_MAX), F.lit(O_MAX)),
    ]
    x = x.select("sensor_id", "tau", "n", "se", "see", "sy", "sey", "syy", ok_u.alias("ok"),
                 *[c.alias(f"a{i}") for i, (c, _) in enumerate(cand)],
                 *[c.alias(f"o{i}") for i, (_, c) in enumerate(cand)])

    def cand_struct(i: int) -> Column:
        a, o = F.col(f"a{i}"), F.col(f"o{i}")
        sse = syy - 2 * a * sey - 2 * o * sy + a * a * see + 2 * a * o * se + n * o * o
        key = F.round(sse, SSE_DIGITS)
        if i == 0:
            key = F.when(F.col("ok"), key).otherwise(F.lit(BIG))
        return F.struct(key.alias("k"), a.alias("a"), o.alias("o"), sse.alias("sse"))

    return x.select("sensor_id", "tau", F.array_min(F.array(*[cand_struct(i) for i in range(5)])).alias("c"))


def _pass(points: DataFrame, grid: DataFrame) -> DataFrame:
    """One grid pass: points x the sensor's taus -> sums per (sensor, tau) -> best (A, offset) per tau ->
    argmin per sensor by (rounded SSE, A, tau)."""
    # Per-sensor grids join their points co-partitioned (both sides are hash-partitioned on sensor_id by the
    # one tail shuffle); the hint keeps the planner from broadcasting a side whose size grows with sensors.
    if "sensor_id" in grid.columns:
        x = points.hint("shuffle_hash").join(grid.hint("shuffle_hash"), "sensor_id")
    else:
        x = points.crossJoin(F.broadcast(grid))   # the coarse grid: 50 constant rows
    e = F.exp(-F.col("t") / F.col("tau"))
    y = F.col("y")
    sums = x.groupBy("sensor_id", "tau").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(e).alias("se"), F.sum(e * e).alias("see"),
        F.sum(y).alias("sy"), F.sum(e * y).alias("sey"), F.sum(y * y).alias("syy"))
    per_tau = _best_per_tau(sums)
    best = per_tau.groupBy("sensor_id").agg(
        F.min(F.struct(F.col("c.k").alias("k"), F.col("c.a").alias("a"), F.col("tau"), F.col("c.o").alias("o"),
                       F.col("c.sse").alias("sse"))).alias("b"))
    return best.select("sensor_id", F.col("b.tau").alias("tau"), F.col("b.a").alias("A"), F.col("b.o").alias("offset"),
                       F.col("b.sse").alias("sse"))


def _refine_grid(best: DataFrame, step: float) -> DataFrame:
    j = F.explode(F.sequence(F.lit(0), F.lit(2 * REFINE_HALF))).alias("j")
    g = best.select("sensor_id", "tau", j)
    tau = F.col("tau") + (F.col("j") - REFINE_HALF) * F.lit(step)
    return g.select("sensor_id", tau.alias("tau")).where(F.col("tau").between(TAU_MIN, TAU_MAX))


def decay_fit(readings: DataFrame, tail: int = S.DECAY_TAIL, min_points: int = S.MIN_READINGS) -> DataFrame:
    """Per sensor: A, tau, offset, R², confidence = clamp(R², 0.3, 0.95), fitted (>= 10 points), and the facts
    needed to evaluate the model (start/current time, hours of the newest point, current moisture)."""
    # The points (<= 168 per sensor) are read by five passes. They are written once to the shared checkpoint
    # folder (reliable checkpoint: lineage is cut and a lost executor costs a re-read of the checkpoint, not of
    # the input). Each pass then starts from one leaf instead of repeating the tail sub-plan, which keeps
    # driver-side planning small; the exchanges of the passes move only these bounded points.
    from soilcast.session import cut_lineage
    pts = cut_lineage(decay_points(readings, tail).where(F.col("n_points") >= min_points))
    spark = readings.sparkSession
    lo, hi, step = COARSE
    coarse = spark.range(int(round((hi - lo) / step)) + 1).select((F.lit(lo) + F.col("id") * F.lit(step)).alias("tau"))
    best = _pass(pts.select("sensor_id", "t", "y"), coarse)
    for step in REFINE_STEPS:
        best = _pass(pts.select("sensor_id", "t", "y"), _refine_grid(best, step))
    return fit_quality(pts, best)


def fit_quality(points: DataFrame, best: DataFrame) -> DataFrame:
    """R² = 1 - SSE/SST from the residuals; confidence = clamp(R², 0.3, 0.95). SST = 0 gives 0.95 when
    SSE = 0 and 0.3 otherwise (R² itself is null then)."""
    w = Window.partitionBy("sensor_id")
    j = points.hint("shuffle_hash").join(best.hint("shuffle_hash"), "sensor_id").withColumn("ybar", F.avg("y").over(w))
    yhat = F.col("A") * F.exp(-F.col("t") / F.col("tau")) + F.col("offset")
    g = j.groupBy("sensor_id").agg(
        F.first("A").alias("A"), F.first("tau").alias("tau"), F.first("offset").alias("offset"),
        F.sum((F.col("y") - yhat) ** 2).alias("sse"), F.sum((F.col("y") - F.col("ybar")) ** 2).alias("sst"),
        F.first("n_points").alias("n_points"), F.first("start_time").alias("start_time"),
        F.first("current_time").alias("current_time"), F.first("current_moisture").alias("current_moisture"),
        F.max("t").alias("t_now"))
    r2 = F.when(F.col("sst") > 0, F.lit(1.0) - F.col("sse") / F.col("sst"))
    conf = (F.when(F.col("sst") > 0, F.greatest(F.lit(0.3), F.least(F.lit(0.95), r2)))
            .when(F.col("sse") == 0, F.lit(0.95)).otherwise(F.lit(0.3)))
    return g.select("sensor_id", "n_points", "A", "tau", "offset", r2.alias("r_squared"), conf.alias("confidence"),
                    F.lit(True).alias("fitted"), "start_time", "current_time", "current_moisture", "t_now")


def decay_value(fit_a: Column, tau: Column, offset: Column, t: Column) -> Column:
    return fit_a * F.exp(-t / tau) + offset


def decay_crossing(fit: DataFrame, threshold: float = S.WATERING_THRESHOLD, horizon: int = S.HORIZON_HOURS) -> DataFrame:
    """Hours h in [0, horizon] where the fitted curve meets ``threshold``, in closed form:
    tau * ln(A / (threshold - offset)) - t_now, clamped; a curve that never gets there (offset >= threshold
    or A = 0) gives the horizon. Timestamp: newest reading + least(floor(h), horizon - 1) whole hours."""
    a, tau, o = F.col("A"), F.col("tau"), F.col("offset")
    reach = (a > 0) & (o < threshold)
    raw = tau * F.log(F.try_divide(a, F.lit(threshold) - o)) - F.col("t_now")
    h = F.when(reach, F.least(F.greatest(raw, F.lit(0.0)), F.lit(float(horizon)))).otherwise(F.lit(float(horizon)))
    out = fit.withColumn("hours_from_now", h)
    whole = F.least(F.floor(F.col("hours_from_now") + F.lit(1e-6)), F.lit(horizon - 1)).cast("int")
    return out.select(
        "sensor_id", "current_time", "current_moisture", "hours_from_now",
        decay_value(a, tau, o, F.col("t_now") + F.col("hours_from_now")).alias("predicted_moisture"),
        urgency_level(F.col("hours_from_now")).alias("urgency"),
        add_hours(F.col("current_time"), whole).alias("predicted_time"),
        F.col("confidence"),
        F.format_string("Exponential decay prediction (R² = %.3f)", F.col("r_squared")).alias("message"),
        add_hours(F.col("current_time"), critical_hour()).alias("critical_time"))


def critical_hour(critical: float = S.CRITICAL_THRESHOLD, horizon: int = S.HORIZON_HOURS) -> Column:
    """First whole hour h in [0, horizon] whose clamped curve value is at or below ``critical`` — the first
    CRITICAL point of ``decay_curve`` without building the curve (null if none). The curve is non-increasing
    (A >= 0, exp is semi-monotonic), so the answer is next to ceil(tau ln(A / (critical - offset)) - t_now);
    the neighbours are checked with the very expression the curve uses, so the result equals the curve's."""
    a, tau, o, t = F.col("A"), F.col("tau"), F.col("offset"), F.col("t_now")

    def value(h: Column) -> Column:
        return F.least(F.greatest(decay_value(a, tau, o, t + h), F.lit(0.0)), F.lit(1.0))

    guess = F.when((a > 0) & (o < critical), F.ceil(tau * F.log(F.try_divide(a, F.lit(critical) - o)) - t)) \
        .otherwise(F.lit(0)).cast("long")
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(horizon))
    cands = F.filter(F.array(guess - 1, guess, guess + 1, F.lit(horizon)),
                     lambda h: (h >= 0) & (h <= horizon) & (value(h) <= F.lit(critical)))
    return F.array_min(cands).cast("int")


def decay_critical(fit: DataFrame, critical: float = S.CRITICAL_THRESHOLD, horizon: int = S.HORIZON_HOURS) -> DataFrame:
    first = critical_hour(critical, horizon)
    return fit.select("sensor_id", first.alias("critical_hour"),
                      add_hours(F.col("current_time"), first).alias("critical_time"))


def decay_curve(fit: DataFrame, horizon: int = S.HORIZON_HOURS) -> DataFrame:
    """337 points per fitted sensor (h = 0..336): clamped model value, status, colour, decaying confidence."""
    h = F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("h")
    x = fit.select("sensor_id", "A", "tau", "offset", "t_now", "current_time", "confidence", h)
    m = F.least(F.greatest(decay_value(F.col("A"), F.col("tau"), F.col("offset"), F.col("t_now") + F.col("h")),
                           F.lit(0.0)), F.lit(1.0))
    conf = F.greatest(F.lit(0.3), F.col("confidence") * (F.lit(1.0) - F.col("h") / F.lit(2.0 * horizon)))
    return x.select("sensor_id", F.col("h").cast("int").alias("hours_from_now"),
                    add_hours(F.col("current_time"), F.col("h")).alias("timestamp"),
                    m.alias("predicted_moisture"), threshold_status(m).alias("status"), threshold_colour(m).alias("color"),
                    conf.alias("confidence"), F.lit("exponential_decay").alias("model_type"))
