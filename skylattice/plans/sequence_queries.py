"""Queries of the sequence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.operators import sequence as seq
from skylattice.plans.common import E, events, r6

DAY = 86400.0
RUN = ["run"]


def _views(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "view")


def _all(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d)


def first_differences(spark: SparkSession, d: str) -> DataFrame:
    """Steps in time and value between successive samples."""
    n = seq.neighbours(_views(spark, d), RUN, ["t", "value"]).where("before is not null")
    return n.select("event_id", r6(F.col("t") - F.col("before.t")).alias("dt"), r6(F.col("value") - F.col("before.value")).alias("dv"))


def gradient_nonuniform(spark: SparkSession, d: str) -> DataFrame:
    """Rate of change per day on uneven times."""
    g = seq.gradient(_views(spark, d), RUN).where("gradient is not null")
    return g.select("event_id", r6(F.col("gradient") * DAY).alias("rate"))


def unwrap_phase(spark: SparkSession, d: str) -> DataFrame:
    """Angles without jumps."""
    v = _views(spark, d).withColumn("value", F.pmod(F.col("value"), F.lit(6.25)) - 3.1)
    return seq.unwrap(v, RUN).select("event_id", r6("unwrapped").alias("angle"))


def trapezoid_integral(spark: SparkSession, d: str) -> DataFrame:
    """Integral of each run in value days."""
    return seq.trapezoid(_views(spark, d), RUN).select("run", r6(F.col("integral") / DAY).alias("integral"))


def ema_by_run(spark: SparkSession, d: str) -> DataFrame:
    """Exponential mean with weight 0.1."""
    return seq.ema(_all(spark, d).withColumn("value", F.col("value") / 7), RUN, 0.1).select("event_id", r6("ema").alias("ema"))


def lowpass_wrap(spark: SparkSession, d: str) -> DataFrame:
    """Low pass of angles round the circle."""
    v = _all(spark, d).withColumn("value", F.pmod(F.col("value"), F.lit(6.25)) - 3.1)
    return seq.lowpass_wrap(v, RUN, 0.98).select("event_id", r6("low").alias("low"))


def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions between gaps of more than a day."""
    return seq.gap_sessions(_all(spark, d), RUN, DAY).select("event_id", F.col("session").cast("int").alias("session"))


def loss_streaks(spark: SparkSession, d: str) -> DataFrame:
    """Longest streak of low readings per run, and how many reached three."""
    s = seq.streaks(_all(spark, d).withColumn("low", F.col("value") < 40), RUN, "low")
    return s.groupBy("run").agg(F.max("streak").alias("longest"), F.sum((F.col("streak") == 3).cast("int")).alias("reached_3"))


def rolling_rescan_count(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the last three days, and whether there are four."""
    return seq.rolling(events(spark, d, "error"), RUN, 3 * DAY, {"n": lambda w: F.count("*").over(w)}).select("event_id", "n", (F.col("n") >= 4).alias("escalate"))


def sliding_buffer_span(spark: SparkSession, d: str) -> DataFrame:
    """Span of the samples of the last five days."""
    return seq.rolling(_views(spark, d), RUN, 5 * DAY, {"span": lambda w: F.col("t") - F.min("t").over(w)}).select("event_id", r6("span").alias("span_s"))


def staleness(spark: SparkSession, d: str) -> DataFrame:
    """Whether the last sample is fresh enough at the next."""
    n = seq.neighbours(_views(spark, d), RUN, ["t"])
    return n.select("event_id", F.coalesce(F.col("t") - F.col("before.t") <= DAY / 2, F.lit(False)).alias("fresh"))


def energy_window_best(spark: SparkSession, d: str) -> DataFrame:
    """The 24 hours of most energy of the standardised hourly series of each event type."""
    h = _all(spark, d).groupBy("topic", F.floor(F.col("t") / 3600).alias("bin")).agg(F.avg("value").alias("v"))
    stats = h.groupBy("topic").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = h.join(stats, "topic").withColumn("z", (F.col("v") - F.col("m")) / F.col("s"))
    w = Window.partitionBy("topic").orderBy("bin").rangeBetween(-23, 0)
    e = z.withColumn("e", F.round(F.sum(F.col("z") * F.col("z")).over(w), 6))
    return e.groupBy("topic").agg(F.max_by("bin", F.struct("e", -F.col("bin"))).alias("bin"), r6(F.max("e")).alias("energy"))


def persistence_breach(spark: SparkSession, d: str) -> DataFrame:
    """Whether a condition has held for more than a day."""
    p = seq.persistence(_all(spark, d).withColumn("out", F.col("value") > 60), RUN, "out", DAY)
    return p.select("event_id", r6("elapsed").alias("elapsed_s"), "breach")


def hold_time(spark: SparkSession, d: str) -> DataFrame:
    """Time spent in a state so far."""
    n = seq.neighbours(_all(spark, d), RUN, ["t", "topic"])
    n = n.withColumn("dt", F.when(F.col("before.topic") == "error", F.col("t") - F.col("before.t")).otherwise(0.0)).drop("before", "after")
    return seq.running_sum(n, RUN, "dt", "held").select("event_id", r6("held", 3).alias("held_s"))


def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The last purchase's value at every row."""
    from skylattice.operators.temporal import bracket_join

    e = _all(spark, d)
    b = bracket_join(e.select("event_id", "run", "t"), e.where("topic = 'purchase'").select("run", "t", "value"), RUN, ["value"])
    return b.select("event_id", r6("prev.value").alias("last_good"))


def cumulative_motion(spark: SparkSession, d: str) -> DataFrame:
    """Motion added up along each run, in the map frame."""
    v = _views(spark, d).withColumn("dx", F.cos(F.col("value"))).withColumn("dy", F.sin(F.col("value")))
    s = seq.running_sum(seq.running_sum(v, RUN, "dx", "x"), RUN, "dy", "y")
    return s.select("event_id", r6("x").alias("x"), r6("y").alias("y"))


def dr_displacement(spark: SparkSession, d: str) -> DataFrame:
    """Velocity integrated over the ten days before the last sample on a grid of a day, null if any part has none."""
    from skylattice.operators.temporal import bracket_join, lerp

    v = _views(spark, d)
    ends = v.groupBy("run").agg(F.max("t").alias("t1"))
    grid = ends.select("run", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i"), "t1").withColumn("t", F.col("t1") - (10 - F.col("i")) * DAY)
    b = bracket_join(grid.select("run", "i", "t"), v.drop("event_id"), RUN, ["value"]).withColumn("v", F.when(F.col("prev").isNotNull() & F.col("next").isNotNull(), lerp("value")))
    weight = F.when(F.col("i").isin(0, 10), 0.5).otherwise(1.0)
    return b.groupBy("run").agg(r6(F.when(F.bool_and(F.col("v").isNotNull()), F.sum(F.col("v") * weight))).alias("displacement"))


def _hourly(spark: SparkSession, d: str, topic: str) -> DataFrame:
    return events(spark, d, topic).groupBy(F.floor(F.col("t") / 3600).alias("bin")).agg(F.avg("value").alias("value")).withColumn("g", F.lit(0))


def lag_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of two hourly series at lags of up to twelve hours."""
    s = seq.lag_correlation(_hourly(spark, d, "view"), _hourly(spark, d, "click"), range(-12, 13), ["g"])
    return s.select("lag", "n", r6("corr").alias("corr"))


def lag_xcorr_parabolic(spark: SparkSession, d: str) -> DataFrame:
    """The best lag, refined between bins."""
    s = seq.lag_correlation(_hourly(spark, d, "view"), _hourly(spark, d, "click"), range(-12, 13), ["g"])
    return seq.best_lag(s, ["g"], False, 10).select("lag", r6("corr").alias("corr"), r6("refined").alias("refined"))


def clock_offset_scan(spark: SparkSession, d: str) -> DataFrame:
    """The offset of the largest absolute correlation with enough overlap, accepted or not."""
    s = seq.lag_correlation(_hourly(spark, d, "view"), _hourly(spark, d, "error"), range(-24, 25), ["g"])
    return seq.best_lag(s, ["g"], True, 100).select("lag", r6("corr").alias("corr"), (F.abs("corr") >= 0.3).alias("accepted"))


def anchored_velocity(spark: SparkSession, d: str) -> DataFrame:
    """Velocities over a sliding baseline."""
    return seq.anchored_velocity(_all(spark, d), RUN, DAY / 4, 2 * DAY, 1.0).select("event_id", "velocity")


def takeover_debounce(spark: SparkSession, d: str) -> DataFrame:
    """Runs in which a condition held for a day, and since when it counts for good."""
    p = seq.persistence(_all(spark, d).withColumn("out", F.col("topic") != "view"), RUN, "out", DAY).where("breach")
    return p.groupBy("run").agg(r6(F.min("t")).alias("latched_t"))


_N = "n AS (SELECT *, lag(t) OVER w AS pt, lag(value) OVER w AS pv, lead(t) OVER w AS nt, lead(value) OVER w AS nv FROM s WINDOW w AS (PARTITION BY run ORDER BY t))"
_V = f"WITH {E}, s AS (SELECT * FROM e WHERE topic = 'view')"
_ANGLE = "(value - 6.25 * floor(value / 6.25) - 3.1)"
_ISL = "i AS (SELECT *, sum(CASE WHEN pf IS NULL OR pf = f THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY t) AS island FROM (SELECT *, lag(f) OVER (PARTITION BY run ORDER BY t) AS pf FROM g))"
_HOURS = "a AS (SELECT floor(t / 3600) AS bin, avg(value) AS value FROM e WHERE topic = '{0}' GROUP BY ALL), b AS (SELECT floor(t / 3600) AS bin, avg(value) AS value FROM e WHERE topic = '{1}' GROUP BY ALL), l AS (SELECT unnest(generate_series({2}, {3})) AS lag), c AS (SELECT lag, count(*) AS n, corr(a.value, b.value) AS corr FROM a, l, b WHERE a.bin = b.bin - lag GROUP BY lag)"

QUERIES = {
    f.__name__: f
    for f in (
        first_differences, gradient_nonuniform, unwrap_phase, trapezoid_integral, ema_by_run, lowpass_wrap, gap_sessions, loss_streaks, rolling_rescan_count,
        sliding_buffer_span, staleness, energy_window_best, persistence_breach, hold_time, carry_forward, cumulative_motion, dr_displacement, lag_correlations,
        lag_xcorr_parabolic, clock_offset_scan, anchored_velocity, takeover_debounce,
    )
}
ORACLES = {
    "first_differences": f"{_V}, {_N} SELECT event_id, round(t - pt, 6) AS dt, round(value - pv, 6) AS dv FROM n WHERE pt IS NOT NULL",
    "gradient_nonuniform": f"""{_V}, {_N}, h AS (SELECT *, t - pt AS hs, nt - t AS hd FROM n) SELECT event_id, round(86400.0 * CASE WHEN pt IS NULL THEN (nv - value) / hd WHEN nt IS NULL THEN (value - pv) / hs
ELSE (hs * hs * nv + (hd * hd - hs * hs) * value - hd * hd * pv) / (hs * hd * (hd + hs)) END, 6) AS rate FROM h WHERE pt IS NOT NULL OR nt IS NOT NULL""",
    "unwrap_phase": f"""WITH {E}, s AS (SELECT event_id, run, t, {_ANGLE} AS value FROM e WHERE topic = 'view'), {_N},
k AS (SELECT *, coalesce(-ceil((value - pv - pi()) / (2 * pi())), 0) AS k FROM n)
SELECT event_id, round(value + 2 * pi() * sum(k) OVER (PARTITION BY run ORDER BY t), 6) AS angle FROM k""",
    "trapezoid_integral": f"{_V}, {_N} SELECT run, round(coalesce(sum((t - pt) * (value + pv) / 2), 0) / 86400.0, 6) AS integral FROM n GROUP BY run",
    "ema_by_run": f"""WITH {E}, o AS (SELECT event_id, row_number() OVER w AS i, list(value / 7) OVER (PARTITION BY run ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS a FROM e WINDOW w AS (PARTITION BY run ORDER BY t, event_id))
SELECT event_id, round(list_reduce(a, lambda p, v: 0.9 * p + 0.1 * v), 6) AS ema FROM o""",
    "lowpass_wrap": f"""WITH {E}, o AS (SELECT event_id, list({_ANGLE}) OVER (PARTITION BY run ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS a FROM e)
SELECT event_id, round(list_reduce(a, lambda p, v: p + (1 - 0.98::DOUBLE) * ((v - p + pi()) - 2 * pi() * floor((v - p + pi()) / (2 * pi())) - pi()), 0.0::DOUBLE), 6) AS low FROM o""",
    "gap_sessions": f"WITH {E}, n AS (SELECT *, lag(t) OVER (PARTITION BY run ORDER BY t) AS pt FROM e) SELECT event_id, CAST(sum(CASE WHEN t - pt > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY t) AS INTEGER) AS session FROM n",
    "loss_streaks": f"""WITH {E}, g AS (SELECT *, value < 40 AS f FROM e), {_ISL}, k AS (SELECT run, CAST(CASE WHEN f THEN row_number() OVER (PARTITION BY run, island ORDER BY t) ELSE 0 END AS INTEGER) AS streak FROM i)
SELECT run, max(streak) AS longest, CAST(sum(CASE WHEN streak = 3 THEN 1 ELSE 0 END) AS BIGINT) AS reached_3 FROM k GROUP BY run""",
    "rolling_rescan_count": f"WITH {E}, c AS (SELECT event_id, count(*) OVER (PARTITION BY run ORDER BY t RANGE BETWEEN 259200.0 PRECEDING AND CURRENT ROW) AS n FROM e WHERE topic = 'error') SELECT event_id, n, n >= 4 AS escalate FROM c",
    "sliding_buffer_span": f"{_V} SELECT event_id, round(t - min(t) OVER (PARTITION BY run ORDER BY t RANGE BETWEEN 432000.0 PRECEDING AND CURRENT ROW), 6) AS span_s FROM s",
    "staleness": f"{_V}, {_N} SELECT event_id, coalesce(t - pt <= 43200, false) AS fresh FROM n",
    "energy_window_best": f"""WITH {E}, h AS (SELECT topic, CAST(floor(t / 3600) AS BIGINT) AS bin, avg(value) AS v FROM e GROUP BY ALL), z AS (SELECT *, (v - avg(v) OVER (PARTITION BY topic)) / stddev_pop(v) OVER (PARTITION BY topic) AS z FROM h),
w AS (SELECT topic, bin, round(sum(z * z) OVER (PARTITION BY topic ORDER BY bin RANGE BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS energy FROM z)
SELECT topic, bin, energy FROM w QUALIFY row_number() OVER (PARTITION BY topic ORDER BY energy DESC, bin) = 1""",
    "persistence_breach": f"""WITH {E}, g AS (SELECT *, value > 60 AS f FROM e), {_ISL}, p AS (SELECT event_id, CASE WHEN f THEN t - min(t) OVER (PARTITION BY run, island) END AS el FROM i)
SELECT event_id, round(el, 6) AS elapsed_s, coalesce(el > 86400, false) AS breach FROM p""",
    "hold_time": f"""WITH {E}, n AS (SELECT event_id, run, t, CASE WHEN lag(topic) OVER w = 'error' THEN t - lag(t) OVER w ELSE 0.0 END AS dt FROM e WINDOW w AS (PARTITION BY run ORDER BY t))
SELECT event_id, round(sum(dt) OVER (PARTITION BY run ORDER BY t), 3) AS held_s FROM n""",
    "carry_forward": f"WITH {E} SELECT event_id, round(last_value(CASE WHEN topic = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY run ORDER BY t), 6) AS last_good FROM e",
    "cumulative_motion": f"{_V} SELECT event_id, round(sum(cos(value)) OVER (PARTITION BY run ORDER BY t), 6) AS x, round(sum(sin(value)) OVER (PARTITION BY run ORDER BY t), 6) AS y FROM s",
    "dr_displacement": f"""{_V}, g AS (SELECT run, i, max(t) - (10 - i) * 86400.0 AS t FROM s, generate_series(0, 10) AS x(i) GROUP BY run, i),
p AS (SELECT g.*, s.t AS pt, s.value AS pv FROM g ASOF LEFT JOIN s ON g.run = s.run AND g.t >= s.t), b AS (SELECT p.*, s.t AS nt, s.value AS nv FROM p ASOF LEFT JOIN s ON p.run = s.run AND p.t <= s.t),
v AS (SELECT run, i, pv + CASE WHEN nt > pt THEN (t - pt) / (nt - pt) ELSE 0.0 END * (nv - pv) AS v FROM b)
SELECT run, round(CASE WHEN bool_and(v IS NOT NULL) THEN sum(v * CASE WHEN i IN (0, 10) THEN 0.5 ELSE 1.0 END) END, 6) AS displacement FROM v GROUP BY run""",
    "lag_correlations": f"WITH {E}, {_HOURS.format('view', 'click', -12, 12)} SELECT CAST(lag AS INTEGER) AS lag, n, round(corr, 6) AS corr FROM c",
    "lag_xcorr_parabolic": f"""WITH {E}, {_HOURS.format('view', 'click', -12, 12)}, k AS (SELECT *, lag(corr) OVER (ORDER BY lag) AS l, lead(corr) OVER (ORDER BY lag) AS r FROM c WHERE n >= 10)
SELECT CAST(lag AS INTEGER) AS lag, round(corr, 6) AS corr, round(lag + coalesce(CASE WHEN l - 2 * corr + r <> 0 THEN 0.5 * (l - r) / (l - 2 * corr + r) ELSE 0.0 END, 0.0), 6) AS refined FROM k ORDER BY corr DESC, lag LIMIT 1""",
    "clock_offset_scan": f"WITH {E}, {_HOURS.format('view', 'error', -24, 24)} SELECT CAST(lag AS INTEGER) AS lag, round(corr, 6) AS corr, abs(corr) >= 0.3 AS accepted FROM c WHERE n >= 100 ORDER BY abs(corr) DESC, lag LIMIT 1",
    "takeover_debounce": f"""WITH {E}, g AS (SELECT *, topic <> 'view' AS f FROM e), {_ISL}, p AS (SELECT run, t, CASE WHEN f THEN t - min(t) OVER (PARTITION BY run, island) END AS el FROM i)
SELECT run, round(min(t), 6) AS latched_t FROM p WHERE el > 86400 GROUP BY run""",
}
