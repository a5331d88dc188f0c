"""Queries of the temporal joins and of sampling in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.sequence import index_in_order
from skylattice.operators.temporal import age, bracket_join, clock_offset, forward_clamped, lerp, nearest, two_stage, velocity_pairs
from skylattice.plans.common import E, events, r6

DAY = 86400.0


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return events(spark, d, "click").drop("value"), events(spark, d, "view").drop("event_id")


def _bracketed(spark: SparkSession, d: str) -> DataFrame:
    return bracket_join(*_sides(spark, d), ["run"], ["value"])


def stride_sample_frames(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth frame of each run in time order, with its index."""
    return index_in_order(events(spark, d, "click"), ["run"]).where("pmod(k, 10) = 0").select("event_id", "run", "k")


def frame_range_gate(spark: SparkSession, d: str) -> DataFrame:
    """Frames [2, 8) of each run."""
    return index_in_order(events(spark, d, "click"), ["run"]).where("k >= 2 and k < 8").select("event_id", "run", "k")


def camera_times(spark: SparkSession, d: str) -> DataFrame:
    """Frame times by the storage clock, without payloads."""
    return events(spark, d, "click").select("run", r6("t").alias("t"))


def asof_backward_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest sample at or before each frame."""
    b = _bracketed(spark, d).where("prev is not null")
    return b.select("event_id", r6("prev.value").alias("value"), r6(age("prev")).alias("age_s"))


def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    """The first sample at or after each frame, else the last."""
    b = _bracketed(spark, d).withColumn("m", forward_clamped()).where("m is not null")
    return b.select("event_id", r6("m.value").alias("value"))


def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The nearest sample, however far."""
    b = _bracketed(spark, d).withColumn("m", nearest()).where("m is not null")
    return b.select("event_id", r6("m.value").alias("value"))


def asof_nearest_tol(spark: SparkSession, d: str) -> DataFrame:
    """The nearest sample within six hours."""
    b = _bracketed(spark, d).withColumn("m", nearest(tolerance=DAY / 4)).where("m is not null")
    return b.select("event_id", r6("m.value").alias("value"), r6(F.abs(F.col("t") - F.col("m.t"))).alias("age_s"))


def asof_two_stage_offset(spark: SparkSession, d: str) -> DataFrame:
    """The nearest sample within six hours by raw stamps, else by stamps a day later."""
    m = two_stage(*_sides(spark, d), ["run"], ["value"], F.lit(DAY), DAY / 4).where("match is not null")
    return m.select("event_id", "stage", r6("match.value").alias("value"))


def bracket_interp_gate(spark: SparkSession, d: str) -> DataFrame:
    """Interpolated samples whose nearer neighbour is within twelve hours."""
    b = _bracketed(spark, d).withColumn("x", lerp("value", max_age=DAY / 2)).where("x is not null")
    return b.select("event_id", r6("x").alias("value"))


def interp_clamped_truth(spark: SparkSession, d: str) -> DataFrame:
    """Samples interpolated at each frame, the end values held beyond the ends."""
    b = _bracketed(spark, d).withColumn("x", lerp("value")).where("x is not null")
    return b.select("event_id", r6("x").alias("value"))


def velocity_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Rates over a baseline of between six hours and three days."""
    v = velocity_pairs(events(spark, d, "view", "purchase").drop("topic"), ["run"], 3 * DAY, DAY / 4, 3 * DAY)
    return v.select("event_id", r6("dt").alias("dt"), r6(F.col("rate") * DAY).alias("rate"))


def clock_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Offset between two clocks from their first stamps."""
    return clock_offset(*_sides(spark, d), ["run"]).select("run", r6("offset").alias("offset_s"))


def track_error_report(spark: SparkSession, d: str) -> DataFrame:
    """How far each run's estimates are from interpolated truth: median, mean, 90 % point, worst, share beyond 30."""
    frames, truth = events(spark, d, "click"), events(spark, d, "view").drop("event_id")
    b = bracket_join(frames.withColumnRenamed("value", "estimate"), truth, ["run"], ["value"])
    e = b.withColumn("err", F.abs(F.col("estimate") - lerp("value"))).where("err is not null")
    return e.groupBy("run").agg(
        F.count("*").alias("n"),
        r6(F.percentile("err", F.lit(0.5))).alias("median"),
        r6(F.avg("err")).alias("mean"),
        r6(F.percentile("err", F.lit(0.9))).alias("p90"),
        r6(F.max("err")).alias("worst"),
        r6(F.avg((F.col("err") > 30).cast("double"))).alias("share_over_30"),
    )


def fresh_altitude_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The bracketed value within six hours, else the newest sample if it is younger than two days."""
    b = _bracketed(spark, d).withColumn("x", F.coalesce(lerp("value", max_age=DAY / 4), F.when(age("prev") < 2 * DAY, F.col("prev.value")))).where("x is not null")
    return b.select("event_id", r6("x").alias("value"))


_SIDES = f"WITH {E}, f AS (SELECT * FROM e WHERE topic = 'click'), s AS (SELECT * FROM e WHERE topic = 'view')"
_BRACKET = (
    _SIDES
    + """, p AS (SELECT f.event_id, f.run, f.t, f.value AS estimate, s.t AS pt, s.value AS pv FROM f ASOF LEFT JOIN s ON f.run = s.run AND f.t >= s.t),
b AS (SELECT p.*, s.t AS nt, s.value AS nv FROM p ASOF LEFT JOIN s ON p.run = s.run AND p.t <= s.t),
c AS (SELECT *, coalesce(pt, nt) AS lt, coalesce(pv, nv) AS lv, coalesce(nt, pt) AS ht, coalesce(nv, pv) AS hv FROM b),
x AS (SELECT *, least(coalesce(abs(t - pt), 1e300), coalesce(abs(t - nt), 1e300)) AS best,
      lv + CASE WHEN ht > lt THEN least(greatest((t - lt) / (ht - lt), 0.0), 1.0) ELSE 0.0 END * (hv - lv) AS v,
      CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL OR abs(t - pt) <= abs(t - nt) THEN pv ELSE nv END AS near,
      CASE WHEN pt IS NULL THEN nt WHEN nt IS NULL OR abs(t - pt) <= abs(t - nt) THEN pt ELSE nt END AS near_t FROM c)
"""
)
_K = f"WITH {E}, k AS (SELECT event_id, run, CAST(row_number() OVER (PARTITION BY run ORDER BY t, event_id) - 1 AS INTEGER) AS k FROM e WHERE topic = 'click')"

QUERIES = {
    f.__name__: f
    for f in (
        track_error_report, stride_sample_frames, frame_range_gate, camera_times, asof_backward_latest, asof_forward, asof_nearest,
        asof_nearest_tol, asof_two_stage_offset, bracket_interp_gate, interp_clamped_truth, velocity_baseline, clock_bridge, fresh_altitude_fallback,
    )
}
ORACLES = {
    "stride_sample_frames": _K + " SELECT event_id, run, k FROM k WHERE k % 10 = 0",
    "frame_range_gate": _K + " SELECT event_id, run, k FROM k WHERE k >= 2 AND k < 8",
    "camera_times": f"WITH {E} SELECT run, round(t, 6) AS t FROM e WHERE topic = 'click'",
    "asof_backward_latest": _BRACKET + "SELECT event_id, round(pv, 6) AS value, round(abs(t - pt), 6) AS age_s FROM x WHERE pt IS NOT NULL",
    "asof_forward": _BRACKET + "SELECT event_id, round(hv, 6) AS value FROM x WHERE hv IS NOT NULL",
    "asof_nearest": _BRACKET + "SELECT event_id, round(near, 6) AS value FROM x WHERE near IS NOT NULL",
    "asof_nearest_tol": _BRACKET + "SELECT event_id, round(near, 6) AS value, round(abs(t - near_t), 6) AS age_s FROM x WHERE abs(t - near_t) <= 21600",
    "asof_two_stage_offset": _SIDES
    + """, q AS (SELECT event_id, run, t, t AS raw, 1 AS stage FROM f UNION ALL SELECT event_id, run, t + 86400.0, t, 2 FROM f),
p AS (SELECT q.*, s.t AS pt, s.value AS pv FROM q ASOF LEFT JOIN s ON q.run = s.run AND q.t >= s.t),
b AS (SELECT p.*, s.t AS nt, s.value AS nv FROM p ASOF LEFT JOIN s ON p.run = s.run AND p.t <= s.t),
m AS (SELECT event_id, stage, CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL OR abs(t - pt) <= abs(t - nt) THEN pv ELSE nv END AS value,
      CASE WHEN pt IS NULL THEN abs(t - nt) WHEN nt IS NULL OR abs(t - pt) <= abs(t - nt) THEN abs(t - pt) ELSE abs(t - nt) END AS age FROM b)
SELECT event_id, stage, round(value, 6) AS value FROM m WHERE age <= 21600 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY stage) = 1""",
    "bracket_interp_gate": _BRACKET + "SELECT event_id, round(v, 6) AS value FROM x WHERE best <= 43200 AND v IS NOT NULL",
    "interp_clamped_truth": _BRACKET + "SELECT event_id, round(v, 6) AS value FROM x WHERE v IS NOT NULL",
    "velocity_baseline": f"""WITH {E}, s AS (SELECT * FROM e WHERE topic IN ('view', 'purchase')),
w AS (SELECT *, first_value(t) OVER v AS ot, first_value(value) OVER v AS ov FROM s WINDOW v AS (PARTITION BY run ORDER BY t RANGE BETWEEN 259200.0 PRECEDING AND CURRENT ROW))
SELECT event_id, round(t - ot, 6) AS dt, round((value - ov) / (t - ot) * 86400.0, 6) AS rate FROM w WHERE t - ot BETWEEN 21600 AND 259200""",
    "clock_bridge": _SIDES + " SELECT a.run, round(a.m - b.m, 6) AS offset_s FROM (SELECT run, min(t) AS m FROM f GROUP BY run) a JOIN (SELECT run, min(t) AS m FROM s GROUP BY run) b ON a.run = b.run",
    "track_error_report": _BRACKET
    + """, r AS (SELECT run, abs(estimate - v) AS err FROM x WHERE v IS NOT NULL)
SELECT run, count(*) AS n, round(quantile_cont(err, 0.5), 6) AS median, round(avg(err), 6) AS mean, round(quantile_cont(err, 0.9), 6) AS p90, round(max(err), 6) AS worst,
round(avg(CASE WHEN err > 30 THEN 1.0 ELSE 0.0 END), 6) AS share_over_30 FROM r GROUP BY run""",
    "fresh_altitude_fallback": _BRACKET
    + "SELECT event_id, round(CASE WHEN best <= 21600 THEN v WHEN t - pt < 172800 THEN pv END, 6) AS value FROM x WHERE (best <= 21600 AND v IS NOT NULL) OR t - pt < 172800",
}
