"""Queries of gates and reports on tracks: envelopes, eligibility, duty, extents, standardisation, aggregates of streams' logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions import geo, rotation
from skylattice.operators.sequence import neighbours
from skylattice.plans.common import E, events, r6
from skylattice.session import load_table

DAY = 86400.0


def _track(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames with a height, two tilt angles and a coverage."""
    e = events(spark, d, "click")
    return e.select("event_id", "run", "t", F.col("value").alias("alt"), (F.pmod("event_id", F.lit(120)) - 60.0).alias("roll"), (F.pmod(F.col("event_id") * 7, F.lit(110)) - 55.0).alias("pitch"), (24 + F.pmod("event_id", F.lit(73))).cast("double").alias("coverage"))


_TRACK = "k AS (SELECT event_id, run, t, value AS alt, event_id % 120 - 60.0 AS roll, (event_id * 7) % 110 - 55.0 AS pitch, CAST(24 + event_id % 73 AS DOUBLE) AS coverage FROM e WHERE topic = 'click')"


def geometry_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Whether a frame's geometry can be used, and why not."""
    k = _track(spark, d)
    why = F.when(~F.col("alt").between(3, 400), "altitude").when(F.abs("roll") >= 50, "roll").when(F.abs("pitch") >= 50, "pitch").otherwise("ok")
    return k.select("event_id", why.alias("reason"))


def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    """Frames that may only carry motion, per run."""
    return _track(spark, d).groupBy("run").agg(F.count_if(F.col("coverage") < 88).alias("motion_only"), F.count("*").alias("frames"))


def scan_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Frames a scan may use: enough coverage, steerable, and no jump since the last."""
    n = neighbours(_track(spark, d), ["run"], ["t", "alt"])
    dt = (F.col("t") - F.col("before.t")) / DAY
    jump = F.abs(F.col("alt") - F.col("before.alt")) > 45 * dt + 60
    return n.where((F.col("coverage") >= 60) & (F.abs("roll") < 40) & ~F.coalesce(jump, F.lit(False))).select("event_id")


def consensus_gate(spark: SparkSession, d: str) -> DataFrame:
    """Shifts accepted by response, speed and turn."""
    k = _track(spark, d)
    ok = (F.col("coverage") / 96 >= 0.5) & (F.col("alt") / 10 <= 15) & (F.abs("roll") < 10)
    return k.where(ok).select("event_id")


def honest_poses(spark: SparkSession, d: str) -> DataFrame:
    """Share of each flight's fixes that are finite and sure, and its extent."""
    v = load_table(spark, d, "vehicle_global_position")
    finite = F.coalesce(~F.isnan("lat") & ~F.isnan("lon") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(False))
    good = finite & (F.col("eph") < 0.5)
    return v.groupBy("flight").agg(r6(F.avg(F.coalesce(good, F.lit(False)).cast("double"))).alias("duty"), F.count_if(finite).alias("finite"))


def extent_diagonal(spark: SparkSession, d: str) -> DataFrame:
    """Box and diagonal of each run's plane positions."""
    e = events(spark, d, "view").select("run", (F.cos(F.col("value")) * 100).alias("x"), (F.sin(F.col("value") / 2) * 100).alias("y"))
    g = e.groupBy("run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return g.select("run", *[r6(c).alias(c) for c in ("x0", "x1", "y0", "y1")], r6(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("diagonal"))


def zscore(spark: SparkSession, d: str) -> DataFrame:
    """Readings standardised per event type by the population deviation."""
    e = events(spark, d)
    s = e.groupBy("topic").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return e.join(s, "topic").select("event_id", r6((F.col("value") - F.col("m")) / F.col("s")).alias("z"))


def origin_displacement(spark: SparkSession, d: str) -> DataFrame:
    """How far each flight's middle lies from its first fix, in metres."""
    v = load_table(spark, d, "vehicle_global_position").where("lat between 1 and 85 and lon between 1 and 180 and not isnan(lat) and not isnan(lon) and t_us is not null")
    g = v.groupBy("flight").agg(F.min_by("lat", F.struct("t_us", "row_id")).alias("a0"), F.min_by("lon", F.struct("t_us", "row_id")).alias("o0"), F.percentile("lat", F.lit(0.5)).alias("a"), F.percentile("lon", F.lit(0.5)).alias("o"))
    return g.select("flight", r6((F.col("a") - F.col("a0")) * geo.M_PER_DEG, 3).alias("north"), r6((F.col("o") - F.col("o0")) * geo.M_PER_DEG * F.cos(F.radians("a0")), 3).alias("east"))


def camera_tilt_chain(spark: SparkSession, d: str) -> DataFrame:
    """Roll and pitch of the camera from body gravity through a fixed mounting."""
    k = _track(spark, d)
    r, p = F.radians("roll"), F.radians("pitch")
    mount = [[0.0, 1.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    roll, pitch = rotation.gravity_tilt(*rotation.mat_vec(mount, (-F.sin(p), F.sin(r) * F.cos(p), F.cos(r) * F.cos(p))))
    return k.select("event_id", r6(roll).alias("roll"), r6(pitch).alias("pitch"))


def motion_between_frames(spark: SparkSession, d: str) -> DataFrame:
    """Motion since the frame before in its own heading, with the turn wrapped."""
    n = neighbours(_track(spark, d), ["run"], ["t", "alt", "roll"]).where("before is not null")
    yaw = F.radians(F.col("before.roll") * 3)
    dx, dy = rotation.rotate(F.col("alt") - F.col("before.alt"), F.col("roll") - F.col("before.roll"), -yaw)
    return n.select("event_id", r6(dx).alias("dx"), r6(dy).alias("dy"), r6(rotation.wrap_angle(F.radians(F.col("roll") * 3) - yaw)).alias("dyaw"))


def landed_sanity(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose last height is that of a landed vehicle."""
    g = _track(spark, d).groupBy("run").agg(F.max_by("alt", F.struct("t", "event_id")).alias("last"))
    return g.select("run", r6("last").alias("last"), (F.abs("last") <= 20).alias("landed"))


def velocity_to_body(spark: SparkSession, d: str) -> DataFrame:
    """World velocities in the body's frame and back."""
    k = _track(spark, d)
    a = F.radians("roll")
    bx, by = rotation.rotate(F.col("alt"), F.col("coverage"), -a)
    wx, wy = rotation.rotate(bx, by, a)
    return k.select("event_id", r6(bx).alias("body_x"), r6(by).alias("body_y"), r6(wx).alias("world_x"), r6(wy).alias("world_y"))


QUERIES = {
    f.__name__: f
    for f in (
        geometry_envelope, coverage_gate, scan_eligibility, consensus_gate, honest_poses, extent_diagonal, zscore, origin_displacement, camera_tilt_chain,
        motion_between_frames, landed_sanity, velocity_to_body,
    )
}
_PREV = "n AS (SELECT *, lag(t) OVER w AS pt, lag(alt) OVER w AS pa, lag(roll) OVER w AS pr FROM k WINDOW w AS (PARTITION BY run ORDER BY t))"
_FIN = "coalesce(CAST(lat AS VARCHAR) <> 'nan' AND CAST(lon AS VARCHAR) <> 'nan' AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false)"
_WRAP = "({0} + pi()) - 2 * pi() * floor(({0} + pi()) / (2 * pi())) - pi()"
ORACLES = {
    "geometry_envelope": f"WITH {E}, {_TRACK} SELECT event_id, CASE WHEN NOT alt BETWEEN 3 AND 400 THEN 'altitude' WHEN abs(roll) >= 50 THEN 'roll' WHEN abs(pitch) >= 50 THEN 'pitch' ELSE 'ok' END AS reason FROM k",
    "coverage_gate": f"WITH {E}, {_TRACK} SELECT run, count(*) FILTER (coverage < 88) AS motion_only, count(*) AS frames FROM k GROUP BY run",
    "scan_eligibility": f"WITH {E}, {_TRACK}, {_PREV} SELECT event_id FROM n WHERE coverage >= 60 AND abs(roll) < 40 AND NOT coalesce(abs(alt - pa) > 45 * (t - pt) / 86400.0 + 60, false)",
    "consensus_gate": f"WITH {E}, {_TRACK} SELECT event_id FROM k WHERE coverage / 96 >= 0.5 AND alt / 10 <= 15 AND abs(roll) < 10",
    "honest_poses": f"SELECT flight, round(avg(CASE WHEN {_FIN} AND eph < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS duty, count(*) FILTER ({_FIN}) AS finite FROM vehicle_global_position GROUP BY flight",
    "extent_diagonal": f"""WITH {E}, p AS (SELECT run, cos(value) * 100 AS x, sin(value / 2) * 100 AS y FROM e WHERE topic = 'view'), g AS (SELECT run, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY run)
SELECT run, round(x0, 6) AS x0, round(x1, 6) AS x1, round(y0, 6) AS y0, round(y1, 6) AS y1, round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 6) AS diagonal FROM g""",
    "zscore": f"WITH {E} SELECT event_id, round((value - avg(value) OVER (PARTITION BY topic)) / stddev_pop(value) OVER (PARTITION BY topic), 6) AS z FROM e",
    "origin_displacement": """WITH v AS (SELECT * FROM vehicle_global_position WHERE lat BETWEEN 1 AND 85 AND lon BETWEEN 1 AND 180 AND CAST(lat AS VARCHAR) <> 'nan' AND CAST(lon AS VARCHAR) <> 'nan' AND t_us IS NOT NULL),
f AS (SELECT flight, lat AS a0, lon AS o0 FROM v QUALIFY row_number() OVER (PARTITION BY flight ORDER BY t_us, row_id) = 1), m AS (SELECT flight, quantile_cont(lat, 0.5) AS a, quantile_cont(lon, 0.5) AS o FROM v GROUP BY flight)
SELECT f.flight, round((a - a0) * 111320.0, 3) AS north, round((o - o0) * 111320.0 * cos(radians(a0)), 3) AS east FROM f JOIN m ON f.flight = m.flight""",
    "camera_tilt_chain": f"""WITH {E}, {_TRACK}, g AS (SELECT event_id, -sin(radians(pitch)) AS gx, sin(radians(roll)) * cos(radians(pitch)) AS gy, cos(radians(roll)) * cos(radians(pitch)) AS gz FROM k)
SELECT event_id, round(atan2(-gx, gz), 6) AS roll, round(atan2(-gy, sqrt(gx * gx + gz * gz)), 6) AS pitch FROM g""",
    "motion_between_frames": f"""WITH {E}, {_TRACK}, {_PREV}, m AS (SELECT event_id, alt - pa AS x, roll - pr AS y, -radians(pr * 3) AS a, radians(roll * 3) - radians(pr * 3) AS turn FROM n WHERE pt IS NOT NULL)
SELECT event_id, round(x * cos(a) - y * sin(a), 6) AS dx, round(x * sin(a) + y * cos(a), 6) AS dy, round({_WRAP.format('turn')}, 6) AS dyaw FROM m""",
    "landed_sanity": f"WITH {E}, {_TRACK} SELECT run, round(alt, 6) AS last, abs(alt) <= 20 AS landed FROM k QUALIFY row_number() OVER (PARTITION BY run ORDER BY t DESC, event_id DESC) = 1",
    "velocity_to_body": f"WITH {E}, {_TRACK} SELECT event_id, round(alt * cos(radians(roll)) + coverage * sin(radians(roll)), 6) AS body_x, round(coverage * cos(radians(roll)) - alt * sin(radians(roll)), 6) AS body_y, round(alt, 6) AS world_x, round(coverage, 6) AS world_y FROM k",
}
