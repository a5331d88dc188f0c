"""Queries of odometry gates and states on the recordings themselves: fixes of flights, inertial samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions import rotation, scalars
from skylattice.operators import sequence as seq
from skylattice.plans.common import r6
from skylattice.session import load_table
from skylattice.sources import decoders

#: Seconds of a recording that one window covers.
SPAN_S = 600.0
RATE, SLACK = 35.0, 8.0
#: Noise a motion step adds: metres, metres, radians, scale; and metres where no motion is known.
NOISE, HOVER = (1.5, 1.5, 0.02, 0.005), 0.6


def fixes(spark: SparkSession, d: str) -> DataFrame:
    """Fixes as odometry frames: seconds, metres east and north of a fixed place, height, and tilt and heading drawn from the row's number."""
    v = load_table(spark, d, "vehicle_global_position").where("t_us is not null and not isnan(lat) and not isnan(lon) and lat is not null and lon is not null")
    i = F.col("row_id")
    return v.select(
        "row_id", "flight", (F.col("t_us") / 1e6).alias("t"), (F.radians(F.col("lon") - 100.0) * 5523628.670).alias("x"), (F.radians(F.col("lat") - 30.0) * 6378137.0).alias("y"),
        F.col("alt").cast("double").alias("alt"), (F.pmod(i * 7, F.lit(113)) - 56.0).alias("roll"), (F.pmod(i * 11, F.lit(110)) - 54.0).alias("pitch"), F.pmod(i * 13, F.lit(71)).cast("double").alias("yaw"),
    )


def _classified(spark: SparkSession, d: str) -> DataFrame:
    """Fixes with ``dx, dy`` (metres, in the heading of the last fix believed), ``turn``, ``dt`` and ``class``."""
    f = fixes(spark, d).withColumn("sane", scalars.odometry_sane(F.col("alt"), F.col("roll"), F.col("pitch")))
    moved = seq.neighbours(f.where("sane"), ["flight"], ["t", "x", "y", "yaw"], ("t", "row_id"), SPAN_S).drop("after")
    rows = moved.unionByName(f.where("not sane"), allowMissingColumns=True)
    b = F.col("before")
    dx, dy = rotation.rotate(F.col("x") - b["x"], F.col("y") - b["y"], -F.radians(b["yaw"]))
    rows = rows.select("*", dx.alias("dx"), dy.alias("dy"), (F.col("yaw") - b["yaw"]).alias("turn"), (F.col("t") - b["t"]).alias("dt"))
    return rows.withColumn("class", scalars.odometry_class(F.col("sane"), F.col("dx"), F.col("dy"), F.col("turn"), F.col("dt")))


def odometry_classes(spark: SparkSession, d: str) -> DataFrame:
    """Fixes classed by whether their odometry can be used, is an anchor only, or is not to be believed."""
    return _classified(spark, d).select("row_id", "class")


def motion_source(spark: SparkSession, d: str) -> DataFrame:
    """The motion and noise each frame moves the particles by: odometry's if usable, else none and a hover's noise. Frames
    believed are the next one's anchor."""
    used = (F.col("class") == "ok") & F.col("dt").isNotNull()
    moved = lambda c: F.when(used, F.col(c)).otherwise(0.0)
    return _classified(spark, d).select(
        "row_id", r6(moved("dx"), 3).alias("dx"), r6(moved("dy"), 3).alias("dy"), r6(F.radians(moved("turn"))).alias("dyaw"), F.when(used, NOISE[0]).otherwise(HOVER).alias("noise"), (F.col("class") != "bad").alias("anchor")
    )


def teleport_gate(spark: SparkSession, d: str) -> DataFrame:
    """Fixes delivered and withheld by the gate on implied speed; every 97th row brings an allowance to jump once."""
    rows = fixes(spark, d).select("row_id", "flight", "t", "x", "y", (F.pmod("row_id", F.lit(97)) == 0).alias("allowed"))
    return seq.teleport_gate(rows, ["flight"], RATE, SLACK, ("x", "y"), ("t", "row_id")).select("row_id", "delivered")


def gravity_tilt_filter(spark: SparkSession, d: str) -> DataFrame:
    """Tilt of each inertial sample from turn rates and specific force alone."""
    rows = decoders.imu(load_table(spark, d, "messages"), load_table(spark, d, "topics")).where("ok and timestamp is not null and timestamp <> 0")
    rows = rows.select("msg_id", "flight", (F.col("timestamp") / 1e9).alias("t"), *("gx", "gy", "gz", "ax", "ay", "az"))
    return seq.gravity_filter(rows, ["flight"], order=("t", "msg_id")).select("msg_id", r6("roll").alias("roll"), r6("pitch").alias("pitch"))


def health_states(spark: SparkSession, d: str) -> DataFrame:
    """A tracker's state by priority, from frame number, particles, gate, recovery and lost frames."""
    i = F.col("row_id")
    bits = fixes(spark, d).select("row_id", (F.pmod(i, F.lit(50)) - 1).alias("k"), (F.pmod(i, F.lit(13)) != 0).alias("ready"), (F.col("alt") < 100).alias("gated"), (F.pmod(i, F.lit(5)) == 0).alias("recovering"), F.pmod(i, F.lit(3)).alias("lost"))
    return bits.select("row_id", scalars.health_state(*[F.col(c) for c in ("k", "ready", "gated", "recovering", "lost")]).alias("state"))


def _attitudes(spark: SparkSession, d: str) -> DataFrame:
    """Fixes with a unit quaternion made of their angles."""
    f = fixes(spark, d)
    n = F.sqrt(F.col("roll") ** 2 + F.col("pitch") ** 2 + F.col("yaw") ** 2 + 3600.0)
    return f.select("*", (F.col("roll") / n).alias("qx"), (F.col("pitch") / n).alias("qy"), (F.col("yaw") / n).alias("qz"), (60.0 / n).alias("qw"))


def camera_tilt_world(spark: SparkSession, d: str) -> DataFrame:
    """Roll and pitch of a downward camera, and its image axes laid flat, from its attitude in the world."""
    q = tuple(F.col(c) for c in ("qx", "qy", "qz", "qw"))
    (roll, pitch), (right, down) = rotation.camera_tilt(q), rotation.level_axes(q)
    return _attitudes(spark, d).select("row_id", r6(roll).alias("roll"), r6(pitch).alias("pitch"), r6(right[0]).alias("right_x"), r6(right[1]).alias("right_y"), r6(down[0]).alias("down_x"), r6(down[1]).alias("down_y"))


def return_velocity(spark: SparkSession, d: str) -> DataFrame:
    """Velocity towards the map's centre at each fix, and the map pixels a patch of its height takes."""
    north, east, heading = scalars.homeward(F.col("x"), F.col("y"), 8.0)
    return fixes(spark, d).select("row_id", r6(north).alias("north"), r6(east).alias("east"), r6(heading).alias("heading"), r6(scalars.source_pixels(F.col("alt"), 0.3)).alias("pixels"))


def trajectory_report(spark: SparkSession, d: str) -> DataFrame:
    """Per flight the error of the last frame, the mean of all and that of the later half; the error is how far off 300 m it flies."""
    f = fixes(spark, d).where("alt is not null and not isnan(alt)").withColumn("err", F.abs(F.col("alt") - 300.0))
    k = seq.index_in_order(f, ["flight"], "k", ("t", "row_id"), SPAN_S)
    n = k.groupBy("flight").agg(F.count("*").alias("n"))
    warm = F.when(F.col("k") >= F.floor(F.col("n") / 2), F.col("err"))
    g = k.join(n, "flight").groupBy("flight").agg(F.max_by("err", "k").alias("last"), F.avg("err").alias("mean"), F.avg(warm).alias("warm"))
    return g.select("flight", *[r6(c, 3).alias(c) for c in ("last", "mean", "warm")])


def altitude_floor(spark: SparkSession, d: str, floor: float = 30.0) -> DataFrame:
    """Frames of each flight kept and skipped for being too near the ground."""
    low = F.coalesce(F.col("alt") < floor, F.lit(True))
    return fixes(spark, d).groupBy("flight").agg(F.count_if(~low).alias("kept"), F.count_if(low).alias("skipped"))


QUERIES = {f.__name__: f for f in (odometry_classes, motion_source, teleport_gate, gravity_tilt_filter, health_states, camera_tilt_world, return_velocity, trajectory_report, altitude_floor)}
_FIXES = """f AS (SELECT row_id, flight, t_us / 1e6 AS t, radians(lon - 100.0) * 5523628.670 AS x, radians(lat - 30.0) * 6378137.0 AS y, CAST(alt AS DOUBLE) AS alt,
  (row_id * 7) % 113 - 56.0 AS roll, (row_id * 11) % 110 - 54.0 AS pitch, CAST((row_id * 13) % 71 AS DOUBLE) AS yaw FROM vehicle_global_position WHERE t_us IS NOT NULL AND CAST(lat AS VARCHAR) <> 'nan' AND CAST(lon AS VARCHAR) <> 'nan')"""
#: Written from what the states mean: a sane attitude within grown limits is ok, beyond them an anchor, all else is bad.
_CLASSED = f"""{_FIXES}, s AS (SELECT *, coalesce(alt >= 3 AND alt <= 400 AND roll > -55 AND roll < 55 AND pitch > -55 AND pitch < 55, false) AS sane FROM f),
p AS (SELECT row_id, t - lag(t) OVER w AS dt, x - lag(x) OVER w AS ex, y - lag(y) OVER w AS ny, radians(lag(yaw) OVER w) AS a, yaw - lag(yaw) OVER w AS turn FROM s WHERE sane WINDOW w AS (PARTITION BY flight ORDER BY t, row_id)),
q AS (SELECT row_id, dt, ex * cos(a) + ny * sin(a) AS dx, ny * cos(a) - ex * sin(a) AS dy, turn, greatest(0.0, dt - 0.5) AS gap FROM p),
c AS (SELECT row_id, dt, dx, dy, turn, CASE WHEN dt IS NULL OR (abs(dx) < 15 + 15 * gap AND abs(dy) < 15 + 15 * gap AND abs(turn) < 45 + 90 * gap) THEN 'ok' ELSE 'resume' END AS class FROM q
  UNION ALL SELECT row_id, NULL, NULL, NULL, NULL, 'bad' FROM s WHERE NOT sane)"""
ORACLES = {
    "odometry_classes": f"WITH {_CLASSED} SELECT row_id, class FROM c",
    "motion_source": f"""WITH {_CLASSED} SELECT row_id, round(CASE WHEN u THEN dx ELSE 0.0 END, 3) AS dx, round(CASE WHEN u THEN dy ELSE 0.0 END, 3) AS dy, round(radians(CASE WHEN u THEN turn ELSE 0.0 END), 6) AS dyaw,
CASE WHEN u THEN 1.5::DOUBLE ELSE 0.6::DOUBLE END AS noise, class <> 'bad' AS anchor FROM (SELECT *, class = 'ok' AND dt IS NOT NULL AS u FROM c)""",
    "health_states": f"""WITH {_FIXES} SELECT row_id, CASE WHEN row_id % 50 = 0 THEN 'no_frames' WHEN row_id % 13 = 0 THEN 'init_wait' WHEN alt < 100 THEN 'motion_only' WHEN row_id % 5 = 0 THEN 'recovering'
WHEN row_id % 3 > 0 THEN 'lost' ELSE 'tracking' END AS state FROM f""",
    "camera_tilt_world": f"""WITH {_FIXES}, n AS (SELECT row_id, roll / l AS x, pitch / l AS y, yaw / l AS z, 60.0 / l AS w FROM (SELECT *, sqrt(roll * roll + pitch * pitch + yaw * yaw + 3600.0) AS l FROM f)),
r AS (SELECT row_id, 1 - 2 * (y * y + z * z) AS a, 2 * (x * y + z * w) AS b, 2 * (x * y - z * w) AS c, 1 - 2 * (x * x + z * z) AS d, 2 * (x * z - y * w) AS g0, 2 * (y * z + x * w) AS g1, 1 - 2 * (x * x + y * y) AS g2 FROM n),
h AS (SELECT *, sqrt(a * a + b * b) AS hn, greatest(sqrt(c * c + d * d), 1e-9) AS hm FROM r), k AS (SELECT *, CASE WHEN hn < 1e-6 THEN -d / hm ELSE a / hn END AS rx, CASE WHEN hn < 1e-6 THEN c / hm ELSE b / hn END AS ry FROM h)
SELECT row_id, round(atan2(0.0 - g1, 0.0 - g2), 6) AS roll, round(asin(least(greatest(g0, -1.0), 1.0)), 6) AS pitch, round(rx, 6) AS right_x, round(ry, 6) AS right_y, round(ry, 6) AS down_x, round(-rx, 6) AS down_y FROM k""",
    "return_velocity": f"""WITH {_FIXES}, v AS (SELECT row_id, alt, -8.0 * y / greatest(sqrt(x * x + y * y), 1e-3) AS n, -8.0 * x / greatest(sqrt(x * x + y * y), 1e-3) AS e FROM f)
SELECT row_id, round(n, 6) AS north, round(e, 6) AS east, round(atan2(e, n), 6) AS heading, round(alt / 0.3, 6) AS pixels FROM v""",
    "trajectory_report": f"""WITH {_FIXES}, o AS (SELECT flight, abs(alt - 300.0) AS err, row_number() OVER (PARTITION BY flight ORDER BY t, row_id) - 1 AS k, count(*) OVER (PARTITION BY flight) AS n FROM f WHERE CAST(alt AS VARCHAR) <> 'nan')
SELECT flight, round(arg_max(err, k), 3) AS last, round(avg(err), 3) AS mean, round(avg(CASE WHEN k >= n // 2 THEN err END), 3) AS warm FROM o GROUP BY flight""",
    "altitude_floor": f"WITH {_FIXES} SELECT flight, count(*) FILTER (NOT coalesce(alt < 30.0, true)) AS kept, count(*) FILTER (coalesce(alt < 30.0, true)) AS skipped FROM f GROUP BY flight",
}
