"""Queries of scans over positions, headings and frames, on the fixes of flights, with a synthetic scorer."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators import scans
from skylattice.plans.common import r6, uniform_duck
from skylattice.plans.flight_queries import _FIXES, fixes

HALF, STEP = 2500.0, 192.0
KEY = ["flight"]


def _newest(spark: SparkSession, d: str) -> DataFrame:
    """Each flight's newest frame: where it is on the map (``tx, ty``) and its heading."""
    n = fixes(spark, d).groupBy("flight").agg(F.max(F.struct("t", "row_id", "x", "y", "yaw")).alias("r"))
    place = lambda k: (F.pmod(F.col("r.row_id") * k, F.lit(3001)) - 1500).cast("double")
    return n.select("flight", place(37).alias("tx"), place(53).alias("ty"), F.radians("r.yaw").alias("tyaw"), F.col("r.x").alias("nx"), F.col("r.y").alias("ny"))


def score(x: Column, y: Column, yaw: Column) -> Column:
    """A scorer with a hill at the frame's place and heading, and lookalikes all over the map."""
    cell = lambda c: F.floor(c / 150.0).cast("string")
    look = F.concat_ws(":", F.lit("map"), cell(x), cell(y))
    u = F.conv(F.substring(F.md5(look), 1, 8), 16, 10).cast("double") / 4294967296.0
    d2 = (x - F.col("tx")) * (x - F.col("tx")) + (y - F.col("ty")) * (y - F.col("ty"))
    return F.round(0.6 * F.exp(-d2 / 125000.0) * (0.5 + 0.5 * F.cos(yaw - F.col("tyaw"))) + 0.4 * u, 9)


def coarse_scan(spark: SparkSession, d: str) -> DataFrame:
    """The eight best places of the whole map for each flight's newest frame."""
    s = scans.coarse_scan(_newest(spark, d), KEY, score, HALF, STEP, 8, 8)
    return s.select("flight", "rank", r6("score").alias("score"), "x", "y", r6("yaw").alias("yaw"))


def local_scan(spark: SparkSession, d: str) -> DataFrame:
    """The three best of each heading's best positions about a guess 60 m off."""
    c = _newest(spark, d).withColumn("x0", F.col("tx") + 60.0).withColumn("y0", F.col("ty") - 60.0)
    s = scans.local_scan(c, KEY, score, 96.0, 24.0, 12, 3)
    return s.select("flight", "rank", r6("score").alias("score"), "x", "y", r6("yaw").alias("yaw"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """The frames of each flight's last seconds, each with its own true place."""
    f = fixes(spark, d).select("flight", "t", F.col("row_id").alias("frame"), F.col("x").alias("px"), F.col("y").alias("py"), F.radians("yaw").alias("yaw0"))
    f = scans.scan_frames(f, KEY, most=5).join(_newest(spark, d).select("flight", "tx", "ty"), "flight")
    return f.withColumn("tx", F.col("tx") + F.col("px") - F.col("rx")).withColumn("ty", F.col("ty") + F.col("py") - F.col("ry")).withColumn("tyaw", F.col("yaw0"))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return scans.steered_scan(_frames(spark, d), KEY, score, HALF, STEP, math.radians(30), 3, 10)


def steered_scan(spark: SparkSession, d: str) -> DataFrame:
    """The ten places that score best in the median of the last frames."""
    return _regions(spark, d).select("flight", "rank", r6("score").alias("score"), "x", "y")


def refined_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first three of these scanned again with the newest frame, and the rest."""
    current = _newest(spark, d).withColumn("yaw0", F.col("tyaw"))
    s = scans.refine(_regions(spark, d), current, KEY, score)
    return s.select("flight", "rank", r6("score").alias("score"), "x", "y", r6("yaw").alias("yaw"))


QUERIES = {f.__name__: f for f in (coarse_scan, local_scan, steered_scan, refined_scan)}
_N = scans.grid_cells(HALF, STEP)
_NEWEST = f"""{_FIXES}, r AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY flight ORDER BY t DESC, row_id DESC) = 1),
n AS (SELECT flight, CAST((row_id * 37) % 3001 - 1500 AS DOUBLE) AS tx, CAST((row_id * 53) % 3001 - 1500 AS DOUBLE) AS ty, radians(yaw) AS tyaw, t AS nt, x AS rx, y AS ry FROM r)"""


def _score(x: str, y: str, yaw: str) -> str:
    u = uniform_duck(f"concat_ws(':', 'map', CAST(floor({x} / 150.0) AS BIGINT), CAST(floor({y} / 150.0) AS BIGINT))")
    return f"round(0.6 * exp(-(({x} - tx) * ({x} - tx) + ({y} - ty) * ({y} - ty)) / 125000.0) * (0.5 + 0.5 * cos({yaw} - tyaw)) + 0.4 * {u}, 9)"


def _choose(peaks: str, by: str, k: int, same: str, fields: str) -> str:
    """Greedy choice among the rows of a table ``peaks``."""
    return f"""l AS (SELECT {by}, list_sort(list({{{fields}}}), 'DESC') AS a FROM {peaks} GROUP BY {by}),
k AS (SELECT {by}, list_reduce(list_transform(a, lambda e: [e]), lambda kept, e: CASE WHEN len(kept) < {k} AND len(list_filter(kept, lambda o: {same})) = 0 THEN list_concat(kept, e) ELSE kept END) AS a FROM l),
u AS (SELECT {by}, unnest(generate_series(1, len(a))) AS i, a FROM k)"""


_FAR = "(o.x - e[1].x) * (o.x - e[1].x) + (o.y - e[1].y) * (o.y - e[1].y) <= {0}"
_TURN = "abs((o.d - e[1].d + 180.0) - 360.0 * floor((o.d - e[1].d + 180.0) / 360.0) - 180.0) <= 30.0"
_ALL = "'score': score, 'x': x, 'y': y, 'd': d, 'yaw': yaw"
_OUT = "SELECT flight, CAST(i - 1 AS INTEGER) AS rank, round(a[i].score, 6) AS score, a[i].x AS x, a[i].y AS y"
_REGIONS = f"""{_NEWEST}, w AS (SELECT f.flight, f.row_id, f.x - rx AS ox, f.y - ry AS oy, tx + (f.x - rx) AS tx, ty + (f.y - ry) AS ty, radians(f.yaw) AS tyaw, f.t FROM f JOIN n ON f.flight = n.flight
  WHERE f.t >= nt - 25.0 AND sqrt((f.x - rx) * (f.x - rx) + (f.y - ry) * (f.y - ry)) <= 45.0 * greatest(0.05, nt - f.t) + 60.0),
v AS (SELECT *, row_number() OVER (PARTITION BY flight ORDER BY t, row_id) - 1 AS k, count(*) OVER (PARTITION BY flight) AS c FROM w),
z AS (SELECT * FROM v WHERE c <= 5 OR list_contains(list_transform(generate_series(0, 4), lambda i: CAST(round_even(i * (c - 1) / 4.0, 0) AS BIGINT)), k)),
g AS (SELECT z.*, CAST(p.i AS INTEGER) AS i, CAST(q.j AS INTEGER) AS j, {STEP - HALF}::DOUBLE + p.i * {STEP} AS x, {STEP - HALF}::DOUBLE + q.j * {STEP} AS y FROM z, generate_series(0, {_N - 1}) AS p(i), generate_series(0, {_N - 1}) AS q(j)),
b AS (SELECT flight, row_id, i, j, ox, oy, greatest({_score('x', 'y', f'(tyaw - {math.radians(60) / 2})')}, {_score('x', 'y', 'tyaw')}, {_score('x', 'y', f'(tyaw + {math.radians(60) / 2})')}) AS s FROM g),
p0 AS (SELECT *, i + ox / {STEP}::DOUBLE AS r, j + oy / {STEP}::DOUBLE AS c FROM b), p1 AS (SELECT *, CAST(least(greatest(floor(r), 0), {_N - 1}) AS INTEGER) AS r0, CAST(least(greatest(floor(c), 0), {_N - 1}) AS INTEGER) AS c0 FROM p0),
p2 AS (SELECT *, least(greatest(r - r0, 0.0), 1.0) AS fr, least(greatest(c - c0, 0.0), 1.0) AS fc, least(r0 + 1, {_N - 1}) AS r1, least(c0 + 1, {_N - 1}) AS c1 FROM p1),
p3 AS (SELECT p2.flight, p2.i, p2.j, a.s * (1 - fr) * (1 - fc) + b1.s * (1 - fr) * fc + d.s * fr * (1 - fc) + e.s * fr * fc AS value FROM p2 JOIN b a ON a.row_id = p2.row_id AND a.i = r0 AND a.j = c0 JOIN b b1 ON b1.row_id = p2.row_id AND b1.i = r0 AND b1.j = c1
  JOIN b d ON d.row_id = p2.row_id AND d.i = r1 AND d.j = c0 JOIN b e ON e.row_id = p2.row_id AND e.i = r1 AND e.j = c1),
m AS (SELECT flight, round(quantile_cont(value, 0.5), 9) AS score, {STEP - HALF}::DOUBLE + i * {STEP} AS x, {STEP - HALF}::DOUBLE + j * {STEP} AS y FROM p3 GROUP BY flight, i, j),
{_choose('m', 'flight', 10, _FAR.format(10000), "'score': score, 'x': x, 'y': y")}"""
ORACLES = {
    "coarse_scan": f"""WITH {_NEWEST}, g AS (SELECT n.*, CAST(p.i AS INTEGER) AS i, CAST(q.j AS INTEGER) AS j, CAST(h.m AS INTEGER) AS m, {STEP - HALF}::DOUBLE + p.i * {STEP} AS x, {STEP - HALF}::DOUBLE + q.j * {STEP} AS y, h.m * {2 * math.pi / 8}::DOUBLE AS yaw
  FROM n, generate_series(0, {_N - 1}) AS p(i), generate_series(0, {_N - 1}) AS q(j), generate_series(0, 7) AS h(m)), s AS (SELECT flight, i, j, m, x, y, yaw, {_score('x', 'y', 'yaw')} AS score FROM g),
o AS (SELECT flight, m, i + a.d AS i, j + b.d AS j, max(score) AS best FROM s, (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d) GROUP BY ALL), top AS (SELECT s.*, degrees(yaw) AS d FROM s JOIN o USING (flight, m, i, j) WHERE score = best),
{_choose('top', 'flight', 8, _FAR.format(10000), "'score': score, 'x': x, 'y': y, 'yaw': yaw")} {_OUT}, round(a[i].yaw, 6) AS yaw FROM u""",
    "local_scan": f"""WITH {_NEWEST}, g AS (SELECT n.*, p.i, h.m, tx + 60.0 - 96.0 + (p.i % 9) * 24.0 AS x, ty - 60.0 - 96.0 + (p.i // 9) * 24.0 AS y, h.m * {2 * math.pi / 12}::DOUBLE AS yaw FROM n, generate_series(0, 80) AS p(i), generate_series(0, 11) AS h(m)),
s AS (SELECT flight, i, m, x, y, yaw, degrees(yaw) AS d, {_score('x', 'y', 'yaw')} AS score FROM g), top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY flight, m ORDER BY score DESC, i) = 1),
{_choose('top', 'flight', 3, _FAR.format(900) + ' AND ' + _TURN, _ALL)} {_OUT}, round(a[i].yaw, 6) AS yaw FROM u""",
    "steered_scan": f"WITH {_REGIONS} {_OUT} FROM u",
    "refined_scan": f"""WITH {_REGIONS}, q AS (SELECT u.flight, CAST(u.i - 1 AS INTEGER) AS rank, u.a[u.i].score AS s0, u.a[u.i].x AS x0, u.a[u.i].y AS y0, tx, ty, tyaw FROM u JOIN n ON u.flight = n.flight),
c AS (SELECT q.*, p.i, h.m, x0 - 192.0 + (p.i % 13) * 32.0 AS x, y0 - 192.0 + (p.i // 13) * 32.0 AS y, tyaw - {math.radians(60) / 2} + h.m * {math.radians(60) / 4} AS yaw FROM q, generate_series(0, 168) AS p(i), generate_series(0, 4) AS h(m) WHERE rank < 3),
s AS (SELECT flight, rank, i, m, x, y, yaw, {_score('x', 'y', 'yaw')} AS score FROM c), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY flight, rank, m ORDER BY score DESC, i) = 1),
y AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY flight, rank ORDER BY score DESC, x DESC, y DESC, yaw DESC) = 1)
SELECT flight, rank, round(score, 6) AS score, x, y, round(yaw, 6) AS yaw FROM y UNION ALL SELECT flight, rank, round(s0, 6), x0, y0, round(tyaw, 6) FROM q WHERE rank >= 3""",
}
