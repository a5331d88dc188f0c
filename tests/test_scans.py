"""Scans against brute force over all positions and headings, across blocks of the grid; suppression of any size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import peaks as pk
from skylattice.operators import scans


def scorer(x, y, yaw):
    return F.round(F.sin(x / 170.0 + F.col("a")) * F.cos(y / 230.0) * (1.2 + F.cos(yaw - F.col("a"))), 9)


def value(a, x, y, yaw):
    return round(math.sin(x / 170.0 + a) * math.cos(y / 230.0) * (1.2 + math.cos(yaw - a)), 9)


def greedy(peaks, k, same):
    kept = []
    for p in sorted(peaks, reverse=True):
        if len(kept) < k and not any(same(p, q) for q in kept):
            kept.append(p)
    return kept


def frames(spark):
    return spark.createDataFrame([("u", 0.3), ("v", 2.0)], "run string, a double")


def test_coarse_scan_over_several_blocks(spark):
    half, step = 2000.0, 90.0  # 43 cells: two blocks a side
    n = scans.grid_cells(half, step)
    assert n == len(np.arange(step, 2 * half - step, step)) == 43
    at = [step - half + step * k for k in range(n)]
    got = [tuple(r) for r in scans.coarse_scan(frames(spark), ["run"], scorer, half, step, 4, 6).orderBy("run", "rank").collect()]
    want = []
    for run, a in (("u", 0.3), ("v", 2.0)):
        peaks = []
        for m in range(4):
            yaw = m * 2 * math.pi / 4
            g = np.array([[value(a, x, y, yaw) for y in at] for x in at])
            pad = np.pad(g, 1, constant_values=-np.inf)
            best = np.max([pad[i : i + n, j : j + n] for i in range(3) for j in range(3)], axis=0)
            peaks += [(g[i, j], at[i], at[j], yaw) for i, j in np.argwhere(g == best)]
        chosen = greedy(peaks, 6, lambda p, q: math.hypot(p[1] - q[1], p[2] - q[2]) <= 100)
        want += [(run, r, *p) for r, p in enumerate(chosen)]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [list(g[2:]) for g in got] == [pytest.approx(list(w[2:])) for w in want]


def test_local_scan(spark):
    df = frames(spark).withColumn("x0", F.lit(50.0)).withColumn("y0", F.lit(-20.0))
    got = [tuple(r) for r in scans.local_scan(df, ["run"], scorer, 60.0, 20.0, 12, 3).orderBy("run", "rank").collect()]
    want = []
    for run, a in (("u", 0.3), ("v", 2.0)):
        best = []
        for m in range(12):
            yaw = m * 2 * math.pi / 12
            cells = [(value(a, 50 - 60 + 20 * i, -20 - 60 + 20 * j, yaw), -j, -i) for j in range(7) for i in range(7)]
            s, j, i = max(cells)
            best.append((s, -10.0 - 20 * i, -80.0 - 20 * j, yaw))
        turn = lambda p, q: abs((math.degrees(p[3] - q[3]) + 180) % 360 - 180)
        chosen = greedy(best, 3, lambda p, q: math.hypot(p[1] - q[1], p[2] - q[2]) <= 30 and turn(p, q) <= 30 + 1e-9)
        want += [(run, r, *p) for r, p in enumerate(chosen)]
    assert [list(g[2:]) for g in got] == [pytest.approx(list(w[2:])) for w in want]


def test_frames_of_a_steered_scan(spark):
    rows = [("u", i, float(t), 10.0 * t, 0.0) for i, t in enumerate(range(40))] + [("u", 90, 38.5, 5000.0, 0.0), ("v", 91, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "run string, frame long, t double, px double, py double")
    got = scans.scan_frames(df, ["run"], most=5).collect()
    assert sorted(r.frame for r in got if r.run == "u") == [14, 20, 26, 33, 39]  # of the last 25 s, without the jump
    assert {(r.rx, r.ry) for r in got if r.run == "u"} == {(390.0, 0.0)} and [r.frame for r in got if r.run == "v"] == [91]


def test_suppression_has_no_cap(spark):
    """More peaks than a batch, hundreds of thousands of them in one scan, equal scores among them."""
    n = 250_000
    df = spark.range(n).select(F.lit("hot").alias("s"), (F.pmod(F.hash("id"), F.lit(1000)) / 1000.0).alias("score"), F.pmod(F.col("id") * 7919, F.lit(5000)).cast("double").alias("x"), F.pmod(F.col("id") * 104729, F.lit(5000)).cast("double").alias("y"), F.lit(0.0).alias("yaw"))
    got = [(r.score, r.x, r.y) for r in pk.suppress(df, ["s"], 20, pk.within(400.0, "x", "y")).orderBy("rank").collect()]
    rows = sorted(((r.score, r.x, r.y) for r in df.where("score > 0.9").collect()), reverse=True)
    assert got == greedy(rows, 20, lambda p, q: math.hypot(p[1] - q[1], p[2] - q[2]) <= 400)
    few = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 350.0), ("a", 0.9, 0.0, 1.0, 5.0), ("a", 0.8, 0.0, 0.0, 90.0), ("a", None, 9e9, 0.0, 0.0), ("b", 0.1, 0.0, 0.0, 0.0)], "s string, score double, x double, y double, yaw double")
    assert sorted((r.s, r["rank"], r.score) for r in pk.suppress(few, ["s"], 3, pk.within_and_yaw(80.0, 30.0)).collect()) == [("a", 0, 1.0), ("a", 1, 0.8), ("b", 0, 0.1)]
    assert pk.suppress(few.limit(0), ["s"], 3, pk.within(1.0, "x")).count() == 0
