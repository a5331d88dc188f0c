"""Sequence operators against NumPy twins, in buckets smaller than the sequences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import sequence as seq

SCHEMA = "event_id long, run string, t double, value double"


def data(spark, seed=0, n=200):
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.uniform(0.1, 30, n))
    v = np.cumsum(rng.normal(0, 1.5, n))
    rows = [(i, "hot", float(a), float(b)) for i, (a, b) in enumerate(zip(t, v))] + [(1000, "one", 5.0, 2.0)]
    return t, v, spark.createDataFrame(rows, SCHEMA)


def by_id(df, column):
    return {r["event_id"]: r[column] for r in df.collect()}


def test_gradient(spark):
    t, v, df = data(spark)
    got = by_id(seq.gradient(df, ["run"]), "gradient")
    assert [got[i] for i in range(len(t))] == pytest.approx(list(np.gradient(v, t)))
    assert got[1000] is None


def test_unwrap(spark):
    t, v, df = data(spark, 1)
    wrapped = (v + np.pi) % (2 * np.pi) - np.pi
    df = df.withColumn("value", F.pmod(F.col("value") + np.pi, F.lit(2 * np.pi)) - np.pi)
    got = by_id(seq.unwrap(df, ["run"]), "unwrapped")
    assert [got[i] for i in range(len(t))] == pytest.approx(list(np.unwrap(wrapped)))


@pytest.mark.parametrize("width", [25.0, 1e9])
def test_running_sum_and_neighbours(spark, width):
    t, v, df = data(spark, 2)
    got = by_id(seq.running_sum(df, ["run"], "value", "s", width=width), "s")
    assert [got[i] for i in range(len(t))] == pytest.approx(list(np.cumsum(v)))
    got = by_id(seq.neighbours(df, ["run"], ["t"], width=width).select("event_id", F.col("before.t").alias("p")), "p")
    assert [got[i] for i in range(1, len(t))] == list(t[:-1]) and got[0] is None


def test_trapezoid(spark):
    t, v, df = data(spark, 3)
    got = {r.run: r.integral for r in seq.trapezoid(df, ["run"]).collect()}
    assert got["hot"] == pytest.approx(np.trapezoid(v, t)) and got["one"] == 0


def test_smoothing_in_blocks():
    x = np.random.default_rng(0).normal(size=1000)
    want, y = [], x[0]
    for k in x:
        y = 0.9 * y + 0.1 * k if want else k
        want.append(y)
    assert seq._smooth(x, None, 0.1) == pytest.approx(want)
    assert np.r_[seq._smooth(x[:300], None, 0.1), seq._smooth(x[300:], want[299], 0.1)] == pytest.approx(want)


def test_fold_over_small_batches(spark):
    t, v, df = data(spark, 4)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = by_id(seq.ema(df, ["run"], 0.1), "ema")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [got[i] for i in range(len(t))] == pytest.approx(list(seq._smooth(v, None, 0.1)))


@pytest.mark.parametrize("width", [40.0, 500.0, 1e9])
def test_smoothing_in_buckets(spark, width):
    t, v, df = data(spark, 8)
    got = by_id(seq.ema(df, ["run"], 0.1, width=width), "ema")
    assert [got[i] for i in range(len(t))] == pytest.approx(list(seq._smooth(v, None, 0.1))) and got[1000] == 2.0
    assert seq.ema(df.limit(0), ["run"], 0.1, width=width).count() == 0


def test_persistence_and_streaks(spark):
    rows = [(i, "r", float(t), float(f)) for i, (t, f) in enumerate(zip([0, 1, 2, 5, 6, 7, 8], [1, 1, 0, 1, 1, 1, 1]))]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("f", F.col("value") > 0)
    assert by_id(seq.persistence(df, ["run"], "f", 2.5), "breach") == {0: False, 1: False, 2: False, 3: False, 4: False, 5: False, 6: True}
    assert by_id(seq.streaks(df, ["run"], "f"), "streak") == {0: 1, 1: 2, 2: 0, 3: 1, 4: 2, 5: 3, 6: 4}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert seq.gradient(none, ["run"]).count() == seq.ema(none, ["run"], 0.1).count() == seq.trapezoid(none, ["run"]).count() == 0


def test_bucket_width(spark):
    t, _, df = data(spark, 5, 400)
    assert seq.bucket_width(spark.range(100).selectExpr("'r' as run", "double(id) as t"), ["run"], rows=10) == seq.WEEK_S  # too small to measure
    rate = 400 / (t[-1] - t[0])
    assert seq.bucket_width(df, ["run"], rows=100, large=0) == pytest.approx(100 / rate)
    assert seq.bucket_width(df, ["run"], rows=1000, large=0) > 1e18 and seq.bucket_width(df.limit(0), ["run"], large=0) > 1e18


def gate(rows, rate, slack):
    """Row by row: the last delivered position, and whether a jump is allowed."""
    last, free, out = None, False, []
    for t, x, y, allowed in rows:
        free = free or bool(allowed)
        ok = last is None or free or np.hypot(x - last[1], y - last[2]) <= rate * max(1e-3, t - last[0]) + slack
        if ok:
            last, free = (t, x, y), False
        out.append(ok)
    return out


def test_teleport_gate(spark):
    rows = [(0.0, 0, 0, None), (1.0, 10, 0, False), (2.0, 500, 0, False), (3.0, 500, 1, False), (4.0, 30, 0, False), (5.0, 900, 0, False), (9.0, 200, 0, False), (10.0, 800, 0, True), (11.0, 805, 0, False), (12.0, 0, 0, None)]
    rows = [(t, float(x), float(y), a) for t, x, y, a in rows]
    want = gate(rows, 35.0, 8.0)
    # what jumps stays out, however often it comes, until the bound has grown to it or a jump is allowed
    assert want == [True, True, False, False, True, False, True, True, True, False]
    df = spark.createDataFrame([(i, "r", *r) for i, r in enumerate(rows)] + [(99, "r", None, 1.0, 1.0, None)], "event_id long, run string, t double, x double, y double, allowed boolean")
    got = by_id(seq.teleport_gate(df, ["run"], 35.0, 8.0, ("x", "y")), "delivered")
    assert [got[i] for i in range(len(rows))] == want and 99 not in got


def turned(v, axis, angle):
    """A vector turned about an axis, by quaternion products."""
    def times(p, q):
        return np.r_[p[0] * q[0] - p[1:] @ q[1:], p[0] * q[1:] + q[0] * p[1:] + np.cross(p[1:], q[1:])]
    q = np.r_[np.cos(angle / 2), np.sin(angle / 2) * axis / np.linalg.norm(axis)]
    return times(times(q, np.r_[0.0, v]), q * [1, -1, -1, -1])[1:]


def test_gravity_filter(spark):
    rng = np.random.default_rng(7)
    t = np.cumsum(rng.choice([0.005, 0.02, 0.3], 200))
    rate, force = rng.normal(0, 2, (200, 3)), rng.normal(0, 1, (200, 3)) + [0, 0, 9.8]
    force[:2] = 0
    g, last, want = None, None, []
    for k in range(200):
        n = np.linalg.norm(force[k])
        if g is None:
            g, last = (-force[k] / n, t[k]) if n > 1e-6 else (None, None)
        else:
            w = -rate[k] * min(t[k] - last, 0.05)
            last, g = t[k], turned(g, w, np.linalg.norm(w))
            g = 0.98 * g - 0.02 * force[k] / n
            g /= np.linalg.norm(g)
        want.append([None, None] if g is None else [np.arctan2(g[1], g[2]), -np.arcsin(g[0])])
    names = "t double, gx double, gy double, gz double, ax double, ay double, az double"
    df = spark.createDataFrame([(i, "f", float(t[i]), *map(float, rate[i]), *map(float, force[i])) for i in range(200)] + [(999, "f", 1.0, None, *[1.0] * 5)], "event_id long, run string, " + names)
    out = seq.gravity_filter(df, ["run"])
    roll, pitch = by_id(out, "roll"), by_id(out, "pitch")
    assert 999 not in roll and roll[0] is roll[1] is None
    assert [[roll[i], pitch[i]] for i in range(2, 200)] == [pytest.approx(w, abs=1e-9) for w in want[2:]]
