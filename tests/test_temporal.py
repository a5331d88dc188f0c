"""Temporal joins against NumPy twins, across bucket edges, with ties and nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import temporal as tj

LEFT = "id long, run string, t double, value string, prev int"
RIGHT = "run string, t double, value double, id string"


def sides(spark, seed=0, n=300):
    rng = np.random.default_rng(seed)
    left = [(i, str(r), float(t), "v", 1) for i, (r, t) in enumerate(zip(rng.choice(["hot", "a"], n, p=[0.8, 0.2]), rng.integers(0, 1000, n)))]
    right = [(str(r), float(t), float(v), "x") for r, t, v in zip(rng.choice(["hot", "b"], n), rng.integers(100, 900, n), rng.random(n))]
    return left, right, spark.createDataFrame([*left, (-1, "hot", None, None, None), (-2, None, 5.0, None, None)], LEFT), spark.createDataFrame([*right, ("hot", None, 5.0, None)], RIGHT)


def series(right, run):
    by = {}
    for r, t, v, _ in right:
        if r == run:
            by[t] = min(by.get(t, v), v)
    t = np.array(sorted(by))
    return t, np.array([by[x] for x in t])


@pytest.mark.parametrize("width", [50.0, 1e9])
def test_bracket_equals_search(spark, width):
    left, right, el, r = sides(spark)
    got = {x.id: x for x in tj.bracket_join(el, r, ["run"], ["value"], width).select("id", F.col("prev.t").alias("p"), F.col("next.t").alias("n"), "value").collect()}
    assert len(got) == len(left) + 2 and got[-1].p is None and got[-2].n is None and got[0].value == "v"
    for i, run, t, _, _ in left:
        ts, _ = series(right, run)
        k = np.searchsorted(ts, t, side="right")
        assert got[i].p == (ts[k - 1] if k else None)
        k = np.searchsorted(ts, t, side="left")
        assert got[i].n == (ts[k] if k < len(ts) else None)


def test_lerp_equals_interp(spark):
    left, right, el, r = sides(spark, 1)
    got = {x.id: x.x for x in tj.bracket_join(el, r, ["run"], ["value"], 40.0).withColumn("x", tj.lerp("value")).select("id", "x").collect()}
    for i, run, t, _, _ in left:
        ts, vs = series(right, run)
        assert got[i] == (pytest.approx(np.interp(t, ts, vs)) if len(ts) else None)


def frames(spark, times, values, at):
    r = spark.createDataFrame([("r", t, v, "") for t, v in zip(times, values)], RIGHT)
    el = spark.createDataFrame([(i, "r", t, "", 0) for i, t in enumerate(at)], LEFT)
    return tj.bracket_join(el, r, ["run"], ["value"])


def test_age_gate_and_invalid_values(spark):
    b = frames(spark, [10.0, 10.1, 10.2, 10.3], [0.01, 0.02, 0.03, 0.04], [10.15, 10.3, 10.9, 9.4])
    got = [r.x for r in b.withColumn("x", tj.lerp("value", max_age=0.5)).orderBy("id").collect()]
    assert got[:2] == pytest.approx([0.025, 0.04]) and got[2:] == [None, None]
    b = frames(spark, [10.0, 10.1, 10.2, 10.3], [0.01, float("nan"), 0.03, 0.04], [10.15, 10.3])
    assert [r.x for r in b.withColumn("x", tj.lerp("value", max_age=0.5)).orderBy("id").collect()] == [None, 0.04]


def test_nearest_ties_go_to_the_earlier(spark):
    b = frames(spark, [1.0, 3.0], [5.0, 7.0], [2.0, 2.5, 9.0])
    got = [r.m and r.m.value for r in b.withColumn("m", tj.nearest(tolerance=1.0)).orderBy("id").collect()]
    assert got == [5.0, 7.0, None]
    assert [r.m.value for r in b.withColumn("m", tj.forward_clamped()).orderBy("id").collect()] == [7.0, 7.0, 7.0]


def test_empty(spark):
    el, r = spark.createDataFrame([], LEFT), spark.createDataFrame([], RIGHT)
    assert tj.bracket_join(el, r, ["run"], ["value"]).count() == 0
