"""Nearest pairs against brute force, over batch and bucket edges."""

import bisect

import numpy as np
import pytest

from skylattice.llm.nearest_time import nearest_in_time

SCHEMA = "id long, entity string, topic int, t long, right boolean, bucket string"


def brute(left, right, tol):
    one = {}
    for i, e, _, t in right:
        if None not in (i, e, t):
            one.setdefault(e, {}).setdefault(t, []).append((_ if _ is not None else -1, i))
    out, seen = set(), {}
    for i, e, p, t in left:
        if None not in (i, e, t):
            k = (e, -1 if p is None else p, t)
            seen[k] = min(seen.get(k, i), i)
    for (e, _, t), i in seen.items():
        ts = sorted(one.get(e, {}))
        k = bisect.bisect_right(ts, t)
        near = [(abs(ts[j] - t), ts[j]) for j in (k - 1, k) if 0 <= j < len(ts) and abs(ts[j] - t) <= tol]
        if near:
            gap, at = min(near)
            out.add((i, min(one[e][at])[1], gap))
    return out


@pytest.mark.parametrize("batch", [3, 10_000])
@pytest.mark.parametrize("bucket", [40, None])
def test_equals_brute_force(spark, batch, bucket):
    rng = np.random.default_rng(batch)
    make = lambda n, base: [(base + i, str(rng.choice(["hot"] * 5 + ["a", "b"])), int(rng.integers(0, 2)), int(rng.integers(-300, 1500))) for i in range(n)]
    left, right = make(700, 0), make(500, 10_000)
    left += left[:30] + [(None, "hot", 1, 5), (1, None, 1, 5), (2, "hot", 1, None), (3, "hot", None, 7)]
    right += right[:30] + [(None, "hot", 1, 5), (9, None, 1, 5), (9, "hot", 1, None)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = lambda rows: spark.createDataFrame([(*r, True, "x") for r in rows], SCHEMA)
        got = [tuple(r) for r in nearest_in_time(df(left), df(right), 10, bucket).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(set(got)) and set(got) == brute(left, right, 10)


def test_ties_and_tolerance(spark):
    df = lambda rows: spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    left = df([(1, "e", 1, 100), (2, "e", 1, 200), (3, "e", 1, 300)])
    right = df([(10, "e", 2, 90), (11, "e", 2, 110), (12, "e", 2, 211), (13, "e", 2, 310), (14, "e", 2, 310)])
    assert {tuple(r) for r in nearest_in_time(left, right, 10).collect()} == {(1, 10, 10), (3, 13, 10)}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "e", 1, 1, None, None)], SCHEMA)
    assert nearest_in_time(none, some, 5).count() == 0 and nearest_in_time(some, none, 5).count() == 0 and nearest_in_time(none, none, 5).count() == 0
