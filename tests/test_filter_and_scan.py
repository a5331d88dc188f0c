"""Particle filter, peaks, scoring, state machines and image kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import images
from skylattice.operators import particles as pf
from skylattice.operators import peaks as pk
from skylattice.operators import scoring
from skylattice.streaming.machine import Machine, Rule, run_batch

PART = "run int, pid int, x double, y double, yaw double, scale double, w double"


def cloud(spark, n=200, seed=0):
    rng = np.random.default_rng(seed)
    w = rng.pareto(1.0, n)
    w /= w.sum()
    rows = [(1, i, *map(float, rng.normal(size=3)), 1.0, float(k)) for i, k in enumerate(w)]
    return np.array([r[2:] for r in rows]), spark.createDataFrame(rows, PART)


def test_estimate(spark):
    a, df = cloud(spark)
    r = pf.estimate(df).first()
    w = a[:, 4]
    mx, my = (w * a[:, 0]).sum(), (w * a[:, 1]).sum()
    assert (r.x, r.y) == pytest.approx((mx, my))
    assert r.spread == pytest.approx(np.sqrt((w * ((a[:, 0] - mx) ** 2 + (a[:, 1] - my) ** 2)).sum()))
    assert r.neff == pytest.approx(1 / (w**2).sum()) and r.yaw == pytest.approx(np.arctan2((w * np.sin(a[:, 2])).sum(), (w * np.cos(a[:, 2])).sum()))


def test_resampling_equals_search(spark):
    a, df = cloud(spark)
    n, w = len(a), a[:, 4]
    u = df.select(pf.uniform("resample", F.col("run"))).first()[0]
    cum = np.cumsum(w)
    cum[-1] = 1.0
    want = a[np.searchsorted(cum, (np.arange(n) + u) / n), 0]
    got = pf.resample(df, 1.1).orderBy("pid").collect()
    assert [r.pid for r in got] == list(range(n)) and [r.x for r in got] == pytest.approx(list(want)) and got[0].w == pytest.approx(1 / n)
    assert [r.w for r in pf.resample(df, 0.0).orderBy("pid").collect()] == pytest.approx(list(w))  # enough effective particles


def test_trajectory_converges(spark):
    runs = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0)], "run int, x double, y double, yaw double, scale double")
    p = pf.initial(runs, 400, (30.0, 30.0, 0.05, 0.02))
    tx, ty = 10.0, -15.0
    for k in range(6):
        tx += 20.0
        moved = pf.predict(p, F.lit(20.0), F.lit(0.0), F.lit(0.0), (2.0, 2.0, 0.01), f"s{k}:p")
        score = moved.select("run", "pid", F.exp(-((F.col("x") - tx) ** 2 + (F.col("y") - ty) ** 2) / 800.0).alias("score"))
        p, est = pf.step(p, score, (F.lit(20.0), F.lit(0.0), F.lit(0.0)), (2.0, 2.0, 0.01), 0.1, 0.5, (1.0, 1.0, 0.01, 0.01), 1.0, f"s{k}")
        p = p.checkpoint()
        e = est.first()
    assert np.hypot(e.x - tx, e.y - ty) < 15 and e.spread < 50


def test_suppression_and_maxima(spark):
    peaks = spark.createDataFrame([(1, s, x, 0.0, y) for s, x, y in [(0.9, 0.0, 0.0), (0.8, 50.0, 90.0), (0.7, 200.0, 0.0), (0.7, 210.0, 0.0), (0.1, 900.0, 0.0)]], "scan int, score double, x double, y double, yaw double")
    got = [(r.score, r.x) for r in pk.suppress(peaks, ["scan"], 3, pk.within(100.0, "x", "y")).orderBy("rank").collect()]
    assert got == [(0.9, 0.0), (0.7, 210.0), (0.1, 900.0)]
    got = [r.x for r in pk.suppress(peaks, ["scan"], 5, pk.within_and_yaw(100.0, 30.0)).orderBy("rank").collect()]
    assert got == [0.0, 50.0, 210.0, 900.0]
    grid = spark.createDataFrame([(0, i, j, float(v)) for i, row in enumerate([[1, 2, 1], [2, 5, 5], [0, 0, 9]]) for j, v in enumerate(row)], "g int, i int, j int, score double")
    assert {(r.i, r.j) for r in pk.local_maxima(grid, ["g"]).collect()} == {(2, 2)}
    assert [r.x for r in pk.suppress(peaks, ["scan"], 3, pk.within(1.0, "x")).orderBy("rank").collect()] == [0.0, 50.0, 210.0]


def test_bilinear(spark):
    ramp = spark.createDataFrame([(0, i, j, 3.0 * j + 5.0 * i) for i in range(4) for j in range(5)], "g int, i int, j int, score double")
    at = [(0.0, 2.1), (1.3, 0.0), (3.0, 1.9), (2.75, 2.2), (9.0, -3.0), (-1.0, 9.0)]
    pts = spark.createDataFrame([(k, 0, r, c) for k, (r, c) in enumerate(at)], "k int, g int, r double, c double")
    got = [r.value for r in pk.bilinear(ramp, pts, ["g"], 4, 5).orderBy("k").collect()]
    assert got == pytest.approx([3 * np.clip(c, 0, 4) + 5 * np.clip(r, 0, 3) for r, c in at])


def test_bilinear_reads_the_whole_grid(spark, tmp_path):
    from skylattice.plans.scan_queries import bilinear_grid

    n, rows, last = 733, 30, 7  # 29 full rows and one of 8 cells
    rng = np.random.default_rng(1)
    vec = rng.normal(size=(n, 4)).astype(np.float32) * 0.3
    spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(vec)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    value = rng.uniform(0, 100, 300).round(3)
    spark.createDataFrame([(i, 1, "click", float(v)) for i, v in enumerate(value)], "event_id long, user_id long, event_type string, value double").selectExpr("*", "TIMESTAMP_NTZ'2020-01-01 00:00:00' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    score = np.round(1 / (1 + np.exp(-5.0 * (vec.astype(np.float64) @ vec[0].astype(np.float64)))), 9)
    cell = lambda i, j: score[i * 25 + (min(j, last) if i == rows - 1 else j)]
    want = []
    for v in value:
        r, c = np.clip(v % (rows + 2) - 1, 0, rows - 1), np.clip(v * 3 % 27 - 1, 0, 24)
        i, j = int(r), int(c)
        k, m = min(i + 1, rows - 1), min(j + 1, 24)
        want.append((cell(i, j) * (1 - c + j) + cell(i, m) * (c - j)) * (1 - r + i) + (cell(k, j) * (1 - c + j) + cell(k, m) * (c - j)) * (r - i))
    got = {r.event_id: r.value for r in bilinear_grid(spark, str(tmp_path)).collect() if r.query_id == 0}
    assert [got[i] for i in range(300)] == pytest.approx(want, abs=2e-6)


def test_scans_of_all_stated_queries(spark, data):
    from skylattice.plans.scan_queries import QUERIES

    e = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding", "label").orderBy("vec_id").collect()
    v, label = np.array([r.embedding for r in e], np.float64), np.array([r.label for r in e])
    stated = [k for k in range(len(e)) if k % 50 == 0]
    peaks, weights, cells = set(), {}, {}
    for q in stated:
        s = 1 / (1 + np.exp(-5.0 * (v @ v[q])))
        g = cells[q] = np.round(s, 9).reshape(-1, 25)
        around = np.pad(g, 1, constant_values=-1)
        best = np.max([around[a : a + len(g), b : b + 25] for a in range(3) for b in range(3)], axis=0)
        peaks |= {(q, int(i), int(j)) for i, j in np.argwhere(g == best)}
        for run in set(label):
            own = np.flatnonzero(label == run)
            w = np.exp((s[own] - s[own].max()) / 0.05)
            weights |= {(q, int(run), int(k)): x for k, x in zip(own, w / w.sum())}
    got = [(r.query_id, r.i, r.j) for r in QUERIES["grid_local_maxima"](spark, data).collect()]
    assert set(got) == peaks and len(got) == len(peaks)
    got = {(r.query_id, r.label, r.pid): r.w for r in QUERIES["softmax_weights"](spark, data).collect()}
    assert got.keys() == weights.keys() and [got[k] for k in weights] == pytest.approx(list(weights.values()), abs=2e-9)
    neff = {(q, int(run)): 1 / sum(w * w for (a, b, _), w in weights.items() if (a, b) == (q, run)) for q in stated for run in set(label)}
    got = {(r.query_id, r.label): r.neff for r in QUERIES["ess_by_run"](spark, data).collect()}
    assert got.keys() == neff.keys() and [got[k] for k in neff] == pytest.approx(list(neff.values()), abs=2e-6)
    clicks = {r.event_id: r.value for r in spark.read.parquet(f"{data}/events.parquet").where("event_type = 'click'").collect()}
    got = {(r.query_id, r.event_id): r.value for r in QUERIES["bilinear_grid"](spark, data).collect()}
    assert got.keys() == {(q, e) for q in stated for e in clicks}
    for (q, e), value in got.items():
        g = cells[q]
        r, c = clicks[e] % (len(g) + 2) - 1, clicks[e] * 3 % 27 - 1
        r, c = min(max(r, 0), len(g) - 1), min(max(c, 0), 24)
        i, j = int(r), int(c)
        k, m = min(i + 1, len(g) - 1), min(j + 1, 24)
        assert value == pytest.approx(g[i, j] * (1 - r + i) * (1 - c + j) + g[i, m] * (1 - r + i) * (c - j) + g[k, j] * (r - i) * (1 - c + j) + g[k, m] * (r - i) * (c - j), abs=2e-6)
    for name in ("weighted_pose", "systematic_resample", "predict_step", "roughen_step", "filter_step_once"):
        assert {(r.query_id, r.label) for r in QUERIES[f"{name}"](spark, data).select("query_id", "label").distinct().collect()} == set(neff)


def test_sweep_of_every_vector(spark, data):
    from skylattice.plans.scan_queries import rotation_sweep

    want = {}
    for (i,) in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id").collect():
        score = lambda a, i=i: round(float(np.cos(np.radians(a - i * 37 % 720 / 2))), 9)
        a0 = max(range(0, 360, 2), key=lambda a: (score(a), -a))
        a = max((a0 + k * 0.5 for k in range(-8, 9)), key=lambda a: (score(a), -a))
        want[i] = (a, round(score(a), 6))
    rows = [(r.id, r.angle, r.score) for r in rotation_sweep(spark, data).collect()]
    assert {i: (a, s) for i, a, s in rows} == want and len(rows) == len(want)


def test_search_in_blocks(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None)], "id long, vec array<double>")
    got = scoring.search(df.where("id % 10 = 0"), df, 5, block=4).collect()
    want = {(q, int(i)) for q in range(0, 120, 10) for i in np.argsort(-(v @ v[q]))[:5]}
    assert {(r.query_id, r.row_id) for r in got} == want and len(got) == 60
    assert scoring.search(df.limit(0), df, 5).count() == scoring.search(df, df.limit(0), 5).count() == 0
    again = scoring.search(df.where("id % 10 = 0").repartition(3), df.repartition(4), 5, block=7, most_sent=3).collect()  # paired by partitions
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    few, many = (scoring.score_pairs(df.where("id % 10 = 0"), df.withColumn("x", -F.col("id")), ["x"], block=50, most_sent=n).collect() for n in (100, 0))
    assert sorted(map(tuple, few)) == sorted(map(tuple, many)) and len(few) == 120 * 12 and all(r.x == -r.row_id for r in few)
    assert max(abs(r.score - 1 / (1 + np.exp(-5 * v[r.query_id] @ v[r.row_id]))) for r in few) < 1e-12


def test_machine(spark):
    rules = (Rule("a", "go", 2.0, "b"), Rule("b", "timeout", 5.0, "c"), Rule("*", "stop", 0.0, "a"))
    m = Machine("a")
    states = []
    for t, go, stop in [(0, True, False), (1, None, False), (2, True, False), (3, False, False), (7, False, False), (8, False, True)]:
        m.advance(t, {"go": go, "stop": stop}, rules)
        states.append(m.state)
    assert states == ["a", "a", "b", "b", "c", "a"] and Machine.load(m.dump()) == m
    df = spark.createDataFrame([("k", 0.0, True, False), ("k", 3.0, True, None), (None, 1.0, None, None), ("k", None, True, True)], "key string, t double, go boolean, stop boolean")
    assert {(r.key, r.t, r.state) for r in run_batch(df, ["key"], rules, "a").collect()} == {("k", 0.0, "a"), ("k", 3.0, "b"), (None, 1.0, "a")}


def test_image_kernels():
    img = np.random.default_rng(0).random((60, 80)) * 255
    assert np.allclose(images.rotated_crop(img, 40, 30, 0.0, 20, 20), img[20:40, 30:50])
    assert np.allclose(images.rotated_crop(img, 40, 30, np.pi / 2, 20, 20), np.rot90(img[20:40, 30:50]), atol=1e-6) or np.allclose(images.rotated_crop(img, 40, 30, np.pi / 2, 20, 20), np.rot90(img[20:40, 30:50], -1), atol=1e-6)
    assert images.centred_crop(img, 2, 2, 20).shape == (20, 20)
    p, mask, ext = images.ground_projection(img, 40.0, 0.0, 0.0, 40.0, 40.0, 40.0, 30.0)
    assert ext == pytest.approx((-40, -30, 40, 30)) and p.shape == (60, 80) and mask.mean() > 0.9
    assert images.valid_coverage(mask, ext) == 56.0
    assert images.valid_coverage(np.zeros((5, 5), bool), (-2, -2, 3, 3)) == 24.0
    k = np.array([[50.0, 0, 40], [0, 50.0, 30], [0, 0, 1]])
    for model in ("radtan", "equidistant"):
        x, y = images.lens_maps(80, 60, k, (0.0, 0.0, 0.0, 0.0), model)
        assert abs(x[30, 40] - 40) < 1e-9 and abs(y[30, 40] - 30) < 1e-9
    assert images.phase_shift(img, np.roll(img, (3, -5), (0, 1)))[:2] == (-5.0, 3.0)
    assert images.laplacian_variance(np.ones((5, 5))) == 0.0 and images.channels_first(np.zeros((2, 3, 4))).shape == (4, 2, 3)
