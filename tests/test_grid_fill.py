"""The regular series: cases against brute force, exact observed cells, recovery of hidden ones, dirt."""

import struct

import numpy as np
import pytest

from skylattice.operators.grid_fill import als_complete, complete_series, fill_errors, missing_slots, regular_series, slot_readings

S = 500_000_000
MSG = "msg_id long, flight string, topic_id int, timestamp long, data binary, slot int"
TOP = "flight string, id int, name string, type string"


def header(frame=b"imu\0"):
    b = b"\x00\x01\x00\x00" + struct.pack("<iI", 5, 7) + struct.pack("<I", len(frame)) + frame
    return b + b"\0" * (-(len(b) - 4) % 8)


def imu(v, frame=b"imu\0"):
    return header(frame) + struct.pack("<13d", *[0.0] * 13) + struct.pack("<3d", *v[:3]) + b"\0" * 72 + struct.pack("<3d", *v[3:]) + b"\0" * 72


def pose(v, frame=b"odom\0"):
    return header(frame) + struct.pack("<7d", *v, 0, 0, 0, 1)


def build(spark, rows, topics=(("f", 1, "/uav/imu0", "Imu"), ("f", 2, "/mavros/local_position/pose", "Pose"), ("f", 3, "/cam0/image_raw", "Image"))):
    m = [(i, f, t, ts, d, 9) for i, (f, t, ts, d) in enumerate(rows)]
    return spark.createDataFrame(m, MSG), spark.createDataFrame(list(topics), TOP)


def brute(rows, imu_topics=(1,), pose_topics=(2,)):
    good = {}
    for f, t, ts, d in rows:
        if ts and d and t in imu_topics + pose_topics and len(d) > 40 and f is not None:
            off = 16 + struct.unpack_from("<I", d, 12)[0]
            off = 4 + (off - 4 + 7) // 8 * 8
            need = 296 if t in imu_topics else 56
            if len(d) < off + need:
                continue
            v = struct.unpack_from("<3d", d, off + (104 if t in imu_topics else 0)) + (struct.unpack_from("<3d", d, off + 200) if t in imu_topics else ())
            if np.isfinite(v).all():
                good.setdefault((f, t), []).append(ts)
    out = set()
    for k, ts in good.items():
        ts.sort()
        for a, b in zip(ts[:-1], ts[1:]):
            if b - a <= 10_000_000_000:
                out |= {(*k, s) for s in range(a // S + 1, b // S)}
    return out


def test_gaps_equal_brute_force_with_dirt(spark):
    rng = np.random.default_rng(3)
    rows, t = [], 1_800_000_000 * S
    for i in range(1500):  # across several windows of 64 slots
        t += int(rng.choice([0, 10, 200, 700, 4000, 9999, 10_000, 10_001, 20_000], p=[0.05, 0.3, 0.35, 0.15, 0.08, 0.02, 0.02, 0.02, 0.01]) * 1_000_000)
        topic = int(rng.choice([1, 2, 3]))
        d = imu(rng.normal(size=6)) if topic == 1 else pose(rng.normal(size=3)) if topic == 2 else b"x" * 60
        kind = rng.random()
        if kind < 0.05:
            d = d[: int(rng.integers(0, len(d)))]
        elif kind < 0.08:
            d = None
        elif kind < 0.1:
            d = imu([np.nan] * 6) if topic == 1 else pose([np.inf, 0, 0])
        rows.append(("f", topic, [t, None, 0][int(rng.choice([0, 0, 0, 0, 0, 0, 0, 0, 1, 2]))], d))
        if kind > 0.9:
            rows.append(rows[-1])  # delivered twice
    rng.shuffle(rows)
    rows.append((None, 1, t, imu([0] * 6)))
    got = missing_slots(regular_series(*build(spark, rows), window=64)).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(rows)


def test_observed_cells_are_exact_and_filled_follow_the_motion(spark):
    track = lambda s: [10 * np.sin(s / 20), 0.5 * s, 30.0]
    rows = [("f", 2, (1000 + s) * S + 3, pose(track(s))) for s in range(300) if s % 7 != 3]
    out = {r.slot - 1000: r for r in regular_series(*build(spark, rows)).collect()}
    assert set(out) == set(range(300))
    for s, r in out.items():
        if s % 7 == 3:
            assert r.status == "filled" and np.abs(np.array(r.vals) - track(s)).max() < 3.0
        else:
            assert r.status == "observed" and r.vals == track(s)


def test_long_gap_stays_marked_and_stop_ends_the_series(spark):
    slots = [0, 1, 2, 3, 4, 5, 6, 7, 26, 27, 28, 29, 30, 31, 32, 60, 61]
    rows = [("f", 2, (5000 + s) * S, pose([float(s), 0, 0])) for s in slots]
    out = {r.slot - 5000: r.status for r in regular_series(*build(spark, rows)).collect()}
    assert set(out) == set(range(33)) | {60, 61}
    assert out[16] == "unsupported" and all(out[s] == "observed" for s in slots)


def test_null_ids_and_names_still_count(spark):
    rows = [(None if s % 2 else s, "f", 2, (9000 + s) * S, pose([float(s), 1, 2]), None) for s in range(40) if s != 20]
    m = spark.createDataFrame(rows + [(5, "f", None, S, pose([0, 0, 0]), None)], MSG)
    t = spark.createDataFrame([("f", 2, "/local_position/pose", None), ("f", None, "/imu0", None), (None, 2, "/imu0", None), ("f", 7, None, None)], TOP)
    out = regular_series(m, t).collect()
    assert len(out) == 40 and [r.slot - 9000 for r in out if r.status != "observed"] == [20]


def test_many_sources_give_the_same_readings(spark):
    rng = np.random.default_rng(11)
    rows = [("f", int(rng.integers(1, 4)), int(s) * S // 3, [imu(rng.normal(size=6)), pose(rng.normal(size=3)), b"x" * 60, None, imu([np.nan] * 6), b""][int(rng.integers(0, 6))]) for s in rng.integers(1, 400, 500)]
    m, t = build(spark, rows)
    few, many = (sorted(map(repr, slot_readings(m, t, n).collect())) for n in (100, 0))
    assert few == many and len(few) > 50


def test_fill_errors(spark):
    track = lambda s: [10 * np.sin(s / 20), 0.5 * s, 30.0]
    rows = [("f", 2, (1000 + s) * S + 3, pose(track(s))) for s in range(600)]
    (r,) = fill_errors(slot_readings(*build(spark, rows))).collect()
    assert r.kind == "pose" and r.hidden % 2 == 0 and r.hidden > 40 and r.filled == r.hidden
    assert r.error < 0.2 < r.mean_error  # the channel that never changes isn't scored
    assert fill_errors(slot_readings(*build(spark, []))).count() == 0


def test_empty_tables(spark):
    assert regular_series(*build(spark, [])).count() == 0
    assert regular_series(*build(spark, [("f", 2, S, pose([1, 2, 3]))], topics=())).count() == 0


def test_als_recovers_low_rank_and_keeps_observed():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9, 2)) @ rng.normal(size=(2, 200))
    y = np.where(rng.random(x.shape) < 0.2, np.nan, x)
    y[:, 17] = np.nan
    done, support = als_complete(y, rank=2, ridge=1e-3)
    seen = np.isfinite(y)
    assert (done[seen] == y[seen]).all()
    assert np.isnan(done[:, 17]).all() and not support[:, 17].any()
    hidden = ~seen & support
    assert np.sqrt(np.mean((done[hidden] - x[hidden]) ** 2)) < 0.2 * x.std()


@pytest.mark.parametrize("x", [np.full((1, 3, 20), np.nan), np.ones((2, 3, 20)), np.where(np.arange(20) % 2, np.nan, 1.0) * np.ones((1, 3, 20))])
def test_degenerate_series(x):
    done, good = complete_series(x.copy())
    assert np.isnan(done[~good]).all() and (done[np.isfinite(x)] == x[np.isfinite(x)]).all()
