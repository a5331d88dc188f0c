"""Image operators on tables: windows against brute force, whole frames, broken payloads."""

import struct

import numpy as np

from skylattice.functions.images import ground_projection, valid_coverage
from skylattice.operators.images import crops, cut_window, ground_patches, nadir_window


def image(px):
    h, w = px.shape
    head = b"\x00\x01\x00\x00" + struct.pack("<iI", 5, 7) + struct.pack("<I", 4) + b"cam\0"
    head += struct.pack("<II", h, w) + struct.pack("<I", 6) + b"mono8\0" + b"\0"
    head += b"\0" * (-(len(head) - 4) % 4)
    return head + struct.pack("<II", w, h * w) + px.astype(np.uint8).tobytes()


def test_nadir_window():
    rng = np.random.default_rng(0)
    for trial in range(60):
        h, w, size = (int(x) for x in rng.integers((5, 5, 2), (20, 20, 7)))
        mask = rng.random((h, w)) < (0.97 if trial % 3 else 0.5)
        extent = (-float(rng.integers(-3, w + 3)), -float(rng.integers(-3, h + 3)), 0.0, 0.0)
        cy, cx, half = round(-extent[1]), round(-extent[0]), size // 2
        clear = lambda y, x: all(mask[a, b] for a in range(max(0, y - half), min(h, y - half + size)) for b in range(max(0, x - half), min(w, x - half + size)))  # noqa: B023, E731
        ok = [(y, x) for y in range(h) for x in range(w) if clear(y, x)]
        if (cy, cx) not in ok and ok:
            cy, cx = min(ok, key=lambda p: ((p[0] - cy) ** 2 + (p[1] - cx) ** 2, p))
        assert nadir_window(mask, extent, size, 1.0) == (cy - half, cx - half)


def test_cut_window():
    a = np.arange(12).reshape(3, 4)
    assert cut_window(a, -1, 2, 3).tolist() == [[0, 0, 0], [2, 3, 0], [6, 7, 0]]
    assert not cut_window(a, 50, 50, 2).any()


def test_ground_patches(spark):
    px = np.random.default_rng(1).integers(0, 255, (40, 60))
    rows = [(1, image(px), 60.0, 0.0, 0.0), (2, image(px), 60.0, 0.3, -0.2), (3, image(px)[:50], 60.0, 0.0, 0.0), (4, None, 60.0, 0.0, 0.0), (5, image(px), None, 0.0, 0.0), (6, image(px), -3.0, 0.0, 0.0), (None, image(px), 60.0, 1.5, 0.0)]
    df = spark.createDataFrame(rows, "msg_id long, data binary, altitude double, roll double, pitch double")
    got = {r.msg_id: r for r in ground_patches(df, size_m=24.0).collect()}
    for k in (1, 2):
        g, mask, extent = ground_projection(px.astype(float), *rows[k - 1][2:], 60, 60, 29.5, 19.5)
        top, left = nadir_window(mask, extent, 24, 1.0)
        want = np.clip(np.round(cut_window(g, top, left, 24)), 0, 255).astype(np.uint8)
        assert np.array_equal(np.frombuffer(got[k].patch, np.uint8).reshape(24, 24), want) and got[k].error is None and got[k].coverage == valid_coverage(mask, extent)
    assert not got[1].shifted and abs(got[1].centre_x) <= 1
    assert all(got[k].patch is None and got[k].error for k in (3, 4, 5, 6, None))
    assert ground_patches(df.limit(0)).count() == 0
    bent = ground_patches(df.where("msg_id = 1"), size_m=24.0, undistort=("equidistant", (0.1, 0.0, 0.0, 0.0))).first()
    assert bent.patch != got[1].patch and bent.error is None


def test_crops(spark):
    a = np.arange(100, dtype=np.uint8).reshape(10, 10)
    rows = [(1, 10, 10, a.tobytes(), 5.0, 5.0, None), (2, 10, 10, a.tobytes(), 0.0, 9.0, None), (3, 10, 10, a.tobytes(), 5.0, 5.0, 0.0), (4, 10, 10, None, 5.0, 5.0, 0.0), (5, 10, 9, a.tobytes(), 5.0, 5.0, None)]
    df = spark.createDataFrame(rows, "id long, height int, width int, pixels binary, cx double, cy double, angle double")
    got = {r.id: r.crop and np.frombuffer(r.crop, np.uint8).reshape(4, 4) for r in crops(df, 4).collect()}
    assert np.array_equal(got[1], a[3:7, 3:7]) and np.array_equal(got[3], a[3:7, 3:7]) and got[4] is None and got[5] is None
    assert np.array_equal(got[2], np.pad(a, 4, mode="reflect")[11:15, 2:6])
