"""Decoders, recordings, logs and sinks on generated files."""

import sqlite3
import struct

import numpy as np
import pytest
from test_grid_fill import MSG, TOP, header, imu, pose

from skylattice.functions.cdr import image_fields
from skylattice.sources import decoders
from skylattice.sources.bag import read_bag, read_ulogs, walk_ulog
from skylattice.sources.sinks import mosaics, write_bank


def image(px, encoding=b"mono8\0", pad=2):
    h, w = px.shape
    b = b"\x00\x01\x00\x00" + struct.pack("<iI", 1, 2) + struct.pack("<I", 4) + b"cam\0"
    b += struct.pack("<II", h, w) + struct.pack("<I", len(encoding)) + encoding + b"\0"
    b += b"\0" * (-(len(b) - 4) % 4)
    rows = np.pad(px, ((0, 0), (0, pad)))
    return b + struct.pack("<II", w + pad, rows.size) + rows.tobytes()


def test_decoders(spark):
    px = np.arange(48, dtype=np.uint8).reshape(6, 8)
    rows = [
        (1, "f", 1, 10, imu([1, 2, 3, 4, 5, 6], b"a_long_frame\0"), 0), (2, "f", 1, 11, imu([1] * 6)[:-1], 0), (3, "f", 1, 12, None, 0), (4, "f", 1, 13, b"", 0),
        (5, "f", 2, 14, pose([7, 8, 9]), 0), (6, "f", 3, 15, image(px), 0), (7, "f", 3, 16, image(px, b"rgb8\0"), 0), (8, "f", 3, 17, b"short", 0), (9, None, 1, 1, imu([0] * 6), 0),
        (10, "f", 4, 18, header() + b"", 0), (11, "f", 4, 19, b"\0\1\0\0" + struct.pack("<I", 19) + b'{"k":3,"score":0.5}\0', 0),
    ]
    m = spark.createDataFrame(rows, MSG)
    t = spark.createDataFrame([("f", 1, "/imu0", ""), ("f", 2, "/x/local_position/pose", ""), ("f", 3, "/cam0/image_raw", ""), ("f", 4, "/x/health", "")], TOP)
    got = {r.msg_id: r for r in decoders.imu(m, t).collect()}
    assert [got[1][c] for c in ("gx", "gy", "gz", "ax", "ay", "az")] == [1, 2, 3, 4, 5, 6] and got[1].stamp == pytest.approx(5 + 7e-9)
    assert set(got) == {1, 2, 3, 4} and not any(got[k].ok for k in (2, 3, 4)) and got[2].gx is None
    p = decoders.poses(m, t).first()
    assert (p.x, p.y, p.z, p.qw) == (7, 8, 9, 1)
    f = {r.msg_id: r for r in decoders.frames(m, t).collect()}
    assert (f[6].height, f[6].width, f[6].mean, f[6].error) == (6, 8, px.mean(), None)
    assert f[7].error == "NotImplementedError" and f[8].error and f[8].mean is None
    h = {r.msg_id: r for r in decoders.health(m, t).collect()}
    assert h[11].k == 3 and h[11].score == 0.5 and h[10].k is None
    assert decoders.imu(m.limit(0), t).count() == 0


def test_image_stride():
    px = np.random.default_rng(0).integers(0, 255, (5, 7)).astype(np.uint8)
    assert image_fields(image(px, pad=3))["pixels"] == px.tobytes()


def test_bag(spark, tmp_path):
    path = str(tmp_path / "b.db3")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE topics(id INTEGER, name TEXT)")
        c.execute("CREATE TABLE messages(topic_id INTEGER, timestamp INTEGER, data BLOB)")
        c.executemany("INSERT INTO topics VALUES (?, ?)", [(1, "/imu0"), (2, "/cam0")])
        c.executemany("INSERT INTO messages VALUES (?, ?, ?)", [(1 + i % 2, i, bytes([i % 256])) for i in range(250)])
    assert read_bag(spark, path).count() == 250
    got = read_bag(spark, path, "/imu0").orderBy("ts_ns").collect()
    assert [r.ts_ns for r in got] == list(range(0, 250, 2)) and bytes(got[1].data) == b"\x02"
    assert read_bag(spark, path, payload=False).where("data is not null").count() == 0
    with pytest.raises(Exception, match="no topic"):
        read_bag(spark, path, "/none").count()


def test_ulog(spark, tmp_path):
    rec = lambda kind, body: struct.pack("<HB", len(body), ord(kind)) + body
    data = b"H" * 16 + rec("I", b"info") + rec("D", struct.pack("<HQ", 7, 1_500_000) + b"abc") + rec("D", struct.pack("<HQ", 8, 2_000_000)) + struct.pack("<HB", 50, ord("D")) + b"cut"
    assert list(walk_ulog(data)) == [(7, 1.5, b"abc"), (8, 2.0, b"")] and list(walk_ulog(b"")) == []
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.ulg").write_bytes(data)
    (tmp_path / "logs" / "empty.ulg").write_bytes(b"")
    assert sorted((r.msg_id, r.t, bytes(r.payload)) for r in read_ulogs(spark, f"file://{tmp_path}/logs").collect()) == [(7, 1.5, b"abc"), (8, 2.0, b"")]


def test_mosaic_and_bank(spark, tmp_path):
    tile = lambda v: bytes([v] * 4)
    df = spark.createDataFrame([(1, 0, 0, tile(1)), (1, 1, 0, tile(2)), (1, 1, 0, tile(9)), (1, 3, 3, tile(4)), (1, 2, 2, None)], "z int, x int, y int, pixels binary")
    got = {(r.bx, r.by): r for r in mosaics(df, 2, 2).collect()}
    assert set(got) == {(0, 0), (1, 1)} and got[(0, 0)].missing == 2
    a = np.frombuffer(bytes(got[(0, 0)].pixels), np.uint8).reshape(4, 4)
    assert a[0].tolist() == [1, 1, 2, 2] and a[2].tolist() == [0] * 4
    bank = spark.createDataFrame([(i % 3, i % 5, f"l{i % 2}", i) for i in range(60)], "area int, node int, layer_file string, v int")
    write_bank(bank, f"file://{tmp_path}/bank", 2)
    assert spark.read.parquet(f"file://{tmp_path}/bank").count() == 60
