"""Controller logs: any topic by its fields, whatever its layout; cut and foreign files."""

import math
import struct

import numpy as np
import pytest

from skylattice.sources import ulog


def record(kind, body):
    return struct.pack("<H", len(body)) + kind.encode() + body


def log(yaws, zs):
    out = ulog.MAGIC + b"\x01" + struct.pack("<Q", 0)
    out += record("F", b"vec:float a;float b") + record("F", b"vehicle_attitude:uint64_t timestamp;uint8_t n;float[4] q;vec v;uint8_t[3] _padding0;")
    out += record("F", b"vehicle_local_position:uint64_t timestamp;float z;float vx;float vy;bool z_valid;")
    out += record("A", b"\x00" + struct.pack("<H", 7) + b"vehicle_attitude") + record("A", b"\x01" + struct.pack("<H", 8) + b"vehicle_attitude") + record("A", b"\x00" + struct.pack("<H", 3) + b"vehicle_local_position")
    for k, (yaw, z) in enumerate(zip(yaws, zs)):
        q = [math.cos(yaw / 2), 0.0, 0.0, math.sin(yaw / 2)]
        out += record("D", struct.pack("<HQB4f2f", 7, 1000 * k, 9, *q, 1.0, 2.0))  # the padding is left out
        out += record("D", struct.pack("<HQB4f2f", 8, 1000 * k, 9, *[9.0] * 6))
        out += record("D", struct.pack("<HQ3f?", 3, 1000 * k + 5, z, 1.0, 2.0, True)) + record("I", b"\x01x")
    return out


def test_topics(spark, tmp_path):
    yaws = np.linspace(0, 9, 50)
    zs = [math.nan if k == 4 else math.inf if k == 5 else -float(k) for k in range(50)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.ulg").write_bytes(log(yaws, zs))
    (tmp_path / "a/cut.ulg").write_bytes(log(yaws, zs)[:-7])
    (tmp_path / "a/none.ulg").write_bytes(b"something else altogether")
    (tmp_path / "a/other.bin").write_bytes(log(yaws, zs))
    a = [r for r in ulog.attitude(spark, str(tmp_path)).orderBy("t").collect() if r.path.endswith("one.ulg")]
    assert [r.yaw for r in a] == pytest.approx(list(yaws), abs=1e-6) and all((r.gx, r.gy, r.gz) == pytest.approx((0, 0, 1), abs=1e-6) for r in a)
    z = ulog.altitude(spark, str(tmp_path)).collect()
    assert sorted(r.alt for r in z if r.path.endswith("one.ulg")) == [float(k) for k in range(50) if k not in (4, 5)]
    m = ulog.motion(spark, str(tmp_path)).collect()
    assert {(r.v_east, r.v_north) for r in m} == {(2.0, 1.0)} and len(m) == 48 + 47  # the cut file lost its last one
    assert ulog.positions(spark, str(tmp_path)).count() == 0
    both = ulog.read_topic(spark, str(tmp_path), "vehicle_attitude", ("n", "q[3]", "nothing")).collect()
    assert {r.instance for r in both} == {0, 1} and {r.n for r in both} == {9.0} and all(r.nothing is None for r in both)
    assert len([r for r in both if r.path.endswith("one.ulg")]) == 100


def test_level_turned_body():
    """Gravity of a body rolled by a right angle lies along its side."""
    q = [math.cos(math.pi / 4), math.sin(math.pi / 4), 0.0, 0.0]
    blob = ulog.MAGIC + b"\x01" + b"\0" * 8 + record("F", b"vehicle_attitude:uint64_t timestamp;float[4] q;") + record("A", b"\x00\x01\x00vehicle_attitude") + record("D", struct.pack("<HQ4f", 1, 5, *q))
    d = ulog.decode(blob, "vehicle_attitude", ("q[0]", "q[1]"))
    assert d["t_us"].tolist() == [5] and d["q[1]"].tolist() == pytest.approx([math.sqrt(0.5)])
    assert len(ulog.decode(b"", "vehicle_attitude", ("q[0]",))) == 0
