"""MCAP recordings and configuration files."""

import struct

import pytest
import zstandard

from skylattice.sources.config import config_row, namespace, parse_simple_yaml
from skylattice.sources.mcap import MAGIC, layout, read_mcap


def rec(kind, body):
    return bytes([kind]) + struct.pack("<Q", len(body)) + body


def text(s):
    return struct.pack("<I", len(s)) + s.encode()


def channel(i, topic):
    return rec(0x04, struct.pack("<HH", i, 0) + text(topic) + text("cdr") + struct.pack("<I", 0))


def message(i, t, data):
    return rec(0x05, struct.pack("<HIQQ", i, 0, t, t) + data)


def chunk(records, how):
    data = zstandard.ZstdCompressor().compress(records) if how == "zstd" else records
    return rec(0x06, struct.pack("<QQQI", 0, 9, len(records), 0) + text(how) + struct.pack("<Q", len(data)) + data)


@pytest.mark.parametrize("outside", [True, False])
def test_mcap(spark, tmp_path, outside):
    path = str(tmp_path / "a.mcap")
    first = channel(1, "/imu0") + channel(2, "/cam0")
    body = rec(0x01, text("ros2") + text("x")) + (first if outside else b"")
    body += chunk((b"" if outside else first) + message(1, 5, b"a") + message(2, 6, b"b"), "zstd") + chunk(message(1, 7, b"c" * 1000), "") + message(2, 8, b"")
    with open(path, "wb") as f:
        f.write(MAGIC + body + rec(0x0F, b"\0" * 4) + b"\x05cut")
    assert len(layout(path)[0]) == 3
    got = {(r.ts_ns, r.topic, bytes(r.data)) for r in read_mcap(spark, path).collect()}
    assert got == {(5, "/imu0", b"a"), (6, "/cam0", b"b"), (7, "/imu0", b"c" * 1000), (8, "/cam0", b"")}
    assert read_mcap(spark, path, "/imu0").count() == 2
    with pytest.raises(Exception, match="no topic"):
        read_mcap(spark, path, "/none").count()


def test_config(spark):
    t = "%YAML:1.0\n---\n# note\nareas:\n  - name: a  # first\n    path: 'x/y'\n    n: 3\n  - name: b\n    ok: true\ncam0:\n  K: [[1.5, 0], [0, 2]]\n  model: radtan\nlist:\n- 1\n- two\nnone:\n"
    tree = parse_simple_yaml(t)
    assert tree == {"areas": [{"name": "a", "path": "x/y", "n": 3}, {"name": "b", "ok": True}], "cam0": {"K": [[1.5, 0], [0, 2]], "model": "radtan"}, "list": [1, "two"], "none": None}
    assert namespace(tree).areas[0].n == 3 and parse_simple_yaml("") == {}
    assert config_row(spark, t).count() == 4
