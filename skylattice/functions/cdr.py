"""Vectorised decoding of little-endian CDR payloads held in Arrow binary arrays.

A payload is a 4-byte encapsulation, a header (``sec`` i32, ``nsec`` u32, frame id as length and bytes), and a body
of doubles aligned to 8 bytes counted from the end of the encapsulation. No row is touched by Python: offsets, lengths
and values are gathered with NumPy from the array's buffers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Fixed values of the two message layouts: byte position of each 3-vector in the body, and the body's length.
IMU_GYRO, IMU_ACCEL, IMU_BODY = 104, 200, 296
POSE_XYZ, POSE_QUAT, POSE_BODY = 0, 24, 56


def binary_layout(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start of each value, length of each value or -1 for null)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_binary(col.type):
        col = col.cast(pa.binary())
    n = len(col)
    if n == 0 or col.buffers()[2] is None:
        return np.zeros(8, np.uint8), np.zeros(n, np.int64), np.where(col.is_valid().to_numpy(zero_copy_only=False), 0, -1) if n else np.zeros(0, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)
    length = np.where(col.is_valid().to_numpy(zero_copy_only=False), np.diff(off), -1)
    return data, off[:-1], length


def gather(data: np.ndarray, at: np.ndarray, count: int, dtype: str) -> np.ndarray:
    """``count`` values of ``dtype`` from each byte position; shape (rows, count)."""
    width = np.dtype(dtype).itemsize * count
    return np.ascontiguousarray(data[at[:, None] + np.arange(width)]).view(dtype).reshape(len(at), count)


def body_starts(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the body within each payload, whether its header is readable and little-endian)."""
    ok = length >= 16
    at = np.where(ok, start, 0)
    if not ok.any():
        return np.zeros(len(start), np.int64), ok
    name = np.zeros(len(start), np.int64)
    name[ok] = gather(data, at[ok] + 12, 1, "<u4")[:, 0]
    little = np.zeros(len(start), bool)
    little[ok] = data[at[ok] + 1] == 1
    body = 4 + (12 + name + 7) // 8 * 8
    return body, ok & little & (name < 4096)


def header_stamp(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(seconds of the sender's clock, readable) for each payload."""
    data, start, length = binary_layout(col)
    _, ok = body_starts(data, start, length)
    out = np.full(len(start), np.nan)
    if ok.any():
        out[ok] = gather(data, start[ok] + 4, 1, "<i4")[:, 0] + gather(data, start[ok] + 8, 1, "<u4")[:, 0] * 1e-9
    return out, ok


def imu_vectors(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(gyro and accel as rows of six, usable): usable payloads are whole and all six values are finite."""
    data, start, length = binary_layout(col)
    body, ok = body_starts(data, start, length)
    ok &= body + IMU_BODY <= length
    out = np.full((len(start), 6), np.nan)
    if ok.any():
        at = start[ok] + body[ok]
        out[ok, :3], out[ok, 3:] = gather(data, at + IMU_GYRO, 3, "<f8"), gather(data, at + IMU_ACCEL, 3, "<f8")
    return out, ok & np.isfinite(out).all(axis=1)


def pose_vectors(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, z, qx, qy, qz, qw rows, usable): usable payloads are whole with finite x, y, z."""
    data, start, length = binary_layout(col)
    body, ok = body_starts(data, start, length)
    ok &= body + POSE_BODY <= length
    out = np.full((len(start), 7), np.nan)
    if ok.any():
        out[ok] = gather(data, start[ok] + body[ok] + POSE_XYZ, 7, "<f8")
    return out, ok & np.isfinite(out[:, :3]).all(axis=1)


def image_fields(blob: bytes) -> dict:
    """Fields of one Image payload; pixels are cropped from the row stride to the width. mono8 only."""
    n = int.from_bytes(blob[12:16], "little")
    p = 4 + (12 + n + 3) // 4 * 4
    height, width, m = (int.from_bytes(blob[p + 4 * i : p + 4 * i + 4], "little") for i in range(3))
    encoding = blob[p + 12 : p + 12 + m].split(b"\0")[0].decode()
    p += 12 + m + 1  # the big-endian flag
    p = 4 + (p - 4 + 3) // 4 * 4
    step, size = (int.from_bytes(blob[p + 4 * i : p + 4 * i + 4], "little") for i in range(2))
    if encoding != "mono8":
        raise NotImplementedError(f"encoding {encoding!r}")
    px = np.frombuffer(blob, np.uint8, size, p + 8).reshape(height, step)[:, :width]
    return {"height": height, "width": width, "encoding": encoding, "pixels": px.tobytes()}
