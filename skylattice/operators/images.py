"""Camera frames as tables: ground patches, crops and lens maps worked out in Arrow batches, a frame at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skylattice.functions import cdr
from skylattice.functions.images import centred_crop, ground_projection, lens_maps, rotated_crop, sample, valid_coverage


def nadir_window(mask: np.ndarray, extent: tuple[float, float, float, float], size: int, resolution: float) -> tuple[int, int]:
    """Top and left of a window of ``size`` pixels about nadir, or else about the nearest pixel around which all is valid.

    What lies beyond the image doesn't count against a window. Of equally near ones the first by rows is taken; where no
    window is valid, nadir's own.
    """
    h, w = mask.shape
    half = size // 2
    cy, cx = round(-extent[1] / resolution), round(-extent[0] / resolution)
    holes = np.zeros((h + 1, w + 1), np.int64)
    holes[1:, 1:] = np.cumsum(np.cumsum(~mask, axis=0), axis=1)
    top, bottom = (np.clip(np.arange(h) + d, 0, h) for d in (-half, size - half))
    left, right = (np.clip(np.arange(w) + d, 0, w) for d in (-half, size - half))
    clear = (holes[bottom][:, right] - holes[top][:, right] - holes[bottom][:, left] + holes[top][:, left]) == 0
    if not (0 <= cy < h and 0 <= cx < w and clear[cy, cx]) and clear.any():
        ys, xs = np.nonzero(clear)
        k = int(((ys - cy) ** 2 + (xs - cx) ** 2).argmin())
        cy, cx = int(ys[k]), int(xs[k])
    return cy - half, cx - half


def cut_window(image: np.ndarray, top: int, left: int, size: int) -> np.ndarray:
    """A square window of an image, zero beyond its edges."""
    out = np.zeros((size, size, *image.shape[2:]), image.dtype)
    h, w = image.shape[:2]
    a, b, c, d = max(top, 0), min(top + size, h), max(left, 0), min(left + size, w)
    if a < b and c < d:
        out[a - top : b - top, c - left : d - left] = image[a:b, c:d]
    return out


def ground_patches(frames: DataFrame, size_m: float = 96.0, resolution: float = 1.0, focal: float = 1.0, undistort: tuple[str, tuple[float, float, float, float]] | None = None, far_m: float = 20.0) -> DataFrame:
    """A square of ground under each frame: ``msg_id, patch, coverage, centre_x, centre_y, shifted, error``.

    ``frames`` has ``msg_id, data`` (an Image payload) and ``altitude, roll, pitch`` (metres, radians). The frame is
    freed of lens distortion if ``undistort`` names a model and its coefficients, projected to the ground, and cut
    about nadir or the nearest place where all is visible; ``centre_x, centre_y`` are that place's metres from nadir and
    ``shifted`` says whether it lies farther than ``far_m``. ``focal`` is in widths of the image. A payload that can't be
    read, or unknown or senseless geometry, gives nulls and an ``error``. Empty tables give no rows.
    """
    size = max(1, round(size_m / resolution))

    def one(blob: bytes, altitude: float, roll: float, pitch: float) -> tuple:
        f = cdr.image_fields(blob)
        px = np.frombuffer(f["pixels"], np.uint8).reshape(f["height"], f["width"]).astype(float)
        fx, cx, cy = focal * f["width"], (f["width"] - 1) / 2, (f["height"] - 1) / 2
        if undistort:
            px = sample(px, *lens_maps(f["width"], f["height"], np.array([[fx, 0, cx], [0, fx, cy], [0, 0, 1]]), undistort[1], undistort[0]))
        if not (altitude > 0 and abs(roll) < 1.2 and abs(pitch) < 1.2 and altitude < 5000):
            raise ValueError("geometry")
        ground, mask, extent = ground_projection(px, altitude, roll, pitch, fx, fx, cx, cy, resolution)
        top, left = nadir_window(mask, extent, size, resolution)
        x, y = (left + size / 2) * resolution + extent[0], (top + size / 2) * resolution + extent[1]
        return np.clip(np.round(cut_window(ground, top, left, size)), 0, 255).astype(np.uint8).tobytes(), valid_coverage(mask, extent, resolution), x, y, bool(np.hypot(x, y) > far_m), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for blob, *geometry in zip(*(b.column(k).to_pylist() for k in range(1, 5))):
                try:
                    rows.append(one(blob, *(float(g) for g in geometry)))
                except Exception as e:  # a broken payload becomes a row that says so
                    rows.append((None, None, None, None, None, type(e).__name__))
            kinds = (pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.string())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["msg_id", "patch", "coverage", "centre_x", "centre_y", "shifted", "error"])

    schema = "msg_id long, patch binary, coverage double, centre_x double, centre_y double, shifted boolean, error string"
    return frames.select("msg_id", "data", "altitude", "roll", "pitch").mapInArrow(run, schema)


def crops(images: DataFrame, size: int, target: int | None = None) -> DataFrame:
    """A crop of each row's image: ``id, crop`` (``target`` or ``size`` pixels a side).

    ``images`` has ``id, height, width, pixels`` (one byte a pixel), ``cx, cy`` and ``angle``. With a null angle the crop
    is upright about a whole pixel, reflected at the edges; else it is turned and resampled. Null pixels, or pixels of
    another number than the size says, give null.
    """
    side = target or size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, w, px, cx, cy, angle in zip(*(b.column(k).to_pylist() for k in range(1, 7))):
                if px is None or not h or not w or cx is None or cy is None or len(px) != h * w:
                    out.append(None)
                    continue
                a = np.frombuffer(px, np.uint8).reshape(h, w)
                if angle is None:
                    c = centred_crop(a, round(cx), round(cy), size) if size < min(h, w) else None
                    out.append(None if c is None or c.shape != (size, size) else c.tobytes())
                else:
                    out.append(np.clip(np.round(rotated_crop(a.astype(float), cx, cy, angle, size, side)), 0, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "crop"])

    return images.select("id", "height", "width", "pixels", "cx", "cy", "angle").mapInArrow(run, "id long, crop binary")
