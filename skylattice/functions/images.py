"""Image kernels in NumPy, for use inside Arrow batches: crops, ground projection, coverage, lens maps."""

from __future__ import annotations

import math

import numpy as np


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray, fill: float = 0.0) -> np.ndarray:
    """Bilinear values at pixel positions; ``fill`` outside."""
    h, w = image.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0
    inside = (x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1)
    xa, ya = np.clip(x0, 0, w - 1), np.clip(y0, 0, h - 1)
    xb, yb = np.clip(x0 + 1, 0, w - 1), np.clip(y0 + 1, 0, h - 1)
    if image.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    v = image[ya, xa] * (1 - fx) * (1 - fy) + image[ya, xb] * fx * (1 - fy) + image[yb, xa] * (1 - fx) * fy + image[yb, xb] * fx * fy
    return np.where(inside[..., None] if image.ndim == 3 else inside, v, fill)


def rotated_crop(image: np.ndarray, cx: float, cy: float, angle: float, source: float, target: int) -> np.ndarray:
    """A square of ``source`` pixels turned by ``angle``, resampled to ``target`` pixels."""
    g = (np.arange(target) + 0.5) / target * source - source / 2
    u, v = np.meshgrid(g, g)
    c, s = math.cos(angle), math.sin(angle)
    return sample(image, cx + c * u - s * v - 0.5, cy + s * u + c * v - 0.5)


def centred_crop(image: np.ndarray, cx: int, cy: int, size: int) -> np.ndarray:
    """A square about a pixel; beyond the edge the image is reflected."""
    half = size // 2
    pad = [(size, size), (size, size)] + [(0, 0)] * (image.ndim - 2)
    p = np.pad(image, pad, mode="reflect")
    return p[cy + size - half : cy + 2 * size - half, cx + size - half : cx + 2 * size - half]


def ground_projection(image: np.ndarray, altitude: float, roll: float, pitch: float, fx: float, fy: float, cx: float, cy: float, resolution: float = 1.0) -> tuple[np.ndarray, np.ndarray, tuple[float, float, float, float]]:
    """A downward view as a map: (projected image, mask of valid pixels, extent x0, y0, x1, y1 in metres from nadir)."""
    h, w = image.shape[:2]
    rot = _camera(roll, pitch)

    def ground(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ray = rot @ np.stack([(u - cx) / fx, (v - cy) / fy, np.ones_like(u)])
        z = np.where(np.abs(ray[2]) < 1e-6, 1e-6, ray[2])
        return ray[0] / z * altitude, ray[1] / z * altitude

    gx, gy = ground(np.array([0.0, w, 0.0, w]), np.array([0.0, 0.0, h, h]))
    x0, x1, y0, y1 = gx.min(), gx.max(), gy.min(), gy.max()
    nx, ny = max(1, math.ceil((x1 - x0) / resolution)), max(1, math.ceil((y1 - y0) / resolution))
    px, py = np.meshgrid(x0 + (np.arange(nx) + 0.5) * resolution, y0 + (np.arange(ny) + 0.5) * resolution)
    back = np.tensordot(rot.T, np.stack([px, py, np.full_like(px, altitude)]), 1)
    u, v = back[0] / back[2] * fx + cx, back[1] / back[2] * fy + cy
    mask = (back[2] > 0) & (u >= 0) & (v >= 0) & (u <= w - 1) & (v <= h - 1)
    return np.where(mask if image.ndim == 2 else mask[..., None], sample(image, u, v), 0.0), mask, (x0, y0, x1, y1)


def _camera(roll: float, pitch: float) -> np.ndarray:
    cr, sr, cp, sp = math.cos(roll), math.sin(roll), math.cos(pitch), math.sin(pitch)
    return np.array([[1, 0, 0], [0, cp, sp], [0, -sp, cp]]) @ np.array([[cr, 0, sr], [0, 1, 0], [-sr, 0, cr]])


def valid_coverage(mask: np.ndarray, extent: tuple[float, float, float, float], resolution: float = 1.0, low: float = 24.0, high: float = 96.0) -> float:
    """Side of the largest square about nadir that a projection covers, in multiples of four metres."""
    c, r = int(-extent[0] / resolution), int(-extent[1] / resolution)
    if not (0 <= r < mask.shape[0] and 0 <= c < mask.shape[1]) or not mask[r, c]:
        return low
    reach = []
    for line, at in ((mask[r, :], c), (mask[:, c], r)):
        gaps = np.flatnonzero(~line)
        reach += [at - max([g for g in gaps if g < at], default=-1) - 1, min([g for g in gaps if g > at], default=len(line)) - at - 1]
    side = (2 * min(reach) + 1) * resolution
    return float(np.round(np.clip(side, low, high) / 4) * 4)


def lens_maps(width: int, height: int, k: np.ndarray, dist: tuple[float, float, float, float], model: str = "radtan") -> tuple[np.ndarray, np.ndarray]:
    """Where each pixel of an ideal image is found in the distorted one."""
    u, v = np.meshgrid(np.arange(width, dtype=float), np.arange(height, dtype=float))
    x, y = (u - k[0, 2]) / k[0, 0], (v - k[1, 2]) / k[1, 1]
    r2 = x * x + y * y
    if model == "radtan":
        k1, k2, p1, p2 = dist
        f = 1 + k1 * r2 + k2 * r2 * r2
        xd, yd = x * f + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * f + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
    elif model == "equidistant":
        r = np.sqrt(r2)
        a = np.arctan(r)
        b = a * (1 + dist[0] * a**2 + dist[1] * a**4 + dist[2] * a**6 + dist[3] * a**8)
        f = np.where(r > 1e-9, b / np.maximum(r, 1e-9), 1.0)
        xd, yd = x * f, y * f
    else:
        raise ValueError(f"unknown lens model {model!r}")
    return xd * k[0, 0] + k[0, 2], yd * k[1, 1] + k[1, 2]


def laplacian_variance(px: np.ndarray) -> float:
    """Sharpness: variance of the four-neighbour Laplacian (0 for images smaller than 3 x 3)."""
    if min(px.shape[:2]) < 3:
        return 0.0
    return float((px[1:-1, :-2] + px[1:-1, 2:] + px[:-2, 1:-1] + px[2:, 1:-1] - 4 * px[1:-1, 1:-1]).var())


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dx, dy, response) of the shift from one image to the other by phase correlation."""
    fa, fb = np.fft.fft2(a), np.fft.fft2(b)
    cross = np.conj(fa) * fb
    corr = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
    r, c = np.unravel_index(corr.argmax(), corr.shape)
    wrap = lambda k, n: k - n if k > n // 2 else k
    return float(wrap(c, b.shape[1])), float(wrap(r, b.shape[0])), float(corr.max())


def channels_first(px: np.ndarray) -> np.ndarray:
    """Height, width, channel to channel, height, width as float32 (0 to 255, not scaled)."""
    return np.ascontiguousarray(px.transpose(2, 0, 1)).astype(np.float32)
