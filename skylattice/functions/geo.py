"""Geodesy and raster-grid expressions: all columns, no Python per row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the web-mercator grid and the sphere.
TILE_PX, MAX_LAT, EARTH_R, M_PER_DEG, GSD_EQUATOR = 256, 85.05112878, 6378137.0, 111320.0, 156543.03392


def _world(zoom: Column | int) -> Column:
    z = F.lit(zoom) if isinstance(zoom, int) else zoom
    return F.lit(float(TILE_PX)) * F.pow(F.lit(2.0), z.cast("double"))


def mercator_x(lon: Column, zoom: Column | int) -> Column:
    """Global pixel column of a longitude."""
    return (lon + 180.0) / 360.0 * _world(zoom)


def mercator_y(lat: Column, zoom: Column | int, clamp: bool = True) -> Column:
    """Global pixel row of a latitude."""
    held = F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT)) if clamp else lat
    return (1.0 - F.asinh(F.tan(F.radians(held))) / math.pi) / 2.0 * _world(zoom)


def pixel_lon(x: Column, zoom: Column | int) -> Column:
    """Longitude of a global pixel column."""
    return x / _world(zoom) * 360.0 - 180.0


def pixel_lat(y: Column, zoom: Column | int) -> Column:
    """Latitude of a global pixel row."""
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1.0 - 2.0 * y / _world(zoom)))))


def ground_sample_distance(lat: Column, zoom: Column | int) -> Column:
    """Metres per pixel."""
    z = F.lit(zoom) if isinstance(zoom, int) else zoom
    return F.lit(GSD_EQUATOR) * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), z.cast("double"))


def tile_bounds(z: Column, x: Column, y: Column, scheme: str = "xyz") -> dict[str, Column]:
    """Bounds of a tile in degrees; rows are counted from the south in scheme ``tms``."""
    if scheme not in ("xyz", "tms"):
        raise ValueError(f"unknown scheme {scheme!r}")
    n = F.pow(F.lit(2.0), z.cast("double"))
    row = (n - 1 - y) if scheme == "tms" else y.cast("double")
    lat = lambda r: F.least(F.greatest(F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1.0 - 2.0 * r / n)))), F.lit(-MAX_LAT)), F.lit(MAX_LAT))
    return {"top_lat": lat(row), "left_lon": x / n * 360.0 - 180.0, "bottom_lat": lat(row + 1), "right_lon": (x + 1) / n * 360.0 - 180.0}


def tile_key(z: Column, x: Column, y: Column) -> Column:
    """One 64-bit key of zoom, column and row."""
    return F.shiftleft(z.cast("long"), 52).bitwiseOR(F.shiftleft(x.cast("long"), 26)).bitwiseOR(y.cast("long"))


def map_to_pixel(x: Column, y: Column, centre_x: float, centre_y: float, gsd: float) -> tuple[Column, Column]:
    """Map metres (north up) to pixels (row down)."""
    return F.lit(centre_x) + x / gsd, F.lit(centre_y) - y / gsd


def pixel_to_map(px: Column, py: Column, centre_x: float, centre_y: float, gsd: float) -> tuple[Column, Column]:
    """The inverse."""
    return (px - centre_x) * gsd, (F.lit(centre_y) - py) * gsd


def latlon_to_map(lat: Column, lon: Column, zoom: int, gsd: float, centre_x: float, centre_y: float, off_x: float = 0.0, off_y: float = 0.0) -> tuple[Column, Column]:
    """Latitude and longitude to map metres, through the offset global grid."""
    return pixel_to_map(mercator_x(lon, zoom) + off_x, mercator_y(lat, zoom) + off_y, centre_x, centre_y, gsd)


def local_east_north(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Equirectangular metres from a reference point."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * EARTH_R, F.radians(lat - lat0) * EARTH_R


def tile_window(centres: DataFrame, zoom: int, half_px: float) -> DataFrame:
    """All tiles of the square of ``half_px`` pixels around each row's ``lat, lon``: adds ``tx, ty``."""
    cx, cy = mercator_x(F.col("lat") * 0 + F.col("lon"), zoom), mercator_y(F.col("lat"), zoom)
    low = lambda c: F.floor((c - half_px) / TILE_PX)
    high = lambda c: F.floor((c + half_px) / TILE_PX)
    return centres.withColumn("tx", F.explode(F.sequence(low(cx), high(cx)))).withColumn("ty", F.explode(F.sequence(low(cy), high(cy))))


def boxes_touch(top: Column, left: Column, bottom: Column, right: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether bounds meet the box given as two corners (lat, lon, lat, lon) in any order; touching counts."""
    a, b, c, d = box
    south, north, west, east = min(a, c), max(a, c), min(b, d), max(b, d)
    return (bottom <= north) & (top >= south) & (left <= east) & (right >= west)


def outside_margin(x: Column, y: Column, half: float, margin: float) -> Column:
    """Whether a map position is closer to the map's edge than the margin."""
    return (F.abs(x) > half - margin) | (F.abs(y) > half - margin)
