"""Rotations, geodesy and parsers: identities, twins, and controls that must fail."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import geo, rotation, scalars


def attitudes(n=300):
    q = np.random.default_rng(0).normal(size=(n, 4))
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def matrix(q):
    x, y, z, w = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


@pytest.fixture(scope="module")
def quats(spark):
    return spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(attitudes())], "i int, x double, y double, z double, w double")


def cols(df):
    return df.x, df.y, df.z, df.w


def test_matrix_is_a_rotation(quats):
    m = rotation.quat_matrix(cols(quats))
    for r in quats.select(*[c.alias(f"m{i}{j}") for i, row in enumerate(m) for j, c in enumerate(row)]).collect():
        a = np.array(r).reshape(3, 3)
        assert np.allclose(a @ a.T, np.eye(3), atol=1e-9) and abs(np.linalg.det(a) - 1) < 1e-9


def test_frames_agree_and_the_wrong_convention_does_not(quats):
    to_enu = np.array([[0, 1, 0], [1, 0, 0], [0, 0, -1]])
    e = rotation.ned_to_enu(cols(quats))
    wrong = 0
    for q, r in zip(attitudes(), quats.orderBy("i").select(*e).collect()):
        want = to_enu @ matrix(q) @ np.diag([1, -1, -1])
        assert np.allclose(matrix(np.array(r)), want, atol=1e-9)
        wrong = max(wrong, np.abs(matrix(q) - want).max())
    assert wrong > 0.5


def test_heading_of_both_paths(quats):
    e = rotation.ned_to_enu(cols(quats))
    d = rotation.wrap_angle(rotation.enu_heading(e) - rotation.quat_yaw(cols(quats)))
    assert quats.select(F.max(F.abs(d))).first()[0] < 1e-9
    d = rotation.wrap_angle(rotation.quat_yaw(e) - rotation.quat_yaw(cols(quats)))
    assert quats.select(F.max(F.abs(d))).first()[0] > 0.5


def test_gravity(spark):
    g = [(0.0, 0.0, 1.0), (0.0, math.sin(0.2), math.cos(0.2)), (-math.sin(0.15), 0.0, math.cos(0.15)), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame(g, "x double, y double, z double")
    got = [tuple(r) for r in df.select(*rotation.gravity_tilt(df.x, df.y, df.z)).collect()]
    assert got[0] == (0, 0) and got[1] == pytest.approx((0.2, 0)) and got[2] == pytest.approx((0, 0.15)) and got[3] == (None, None)


def test_plane_rotations_compose(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(200, 4))], "x double, y double, a double, b double")
    one = rotation.rotate(*rotation.rotate(df.x, df.y, df.a), df.b)
    two = rotation.rotate(df.x, df.y, df.a + df.b)
    assert df.select(F.max(F.abs(one[0] - two[0]) + F.abs(one[1] - two[1]))).first()[0] < 1e-9


def test_wrap(spark):
    df = spark.createDataFrame([(math.pi,), (-math.pi,), (7.0,), (-7.0,), (None,)], "a double")
    got = [r[0] for r in df.select(rotation.wrap_angle(df.a)).collect()]
    assert got[:4] == pytest.approx([-math.pi, -math.pi, 7 - 2 * math.pi, 2 * math.pi - 7]) and got[4] is None


def test_mercator_round_trip(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(-84, 84, 200), rng.uniform(-180, 180, 200))], "lat double, lon double")
    d = F.abs(geo.pixel_lat(geo.mercator_y(df.lat, 18), 18) - df.lat) + F.abs(geo.pixel_lon(geo.mercator_x(df.lon, 18), 18) - df.lon)
    assert df.select(F.max(d)).first()[0] < 1e-9


def test_tile_bounds_agree(spark):
    df = spark.createDataFrame([(3, 2, 1, 6)], "z int, x int, y int, s int")
    a, b = geo.tile_bounds(df.z, df.x, df.y), geo.tile_bounds(df.z, df.x, df.s, "tms")
    r = df.select(*[F.abs(a[k] - b[k]) for k in a]).first()
    assert max(r) < 1e-12
    with pytest.raises(ValueError):
        geo.tile_bounds(df.z, df.x, df.y, "other")


def test_parsers(spark):
    rows = ["-1,1.3", " 0.5 , 2.5 ", "garbage", "1", "-1,1.3,7", None]
    df = spark.createDataFrame([(s,) for s in rows], "s string")
    got = [tuple(r) for r in df.select(*scalars.parse_pair(df.s, -1.0, 1.3)).collect()]
    assert got == [(-1, 1.3), (0.5, 2.5), (-1, 1.3), (-1, 1.3), (-1, 1.3), (-1, 1.3)]
    df = spark.createDataFrame([("quarry_0_20210307.png",), ("2021-03_x.png",), ("none",)], "n string")
    assert [r[0] for r in df.select(scalars.file_month(df.n)).collect()] == [2021 * 12 + 3, 2021 * 12 + 3, 0]


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(26.0,), (30.0,), (500.0,), (1.0,)], "c double")
    assert [r[0] for r in df.select(scalars.coverage_step(df.c)).collect()] == [24.0, 32.0, 96.0, 24.0]


def test_window_of_every_place(spark, data):
    from skylattice.plans.geo_queries import tile_window

    ids = [r[0] for r in spark.read.parquet(f"{data}/customer.parquet").select("c_custkey").collect()]
    want, world = set(), 256.0 * 2**17
    for i in ids:
        lat, lon = 30.0 + i % 97 / 100.0, 100.0 + i * 7 % 89 / 100.0
        px, py = (lon + 180.0) / 360.0 * world, (1.0 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2.0 * world
        span = lambda c: range(math.floor((c - 300) / 256), math.floor((c + 300) / 256) + 1)
        want |= {(i, x, y) for x in span(px) for y in span(py)}
    got = [tuple(r) for r in tile_window(spark, data).collect()]
    assert set(got) == want and len(got) == len(want) and {g[0] for g in got} == set(ids)


def test_tiles_are_placed_by_their_paths(spark, tmp_path):
    from skylattice.plans.geo_queries import QUERIES

    rows = [
        (1, 3, 2, 1, "xyz", "3/2/1.png", 1), (2, None, None, None, None, "a/3%2F2/1.JPG ", 2), (3, None, None, None, "xyz", "3/4/2.PNG", 1), (4, 3, 4, 1, " TMS", "3/4/1.jpeg", None),
        (5, 3, 2, 1, "tms", "3/2/1.png", 9), (6, None, None, None, None, "3/2/index.json", 3), (7, 3, 4, 7, "tms", "odd", 1), (8, None, None, None, "xyz", "30/1000000000/3.png", 1),
    ]
    df = spark.createDataFrame(rows, "file_id long, z int, x int, y int, scheme string, rel_path string, m int").selectExpr("*", "timestamp_seconds(m) AS mtime")
    df.drop("m").write.parquet(f"{tmp_path}/tiles.parquet")
    run = lambda name: {tuple(r) for r in QUERIES[f"{name}"](spark, str(tmp_path)).collect()}
    assert run("tile_index_upsert") == {(3, 2, 1, 2), (3, 4, 2, 3), (3, 4, 6, 4), (3, 2, 6, 5), (3, 4, 0, 7), (30, 10**9, 3, 8)}
    assert run("tile_extension_choice") == {(3, 2, 1, "a/3%2F2/1.JPG "), (3, 4, 2, "3/4/2.PNG"), (3, 4, 6, "3/4/1.jpeg"), (3, 2, 6, "3/2/1.png"), (30, 10**9, 3, "30/1000000000/3.png")}
    have = {(2, 1), (4, 2), (4, 6), (2, 6), (4, 0)}
    cells = [(z, x, y) for z, x0, x1, y0, y1 in run("missing_tiles_anti") for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]
    assert set(cells) == {(3, x, y) for x in range(2, 5) for y in range(7) if (x, y) not in have} and len(cells) == len(set(cells))
    assert run("missing_tile_fraction") == {(3, round(1 - 5 / 21, 6), True), (30, 0.0, False)}
    counts = {r[0]: r for r in run("tile_counts_union_bbox")}
    assert counts[3][1] == 6 and counts[30][1] == 1 and counts[3][2] == pytest.approx(85.0511288) and counts[3][3] == -90.0 and counts[3][5] == 45.0
