"""Queries of the scalar libraries: geodesy, rotations, schedules, parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.functions import geo, rotation, scalars
from skylattice.operators.tile_paths import tile_of
from skylattice.plans.common import E, events, r6
from skylattice.session import load_table

ZOOM, GSD, CX, CY = 17, 1.0, 2500.0, 2500.0


def places(spark: SparkSession, d: str) -> DataFrame:
    """Customers as places near 30 N, 100 E."""
    c = load_table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return c.select("id", (30.0 + F.pmod("id", F.lit(97)) / 100.0).alias("lat"), (100.0 + F.pmod(F.col("id") * 7, F.lit(89)) / 100.0).alias("lon"))


_PLACES = "places AS (SELECT c_custkey AS id, 30.0 + (c_custkey % 97) / 100.0 AS lat, 100.0 + ((c_custkey * 7) % 89) / 100.0 AS lon FROM customer)"
_W = f"256.0 * pow(2, {ZOOM})"
_MX, _MY = f"(lon + 180.0) / 360.0 * {_W}", f"(1.0 - asinh(tan(radians(lat))) / pi()) / 2.0 * {_W}"


def mercator_forward(spark: SparkSession, d: str) -> DataFrame:
    """Global pixels of places."""
    p = places(spark, d)
    return p.select("id", r6(geo.mercator_x(p.lon, ZOOM), 4).alias("px"), r6(geo.mercator_y(p.lat, ZOOM), 4).alias("py"))


def mercator_inverse(spark: SparkSession, d: str) -> DataFrame:
    """Places back from pixels."""
    p = places(spark, d).withColumn("px", geo.mercator_x(F.col("lon"), ZOOM) + F.col("id")).withColumn("py", geo.mercator_y(F.col("lat"), ZOOM) + F.col("id"))
    return p.select("id", r6(geo.pixel_lon(p.px, ZOOM)).alias("lon"), r6(geo.pixel_lat(p.py, ZOOM)).alias("lat"))


def ground_sample(spark: SparkSession, d: str) -> DataFrame:
    """Metres per pixel at places."""
    p = places(spark, d)
    return p.select("id", r6(geo.ground_sample_distance(p.lat, ZOOM)).alias("gsd"))


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "tiles").where("z is not null and x is not null and y is not null")


def _bounds(spark: SparkSession, d: str, scheme: str) -> DataFrame:
    t = _tiles(spark, d).where(F.lower(F.trim(F.coalesce("scheme", F.lit("xyz")))) == scheme)
    b = geo.tile_bounds(t.z, t.x, t.y, scheme)
    return t.select("file_id", *[r6(c, 7).alias(k) for k, c in b.items()])


def tile_bounds_xyz(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of tiles counted from the north."""
    return _bounds(spark, d, "xyz")


def tile_bounds_tms(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of tiles counted from the south."""
    return _bounds(spark, d, "tms")


def tile_pk(spark: SparkSession, d: str) -> DataFrame:
    """Packed keys and names of tiles."""
    t = _tiles(spark, d)
    return t.select("file_id", geo.tile_key(t.z, t.x, t.y).alias("tile_pk"), F.concat_ws("/", "z", "x", "y").alias("name"))


def tile_window(spark: SparkSession, d: str) -> DataFrame:
    """Tiles around every place."""
    return geo.tile_window(places(spark, d), ZOOM, 300.0).select("id", "tx", "ty")


def _placed_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Files with the tile ``z, x, y``, counted from the north, that the path names or else the columns."""
    t = load_table(spark, d, "tiles")
    south = F.coalesce(F.lower(F.trim("scheme")) == "tms", F.lit(False))
    y = F.when(south, F.pow(F.lit(2.0), t.z).cast("long") - 1 - t.y).otherwise(t.y.cast("long"))
    told = F.when(t.z.isNotNull() & t.x.isNotNull() & t.y.isNotNull(), F.struct(t.z.alias("z"), t.x.cast("long").alias("x"), y.alias("y")))
    return t.select("file_id", "rel_path", "mtime", F.coalesce(tile_of(t.rel_path, t.scheme), told).alias("t")).where("t is not null").select("file_id", "rel_path", "mtime", "t.*")


def missing_tiles_anti(spark: SparkSession, d: str) -> DataFrame:
    """Tiles without a file in the rectangle of each zoom's tiles, as the rectangles ``x0..x1, y0..y1`` they make up: gaps
    within a column of tiles, and whole columns. They are no more than the tiles there are, however sparse a zoom is."""
    have = _placed_tiles(spark, d).select("z", "x", "y").distinct()
    box = have.groupBy("z").agg(F.min("x").alias("lox"), F.min("y").alias("loy"), F.max("y").alias("hiy"))  # a row a zoom
    rows = have.join(F.broadcast(box), "z")
    down, along = Window.partitionBy("z", "x").orderBy("y"), Window.partitionBy("z").orderBy("x")
    above = rows.select("z", F.col("x").alias("x0"), F.col("x").alias("x1"), (F.coalesce(F.lag("y").over(down), F.col("loy") - 1) + 1).alias("y0"), (F.col("y") - 1).alias("y1"))
    below = rows.groupBy("z", "x", "hiy").agg(F.max("y").alias("y")).select("z", F.col("x").alias("x0"), F.col("x").alias("x1"), (F.col("y") + 1).alias("y0"), F.col("hiy").alias("y1"))
    columns = rows.select("z", "x", "lox", "loy", "hiy").distinct()
    between = columns.select("z", (F.coalesce(F.lag("x").over(along), F.col("lox") - 1) + 1).alias("x0"), (F.col("x") - 1).alias("x1"), F.col("loy").alias("y0"), F.col("hiy").alias("y1"))
    return above.unionByName(below).unionByName(between).where("x0 <= x1 and y0 <= y1")


def missing_tile_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Share of each zoom's rectangle that is missing, and whether that is worth a warning."""
    have = _placed_tiles(spark, d).select("z", "x", "y").distinct()
    g = have.groupBy("z").agg(F.count("*").alias("n"), ((F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)).alias("cells"))
    return g.select("z", r6(1 - F.col("n") / F.col("cells")).alias("missing"), (1 - F.col("n") / F.col("cells") > 0.02).alias("warn"))


def bbox_tiles(spark: SparkSession, d: str, zooms: tuple[int, int] = (-1, -1), half: float = 0.01) -> DataFrame:
    """Files whose tile meets a box about a corner of the last tile of the deepest zoom, of zooms from the first to the second (-1: open)."""
    t = _placed_tiles(spark, d)
    low, high = zooms
    t = t.where((F.col("z") >= low) if low >= 0 else F.lit(True)).where((F.col("z") <= high) if high >= 0 else F.lit(True))
    t = t.select("file_id", "z", "x", "y", *[c.alias(k) for k, c in geo.tile_bounds(t.z, t.x, t.y).items()])
    last = t.agg(F.max(F.struct("z", "x", "y", "top_lat", "left_lon")).alias("m")).select(F.col("m.top_lat").alias("a"), F.col("m.left_lon").alias("b"))
    j = t.join(F.broadcast(last))  # one row
    hit = (F.col("bottom_lat") <= F.col("a") + half) & (F.col("top_lat") >= F.col("a") - half) & (F.col("left_lon") <= F.col("b") + half) & (F.col("right_lon") >= F.col("b") - half)
    return j.where(hit).select("file_id")


def tile_counts_union_bbox(spark: SparkSession, d: str) -> DataFrame:
    """Tiles per zoom and their common bounds."""
    t = _placed_tiles(spark, d)
    b = t.select("z", *[c.alias(k) for k, c in geo.tile_bounds(t.z, t.x, t.y).items()])
    return b.groupBy("z").agg(F.count("*").alias("n"), r6(F.max("top_lat"), 7).alias("north"), r6(F.min("left_lon"), 7).alias("west"), r6(F.min("bottom_lat"), 7).alias("south"), r6(F.max("right_lon"), 7).alias("east"))


def tile_index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """One row per tile: the newest file. A packed key has no room for every zoom that a path may name."""
    return _placed_tiles(spark, d).groupBy("z", "x", "y").agg(F.max_by("file_id", F.struct("mtime", "file_id")).alias("file_id"))


def tile_extension_choice(spark: SparkSession, d: str) -> DataFrame:
    """Of the files of a tile the one whose suffix, in any case, comes first: jpg, png, jpeg."""
    ext = F.lower(F.regexp_extract(F.trim("rel_path"), r"\.(\w+)$", 1))
    rank = F.when(ext == "jpg", 0).when(ext == "png", 1).when(ext == "jpeg", 2)
    t = _placed_tiles(spark, d).withColumn("r", rank).where("r is not null")
    return t.groupBy("z", "x", "y").agg(F.min_by("rel_path", F.struct("r", "file_id")).alias("rel_path"))


def enu_equirect(spark: SparkSession, d: str) -> DataFrame:
    """Metres from the place with the smallest id."""
    p = places(spark, d)
    first = p.agg(F.min_by("lat", "id").alias("lat0"), F.min_by("lon", "id").alias("lon0"))
    j = p.join(F.broadcast(first))  # one row
    e, n = geo.local_east_north(j.lat, j.lon, j.lat0, j.lon0)
    return j.select("id", r6(e, 4).alias("east"), r6(n, 4).alias("north"))


def map_px_metres(spark: SparkSession, d: str) -> DataFrame:
    """Map metres to pixels and back."""
    p = places(spark, d).select("id", (F.col("id") * 1.5 - 800).alias("x"), (F.col("id") * 0.7 - 300).alias("y"))
    px, py = geo.map_to_pixel(p.x, p.y, CX, CY, 0.5)
    bx, by = geo.pixel_to_map(px, py, CX, CY, 0.5)
    return p.select("id", r6(px).alias("px"), r6(py).alias("py"), r6(bx).alias("x"), r6(by).alias("y"))


def latlon_map_metres(spark: SparkSession, d: str) -> DataFrame:
    """Places as map metres."""
    p = places(spark, d)
    x, y = geo.latlon_to_map(p.lat, p.lon, ZOOM, GSD, CX, CY, -26000000.0, -14000000.0)
    return p.select("id", r6(x, 3).alias("x"), r6(y, 3).alias("y"))


def margin_report(spark: SparkSession, d: str) -> DataFrame:
    """Positions too close to the map's edge."""
    p = places(spark, d).select("id", (F.pmod(F.col("id") * 37, F.lit(5000)) - 2500.0).alias("x"), (F.pmod(F.col("id") * 53, F.lit(5000)) - 2500.0).alias("y"))
    return p.select("id", geo.outside_margin(p.x, p.y, 2500.0, 300.0).alias("outside"))


def _angles(spark: SparkSession, d: str) -> DataFrame:
    e = load_table(spark, d, "events").where("event_type = 'click'")
    return e.select("event_id", (F.col("value") / 25.0).alias("a"), (F.pmod("event_id", F.lit(628)) / 100.0).alias("b"), (F.pmod(F.col("event_id") * 3, F.lit(157)) / 100.0).alias("c"))


_ANGLES = "g AS (SELECT event_id, value / 25.0 AS a, (event_id % 628) / 100.0 AS b, ((event_id * 3) % 157) / 100.0 AS c FROM events WHERE event_type = 'click')"
_PMOD = "({0} + pi()) - 2 * pi() * floor(({0} + pi()) / (2 * pi())) - pi()"


def _unit(g: DataFrame) -> rotation.Quat:
    """A unit quaternion from two angles: a turn by ``b`` about an axis tilted by ``c``."""
    h = g.b / 2
    return F.sin(h) * F.sin(g.c), F.lit(0.0) * g.c, F.sin(h) * F.cos(g.c), F.cos(h)


_Q = "q AS (SELECT *, sin(b / 2) * sin(c) AS qx, 0.0 AS qy, sin(b / 2) * cos(c) AS qz, cos(b / 2) AS qw FROM g)"


def wrap_angle(spark: SparkSession, d: str) -> DataFrame:
    """Angles in [-pi, pi)."""
    g = _angles(spark, d)
    return g.select("event_id", r6(rotation.wrap_angle(g.a - g.b * 3)).alias("angle"))


def quat_yaw(spark: SparkSession, d: str) -> DataFrame:
    """Headings of quaternions, by the two formulas."""
    g = _angles(spark, d)
    q = _unit(g)
    return g.select("event_id", r6(rotation.quat_yaw(q)).alias("yaw"), r6(rotation.enu_heading(q)).alias("heading"))


def quat_mul_frames(spark: SparkSession, d: str) -> DataFrame:
    """Attitudes from north-east-down to east-north-up."""
    g = _angles(spark, d)
    return g.select("event_id", *[r6(c).alias(n) for n, c in zip(("x", "y", "z", "w"), rotation.ned_to_enu(_unit(g)))])


def gravity_tilt(spark: SparkSession, d: str) -> DataFrame:
    """Roll and pitch of gravity vectors."""
    g = _angles(spark, d)
    roll, pitch = rotation.gravity_tilt(-F.sin(g.c) * 9.81, F.sin(g.b) * F.cos(g.c) * 9.81, F.cos(g.b) * F.cos(g.c) * 9.81)
    return g.select("event_id", r6(roll).alias("roll"), r6(pitch).alias("pitch"))


def compass_yaw_residual(spark: SparkSession, d: str) -> DataFrame:
    """Residual of the yaw predicted from a compass."""
    g = _angles(spark, d)
    return g.select("event_id", r6(rotation.wrap_angle(g.a - rotation.compass_yaw(g.b, -1.0, 1.3))).alias("residual"), r6(rotation.yaw_heading(g.b, -1.0, 1.3)).alias("heading"))


def rotate_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Plane motion turned into the map frame."""
    g = _angles(spark, d)
    x, y = rotation.rotate(g.a, g.c, g.b)
    return g.select("event_id", r6(x).alias("dx"), r6(y).alias("dy"))


def footprint_corners(spark: SparkSession, d: str) -> DataFrame:
    """Extent on the ground of a tilted image."""
    g = _angles(spark, d).select("event_id", (F.col("c") / 5).alias("roll"), (F.col("b") / 30).alias("pitch"), (F.col("a") + 20).alias("alt"))
    corner = F.explode(F.array(*[F.struct(F.lit(float(u)).alias("u"), F.lit(float(v)).alias("v")) for u in (0, 752) for v in (0, 480)]))
    c = g.withColumn("k", corner)
    x, y = rotation.ground_ray(F.col("k.u"), F.col("k.v"), 450.0, 450.0, 376.0, 240.0, F.col("roll"), F.col("pitch"), F.col("alt"))
    e = c.select("event_id", x.alias("x"), y.alias("y")).groupBy("event_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return e.select("event_id", r6("x0", 4).alias("x0"), r6("x1", 4).alias("x1"), r6("y0", 4).alias("y0"), r6("y1", 4).alias("y1"), F.greatest(F.lit(1), F.ceil(F.round(F.col("x1") - F.col("x0"), 6))).cast("int").alias("width"))


def yaw_cal_parse(spark: SparkSession, d: str) -> DataFrame:
    """Calibration strings, well formed and not."""
    s = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" , 2.5 "))).when(F.col("event_id") % 5 == 1, "garbage").when(F.col("event_id") % 5 == 2, "1").when(F.col("event_id") % 5 == 3, "-1,1.3,7")
    e = load_table(spark, d, "events").withColumn("s", s)
    a, b = scalars.parse_pair(e.s, -1.0, 1.3)
    return e.select("event_id", r6(a).alias("a"), r6(b).alias("b"))


def file_date_parse(spark: SparkSession, d: str) -> DataFrame:
    """Months from layer file names."""
    return load_table(spark, d, "bank_meta").select("layer_file").distinct().select("layer_file", scalars.file_month(F.col("layer_file")).alias("month"))


def waypoint_parse(spark: SparkSession, d: str) -> DataFrame:
    """Waypoint lists taken apart."""
    text = F.concat_ws("; ", F.concat_ws(",", F.col("event_id").cast("string"), F.lit("2.5")), F.concat_ws(" , ", F.lit("-7"), (F.col("event_id") % 11).cast("string")), F.lit(""))
    e = load_table(spark, d, "events").where("event_type = 'signup'").select("event_id", F.posexplode(F.filter(F.split(text, ";"), lambda x: F.trim(x) != "")).alias("seq", "wp"))
    part = lambda k: F.trim(F.element_at(F.split("wp", ","), k)).try_cast("double")
    return e.select("event_id", "seq", part(1).alias("x"), part(2).alias("y"))


def mission_plan_parse(spark: SparkSession, d: str) -> DataFrame:
    """Plans in JSON: speed changes carried forward to the waypoints after them."""
    item = lambda cmd, p2, lat, lon, alt: f'{{"command":{cmd},"frame":3,"params":[0,{p2},0,0,{lat},{lon},{alt}]}}'
    js = F.concat(F.lit('{"mission":{"items":['), F.concat_ws(",", F.lit(item(22, 0, 30, 100, 50)), F.concat(F.lit('{"command":178,"frame":2,"params":[1,'), (F.col("event_id") % 7 + 3).cast("string"), F.lit(",0,0,0,0,0]}")), F.lit(item(16, 0, 30.1, 100.1, 60)), F.lit(item(16, 0, 30.2, 100.2, 0.2)), F.lit(item(21, 0, 0, 0, 0))), F.lit("]}}"))
    schema = "mission struct<items: array<struct<command: int, frame: int, params: array<double>>>>"
    e = load_table(spark, d, "events").where("event_type = 'signup'").select("event_id", F.from_json(js, schema).alias("p")).select("event_id", F.posexplode("p.mission.items").alias("seq", "i"))
    w = Window.partitionBy("event_id").orderBy("seq")
    speed = F.last(F.when(F.col("i.command") == 178, F.element_at("i.params", 2)), ignorenulls=True).over(w)
    out = e.withColumn("speed", F.least(F.lit(8.0), F.coalesce(speed, F.lit(8.0)))).where("i.command = 16")
    alt = F.element_at("i.params", 7)
    return out.select("event_id", "seq", F.element_at("i.params", 5).alias("lat"), F.element_at("i.params", 6).alias("lon"), F.when(alt <= 0.5, 50.0).otherwise(alt).alias("alt"), "speed")


def health_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Health snapshots to JSON and back, with the state derived from them."""
    e = load_table(spark, d, "events").select("event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    h = e.select("event_id", F.to_json(F.struct("k", F.round("value", 2).alias("score"), (F.col("k") % 7).alias("lost"))).alias("js"))
    b = h.select("event_id", F.from_json("js", "k int, score double, lost int").alias("h")).select("event_id", "h.*")
    state = scalars.health_state(F.col("k"), F.col("score").isNotNull(), F.col("score") < 50, F.col("k") % 5 == 0, F.col("lost"))
    return b.select("event_id", "k", "score", "lost", state.alias("state"))


def schedules(spark: SparkSession, d: str) -> DataFrame:
    """Schedules, tolerances and variances of the filter."""
    e = load_table(spark, d, "events").select("event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.select(
        "event_id",
        scalars.coverage_step(e.value).alias("coverage"),
        r6(scalars.anneal(e.k)).alias("anneal"),
        r6(scalars.widen(e.value, e.k % 9)).alias("widened"),
        r6(scalars.drift_tolerance(e.k.cast("double"))).alias("tolerance"),
        scalars.streak_needed(e.value).alias("streak"),
        r6(scalars.estimate_variance(e.value / 7, 1000.0, e.k + 1.0, e.k / 10.0)).alias("variance"),
        r6(scalars.rescan_radius(e.k.cast("double"), (e.k % 5).cast("double"))).alias("radius"),
        r6(scalars.planned_speed(e.value, 8.0)).alias("speed"),
    )


def position_fixes(spark: SparkSession, d: str) -> DataFrame:
    """Fixes of good quality and finite values, with global pixels moved by the map's offset."""
    v = load_table(spark, d, "vehicle_global_position").where("lat between -85 and 85 and lon between -180 and 180 and not isnan(lat) and not isnan(lon) and eph < 5")
    return v.select("row_id", r6(geo.mercator_x(v.lon, ZOOM) - 26000000.0, 3).alias("px"), r6(geo.mercator_y(v.lat, ZOOM) - 14000000.0, 3).alias("py"))


_TMS = "power(2, z) - 1 - y"
_BND = """SELECT file_id, round(least(greatest(degrees(atan(sinh(pi() * (1.0 - 2.0 * r / n)))), -85.05112878), 85.05112878), 7) AS top_lat, round(x / n * 360.0 - 180.0, 7) AS left_lon,
round(least(greatest(degrees(atan(sinh(pi() * (1.0 - 2.0 * (r + 1) / n)))), -85.05112878), 85.05112878), 7) AS bottom_lat, round((x + 1) / n * 360.0 - 180.0, 7) AS right_lon
FROM (SELECT *, pow(2, z) AS n, {0} AS r FROM tiles WHERE z IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND lower(trim(coalesce(scheme, 'xyz'))) = '{1}')"""
#: Files with the tile their path names, or else the columns, counted from the north.
_PLACED = r"""plain AS (SELECT *, coalesce(lower(trim(scheme)) = 'tms', false) AS south, trim(replace(regexp_replace(rel_path, '%2[fF]', '/', 'g'), '\', '/')) AS p FROM tiles),
parts AS (SELECT *, string_split(regexp_replace(regexp_replace(regexp_replace(p, '(^|/)(\./)+', '\1', 'g'), '/+', '/', 'g'), '[^/]+/\.\./', '', 'g'), '/') AS s FROM plain),
named AS (SELECT *, s[-3] AS nz, s[-2] AS nx, regexp_extract(s[-1], '^([0-9]+)\.(png|jpg|jpeg)$', 1, 'i') AS ny FROM parts), told AS (SELECT *, coalesce(regexp_matches(nz, '^[0-9]+$') AND regexp_matches(nx, '^[0-9]+$') AND ny <> '', false) AS ok FROM named),
num AS (SELECT file_id, rel_path, mtime, south, CASE WHEN ok THEN CAST(nz AS INTEGER) ELSE z END AS z, CASE WHEN ok THEN CAST(nx AS BIGINT) ELSE x END AS x, CASE WHEN ok THEN CAST(ny AS BIGINT) ELSE y END AS y FROM told),
tile AS (SELECT file_id, rel_path, mtime, z, CAST(x AS BIGINT) AS x, CASE WHEN south THEN (CAST(1 AS BIGINT) << z) - 1 - y ELSE CAST(y AS BIGINT) END AS y FROM num WHERE z IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL)"""
_BOUNDED = f"""{_PLACED}, bounded AS (SELECT file_id, z, x, y, least(greatest(degrees(atan(sinh(pi() * (1.0 - 2.0 * y / pow(2, z))))), -85.05112878), 85.05112878) AS top_lat, x / pow(2, z) * 360.0 - 180.0 AS left_lon,
least(greatest(degrees(atan(sinh(pi() * (1.0 - 2.0 * (y + 1) / pow(2, z))))), -85.05112878), 85.05112878) AS bottom_lat, (x + 1) / pow(2, z) * 360.0 - 180.0 AS right_lon FROM tile)"""
_T = "t AS (SELECT * FROM tiles WHERE z IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL)"
_PK = "(CAST(z AS BIGINT) << 52) | (CAST(x AS BIGINT) << 26) | CAST(y AS BIGINT)"

QUERIES = {
    f.__name__: f
    for f in (
        mercator_forward, mercator_inverse, ground_sample, tile_bounds_xyz, tile_bounds_tms, tile_pk, tile_window, missing_tiles_anti, missing_tile_fraction,
        bbox_tiles, tile_counts_union_bbox, tile_index_upsert, tile_extension_choice, enu_equirect, map_px_metres, latlon_map_metres, margin_report, wrap_angle,
        quat_yaw, quat_mul_frames, gravity_tilt, compass_yaw_residual, rotate_deltas, footprint_corners, yaw_cal_parse, file_date_parse, waypoint_parse,
        mission_plan_parse, health_json_roundtrip, schedules, position_fixes,
    )
}
_K = "k AS (SELECT event_id, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"
ORACLES = {
    "mercator_forward": f"WITH {_PLACES} SELECT id, round({_MX}, 4) AS px, round({_MY}, 4) AS py FROM places",
    "mercator_inverse": f"WITH {_PLACES}, m AS (SELECT id, {_MX} + id AS px, {_MY} + id AS py FROM places) SELECT id, round(px / ({_W}) * 360.0 - 180.0, 6) AS lon, round(degrees(atan(sinh(pi() * (1.0 - 2.0 * py / ({_W}))))), 6) AS lat FROM m",
    "ground_sample": f"WITH {_PLACES} SELECT id, round(156543.03392 * cos(radians(lat)) / pow(2, {ZOOM}), 6) AS gsd FROM places",
    "tile_bounds_xyz": _BND.format("CAST(y AS DOUBLE)", "xyz"),
    "tile_bounds_tms": _BND.format("pow(2, z) - 1 - y", "tms"),
    "tile_pk": f"WITH {_T} SELECT file_id, {_PK} AS tile_pk, concat_ws('/', z, x, y) AS name FROM t",
    "tile_window": f"""WITH {_PLACES}, c AS (SELECT id, {_MX} AS px, {_MY} AS py FROM places),
a AS (SELECT id, py, unnest(generate_series(CAST(floor((px - 300) / 256) AS BIGINT), CAST(floor((px + 300) / 256) AS BIGINT))) AS tx FROM c)
SELECT id, tx, unnest(generate_series(CAST(floor((py - 300) / 256) AS BIGINT), CAST(floor((py + 300) / 256) AS BIGINT))) AS ty FROM a""",
    "missing_tiles_anti": f"""WITH {_PLACED}, have AS (SELECT DISTINCT z, x, y FROM tile), b AS (SELECT z, min(x) AS lox, min(y) AS loy, max(y) AS hiy FROM have GROUP BY z), c AS (SELECT DISTINCT z, x FROM have),
g AS (SELECT z, x AS x0, x AS x1, coalesce(lag(y) OVER (PARTITION BY z, x ORDER BY y), loy - 1) + 1 AS y0, y - 1 AS y1 FROM have JOIN b USING (z) UNION ALL SELECT z, x, x, max(y) + 1, any_value(hiy) FROM have JOIN b USING (z) GROUP BY z, x
UNION ALL SELECT z, coalesce(lag(x) OVER (PARTITION BY z ORDER BY x), lox - 1) + 1, x - 1, loy, hiy FROM c JOIN b USING (z)) SELECT z, x0, x1, y0, y1 FROM g WHERE x0 <= x1 AND y0 <= y1""",
    "missing_tile_fraction": f"""WITH {_PLACED}, have AS (SELECT DISTINCT z, x, y FROM tile), g AS (SELECT z, count(*) AS n, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) AS cells FROM have GROUP BY z)
SELECT z, round(1 - n / cells, 6) AS missing, 1 - n / cells > 0.02 AS warn FROM g""",
    "bbox_tiles": f"""WITH {_BOUNDED}, m AS (SELECT top_lat AS a, left_lon AS b FROM bounded ORDER BY z DESC, x DESC, y DESC LIMIT 1)
SELECT file_id FROM bounded, m WHERE bottom_lat <= a + 0.01 AND top_lat >= a - 0.01 AND left_lon <= b + 0.01 AND right_lon >= b - 0.01""",
    "tile_counts_union_bbox": f"WITH {_BOUNDED} SELECT z, count(*) AS n, round(max(top_lat), 7) AS north, round(min(left_lon), 7) AS west, round(min(bottom_lat), 7) AS south, round(max(right_lon), 7) AS east FROM bounded GROUP BY z",
    "tile_index_upsert": f"WITH {_PLACED} SELECT z, x, y, file_id FROM tile QUALIFY row_number() OVER (PARTITION BY z, x, y ORDER BY mtime DESC NULLS LAST, file_id DESC) = 1",
    "tile_extension_choice": f"""WITH {_PLACED}, r AS (SELECT *, CASE lower(regexp_extract(trim(rel_path), '\\.(\\w+)$', 1)) WHEN 'jpg' THEN 0 WHEN 'png' THEN 1 WHEN 'jpeg' THEN 2 END AS r FROM tile)
SELECT z, x, y, rel_path FROM r WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY z, x, y ORDER BY r, file_id) = 1""",
    "enu_equirect": f"WITH {_PLACES}, o AS (SELECT arg_min(lat, id) AS a, arg_min(lon, id) AS b FROM places) SELECT id, round(radians(lon - b) * cos(radians(a)) * 6378137.0, 4) AS east, round(radians(lat - a) * 6378137.0, 4) AS north FROM places, o",
    "map_px_metres": f"WITH {_PLACES}, m AS (SELECT id, id * 1.5 - 800 AS x, id * 0.7 - 300 AS y FROM places) SELECT id, CAST(round(2500.0 + x / 0.5, 6) AS DOUBLE) AS px, CAST(round(2500.0 - y / 0.5, 6) AS DOUBLE) AS py, CAST(round(x, 6) AS DOUBLE) AS x, CAST(round(y, 6) AS DOUBLE) AS y FROM m",
    "latlon_map_metres": f"WITH {_PLACES} SELECT id, round({_MX} - 26000000.0 - 2500.0, 3) AS x, round(2500.0 - ({_MY} - 14000000.0), 3) AS y FROM places",
    "margin_report": f"WITH {_PLACES}, m AS (SELECT id, (id * 37) % 5000 - 2500.0 AS x, (id * 53) % 5000 - 2500.0 AS y FROM places) SELECT id, abs(x) > 2200 OR abs(y) > 2200 AS outside FROM m",
    "wrap_angle": f"WITH {_ANGLES} SELECT event_id, round({_PMOD.format('(a - b * 3)')}, 6) AS angle FROM g",
    "quat_yaw": f"WITH {_ANGLES}, {_Q} SELECT event_id, round(atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz)), 6) AS yaw, round(atan2(1 - 2 * (qy * qy + qz * qz), 2 * (qx * qy + qz * qw)), 6) AS heading FROM q",
    "quat_mul_frames": f"""WITH {_ANGLES}, {_Q}, l AS (SELECT event_id, s * qw + s * qz AS x1, s * qw - s * qz AS y1, s * qy - s * qx AS z1, -s * qx - s * qy AS w1 FROM (SELECT *, sqrt(0.5) AS s FROM q))
SELECT event_id, round(w1, 6) AS x, round(z1, 6) AS y, round(-y1, 6) AS z, round(-x1, 6) AS w FROM l""",
    "gravity_tilt": f"WITH {_ANGLES}, v AS (SELECT event_id, -sin(c) * 9.81 AS gx, sin(b) * cos(c) * 9.81 AS gy, cos(b) * cos(c) * 9.81 AS gz FROM g) SELECT event_id, round(atan2(gy, gz), 6) AS roll, round(atan2(-gx, sqrt(gy * gy + gz * gz)), 6) AS pitch FROM v",
    "compass_yaw_residual": f"WITH {_ANGLES}, p AS (SELECT *, {_PMOD.format('(-b + radians(1.3))')} AS y, pi() / 2 + (b - radians(1.3)) AS h FROM g) SELECT event_id, round({_PMOD.format('(a - y)')}, 6) AS residual, round({_PMOD.format('h')}, 6) AS heading FROM p",
    "rotate_deltas": f"WITH {_ANGLES} SELECT event_id, round(a * cos(b) - c * sin(b), 6) AS dx, round(a * sin(b) + c * cos(b), 6) AS dy FROM g",
    "footprint_corners": f"""WITH {_ANGLES}, i AS (SELECT event_id, c / 5 AS roll, b / 30 AS pitch, a + 20 AS alt, unnest([{{'u': 0.0, 'v': 0.0}}, {{'u': 0.0, 'v': 480.0}}, {{'u': 752.0, 'v': 0.0}}, {{'u': 752.0, 'v': 480.0}}]) AS k FROM g),
j AS (SELECT *, (CAST(k.u AS DOUBLE) - 376.0) / 450.0 AS x, (CAST(k.v AS DOUBLE) - 240.0) / 450.0 AS y FROM i),
l AS (SELECT *, x * cos(roll) + sin(roll) AS x1, cos(roll) - x * sin(roll) AS z1 FROM j), m AS (SELECT *, y * cos(pitch) + z1 * sin(pitch) AS y1, z1 * cos(pitch) - y * sin(pitch) AS z2 FROM l),
e AS (SELECT event_id, min(x1 / z2 * alt) AS x0, max(x1 / z2 * alt) AS x1, min(y1 / z2 * alt) AS y0, max(y1 / z2 * alt) AS y1 FROM m GROUP BY event_id)
SELECT event_id, round(x0, 4) AS x0, round(x1, 4) AS x1, round(y0, 4) AS y0, round(y1, 4) AS y1, CAST(greatest(1, ceil(round(x1 - x0, 6))) AS INTEGER) AS width FROM e""",
    "yaw_cal_parse": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN round(value, 6) ELSE -1.0::DOUBLE END AS a, CASE WHEN event_id % 5 = 0 THEN 2.5::DOUBLE ELSE 1.3::DOUBLE END AS b FROM events",
    "file_date_parse": r"""SELECT DISTINCT layer_file, coalesce(TRY_CAST(substr(layer_file, 1, 4) AS INTEGER) * 12 + TRY_CAST(substr(layer_file, 6, 2) AS INTEGER),
TRY_CAST(regexp_extract(layer_file, '_(\d{4})(\d{2})\d{2}\.', 1) AS INTEGER) * 12 + TRY_CAST(regexp_extract(layer_file, '_(\d{4})(\d{2})\d{2}\.', 2) AS INTEGER), 0) AS month FROM bank_meta""",
    "waypoint_parse": "SELECT event_id, 0 AS seq, CAST(event_id AS DOUBLE) AS x, 2.5::DOUBLE AS y FROM events WHERE event_type = 'signup' UNION ALL SELECT event_id, 1, -7.0::DOUBLE, CAST(event_id % 11 AS DOUBLE) FROM events WHERE event_type = 'signup'",
    "mission_plan_parse": """SELECT event_id, 2 AS seq, 30.1::DOUBLE AS lat, 100.1::DOUBLE AS lon, 60.0::DOUBLE AS alt, CAST(least(8, event_id % 7 + 3) AS DOUBLE) AS speed FROM events WHERE event_type = 'signup'
UNION ALL SELECT event_id, 3, 30.2::DOUBLE, 100.2::DOUBLE, 50.0::DOUBLE, CAST(least(8, event_id % 7 + 3) AS DOUBLE) FROM events WHERE event_type = 'signup'""",
    "health_json_roundtrip": f"""WITH {_K} SELECT event_id, k, round(value, 2) AS score, k % 7 AS lost,
CASE WHEN k < 0 OR k IS NULL THEN 'no_frames' WHEN value IS NULL THEN 'init_wait' WHEN round(value, 2) < 50 THEN 'motion_only' WHEN k % 5 = 0 THEN 'recovering' WHEN k % 7 > 0 THEN 'lost' ELSE 'tracking' END AS state FROM k""",
    "schedules": f"""WITH {_K} SELECT event_id, round_even(greatest(24.0, least(96.0, value)) / 4.0, 0) * 4.0 AS coverage, CAST(round(greatest(0.2, 1.0 - 0.4 * k / 50.0), 6) AS DOUBLE) AS anneal, round(value * (1.0 + 2.0 * least(k % 9, 4)), 6) AS widened,
CAST(round(least(30.0 + k + 0.05 * k * k, 120.0), 6) AS DOUBLE) AS tolerance, CAST(least(20, 10 + ceil(value / 50.0)) AS INTEGER) AS streak,
round(greatest(4.0, 0.5 * (value / 7) * (value / 7) * greatest(1.0, 1000.0 / (k + 1.0))) + (k / 10.0) * (k / 10.0), 6) AS variance,
round(least(2000.0, greatest(40.0, 15.0 * k) * pow(1.5, k % 5)), 6) AS radius, round(least(8.0, 0.7 * value), 6) AS speed FROM k""",
    "position_fixes": f"SELECT row_id, round({_MX} - 26000000.0, 3) AS px, round({_MY} - 14000000.0, 3) AS py FROM vehicle_global_position WHERE lat BETWEEN -85 AND 85 AND lon BETWEEN -180 AND 180 AND CAST(lat AS VARCHAR) <> 'nan' AND CAST(lon AS VARCHAR) <> 'nan' AND eph < 5",
}
