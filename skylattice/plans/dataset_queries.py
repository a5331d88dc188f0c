"""Queries of dataset building: layers, pairs, joins of flights and logs, tile range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.scalars import file_month
from skylattice.operators import training as tr
from skylattice.operators.sequence import index_in_order
from skylattice.plans.common import E, events, r6, uniform_duck
from skylattice.plans.scan_queries import _norm
from skylattice.session import load_table


def _bank(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "bank_meta")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "real_pairs").drop("patch").withColumn("flight", F.coalesce("flight", F.lit("flight0")))


def real_pairs_table(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with a default for the missing flight tag."""
    return _pairs(spark, d).select("pair_id", "flight", "k")


def layer_order(spark: SparkSession, d: str) -> DataFrame:
    """Layers of each area in order of date."""
    return tr.layers_in_order(_bank(spark, d), file_month(F.col("layer_file"))).select("area", "layer_file", F.col("pos").cast("int").alias("pos"), "newest")


def nearest_layers(spark: SparkSession, d: str) -> DataFrame:
    """The two later layers nearest in date."""
    return tr.nearest_layers(tr.layers_in_order(_bank(spark, d), file_month(F.col("layer_file")))).select("area", "layer_file", "ref", F.col("try").cast("int").alias("try"))


def node_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each node, in order."""
    g = _bank(spark, d).groupBy("area", "node").agg(F.sort_array(F.collect_list("bank_row")).alias("rows"))
    return g.select("area", "node", F.concat_ws(",", F.transform("rows", lambda x: x.cast("string"))).alias("rows"))


def temporal_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two layers of each node."""
    return tr.temporal_pairs(_bank(spark, d)).select("area", "node", "row_a", "row_b")


def negative_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Another node of the same area."""
    return tr.negative_pairs(_bank(spark, d))


def triplet_index(spark: SparkSession, d: str) -> DataFrame:
    """Anchors, positives and negatives."""
    return tr.triplets(_bank(spark, d)).select("area", "node", "row_a", "row_b", "negative", "real")


def node_grid(spark: SparkSession, d: str) -> DataFrame:
    """Jittered nodes of each area."""
    areas = _bank(spark, d).select("area").where("area is not null").distinct()
    return tr.node_grid(areas, 1024, 136, 32, 4.0).select("area", "gi", "gj", r6("cx").alias("cx"), r6("cy").alias("cy"))


def bank_crop_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Crop sizes that hold a patch at any rotation."""
    px = _bank(spark, d).select(F.col("area").alias("px")).where("px is not null").distinct()
    return px.select("px", F.ceil(F.col("px") * F.lit(2.0**0.5)).cast("int").alias("crop"), F.concat(F.lit("bank_"), F.ceil(F.col("px") * F.lit(2.0**0.5))).alias("folder"))


def distinct_flights(spark: SparkSession, d: str) -> DataFrame:
    """Flights that have pairs."""
    return _pairs(spark, d).select("flight").distinct()


def missing_flights_except(spark: SparkSession, d: str) -> DataFrame:
    """Flights with a recording but no pairs."""
    return load_table(spark, d, "topics").select("flight").distinct().subtract(_pairs(spark, d).select("flight"))


def val_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the flights that have a recording."""
    return _pairs(spark, d).join(load_table(spark, d, "topics").select("flight").distinct(), "flight", "left_semi").select("pair_id")


def flight_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Each pair with its flight's number of topics, or none."""
    t = load_table(spark, d, "topics").groupBy("flight").agg(F.count("*").alias("topics"))
    return _pairs(spark, d).join(t, "flight", "left").select("pair_id", "topics")


def composite_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that share flight and frame with an earlier row of the table: repeated deliveries."""
    p = _pairs(spark, d)
    first = p.groupBy("flight", "k").agg(F.min("pair_id").alias("first_id"))
    return p.join(first, ["flight", "k"]).where("pair_id <> first_id").select("pair_id", "first_id")


def frame_log_join(spark: SparkSession, d: str) -> DataFrame:
    """Frames met with log rows by index and run; what has no partner is dropped."""
    idx = lambda topic, name: index_in_order(events(spark, d, topic), ["run"]).select("run", "k", F.col("event_id").alias(name))
    return idx("click", "frame").join(idx("view", "log"), ["run", "k"]).select("frame", "log")


def flight_split(spark: SparkSession, d: str) -> DataFrame:
    """Splits by every fifth flight."""
    f = _pairs(spark, d).select("flight").distinct()
    code = F.conv(F.substring(F.md5("flight"), 1, 8), 16, 10).cast("long")
    return f.select("flight", F.when(F.pmod(code, F.lit(5)) == 4, "val").otherwise("train").alias("split"))


def altitude_floor_skips(spark: SparkSession, d: str) -> DataFrame:
    """Fixes kept and skipped by the altitude floor, per flight."""
    v = load_table(spark, d, "vehicle_global_position").where("alt is not null and not isnan(alt)")
    return v.groupBy("flight").agg(F.count_if(F.col("alt") >= 300).alias("kept"), F.count_if(F.col("alt") < 300).alias("skipped"))


def label_score_gate(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose label is sure enough."""
    return _pairs(spark, d).where("label_score >= 0.5 and not isnan(label_score)").select("pair_id")


def integrity_match(spark: SparkSession, d: str) -> DataFrame:
    """Share of each flight's pairs that have a bank area, and whether that is enough."""
    areas = _bank(spark, d).select("area").where("area is not null").distinct().withColumn("hit", F.lit(1))
    g = _pairs(spark, d).join(areas, "area", "left").groupBy("flight").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("s"))
    return g.select("flight", r6("s").alias("matched"), (F.col("s") >= 0.9).alias("passed"))


def debug_patch_names(spark: SparkSession, d: str) -> DataFrame:
    """Frame numbers read back from artefact names."""
    p = _pairs(spark, d).select("pair_id", F.concat(F.lit("run/k"), F.lpad(F.col("k").cast("string"), 5, "0"), F.lit("_3.png")).alias("name"))
    return p.select("pair_id", F.regexp_extract("name", r"k(\d{5})_\d\.png$", 1).cast("int").alias("k"))


def newest_run(spark: SparkSession, d: str) -> DataFrame:
    """The last written document of each flight."""
    t = load_table(spark, d, "documents").where("flight is not null and written_at is not null")
    return t.groupBy("flight").agg(F.max_by("doc_id", F.struct("written_at", "doc_id")).alias("doc_id"))


def bbox_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of zoom 18 whose centre lies in a tile of zoom 16."""
    t = load_table(spark, d, "tiles").where("top_left_lat is not null and rel_path is not null and z is not null")
    pts = t.where("z = 18").select(F.col("file_id").alias("pid"), ((F.col("top_left_lat") + F.col("bottom_right_lat")) / 2).alias("lat"), ((F.col("top_left_lon") + F.col("bottom_right_lon")) / 2).alias("lon"))
    box = t.where("z = 16").select(F.col("file_id").alias("bid"), F.col("bottom_right_lat").alias("south"), F.col("top_left_lat").alias("north"), F.col("top_left_lon").alias("west"), F.col("bottom_right_lon").alias("east"))
    return tr.range_join_points(pts, box, 0.01)


def near_far_union(spark: SparkSession, d: str) -> DataFrame:
    """Candidate places on a near ring and a far ring, told apart by kind."""
    p = load_table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    from skylattice.operators.particles import uniform

    ring = lambda kind, lo, hi: p.select("id", F.lit(kind).alias("kind"), (lo + (hi - lo) * uniform(kind, F.col("id"))).alias("radius"))
    return ring("near", 176.0, 660.0).unionByName(ring("far", 900.0, 2000.0)).select("id", "kind", r6("radius").alias("radius"))


def georef_json(spark: SparkSession, d: str) -> DataFrame:
    """Sidecar records of the tile set per zoom."""
    t = load_table(spark, d, "tiles").where("z is not null and x is not null and y is not null")
    g = t.groupBy("z").agg(F.min("x").alias("tx0"), F.min("y").alias("ty0"), F.count("*").alias("tiles"))
    return g.select("z", F.to_json(F.struct(F.col("z").alias("zoom"), "tx0", "ty0", (-F.col("tx0") * 256).alias("off_x"), (-F.col("ty0") * 256).alias("off_y"), "tiles")).alias("js"))


_PR = "p AS (SELECT pair_id, coalesce(flight, 'flight0') AS flight, k, area, label_score FROM real_pairs)"
_MONTH = r"""coalesce(TRY_CAST(substr(layer_file, 1, 4) AS INTEGER) * 12 + TRY_CAST(substr(layer_file, 6, 2) AS INTEGER), TRY_CAST(regexp_extract(layer_file, '_(\d{4})(\d{2})\d{2}\.', 1) AS INTEGER) * 12 + TRY_CAST(regexp_extract(layer_file, '_(\d{4})(\d{2})\d{2}\.', 2) AS INTEGER), 0)"""
_LAY = f"d AS (SELECT DISTINCT area, layer_file, {_MONTH} AS month FROM bank_meta WHERE area IS NOT NULL AND layer_file IS NOT NULL), l AS (SELECT *, CAST(row_number() OVER (PARTITION BY area ORDER BY month, layer_file) - 1 AS INTEGER) AS pos, count(*) OVER (PARTITION BY area) AS n FROM d QUALIFY n >= 2)"
_RANK = "r AS (SELECT area, node, layer_file, min(bank_row) AS bank_row FROM bank_meta WHERE area IS NOT NULL AND node IS NOT NULL AND layer_file IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY area, node ORDER BY md5(concat_ws(':', area, node, layer_file)), layer_file) AS draw FROM r), t AS (SELECT area, node, max(CASE WHEN draw = 1 THEN bank_row END) AS row_a, max(CASE WHEN draw = 2 THEN bank_row END) AS row_b FROM k GROUP BY ALL HAVING row_b IS NOT NULL)"
_NEG = "nd AS (SELECT DISTINCT area, node FROM bank_meta WHERE area IS NOT NULL AND node IS NOT NULL), ng AS (SELECT area, node, coalesce(lead(node) OVER w, first_value(node) OVER (PARTITION BY area ORDER BY md5(concat_ws(':', area, node)), node ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS negative FROM nd WINDOW w AS (PARTITION BY area ORDER BY md5(concat_ws(':', area, node)), node))"
_START, _STEP = 136 / 2 + 136 / 2**0.5, 168

QUERIES = {
    f.__name__: f
    for f in (
        real_pairs_table, layer_order, nearest_layers, node_rows, temporal_pairs, negative_pairs, triplet_index, node_grid, bank_crop_sizes, distinct_flights,
        missing_flights_except, val_semi_join, flight_dimension, composite_key_join, frame_log_join, flight_split, altitude_floor_skips, label_score_gate,
        integrity_match, debug_patch_names, newest_run, bbox_range_join, near_far_union, georef_json,
    )
}
ORACLES = {
    "real_pairs_table": f"WITH {_PR} SELECT pair_id, flight, k FROM p",
    "layer_order": f"WITH {_LAY} SELECT area, layer_file, pos, pos = n - 1 AS newest FROM l",
    "nearest_layers": f"WITH {_LAY} SELECT a.area, a.layer_file, b.layer_file AS ref, CAST(row_number() OVER (PARTITION BY a.area, a.layer_file ORDER BY abs(b.month - a.month), b.pos) AS INTEGER) AS try FROM l a JOIN l b ON a.area = b.area AND b.pos > a.pos QUALIFY try <= 2",
    "node_rows": "SELECT area, node, list_aggregate(list_sort(list(bank_row)), 'string_agg', ',') AS rows FROM bank_meta GROUP BY area, node",
    "temporal_pairs": f"WITH {_RANK} SELECT * FROM t",
    "negative_pairs": f"WITH {_NEG} SELECT * FROM ng WHERE negative <> node",
    "triplet_index": f"WITH {_RANK}, {_NEG} SELECT t.*, ng.negative, {uniform_duck(chr(99) + 'oncat_ws(' + repr(':') + ', ' + repr('real') + ', t.area, t.node)')} < 0.5 AS real FROM t JOIN ng ON t.area = ng.area AND t.node = ng.node WHERE negative <> ng.node",
    "node_grid": f"""WITH a AS (SELECT DISTINCT area FROM bank_meta WHERE area IS NOT NULL), g AS (SELECT area, CAST(gi AS INTEGER) AS gi, CAST(gj AS INTEGER) AS gj FROM a, generate_series(0, {int((1024 - 2 * _START) // _STEP)}) AS x(gi), generate_series(0, {int((1024 - 2 * _START) // _STEP)}) AS y(gj))
SELECT area, gi, gj, round(least(greatest({_START!r}::DOUBLE + gi * {_STEP} + 4.0 * {_norm('node:x', 'area, gi, gj')}, {_START!r}::DOUBLE), {1024 - _START!r}::DOUBLE), 6) AS cx, round(least(greatest({_START!r}::DOUBLE + gj * {_STEP} + 4.0 * {_norm('node:y', 'area, gi, gj')}, {_START!r}::DOUBLE), {1024 - _START!r}::DOUBLE), 6) AS cy FROM g""",
    "bank_crop_sizes": "SELECT DISTINCT area AS px, CAST(ceil(area * sqrt(2)) AS INTEGER) AS crop, concat('bank_', CAST(ceil(area * sqrt(2)) AS INTEGER)) AS folder FROM bank_meta WHERE area IS NOT NULL",
    "distinct_flights": f"WITH {_PR} SELECT DISTINCT flight FROM p",
    "missing_flights_except": f"WITH {_PR} SELECT DISTINCT flight FROM topics EXCEPT SELECT flight FROM p",
    "val_semi_join": f"WITH {_PR} SELECT pair_id FROM p WHERE flight IN (SELECT flight FROM topics)",
    "flight_dimension": f"WITH {_PR}, t AS (SELECT flight, count(*) AS topics FROM topics GROUP BY flight) SELECT pair_id, topics FROM p LEFT JOIN t ON p.flight = t.flight",
    "composite_key_join": f"WITH {_PR}, f AS (SELECT flight, k, min(pair_id) AS first_id FROM p GROUP BY ALL) SELECT pair_id, first_id FROM p JOIN f ON p.flight = f.flight AND p.k = f.k WHERE pair_id <> first_id",
    "frame_log_join": f"WITH {E}, k AS (SELECT *, row_number() OVER (PARTITION BY topic, run ORDER BY t, event_id) AS k FROM e) SELECT a.event_id AS frame, b.event_id AS log FROM k a JOIN k b ON a.run = b.run AND a.k = b.k WHERE a.topic = 'click' AND b.topic = 'view'",
    "flight_split": f"WITH {_PR} SELECT DISTINCT flight, CASE WHEN CAST(concat('0x', substr(md5(flight), 1, 8)) AS BIGINT) % 5 = 4 THEN 'val' ELSE 'train' END AS split FROM p",
    "altitude_floor_skips": "SELECT flight, count(*) FILTER (alt >= 300) AS kept, count(*) FILTER (alt < 300) AS skipped FROM vehicle_global_position WHERE alt IS NOT NULL AND CAST(alt AS VARCHAR) <> 'nan' GROUP BY flight",
    "label_score_gate": f"WITH {_PR} SELECT pair_id FROM p WHERE label_score >= 0.5 AND CAST(label_score AS VARCHAR) <> 'nan'",
    "integrity_match": f"WITH {_PR}, m AS (SELECT flight, avg(CASE WHEN area IN (SELECT area FROM bank_meta WHERE area IS NOT NULL) THEN 1.0 ELSE 0.0 END) AS s FROM p GROUP BY flight) SELECT flight, round(s, 6) AS matched, s >= 0.9 AS passed FROM m",
    "debug_patch_names": f"WITH {_PR} SELECT pair_id, CAST(regexp_extract('run/k' || lpad(CAST(k AS VARCHAR), 5, '0') || '_3.png', 'k(\\d{{5}})_\\d\\.png$', 1) AS INTEGER) AS k FROM p",
    "newest_run": "SELECT flight, doc_id FROM documents WHERE flight IS NOT NULL AND written_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY flight ORDER BY written_at DESC, doc_id DESC) = 1",
    "bbox_range_join": """WITH t AS (SELECT * FROM tiles WHERE top_left_lat IS NOT NULL AND rel_path IS NOT NULL AND z IS NOT NULL), p AS (SELECT file_id AS pid, (top_left_lat + bottom_right_lat) / 2 AS lat, (top_left_lon + bottom_right_lon) / 2 AS lon FROM t WHERE z = 18)
SELECT pid, file_id AS bid FROM p JOIN t ON z = 16 AND lat >= bottom_right_lat AND lat <= top_left_lat AND lon >= top_left_lon AND lon <= bottom_right_lon""",
    "near_far_union": f"SELECT c_custkey AS id, 'near' AS kind, round(176.0 + 484.0 * {uniform_duck('concat_ws(' + repr(':') + ', ' + repr('near') + ', c_custkey)')}, 6) AS radius FROM customer UNION ALL SELECT c_custkey, 'far', round(900.0 + 1100.0 * {uniform_duck('concat_ws(' + repr(':') + ', ' + repr('far') + ', c_custkey)')}, 6) FROM customer",
    "georef_json": "SELECT z, CAST(json_object('zoom', z, 'tx0', min(x), 'ty0', min(y), 'off_x', -min(x) * 256, 'off_y', -min(y) * 256, 'tiles', count(*)) AS VARCHAR) AS js FROM tiles WHERE z IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL GROUP BY z",
}
