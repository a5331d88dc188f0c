"""Training-pair construction: layers, nodes, temporal pairs, negatives and triplets, as joins over the patch bank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators.particles import normal, uniform


def layers_in_order(bank: DataFrame, month: Column) -> DataFrame:
    """Each area's layers by date (ties by name), newest last, of areas with at least two: ``area, layer_file, month, pos, newest``."""
    layers = bank.where("area is not null and layer_file is not null").select("area", "layer_file", month.alias("month")).distinct()
    w = Window.partitionBy("area").orderBy("month", "layer_file")
    n = F.count("*").over(Window.partitionBy("area"))
    out = layers.withColumn("pos", F.row_number().over(w) - 1).withColumn("n", n).where("n >= 2")
    return out.withColumn("newest", F.col("pos") == F.col("n") - 1).drop("n")


def nearest_layers(layers: DataFrame, tries: int = 2) -> DataFrame:
    """For each layer but the newest the ``tries`` later ones nearest in date, to align it with."""
    other = layers.select("area", F.col("layer_file").alias("ref"), F.col("month").alias("ref_month"), F.col("pos").alias("ref_pos"))
    pairs = layers.join(other, "area").where("ref_pos > pos")
    w = Window.partitionBy("area", "layer_file").orderBy(F.abs(F.col("ref_month") - F.col("month")), "ref_pos")
    return pairs.withColumn("try", F.row_number().over(w)).where(F.col("try") <= tries).select("area", "layer_file", "ref", "try")


def ranked_rows(bank: DataFrame) -> DataFrame:
    """One row per (area, node, layer), numbered inside its node by a hash: the order in which they are drawn."""
    one = bank.where("area is not null and node is not null and layer_file is not null").groupBy("area", "node", "layer_file").agg(F.min("bank_row").alias("bank_row"))
    w = Window.partitionBy("area", "node").orderBy(F.md5(F.concat_ws(":", "area", "node", "layer_file")), "layer_file")
    return one.withColumn("draw", F.row_number().over(w))


def temporal_pairs(bank: DataFrame) -> DataFrame:
    """Two different layers of every node that has them: ``area, node, row_a, row_b``. One pass, no self-join."""
    r = ranked_rows(bank).where("draw <= 2")
    p = r.groupBy("area", "node").agg(F.max(F.when(F.col("draw") == 1, F.col("bank_row"))).alias("row_a"), F.max(F.when(F.col("draw") == 2, F.col("bank_row"))).alias("row_b"))
    return p.where("row_b is not null")


def negative_pairs(bank: DataFrame) -> DataFrame:
    """For every node another node of its area, the next one in a hashed circle; areas of one node have none."""
    nodes = bank.where("area is not null and node is not null").select("area", "node").distinct().withColumn("h", F.md5(F.concat_ws(":", "area", "node")))
    w = Window.partitionBy("area").orderBy("h", "node")
    first = F.first("node").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return nodes.withColumn("negative", F.coalesce(F.lead("node").over(w), first)).where("negative <> node").select("area", "node", "negative")


def triplets(bank: DataFrame, real_share: float = 0.5) -> DataFrame:
    """Triplet index: the temporal pair, the negative node, and whether the anchor is to be a real or a simulated view."""
    t = temporal_pairs(bank).join(negative_pairs(bank), ["area", "node"])
    return t.withColumn("real", uniform("real", F.col("area"), F.col("node")) < real_share)


def node_grid(areas: DataFrame, size: int, crop: int, margin: int, jitter: float) -> DataFrame:
    """Regular nodes of each area with a jitter shared by all its layers: ``area, gi, gj, cx, cy``."""
    start, step = crop / 2 + crop / 2**0.5, crop + margin
    n = int((size - 2 * start) // step) + 1
    g = areas.withColumn("gi", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("gj", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    place = lambda k, s: F.least(F.greatest(start + F.col(k) * step + jitter * normal(f"node:{s}", F.col("area"), F.col("gi"), F.col("gj")), F.lit(start)), F.lit(size - start))
    return g.select("area", "gi", "gj", place("gi", "x").alias("cx"), place("gj", "y").alias("cy"))


def range_join_points(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """Points ``pid, lat, lon`` in boxes ``bid, south, north, west, east``, by cells of ``cell`` degrees: ``pid, bid``.

    A box is given once for each cell it covers, and met by an equi-join; a hot cell is split by AQE's skew join.
    """
    down = lambda c: F.floor(c / cell)
    b = boxes.withColumn("ci", F.explode(F.sequence(down(F.col("south")), down(F.col("north"))))).withColumn("cj", F.explode(F.sequence(down(F.col("west")), down(F.col("east")))))
    p = points.withColumn("ci", down(F.col("lat"))).withColumn("cj", down(F.col("lon")))
    return p.join(b, ["ci", "cj"]).where("lat >= south and lat <= north and lon >= west and lon <= east").select("pid", "bid")
