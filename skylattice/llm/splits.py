"""Train, validation and test splits that keep related records together.

Records that share an area or a flight, directly or through others, form a component. Components are found by
alternating large-star and small-star rounds on the distinct (area, flight) pairs: every round is aggregation and
equi-join, with its lineage cut in the shared folder. Components are then balanced by the largest-differencing method:
the two partial solutions with the widest spread are combined, heaviest bin with lightest, until one remains; its many
nearly equal bins are handed out whole to the splits. Differencing runs in chunks of bounded size, and the chunks'
bins are differenced in turn, so no task or driver ever holds all components.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.session import ensure_checkpoint_dir


def flight_key(tag: Column) -> Column:
    """A flight's counter, date and time however its tag is spelled; an unknown spelling stands for itself, blank is null."""
    p = r"bag[ _-]*0*([0-9]+)[ _-]+([0-9]{4})[-:]?([0-9]{2})[-:]?([0-9]{2})[ _tT-]+([0-9]{2})[-:]?([0-9]{2})[-:]?([0-9]{2})"
    low = F.lower(F.trim(tag))
    part = lambda k: F.regexp_extract(low, p, k)
    known = F.concat(part(1), F.lit("_"), part(2), part(3), part(4), F.lit("_"), part(5), part(6), part(7))
    return F.when(part(1) != "", known).when(low != "", low)


def split_label(label: Column) -> Column:
    """train, val or test however spelled or shortened; anything else is null."""
    low = F.lower(F.trim(label))
    return F.when(low.rlike("^tr"), "train").when(low.rlike("^(va|dev)"), "val").when(low.rlike("^(te|ts)"), "test")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the pairs ``u, v`` (strings): ``node, component``, the component being its least node.

    Nulls and loops tie nothing and are left out. Raises if ``max_rounds`` rounds don't settle (each at least halves the
    distance to the least node, so that would take more than 2^30 nodes in a row).
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    mark = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), "m").where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def difference(tuples: list[np.ndarray], bins: int) -> list[np.ndarray]:
    """Largest differencing: for each tuple (weights of its own bins), the common bin that each of its places falls to.

    Ties are resolved by position, so the result is repeatable. The places of one tuple always fall to different bins.
    """
    if not tuples:
        return []
    # an entry: (-spread, order, weights sorted down, content of each place); content is a linked pair or a leaf (tuple, place)
    heap = []
    for i, w in enumerate(tuples):
        full = np.zeros(bins)
        full[: len(w)] = w
        order = np.argsort(-full, kind="stable")
        heap.append((-(full.max() - full.min()), i, full[order], [(i, int(k)) if k < len(w) else None for k in order]))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, wa, ca = heapq.heappop(heap)
        _, _, wb, cb = heapq.heappop(heap)
        w = wa + wb[::-1]
        c = [y if x is None else x if y is None else [x, y] for x, y in zip(ca, reversed(cb))]
        order = np.argsort(-w, kind="stable")
        w = w[order]
        heapq.heappush(heap, (-(w[0] - w[-1]), n, w, [c[k] for k in order]))
        n += 1
    out = [np.zeros(len(w), np.int64) for w in tuples]
    for b, content in enumerate(heap[0][3]):
        stack = [content] if content is not None else []
        while stack:
            x = stack.pop()
            if isinstance(x, list):
                stack += x
            else:
                out[x[0]][x[1]] = b
    return out


def hand_out(weights: np.ndarray, shares: dict[str, float]) -> list[str]:
    """Whole bins to splits: heaviest first, each to the split that is furthest below its share."""
    total, names = weights.sum(), sorted(shares)
    want = {s: shares[s] * total for s in names}
    out = [""] * len(weights)
    for k in np.argsort(-weights, kind="stable"):
        s = max(names, key=lambda s: want[s])
        out[k] = s
        want[s] -= weights[k]
    return out


def balance(weights: DataFrame, shares: dict[str, float], bins: int = 100, chunk_items: int = 20000, fan: int = 500) -> DataFrame:
    """Whole components to splits: ``component, bin, split`` of ``component, weight``. Empty input gives an empty result."""
    ensure_checkpoint_dir(weights.sparkSession)
    n = weights.count()
    chunks = max(1, math.ceil(n / chunk_items))
    placed = weights.select("component", "weight", F.pmod(F.xxhash64("component"), F.lit(chunks)).cast("long").alias("chunk"))

    def first(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["weight", "component"], ascending=[False, True], ignore_index=True)
        at = difference([np.array([w], float) for w in g["weight"]], bins)
        return g.assign(slot=[int(a[0]) for a in at])

    placed = placed.groupBy("chunk").applyInPandas(first, "component string, weight double, chunk long, slot long").checkpoint()
    while True:
        groups = max(1, math.ceil(chunks / fan))
        sums = placed.groupBy("chunk", "slot").agg(F.sum("weight").alias("weight"))

        def again(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(["chunk", "weight", "slot"], ascending=[True, False, True], ignore_index=True)
            parts = [p for _, p in g.groupby("chunk", sort=True)]
            at = difference([p["weight"].to_numpy(float) for p in parts], bins)
            return pd.concat([p.assign(slot2=a) for p, a in zip(parts, at)])[["chunk", "slot", "group", "slot2"]]

        moved = sums.withColumn("group", F.pmod("chunk", F.lit(groups)).cast("long")).groupBy("group").applyInPandas(again, "chunk long, slot long, group long, slot2 long")
        placed = placed.join(moved, ["chunk", "slot"]).select("component", "weight", F.col("group").alias("chunk"), F.col("slot2").alias("slot"))
        chunks = groups
        if groups == 1:
            break
        placed = placed.checkpoint()
    placed = placed.checkpoint()

    def allocate(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("slot", ignore_index=True)
        return pd.DataFrame({"slot": g["slot"], "split": hand_out(g["weight"].to_numpy(float), shares)})

    names = placed.groupBy("slot").agg(F.sum("weight").alias("weight")).withColumn("all", F.lit(True)).groupBy("all").applyInPandas(allocate, "slot long, split string")
    return placed.join(F.broadcast(names), "slot").select("component", F.col("slot").alias("bin"), "split")  # at most ``bins`` rows


def related_records(bank: DataFrame, pairs: DataFrame) -> DataFrame:
    """Records of both tables with their node and group: ``source, record_id, area, flight, label, component``.

    A record without area and flight is a group of its own. Repeated rows are records of their own, in the same group.
    """
    a = bank.select(F.lit("bank_meta").alias("source"), F.col("bank_row").alias("record_id"), "area", F.lit(None).cast("string").alias("flight"), split_label(F.col("split")).alias("label"))
    b = pairs.select(F.lit("real_pairs").alias("source"), F.col("pair_id").alias("record_id"), "area", flight_key(F.col("flight")).alias("flight"), F.lit(None).cast("string").alias("label"))
    area, flight = F.concat(F.lit("a"), F.col("area")), F.concat(F.lit("f"), F.col("flight"))
    own = F.concat(F.lit("r:"), "source", F.lit(":"), F.coalesce(F.col("record_id").cast("string"), F.lit("?")))
    records = a.unionByName(b).withColumn("node", F.coalesce(area, flight, own))
    ties = b.where("area is not null and flight is not null").select(area.alias("u"), flight.alias("v")).distinct()
    groups = components(ties)
    return records.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")


def assign_splits(bank: DataFrame, pairs: DataFrame, targets: DataFrame, bins: int = 100) -> DataFrame:
    """Every record with its split: ``source, record_id, area, flight, component, bin, split``.

    ``targets`` has ``split, share``; it is a list of splits, whose length doesn't grow with the data. Shares are
    scaled to a sum of one. Shares can be met only as closely as the largest group allows: no group is ever divided.
    """
    wanted = {r["split"]: float(r["share"]) for r in targets.where("split is not null and share > 0").select("split", "share").collect()}
    shares = {k: v / sum(wanted.values()) for k, v in wanted.items()}
    records = related_records(bank, pairs)
    weights = records.groupBy("component").agg(F.count("*").cast("double").alias("weight"))
    return records.join(balance(weights, shares, bins), "component").select("source", "record_id", "area", "flight", "component", "bin", "split")


def leaking_areas(bank: DataFrame, pairs: DataFrame) -> DataFrame:
    """Areas of ``bank`` whose group has rows of ``bank`` in more than one split: ``area``."""
    records = related_records(bank, pairs).where("source = 'bank_meta' and area is not null")
    by_area = records.groupBy("component", "area").agg(F.collect_set("label").alias("labels"))
    mixed = by_area.select("component", F.explode("labels").alias("label")).groupBy("component").agg(F.count_distinct("label").alias("n")).where("n > 1")
    return by_area.join(mixed, "component", "left_semi").select("area")
