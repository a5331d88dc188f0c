"""Scans of a map for a frame's place: positions x headings, scored by a pluggable expression.

A scorer is a function from columns ``x, y, yaw`` (metres, radians) to a score, which may use the frame's own columns.
Candidates are made inside the row as arrays over blocks of the grid, so scoring and the search for local maxima shuffle
nothing and no array grows with the map; only peaks are shuffled, to choose among those of one scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators import peaks as pk

Scorer = Callable[[Column, Column, Column], Column]
BLOCK = 32


def grid_cells(half: float, step: float) -> int:
    """Cells along one side of a square map of ``2 * half`` metres, a step of margin left at both edges."""
    return max(0, math.ceil((2 * half - 2 * step) / step))


def _at(half: float, step: float, k: Column) -> Column:
    return F.lit(step - half) + k * step


def _circle(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda m: m * (2 * math.pi / n))


def around(yaw: Column, span: float, n: int) -> Column:
    """``n`` headings evenly spaced over ``span`` about ``yaw``, both ends included."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda m: yaw - span / 2 + m * (span / max(1, n - 1)))


def coarse_peaks(frames: DataFrame, keys: list[str], scorer: Scorer, half: float, step: float, yaws: int) -> DataFrame:
    """Local maxima of each heading's grid of scores over the whole map: ``keys, score, x, y, yaw`` (all of a plateau)."""
    n = grid_cells(half, step)
    blocks = F.sequence(F.lit(0), F.lit(max(0, (n - 1) // BLOCK)))
    b = frames.withColumn("yaw_", F.explode(_circle(yaws))).withColumn("bi", F.explode(blocks)).withColumn("bj", F.explode(blocks))
    side = BLOCK + 2  # one cell of the neighbouring blocks on each side
    i0, j0 = F.col("bi") * BLOCK - 1, F.col("bj") * BLOCK - 1

    def score(p: Column) -> Column:
        i, j = i0 + (p / side).cast("int"), j0 + p % side
        inside = (i >= 0) & (j >= 0) & (i < n) & (j < n)
        return F.when(inside, scorer(_at(half, step, i), _at(half, step, j), F.col("yaw_")))

    b = b.withColumn("scores", F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), score))
    inner = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(BLOCK)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(BLOCK)), lambda j: i * side + j)))
    near = [a * side + c for a in (-1, 0, 1) for c in (-1, 0, 1) if (a, c) != (0, 0)]
    value = lambda p: F.get("scores", p)
    top = F.filter(inner, lambda p: value(p).isNotNull() & F.coalesce(value(p) >= F.greatest(*[value(p + d) for d in near]), F.lit(True)))
    out = b.withColumn("p", F.explode(top))
    i, j = i0 + (F.col("p") / side).cast("int"), j0 + F.col("p") % side
    return out.select(*keys, value(F.col("p")).alias("score"), _at(half, step, i).alias("x"), _at(half, step, j).alias("y"), F.col("yaw_").alias("yaw"))


def coarse_scan(frames: DataFrame, keys: list[str], scorer: Scorer, half: float, step: float = 96.0, yaws: int = 8, k: int = 8) -> DataFrame:
    """The best ``k`` local maxima of the whole map, more than 100 m apart: ``keys, rank, score, x, y, yaw``."""
    return pk.suppress(coarse_peaks(frames, keys, scorer, half, step, yaws), keys, k, pk.within(100.0, "x", "y"))


def best_per_heading(centres: DataFrame, keys: list[str], scorer: Scorer, radius: float, step: float, headings: Column) -> DataFrame:
    """The best position of each heading in a square about each row's ``x0, y0``; the first in order of y, then x, at equal scores."""
    n = int((2 * radius + 1e-6) // step) + 1
    rows = centres.withColumn("yaw_", F.explode(headings))
    at = lambda c, m: F.col(c) - radius + m * step
    cell = lambda p: F.struct(scorer(at("x0", p % n), at("y0", (p / n).cast("int")), F.col("yaw_")).alias("s"), (-p).alias("p"))
    rows = rows.withColumn("b", F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), cell)))
    p = -F.col("b.p")
    return rows.select(*keys, F.col("b.s").alias("score"), at("x0", p % n).alias("x"), at("y0", (p / n).cast("int")).alias("y"), F.col("yaw_").alias("yaw"))


def local_scan(centres: DataFrame, keys: list[str], scorer: Scorer, radius: float = 48.0, step: float = 12.0, yaws: int = 12, k: int = 3, yaw0: Column | None = None, span: float = 2 * math.pi) -> DataFrame:
    """The best ``k`` of the headings' best positions about ``x0, y0``, peaks within 30 m and 30 degrees being one.

    Headings go round the circle, or over ``span`` about ``yaw0``. Returns ``keys, rank, score, x, y, yaw``.
    """
    best = best_per_heading(centres, keys, scorer, radius, step, _circle(yaws) if yaw0 is None else around(yaw0, span, yaws))
    turned = best.withColumn("rad", F.col("yaw")).withColumn("yaw", F.degrees("yaw"))  # the rule is in degrees
    out = pk.suppress(turned, keys, k, pk.within_and_yaw(30.0, 30.0), ("score", "x", "y", "yaw", "rad"))
    return out.select(*keys, "rank", "score", "x", "y", F.col("rad").alias("yaw"))


def scan_frames(frames: DataFrame, keys: list[str], window_s: float = 25.0, v_max: float = 15.0, most: int = 9) -> DataFrame:
    """Frames a steered scan uses: of the last ``window_s`` of each run, none that jumped from the newest by more than
    thrice what ``v_max`` allows and 60 m, and at most ``most`` of these, evenly spaced. Adds the newest's ``rx, ry``.

    ``frames`` has ``t, px, py`` and a unique ``frame``; only the last frames of a run are ever sorted together.
    """
    newest = frames.groupBy(*keys).agg(F.max(F.struct("t", "frame", "px", "py")).alias("_r")).select(*keys, F.col("_r.t").alias("_t"), F.col("_r.px").alias("rx"), F.col("_r.py").alias("ry"))
    f = frames.join(newest, keys).where(F.col("t") >= F.col("_t") - window_s)
    f = f.where(F.hypot(F.col("px") - F.col("rx"), F.col("py") - F.col("ry")) <= 3 * v_max * F.greatest(F.lit(0.05), F.col("_t") - F.col("t")) + 60.0)
    w = Window.partitionBy(*keys)
    f = f.withColumn("_k", F.row_number().over(w.orderBy("t", "frame")) - 1).withColumn("_n", F.count("*").over(w))
    marks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / float(max(1, most - 1))).cast("int"))
    return f.where((F.col("_n") <= most) | F.array_contains(marks, F.col("_k"))).drop("_t", "_k", "_n")


def steered_scan(frames: DataFrame, keys: list[str], scorer: Scorer, half: float, step: float = 96.0, span: float = math.radians(30), yaws: int = 5, k: int = 10) -> DataFrame:
    """Places that score well in most frames: ``keys, rank, score, x, y``.

    Each frame (``frame, px, py, yaw0``, and ``rx, ry`` of the newest) is scored over the whole map within ``span`` on
    either side of its heading; its grid is moved by the motion since then onto the newest frame's, between cells where
    need be; the median over the frames decides, places within 100 m being one.
    """
    n = grid_cells(half, step)
    side = F.sequence(F.lit(0), F.lit(n - 1))
    cells = frames.select(*keys, "frame", "yaw0", *[c for c in frames.columns if c not in (*keys, "frame", "yaw0")]).withColumn("i", F.explode(side)).withColumn("j", F.explode(side))
    x, y = _at(half, step, F.col("i")), _at(half, step, F.col("j"))
    best = F.array_max(F.transform(around(F.col("yaw0"), 2 * span, yaws), lambda a: scorer(x, y, a)))
    grid = cells.select(*keys, "frame", "i", "j", best.alias("score"))
    points = cells.select(*keys, "frame", F.col("i").alias("ci"), F.col("j").alias("cj"), (F.col("i") + (F.col("px") - F.col("rx")) / step).alias("r"), (F.col("j") + (F.col("py") - F.col("ry")) / step).alias("c"))
    moved = pk.bilinear(grid, points, [*keys, "frame"], n, n)
    median = moved.groupBy(*keys, "ci", "cj").agg(F.round(F.percentile("value", F.lit(0.5)), 9).alias("score"))  # a value a frame, few
    regions = median.select(*keys, "score", _at(half, step, F.col("ci")).alias("x"), _at(half, step, F.col("cj")).alias("y"))
    return pk.suppress(regions, keys, k, pk.within(100.0, "x", "y"), ("score", "x", "y"))


def refine(regions: DataFrame, current: DataFrame, keys: list[str], scorer: Scorer, first: int = 3, radius: float = 192.0, step: float = 32.0, yaws: int = 5, span: float = math.radians(60)) -> DataFrame:
    """The ``first`` regions scanned again about their place with the current frame, the others as they were:
    ``keys, rank, score, x, y, yaw``. ``current`` has one row a run, with ``yaw0`` and what the scorer uses."""
    j = regions.withColumnsRenamed({"x": "x0", "y": "y0", "score": "s0"}).join(current, keys)
    fine = local_scan(j.where(F.col("rank") < first).withColumnRenamed("rank", "nominee"), [*keys, "nominee"], scorer, radius, step, yaws, 1, F.col("yaw0"), span)
    rest = j.where(F.col("rank") >= first).select(*keys, "rank", F.col("s0").alias("score"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("yaw0").alias("yaw"))
    return fine.drop("rank").withColumnRenamed("nominee", "rank").select(*rest.columns).unionByName(rest)
