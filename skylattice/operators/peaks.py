"""Peaks on grids of scores: local maxima, suppression in space, sampling between cells."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.operators.sequence import ordered_fold


@dataclass(frozen=True)
class Duplicate:
    """When two peaks are one: no farther apart than ``radius`` along ``axes`` and, if ``degrees`` is given, headings no
    farther apart than that."""

    radius: float
    axes: tuple[str, ...]
    degrees: float | None = None

    def of(self, kept: pd.Series | dict, new: pd.DataFrame) -> np.ndarray:
        """Which of the new peaks are the same as a kept one."""
        near = sum((new[a].to_numpy(float) - kept[a]) ** 2 for a in self.axes) <= self.radius * self.radius
        if self.degrees is None:
            return near
        return near & (np.abs((kept["yaw"] - new["yaw"].to_numpy(float) + 180.0) % 360.0 - 180.0) <= self.degrees)


def within(radius: float, *axes: str) -> Duplicate:
    """Two peaks are one if they are no farther apart than the radius."""
    return Duplicate(radius, axes)


def within_and_yaw(radius: float, degrees: float) -> Duplicate:
    """The same, but only if their headings are also close."""
    return Duplicate(radius, ("x", "y"), degrees)


def suppress(peaks: DataFrame, keys: list[str], k: int, same: Duplicate, columns: tuple[str, ...] = ("score", "x", "y", "yaw")) -> DataFrame:
    """Greedy choice of up to ``k`` peaks per scan, best first (ties by the next columns, descending), no two the same.

    Peaks come sorted within partitions, batch by batch; only those kept are held, and what follows the last of them is
    passed over, so a scan may have any number of peaks. Peaks without a score are left out.
    """
    types = dict(peaks.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in keys), "rank int", *(f"{c} {types[c]}" for c in columns)])

    def step(kept: list[dict], rows: pd.DataFrame) -> tuple[list[dict], pd.DataFrame]:
        begin = len(kept)
        if begin < k:
            free = np.ones(len(rows), bool)
            for o in kept:
                free &= ~same.of(o, rows)
            while len(kept) < k and free.any():
                new = rows.iloc[int(free.argmax())].to_dict()
                kept.append(new)
                free &= ~same.of(new, rows)
        out = pd.DataFrame(kept[begin:], columns=rows.columns).assign(rank=range(begin, len(kept)))
        return kept, out[[*keys, "rank", *columns]]

    return ordered_fold(peaks.select(*keys, *columns).where(F.col(columns[0]).isNotNull()), keys, [F.desc(c) for c in columns], list, step, schema)


def local_maxima(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Cells ``i, j`` no lower than any of their eight neighbours (all of a plateau)."""
    offsets = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    spread = grid.withColumn("_o", F.explode(offsets)).groupBy(*keys, (F.col("i") + F.col("_o.di")).alias("i"), (F.col("j") + F.col("_o.dj")).alias("j")).agg(F.max("score").alias("_m"))
    return grid.join(spread, [*keys, "i", "j"]).where("score = _m").drop("_m")


def bilinear(grid: DataFrame, points: DataFrame, keys: list[str], rows: Column | int, cols: int, last: Column | None = None) -> DataFrame:
    """The grid's value at fractional ``r, c``, held at the edges: adds ``value``. Four equi-joins in one.

    ``rows`` may be a column of the points; ``last`` is the last column of the last row, if that row isn't full.
    """
    clip = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n)).cast("int")
    r0, c0 = clip(F.floor("r"), rows - 1), clip(F.floor("c"), cols - 1)
    fr, fc = F.least(F.greatest(F.col("r") - r0, F.lit(0.0)), F.lit(1.0)), F.least(F.greatest(F.col("c") - c0, F.lit(0.0)), F.lit(1.0))

    def corner(dr: int, dc: int, w: Column) -> Column:
        i, j = F.least(r0 + dr, F.lit(rows - 1)), F.least(c0 + dc, F.lit(cols - 1))
        if last is not None:
            j = F.when(i == rows - 1, F.least(j, last)).otherwise(j)
        return F.struct(i.alias("i"), j.alias("j"), w.alias("w"))

    corners = F.array(corner(0, 0, (1 - fr) * (1 - fc)), corner(0, 1, (1 - fr) * fc), corner(1, 0, fr * (1 - fc)), corner(1, 1, fr * fc))
    p = points.withColumn("_k", F.explode(corners)).select(*points.columns, "_k.*")
    return p.join(grid, [*keys, "i", "j"]).groupBy(*points.columns).agg(F.sum(F.col("w") * F.col("score")).alias("value"))
