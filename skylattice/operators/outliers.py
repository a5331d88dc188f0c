"""Implausible readings per source, relative to that source's normal behaviour.

Three kinds are flagged: values out of physical bounds; spikes, whose coefficients in a wavelet decomposition (see
``functions.lifting``) lie above a threshold scaled robustly per source and level; and sticking, found as runs of zero
detail far longer than the source's usual time between new values. The decomposition says where an excursion may lie
and how wide it is; an exact check of its first and last reading against the path around it follows.

Scale: rows are placed into blocks of time with a halo, so a source with a third of all rows is many bounded blocks, and
shuffled once. What is normal for a source comes from mergeable log-scale histograms of the blocks' details, added up
per source and sent back to its blocks; no source is ever gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.lifting import decompose, details, predict, runs

FIELDS = ("alt", "lat", "lon")
#: Physical bounds of each field, and the least scatter that counts (about the resolution of the recording).
BOUNDS = {"alt": (-500.0, 20000.0), "lat": (-90.0, 90.0), "lon": (-180.0, 180.0)}
LEAST_SCALE = {"alt": 0.05, "lat": 5e-7, "lon": 5e-7}
_PER_OCTAVE = 4
_ZERO = -100000
#: Statistics by number; those by level add the level.
_RUN, _SPEED, _LEVEL, _SPAN = 0, 1, 100, 200
#: Most levels kept of a source's scatter: 2**20 values between renewals; wider spans take the last one's.
LEVELS = 20


def out_of_bounds(field: str) -> F.Column:
    """Whether a present value is impossible: outside its bounds, infinite, or (lat, lon) exactly the null island."""
    c, (low, high) = F.col(field).cast("double"), BOUNDS[field]
    bad = ~c.between(low, high)
    if field != "alt":
        bad = bad | ((F.col("lat") == 0) & (F.col("lon") == 0))
    return F.coalesce(bad & ~F.isnan(c), F.lit(False))


def _series(g: dict[str, np.ndarray], field: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seconds, values, rows, place of each row) of the field in order of time: one entry for all copies of a delivery,
    of what is present and possible; rows are those of ``g`` that stand for an entry."""
    v = g[field]
    low, high = BOUNDS[field]
    with np.errstate(invalid="ignore"):
        ok = np.isfinite(v) & (v >= low) & (v <= high)
    if field != "alt":
        ok &= ~((g["lat"] == 0) & (g["lon"] == 0))
    at = np.flatnonzero(ok)
    at = at[np.lexsort((v[at], g["t_us"][at]))]
    t, v = g["t_us"][at], v[at]
    once = np.r_[True, (np.diff(t) != 0) | (v[1:] != v[:-1])] if len(at) else np.zeros(0, bool)
    return t[once] / 1e6, v[once], at, np.cumsum(once) - 1


def _columns(g: pa.Table) -> dict[str, np.ndarray]:
    """Rows of a block as arrays, null values as NaN."""
    return {c: g[c].to_numpy() for c in ("row_id", "t_us", *FIELDS)}


def _histogram(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bins of the logarithms of sizes, their counts)."""
    x = np.abs(x)
    with np.errstate(divide="ignore"):
        bins = np.floor(_PER_OCTAVE * np.log2(x))
    return np.unique(np.where(x > 0, bins, _ZERO).astype(np.int32), return_counts=True)


def _normal_histograms(key: tuple, g: pa.Table) -> pa.Table:
    """Histograms of one block: run lengths, coefficients of each level, scatter over spans, speeds."""
    found: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    columns = _columns(g) if pc.any(g["home"]).as_py() else {c: np.zeros(0) for c in ("row_id", "t_us", *FIELDS)}  # nothing but a halo
    for k, f in enumerate(FIELDS):
        t, v, _, _ = _series(columns, f)
        first, length = runs(v)
        found.append((-1, _RUN, *np.unique(length[1:-1], return_counts=True)))
        ft, fv = t[first], v[first]
        if len(ft) < 3:
            continue
        dt = np.diff(ft)
        step = np.median(dt)
        for level, d in enumerate(decompose(ft, fv, LEVELS)):
            reach = 2**level
            at = np.arange(reach, len(ft) - reach)  # with both neighbours
            near = ft[at + reach] - ft[at - reach] <= (2 * reach + 3) * step
            found.append((k, _LEVEL + level, *_histogram(d[at][near])))
            d, span = details(ft, fv, reach)
            found.append((k, _SPAN + level, *_histogram(d[span <= (reach + 4) * step])))
        usual = (dt > 0.6 * step) & (dt <= 2.5 * step)
        found.append((k, _SPEED, *_histogram(np.diff(fv)[usual] / dt[usual])))
    size = [len(x[2]) for x in found]
    put = lambda v: pa.array(np.asarray(v, np.int32))
    repeat = lambda i: put(np.repeat([x[i] for x in found], size))
    flight = pa.DictionaryArray.from_arrays(put(np.zeros(sum(size))), pa.array([key[0].as_py()], pa.string())).cast(pa.string())
    return pa.table({"flight": flight, "field": repeat(0), "stat": repeat(1), "bin": put(np.concatenate([x[2] for x in found])), "n": pa.array(np.concatenate([x[3] for x in found]).astype(np.int64))})


def source_normals(histograms: DataFrame) -> DataFrame:
    """Per flight ``stats``, an array of ``field, stat, usual, high, scale``: the commonest bin, the value that 95 % stay
    below, and the robust scatter. It has an entry for each field and statistic, whatever the size of a flight."""
    h = histograms.groupBy("flight", "field", "stat", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("flight", "field", "stat").orderBy("bin")  # a few hundred bins, whatever the size of a flight
    ranked = h.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))

    def at(q: float) -> F.Column:
        """The quantile, within its bin by rank."""
        inside = (q * F.col("total") - (F.col("upto") - F.col("n"))) / F.col("n")
        value = F.when(F.col("bin") <= _ZERO, 0.0).otherwise(F.pow(F.lit(2.0), (F.col("bin") + inside) / _PER_OCTAVE))
        return F.min(F.when(F.col("upto") >= q * F.col("total"), F.struct("bin", value.alias("x"))))["x"]

    # the deviation of a normal distribution with this median, or half that of one with this 80 % point
    q = ranked.groupBy("flight", "field", "stat").agg(F.max(F.struct("n", "bin"))["bin"].alias("usual"), at(0.95).alias("high"), F.greatest(at(0.5) / 0.6745, at(0.8) / 1.2816 / 2).alias("scale"))
    return q.groupBy("flight").agg(F.collect_list(F.struct("field", "stat", "usual", "high", "scale")).alias("stats"))


def _normals(stats: list[dict]) -> tuple[float, np.ndarray, np.ndarray, list[float]]:
    """(hold, scales of the levels, scales of the spans, speeds) of a flight; a row of scales for each field."""
    scales, hold, speeds = np.full((2, len(FIELDS), LEVELS), np.nan), np.inf, [0.0] * len(FIELDS)
    for s in stats:
        if s["stat"] == _RUN:
            hold = float(s["usual"])
        elif s["stat"] == _SPEED:
            speeds[s["field"]] = s["high"]
        else:
            scales[s["stat"] // 100 - 1, s["field"], s["stat"] % 100] = s["scale"]
    return hold, *scales, speeds


def _scales(x: np.ndarray, least: float) -> np.ndarray:
    """A scale for each level: the measured one, at least ``least``, never below that of a finer level."""
    return np.maximum.accumulate(np.where(np.isfinite(x), np.maximum(x, least), least))


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number in it) of every whole number from low up to, not including, high."""
    size = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(low)), size)
    return which, low[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)


def _candidates(t: np.ndarray, v: np.ndarray, levels: np.ndarray, times: float) -> tuple[np.ndarray, np.ndarray]:
    """Runs [i, j) that the decomposition allows to be excursions: a coefficient of the level of their width stands out
    in their middle, and those of the finest level at both edges."""
    ds = decompose(t, v, len(levels))
    out_i, out_j = [], []
    if not ds:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d0 = np.nan_to_num(ds[0])
    hot = np.abs(d0) > times * levels[0]
    edge = np.flatnonzero(hot[1:] | hot[:-1]) + 1  # between a value and the one before it
    begin, end = edge[edge < len(v)], edge
    for k, d in enumerate(ds):
        stands = np.abs(np.nan_to_num(d)) > times * levels[k]
        if not stands.any():
            continue
        narrow, wide = (2 ** (k - 1) if k else 0), 2**k  # widths over narrow, up to wide
        low = np.searchsorted(end, begin + narrow, side="right")
        which, at = _ranges(low, np.searchsorted(end, begin + wide, side="right"))
        i, j = begin[which], end[at]
        keep = stands[(i + j - 1) // 2] | stands[(i + j) // 2]
        out_i.append(i[keep])
        out_j.append(j[keep])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def spikes(t: np.ndarray, v: np.ndarray, held: np.ndarray, hold: float, levels: np.ndarray, spans: np.ndarray, speed: float, times: float = 8.5, standing: float = 3.0) -> np.ndarray:
    """Mask of the values of excursions: runs whose coefficients stand out, all of whose readings lie on one side of the
    path by more than ``times`` x the scatter over such a span and than the usual high speed covers since the neighbours,
    and that return.

    ``t, v`` are successive different values, ``held`` how many readings each stood for, ``hold`` how many they usually
    do; ``levels`` and ``spans`` are scales by level, ``standing`` x those of the levels is what a candidate needs. The
    path has returned if the values around the run differ by less than three quarters of the least distance. Of
    overlapping runs the one farthest off counts, one whose values were held as usual half as much (a wrong reading
    replaces single readings); then the rest is searched again without it, until nothing is found. A run must also lie
    off the median of the few values on either side, so that what lies between two spikes isn't taken for one.
    """
    bad = np.zeros(len(v), bool)
    while True:
        live = np.flatnonzero(~bad)
        tt, vv = t[live], v[live]
        if len(tt) < 3:
            return bad
        i, j = _candidates(tt, vv, levels, standing)
        inside = (i > 0) & (j < len(vv)) & (j > i)
        i, j = i[inside], j[inside]
        if not len(i):
            return bad
        dt = np.diff(tt)
        step = np.median(dt)
        readings = np.r_[0, np.cumsum(held[live])]
        # natural details grow with the time between the neighbours, so that time picks the scale
        span = np.ceil((tt[j] - tt[i - 1]) / max(step, 1e-9) - 1.5)
        level = np.ceil(np.log2(np.clip(np.minimum(span, j - i), 1, None))).astype(np.int64)
        scale = spans[np.minimum(level, len(spans) - 1)]
        need = np.maximum(times * scale, 1.3 * speed * np.minimum(dt[i - 1], dt[j - 1]))
        # the ends and the middle first: few runs need all their values looked at
        ends = np.stack([vv[m] - predict(tt, vv, m, i - 1, j) for m in (i, (i + j - 1) // 2, j - 1)])
        least = np.abs(ends).min(axis=0)
        keep = ((ends > 0).all(axis=0) | (ends < 0).all(axis=0)) & (least > need) & (np.abs(vv[j] - vv[i - 1]) <= 0.75 * least)
        i, j, need = i[keep], j[keep], need[keep]
        found = []
        for a, b, n in zip(i.tolist(), j.tolist(), need.tolist()):
            d = vv[a:b] - predict(tt, vv, np.arange(a, b), np.full(b - a, a - 1), np.full(b - a, b))
            least = np.abs(d).min()
            if not ((d > 0).all() or (d < 0).all()) or least <= n or abs(vv[b] - vv[a - 1]) > 0.75 * least:
                continue
            width, side = b - a, 3 + (b - a) // 2
            around = np.r_[vv[max(0, a - side) : a], vv[b : b + side]]
            if abs(np.median(vv[a:b]) - np.median(around)) > 0.5 * least:
                usual_hold = hold >= 2 and readings[b] - readings[a] >= 0.75 * hold * width
                found.append((least * (0.5 if usual_hold else 1.0), -a, b))
        if not found:
            return bad
        taken = np.zeros(len(vv), bool)
        for _, a, b in sorted(found, reverse=True):
            if not taken[-a - 1 : b + 1].any():  # nor may its neighbours be spikes themselves
                taken[-a:b] = True
        bad[live[taken]] = True


def flag_implausible(positions: DataFrame, times: float = 8.5, stuck_times: float = 5.5, block_s: int = 1800, halo_s: int = 120) -> DataFrame:
    """Implausible values as rows ``row_id, flight, field, reason``; every delivered copy of a value has its own row.

    ``positions`` needs ``row_id, flight, t_us, alt, lat, lon``. ``reason`` is ``bounds``, ``spike`` or ``stuck``. Null
    and NaN values are missing and never flagged. Rows without a time, flight or id are held against the bounds alone. A
    series with fewer than three values has no spikes. Blocks of ``block_s`` see ``halo_s`` beyond their edges: an
    excursion or run that crosses an edge is judged by what lies within that. An empty table gives an empty result.
    """
    p = positions.select("row_id", "flight", "t_us", *[F.col(f).cast("double").alias(f) for f in FIELDS])
    bounds = p.select("row_id", "flight", F.explode(F.filter(F.array(*[F.when(out_of_bounds(f), F.lit(f)) for f in FIELDS]), lambda x: x.isNotNull())).alias("field"), F.lit("bounds").alias("reason"))
    length, halo = block_s * 1_000_000, halo_s * 1_000_000
    block, t = F.floor(F.col("t_us") / length), F.col("t_us")
    near = F.array(block, F.when(t - block * length < halo, block - 1), F.when(t - block * length >= length - halo, block + 1))
    placed = p.where("t_us is not null and flight is not null and row_id is not null").withColumn("block", F.explode(F.filter(near, lambda x: x.isNotNull()))).withColumn("home", F.col("block") == block)
    blocks = placed.groupBy("flight", "block")
    histograms = blocks.applyInArrow(_normal_histograms, "flight string, field int, stat int, bin int, n long")
    # the rows are shuffled once, by flight and block: the normals, few and small, are brought to the blocks
    keys = placed.select(F.col("flight").alias("source"), F.col("block").alias("part")).distinct()
    normals = keys.join(source_normals(histograms).withColumnRenamed("flight", "source"), "source")

    def flag(key: tuple, g: pa.Table, normal: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, str, str]] = []
        if len(normal) and pc.any(g["home"]).as_py():
            hold, levels, spans, speeds = _normals(normal["stats"][0].as_py())
            columns, own = _columns(g), g["home"].to_numpy()
            for k, f in enumerate(FIELDS):
                t, v, rows, place = _series(columns, f)
                if len(t) < 3:
                    continue
                first, length_ = runs(v)
                which = np.repeat(np.arange(len(first)), length_)
                scales = (_scales(x[k], LEAST_SCALE[f]) for x in (levels, spans))
                spike = spikes(t[first], v[first], length_, hold if np.isfinite(hold) else 1.0, *scales, speeds[k], times)[which]
                rest = np.flatnonzero(~spike)
                _, length_ = runs(v[rest])
                stuck = np.zeros(len(v), bool)
                begins = np.zeros(len(rest), bool)
                begins[np.cumsum(length_) - length_] = True
                stuck[rest[np.repeat(length_ > max(6.0, stuck_times * hold), length_) & ~begins]] = True
                for mask, why in ((spike, "spike"), (stuck, "stuck")):
                    hit = rows[mask[place]]  # all delivered copies
                    out.append((columns["row_id"][hit[own[hit]]], f, why))
        size = [len(ids) for ids, _, _ in out]
        repeat = lambda i: pa.array([x[i] for x, m in zip(out, size) for _ in range(m)], pa.string())
        ids = np.concatenate([x[0] for x in out]) if out else np.zeros(0)
        return pa.table({"row_id": pa.array(ids.astype(np.int64)), "flight": pa.array([key[0].as_py()] * sum(size), pa.string()), "field": repeat(1), "reason": repeat(2)})

    flags = blocks.cogroup(normals.groupBy("source", "part")).applyInArrow(flag, "row_id long, flight string, field string, reason string")
    return bounds.unionByName(flags)
