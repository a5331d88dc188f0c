"""Operators on ordered sequences per key.

What needs only neighbours or running sums is done in buckets of time: windows run inside (key, bucket), and one row
per bucket carries what crosses the edges, so a key with a third of all rows is many bounded windows. What depends on
its own last output is a fold over rows sorted within partitions, in an iterator that keeps one state per key in hand.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEK_S = 604800.0
#: Estimated bytes of input from which it is worth a pass over keys and times to measure how dense they are.
LARGE = 1 << 30


def bucket_width(df: DataFrame, keys: list[str], t: str = "t", rows: int = 50_000, large: int = LARGE) -> float:
    """How much time a bucket may cover so that it holds about ``rows`` rows of the densest key: its rate tells.

    Only times and keys are read, reduced to one number. Keys of fewer rows are no reason to divide. Inputs that Spark
    estimates below ``large`` bytes aren't measured: there a week does. The width never changes a result.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < large:
        return WEEK_S
    c = F.col(t).cast("double")
    per = df.where(c.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), (F.max(c) - F.min(c)).alias("span"))
    rate = per.agg(F.max(F.when((F.col("n") > rows) & (F.col("span") > 0), F.col("n") / F.col("span")))).first()[0]
    return rows / rate if rate else float(1 << 62)


def neighbours(df: DataFrame, keys: list[str], columns: list[str], order: tuple[str, ...] = ("t",), width: float | None = None) -> DataFrame:
    """Rows with ``before`` and ``after``: structs of ``columns`` of the rows next to them, null at the ends.

    Columns of those names are replaced.
    """
    df = df.drop("before", "after")
    width = width or bucket_width(df, keys, order[0])
    b = df.withColumn("_b", F.floor(F.col(order[0]) / width)).withColumn("_s", F.struct(*columns))
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    rows = b.withColumn("_p", F.lag("_s").over(w)).withColumn("_n", F.lead("_s").over(w))
    place = F.struct(*order)
    edges = b.groupBy(*keys, "_b").agg(F.min_by("_s", place).alias("_first"), F.max_by("_s", place).alias("_last"))
    e = Window.partitionBy(*keys).orderBy("_b")
    carried = edges.select(*keys, "_b", F.lag("_last").over(e).alias("_cp"), F.lead("_first").over(e).alias("_cn"))
    return rows.join(carried, [*keys, "_b"]).select(*df.columns, F.coalesce("_p", "_cp").alias("before"), F.coalesce("_n", "_cn").alias("after"))


def _running(df: DataFrame, keys: list[str], value: Column, name: str, order: tuple[str, ...], width: float | None, combine: Callable[[Column | str], Column], add: Callable[[Column, Column], Column]) -> DataFrame:
    width = width or bucket_width(df, keys, order[0])
    b = df.withColumn("_b", F.floor(F.col(order[0]) / width)).withColumn("_v", value)
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy(*keys, "_b").agg(combine("_v").alias("_t")).withColumn("_c", combine("_t").over(e)).drop("_t")
    return b.withColumn("_r", combine("_v").over(w)).join(totals, [*keys, "_b"]).select(*df.columns, add(F.col("_r"), F.col("_c")).alias(name))


def running_sum(df: DataFrame, keys: list[str], value: str, name: str, order: tuple[str, ...] = ("t",), width: float | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to and with each row; nulls count as nothing."""
    return _running(df, keys, F.coalesce(F.col(value), F.lit(0)), name, order, width, F.sum, lambda r, c: r + F.coalesce(c, F.lit(0)))


def running_max(df: DataFrame, keys: list[str], value: str, name: str, order: tuple[str, ...] = ("t",), width: float | None = None) -> DataFrame:
    """Adds ``name``: the largest ``value`` up to and with each row."""
    return _running(df, keys, F.col(value), name, order, width, F.max, lambda r, c: F.greatest(r, c))


def index_in_order(df: DataFrame, keys: list[str], name: str = "k", order: tuple[str, ...] = ("t", "event_id"), width: float | None = None) -> DataFrame:
    """Adds ``name``: the row's place in its key's order, from 0."""
    return _running(df, keys, F.lit(1), name, order, width, F.sum, lambda r, c: (r + F.coalesce(c, F.lit(0)) - 1).cast("int"))


def rolling(df: DataFrame, keys: list[str], reach: float, columns: dict[str, Callable[[Window], Column]], on: str = "t", width: float | None = None) -> DataFrame:
    """Adds columns computed over the rows of the last ``reach`` units of ``on`` (this one counted).

    Rows are placed in buckets, those near a bucket's end also in the next, so the window of a long key is many small
    ones. ``columns`` maps a name to a function from the window to its expression.
    """
    width = width or 20 * reach
    at = F.floor(F.col(on) / width)
    spread = F.filter(F.array(at, F.when(F.col(on) >= (at + 1) * width - reach, at + 1)), lambda b: b.isNotNull())
    placed = df.withColumn("_home", at).withColumn("_b", F.explode(spread))
    fine = F.round(F.col(on) * 1e6).cast("long")
    w = Window.partitionBy(*keys, "_b").orderBy(fine).rangeBetween(-round(reach * 1e6), 0)
    out = placed.select("*", *[f(w).alias(n) for n, f in columns.items()])
    return out.where("_b = _home").drop("_b", "_home")


def gradient(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Adds ``gradient``: second-order differences on uneven times, one-sided at the ends, null for a single row."""
    n = neighbours(df, keys, ["t", value])
    y, t, p, q = F.col(value), F.col("t"), F.col("before"), F.col("after")
    hs, hd = t - p["t"], q["t"] - t
    inner = (hs * hs * q[value] + (hd * hd - hs * hs) * y - hd * hd * p[value]) / (hs * hd * (hd + hs))
    return n.withColumn("gradient", F.when(p.isNull() & q.isNull(), None).when(p.isNull(), (q[value] - y) / hd).when(q.isNull(), (y - p[value]) / hs).otherwise(inner)).drop("before", "after")


def unwrap(df: DataFrame, keys: list[str], value: str = "value", width: float | None = None) -> DataFrame:
    """Adds ``unwrapped``: the angle with jumps of more than half a turn taken out."""
    width = width or bucket_width(df, keys)
    n = neighbours(df, keys, ["t", value], width=width)
    d = F.col(value) - F.col("before")[value]
    # whole turns to add at each row, as whole numbers so that the running sum is exact
    turns = -F.ceil((d - math.pi) / (2 * math.pi))
    n = n.withColumn("_k", F.coalesce(turns, F.lit(0)).cast("long")).drop("before", "after")
    return running_sum(n, keys, "_k", "_turns", width=width).withColumn("unwrapped", F.col(value) + 2 * math.pi * F.col("_turns")).drop("_k", "_turns")


def trapezoid(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Integral over time per key: ``integral``, zero for a single row."""
    n = neighbours(df, keys, ["t", value])
    area = (F.col("t") - F.col("before.t")) * (F.col(value) + F.col("before")[value]) / 2
    return n.groupBy(*keys).agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("integral"))


def gap_sessions(df: DataFrame, keys: list[str], gap: float, width: float | None = None) -> DataFrame:
    """Adds ``session``: numbered from 0, a new one after every gap longer than ``gap``."""
    width = width or bucket_width(df, keys)
    n = neighbours(df, keys, ["t"], width=width).withColumn("_new", F.when(F.col("t") - F.col("before.t") > gap, 1).otherwise(0)).drop("before", "after")
    return running_sum(n, keys, "_new", "session", width=width).drop("_new")


def islands(df: DataFrame, keys: list[str], flag: str, width: float | None = None) -> DataFrame:
    """Adds ``island``: runs of equal ``flag`` are numbered."""
    width = width or bucket_width(df, keys)
    n = neighbours(df, keys, ["t", flag], width=width).withColumn("_new", F.when(F.col("before").isNull() | F.col("before")[flag].eqNullSafe(F.col(flag)), 0).otherwise(1)).drop("before", "after")
    return running_sum(n, keys, "_new", "island", width=width).drop("_new")


def persistence(df: DataFrame, keys: list[str], flag: str, hold: float) -> DataFrame:
    """Adds ``elapsed`` since the condition began (null while it doesn't hold) and ``breach``: it has held longer than ``hold``."""
    i = islands(df, keys, flag)
    starts = i.where(F.col(flag)).groupBy(*keys, "island").agg(F.min("t").alias("_t0"))
    out = i.join(starts, [*keys, "island"], "left").withColumn("elapsed", F.when(F.col(flag), F.col("t") - F.col("_t0")))
    return out.withColumn("breach", F.coalesce(F.col("elapsed") > hold, F.lit(False))).drop("_t0", "island")


def streaks(df: DataFrame, keys: list[str], flag: str, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """Adds ``streak``: how many rows in a row the flag has been set, this one counted."""
    width = bucket_width(df, keys)
    i = index_in_order(islands(df, keys, flag, width), keys, "_k", order, width)
    starts = i.where(F.col(flag)).groupBy(*keys, "island").agg(F.min("_k").alias("_k0"))
    out = i.join(starts, [*keys, "island"], "left")
    return out.withColumn("streak", F.when(F.col(flag), F.col("_k") - F.col("_k0") + 1).otherwise(0).cast("int")).drop("island", "_k", "_k0")


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]], schema: str) -> DataFrame:
    """Fold each key's rows in order: ``step(state, rows) -> (state, output rows)`` is called with successive batches.

    Rows are repartitioned by key and sorted within partitions; only one batch and one state are held at a time, so a
    long sequence takes time but no memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple | None = None
        state = None
        for b in batches:
            if b.empty:
                continue
            k = b[keys]
            new = (k.ne(k.shift()) & ~(k.isna() & k.shift().isna())).any(axis=1).to_numpy()
            new[0] = True
            cuts = [*np.flatnonzero(new), len(b)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = b.iloc[lo:hi]
                key = tuple(None if pd.isna(x) else x for x in part[keys].iloc[0])
                if key != at:
                    at, state = key, start()
                state, out = step(state, part)
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _smooth(x: np.ndarray, last: float | None, alpha: float, block: int = 128) -> np.ndarray:
    """y[n] = (1 - alpha) y[n-1] + alpha x[n], by blocks; the first value stands for itself."""
    out = np.empty(len(x))
    decay = (1 - alpha) ** np.arange(block + 1)
    lower = np.tril(alpha * (1 - alpha) ** np.clip(np.subtract.outer(np.arange(block), np.arange(block)), 0, None))
    i = 0
    if last is None and len(x):
        out[0] = last = x[0]
        i = 1
    while i < len(x):
        n = min(block, len(x) - i)
        out[i : i + n] = lower[:n, :n] @ x[i : i + n] + decay[1 : n + 1] * last
        last = out[i + n - 1]
        i += n
    return out


def ema(df: DataFrame, keys: list[str], alpha: float, order: tuple[str, ...] = ("t", "event_id"), width: float | None = None) -> DataFrame:
    """Adds ``ema`` of ``value``: seeded with the first value. Null values are left out.

    A step is an affine map of the last output, and so is a whole bucket of them: buckets of time are smoothed side by
    side as if nothing came before, one row a bucket carries what does, and it is added with its decay. ``width`` is a
    bucket's; where nothing is said a small input is one fold a key, a large one is divided by the densest key's rate.
    """
    rows = df.where("value is not null")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", ema double"
    given, width = width is not None, width or bucket_width(df, keys, order[0])

    def step(last: float | None, b: pd.DataFrame) -> tuple[float, pd.DataFrame]:
        y = _smooth(b["value"].to_numpy(float), last, alpha)
        return float(y[-1]), b.assign(ema=y)

    if not given and width in (WEEK_S, float(1 << 62)):  # no key is worth dividing
        return ordered_fold(rows, keys, list(order), lambda: None, step, schema)

    def own(state: tuple[float, int], b: pd.DataFrame) -> tuple[tuple[float, int], pd.DataFrame]:
        y = _smooth(b["value"].to_numpy(float), state[0], alpha)
        return (float(y[-1]), state[1] + len(b)), b.assign(_y=y, _n=np.arange(state[1] + 1, state[1] + len(b) + 1))

    def carry(last: float | None, b: pd.DataFrame) -> tuple[float, pd.DataFrame]:
        before = np.empty(len(b))
        for k, (y, n, x) in enumerate(zip(b["_last"].to_numpy(float), b["_size"].to_numpy(float), b["_first"].to_numpy(float))):
            before[k] = x if last is None else last  # the first value of all stands for itself
            last = y + (1 - alpha) ** n * before[k]
        return last, b[[*keys, "_b"]].assign(_before=before)

    types = dict(df.dtypes)
    key = ", ".join(f"`{k}` {types[k]}" for k in keys)
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    apart = ordered_fold(rows.withColumn("_b", F.floor(F.col(order[0]) / width)), [*keys, "_b"], list(order), lambda: (0.0, 0), own, f"{base}, _b long, _y double, _n long")
    ends = apart.groupBy(*keys, "_b").agg(F.max_by("_y", "_n").alias("_last"), F.max("_n").alias("_size"), F.min_by("value", "_n").alias("_first"))
    starts = ordered_fold(ends, keys, ["_b"], lambda: None, carry, f"{key}, _b long, _before double")
    out = apart.join(starts, [*keys, "_b"])
    return out.select(*df.columns, (F.col("_y") + F.pow(F.lit(1 - alpha), F.col("_n")) * F.col("_before")).alias("ema"))


def lowpass_wrap(df: DataFrame, keys: list[str], alpha: float, order: tuple[str, ...] = ("t", "event_id")) -> DataFrame:
    """Adds ``low``: a low pass of the angle ``value`` that takes the short way round; it starts from 0."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", low double"

    def step(p: float, rows: pd.DataFrame) -> tuple[float, pd.DataFrame]:
        out = np.empty(len(rows))
        for i, v in enumerate(rows["value"].to_numpy(float)):
            turn = (v - p + math.pi) % (2 * math.pi) - math.pi
            p = p + (1 - alpha) * turn
            out[i] = p
        return p, rows.assign(low=out)

    return ordered_fold(df.where("value is not null"), keys, list(order), lambda: 0.0, step, schema)


def teleport_gate(df: DataFrame, keys: list[str], rate: float, slack: float, position: tuple[str, ...] = ("value",), order: tuple[str, ...] = ("t",)) -> DataFrame:
    """Adds ``delivered``: false where the position is further than ``rate`` x time + ``slack`` from the last delivered one.

    Whatever jumps is withheld until it lies inside that bound, which grows with the time since the last delivery, or
    until a row's ``allowed`` is true: the next position is then let through once, however far. ``df`` needs ``t``, the
    columns of ``position`` and may have ``allowed``. Rows without time or position are left out.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", delivered boolean"

    def step(state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        out = np.ones(len(rows), bool)
        at = rows[list(position)].to_numpy(float)
        free = rows["allowed"].fillna(False).to_numpy(bool) if "allowed" in rows else np.zeros(len(rows), bool)
        for i, (t, v) in enumerate(zip(rows["t"].to_numpy(float), at)):
            state["free"] = state.get("free", False) or free[i]
            if "v" in state and not state["free"] and np.sqrt(((v - state["v"]) ** 2).sum()) > rate * max(1e-3, t - state["t"]) + slack:
                out[i] = False
            else:
                state.update(t=t, v=v, free=False)
        return state, rows.assign(delivered=out)

    known = " and ".join(f"{c} is not null" for c in ("t", *position))
    return ordered_fold(df.where(known), keys, list(order), dict, step, schema)


def gravity_filter(df: DataFrame, keys: list[str], gain: float = 0.02, mount: np.ndarray | None = None, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """Adds ``roll`` and ``pitch`` (radians) of the camera from turn rates and specific force alone.

    The direction of gravity in the body's frame is turned by the rates over the time since the last sample (0 to 0.05 s),
    then drawn by ``gain`` towards the opposite of the measured force. ``df`` needs ``t``, ``gx, gy, gz`` and ``ax, ay,
    az``; ``mount`` turns body vectors into the camera's frame. Samples before the first force that isn't zero have null
    angles; one with a null or NaN component is left out. Keys are folded one after another in sorted partitions.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", roll double, pitch double"
    m = np.eye(3) if mount is None else np.asarray(mount, float)
    names = ["gx", "gy", "gz", "ax", "ay", "az"]

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple | None, pd.DataFrame]:
        g_out = np.full((len(rows), 3), np.nan)
        for i, (t, wx, wy, wz, ax, ay, az) in enumerate(zip(rows["t"].to_numpy(float).tolist(), *(rows[c].to_numpy(float).tolist() for c in names))):
            force = (ax * ax + ay * ay + az * az) ** 0.5
            if state is None:
                if force < 1e-6:
                    continue
                state = (t, -ax / force, -ay / force, -az / force)
            else:
                last, x, y, z = state
                dt = min(max(t - last, 0.0), 0.05)
                wx, wy, wz = -wx * dt, -wy * dt, -wz * dt
                angle = (wx * wx + wy * wy + wz * wz) ** 0.5
                if angle > 1e-12:  # about the axis: the part along it stays, the rest turns
                    ux, uy, uz = wx / angle, wy / angle, wz / angle
                    c, s = np.cos(angle), np.sin(angle)
                    along = (ux * x + uy * y + uz * z) * (1 - c)
                    x, y, z = x * c + (uy * z - uz * y) * s + ux * along, y * c + (uz * x - ux * z) * s + uy * along, z * c + (ux * y - uy * x) * s + uz * along
                if force > 1e-6:
                    x, y, z = ((1 - gain) * v - gain * a / force for v, a in ((x, ax), (y, ay), (z, az)))
                    n = (x * x + y * y + z * z) ** 0.5
                    x, y, z = x / n, y / n, z / n
                state = (t, x, y, z)
            g_out[i] = state[1:]
        c = g_out @ m.T
        return state, rows.assign(roll=np.arctan2(c[:, 1], c[:, 2]), pitch=-np.arcsin(np.clip(c[:, 0], -1, 1)))

    known = " and ".join(f"{c} is not null and not isnan({c})" for c in ("t", *names))
    return ordered_fold(df.where(known), keys, list(order), lambda: None, step, schema)


def anchored_velocity(df: DataFrame, keys: list[str], low: float, high: float, most: float) -> DataFrame:
    """Adds ``velocity`` from an anchor that slides when its baseline lies in [low, high] and is set anew beyond it."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", velocity double"

    def step(a: tuple | None, rows: pd.DataFrame) -> tuple[tuple | None, pd.DataFrame]:
        out = np.full(len(rows), np.nan)
        for i, (t, v) in enumerate(zip(rows["t"].to_numpy(float), rows["value"].to_numpy(float))):
            if a is None or t - a[0] > high:
                a = (t, v)
            elif t - a[0] >= low:
                rate = (v - a[1]) / (t - a[0])
                if abs(rate) <= most:
                    out[i] = rate
                    a = (t, v)
        return a, rows.assign(velocity=out)

    return ordered_fold(df.where("value is not null"), keys, ["t", "event_id"], lambda: None, step, schema)


def lag_correlation(a: DataFrame, b: DataFrame, lags: range, keys: list[str]) -> DataFrame:
    """Pearson correlation of the binned series ``bin, value`` at each lag of the second: ``keys, lag, n, corr``.

    The lags are a short fixed list: each row of ``b`` is given once per lag and met by an equi-join on the bin.
    """
    moved = b.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags]))).select(*keys, (F.col("bin") - F.col("lag")).alias("bin"), "lag", F.col("value").alias("_v"))
    return a.join(moved, [*keys, "bin"]).groupBy(*keys, "lag").agg(F.count("*").alias("n"), F.corr("value", "_v").alias("corr"))


def best_lag(scan: DataFrame, keys: list[str], absolute: bool, least_n: int, step: float = 1.0) -> DataFrame:
    """The lag of the largest (absolute) correlation, refined by a parabola through its neighbours: ``lag, corr, refined``."""
    s = scan.where((F.col("n") >= least_n) & F.col("corr").isNotNull() & ~F.isnan("corr"))
    w = Window.partitionBy(*keys).orderBy("lag")
    near = s.withColumn("_l", F.lag("corr").over(w)).withColumn("_r", F.lead("corr").over(w))
    rank = F.abs("corr") if absolute else F.col("corr")
    best = near.groupBy(*keys).agg(F.max_by(F.struct("lag", "corr", "_l", "_r"), F.struct(rank, -F.col("lag"))).alias("m")).select(*keys, "m.*")
    bend = F.col("_l") - 2 * F.col("corr") + F.col("_r")
    shift = F.when(bend != 0, 0.5 * (F.col("_l") - F.col("_r")) / bend).otherwise(0.0)
    return best.select(*keys, "lag", "corr", ((F.col("lag") + F.coalesce(shift, F.lit(0.0))) * step).alias("refined"))


def hash_normal(u1: Column, u2: Column) -> Column:
    """A normal number from two uniform ones (the first not zero)."""
    return F.sqrt(-2 * F.ln(F.greatest(u1, F.lit(1e-12)))) * F.cos(2 * math.pi * u2)
