"""Irregular readings onto a regular grid, gaps filled by low-rank factorisation.

Each flight's sources form matrices: a row per channel of a source and lag of a few slots, a column per slot of time.
Missing cells are filled from a low-rank factorisation fitted by alternating least squares to the observed cells; the
lagged rows let it carry a source's motion across a gap, where other sources alone say little. Observed cells are given
back unchanged; a cell with no reading of its own source within the lags, or too few readings in all, stays marked.

Scale: payloads are decoded and reduced to one reading a slot inside each Arrow batch, then by Spark's own partial
aggregation, before anything is shuffled by time. A matrix covers one flight over ``window`` slots (plus the halo that
the longest gap needs), so neither a task nor a matrix grows with the length or the share of a flight: a flight with a
third of all rows is simply many windows. Local windows also fit the slowly changing motion better than one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions.cdr import imu_vectors, pose_vectors

SLOT_NS = 500_000_000
MAX_GAP_NS = 10_000_000_000


def als_complete(x: np.ndarray, rank: int = 4, ridge: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Complete a matrix (rows: channels, columns: slots; NaN: missing).

    Returns the completed matrix and a mask of supported cells. Observed cells are exactly those of ``x``. A missing
    cell is supported if its column holds an observed cell and its row more than ``rank`` of them; all others stay NaN.
    """
    seen = np.isfinite(x)
    per_row = seen.sum(axis=1)
    support = seen | ((per_row > rank)[:, None] & seen.any(axis=0)[None, :])
    out = np.where(seen, x, np.nan)
    if not (support & ~seen).any():
        return out, support
    count = np.maximum(per_row, 1)[:, None]
    mean = np.where(seen, x, 0).sum(axis=1, keepdims=True) / count
    scale = np.sqrt((np.where(seen, x - mean, 0.0) ** 2).sum(axis=1, keepdims=True) / count)
    scale[scale < 1e-9] = 1.0
    m, z = seen.astype(float), np.where(seen, (x - mean) / scale, 0.0)
    r = min(rank, x.shape[0])
    eye = ridge * np.eye(r)

    def solve(mask: np.ndarray, basis: np.ndarray, target: np.ndarray) -> np.ndarray:
        """All least-squares problems of one side at once: row ``k`` uses the basis rows where ``mask[k]`` is set."""
        squares = (basis[:, :, None] * basis[:, None, :]).reshape(len(basis), -1)
        return np.linalg.solve((mask @ squares).reshape(-1, r, r) + eye, target[..., None])[..., 0]

    u = np.cos(np.outer(np.arange(1, x.shape[0] + 1), np.arange(1, r + 1)))  # a fixed start: the result is repeatable
    v = solve(m.T, u, z.T @ u)
    for _ in range(rounds):
        last, u = u, solve(m, v, z @ v)
        v = solve(m.T, u, z.T @ u)
        if np.abs(u - last).max() < 1e-6:
            break
    fit = mean + scale * (u @ v.T)
    out[support & ~seen] = fit[support & ~seen]
    return out, support


def complete_series(x: np.ndarray, lags: int = 4, rank: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Complete several sources' series, shape (sources, channels, slots), through lagged copies of their rows.

    Returns the completed series and a mask of supported cells: observed, or with a reading of the same source within
    ``lags`` slots and enough readings in all to fit the rank.
    """
    sources, channels, slots = x.shape
    used = np.isfinite(x).any(axis=2).ravel()
    rows = x.reshape(-1, slots)[used]
    lagged = np.full((2 * lags + 1, *rows.shape), np.nan)
    for k, lag in enumerate(range(-lags, lags + 1)):
        lagged[k, :, max(0, lag) : slots + min(0, lag)] = rows[:, max(0, -lag) : slots + min(0, -lag)]
    done, support = als_complete(lagged.reshape(-1, slots), rank)
    done, support = (a.reshape(lagged.shape)[lags] for a in (done, support))
    own = np.isfinite(x).any(axis=1)
    near = np.array([np.convolve(o, np.ones(2 * lags + 1), "same") > 0 for o in own]).repeat(channels, axis=0)[used]
    out, good = np.full_like(x, np.nan).reshape(-1, slots), np.zeros((sources * channels, slots), bool)
    out[used], good[used] = np.where(support & near, done, np.nan), support & near
    return out.reshape(x.shape), good.reshape(x.shape)


def _first_of_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decode payloads; per batch keep a slot's first usable reading and its last time (a map-side combine)."""
    for b in batches:
        kind = b.column("kind").to_numpy(zero_copy_only=False)
        values, ok = np.full((b.num_rows, 6), np.nan), np.zeros(b.num_rows, bool)
        for code, read in ((0, imu_vectors), (1, pose_vectors)):
            if (at := np.flatnonzero(kind == code)).size:
                v, good = read(b.column("data").take(pa.array(at)))
                values[at, : min(6, 3 + 3 * (code == 0))] = v[:, : 3 + 3 * (code == 0)]
                ok[at] = good
        at = np.flatnonzero(ok)
        if not at.size:
            continue
        b = b.take(pa.array(at))
        flight = b.column("flight").dictionary_encode()
        code, topic, ts, msg = flight.indices.to_numpy(), b.column("topic_id").to_numpy(), b.column("timestamp").to_numpy(), b.column("msg_id").to_numpy()
        slot = ts // SLOT_NS
        order = np.lexsort((msg, ts, slot, topic, code))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(code[order]) != 0) | (np.diff(topic[order]) != 0) | (np.diff(slot[order]) != 0)
        first = np.flatnonzero(new)
        keep = order[first]
        vals = pa.ListArray.from_arrays(pa.array(np.arange(0, 6 * len(keep) + 1, 6, dtype=np.int32)), pa.array(values[at][keep].ravel()))
        yield pa.RecordBatch.from_arrays(
            [b.column("flight").take(pa.array(keep)), pa.array(topic[keep]), pa.array(kind[at][keep].astype(np.int32)), pa.array(slot[keep]), pa.array(ts[keep]), pa.array(msg[keep]), pa.array(np.maximum.reduceat(ts[order], first)), vals],
            names=["flight", "topic_id", "kind", "slot", "first_ts", "msg_id", "last_ts", "vals"],
        )


def _decode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads as what either kind of message would hold: ``imu`` and ``pose``, null where it can't be that kind."""
    for b in batches:
        columns, seen = [], np.zeros(b.num_rows, bool)
        for read, width in ((imu_vectors, 6), (pose_vectors, 3)):
            v, ok = read(b.column("data"))
            v = np.where(ok[:, None], v[:, :width], 0.0)
            seen |= ok
            size = np.r_[0, np.cumsum(np.where(ok, width, 0))].astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(size), pa.array(v[ok].ravel()), mask=pa.array(~ok)))
        at = pa.array(np.flatnonzero(seen))
        names = ["flight", "topic_id", "timestamp", "msg_id"]
        yield pa.RecordBatch.from_arrays([x.take(at) for x in (*(b.column(c) for c in names), *columns)], names=[*names, "imu", "pose"])


def slot_readings(messages: DataFrame, topics: DataFrame, most_sources: int = 100_000) -> DataFrame:
    """One row per source and slot with a usable reading: the slot's first reading, its time, and the slot's last time.

    ``messages`` needs ``msg_id, flight, topic_id, timestamp, data``; other columns are ignored. Rows with a null
    flight or topic, a time that is null or 0, or an unusable payload are left out; a null id comes last among equals.
    Up to ``most_sources`` sources are sent to the messages and only theirs decoded; were there more, all payloads would
    be shuffled to meet them, so then all are decoded first, and the few numbers are shuffled.
    """
    kind = F.when(F.col("name").endswith("/imu0"), 0).when(F.col("name").endswith("/local_position/pose"), 1)
    sources = topics.select("flight", F.col("id").alias("topic_id"), kind.alias("kind")).where("kind is not null").dropDuplicates(["flight", "topic_id"])
    rows = messages.select(F.coalesce("msg_id", F.lit(2**63 - 1)).alias("msg_id"), "flight", "topic_id", "timestamp", "data").where("timestamp is not null and timestamp <> 0 and data is not null")
    best = F.min(F.struct("first_ts", "msg_id", "vals"))
    if sources.limit(most_sources + 1).count() <= most_sources:
        decoded = rows.join(F.broadcast(sources), ["flight", "topic_id"]).select("flight", "topic_id", "kind", "timestamp", "msg_id", "data")
        cells = decoded.mapInArrow(_first_of_slot, "flight string, topic_id int, kind int, slot long, first_ts long, msg_id long, last_ts long, vals array<double>")
    else:
        both = rows.mapInArrow(_decode_all, "flight string, topic_id int, timestamp long, msg_id long, imu array<double>, pose array<double>")
        vals = F.when(F.col("kind") == 0, F.col("imu")).otherwise(F.concat("pose", F.array(*[F.lit(float("nan"))] * 3)))
        cells = both.join(sources, ["flight", "topic_id"]).withColumn("vals", vals).where("vals is not null")
        cells = cells.select("flight", "topic_id", "kind", F.floor(F.col("timestamp") / SLOT_NS).alias("slot"), F.col("timestamp").alias("first_ts"), "msg_id", F.col("timestamp").alias("last_ts"), "vals")
    return cells.groupBy("flight", "topic_id", "kind", "slot").agg(best.alias("b"), F.max("last_ts").alias("last_ts")).select("flight", "topic_id", "kind", "slot", "b.first_ts", "last_ts", "b.vals")


def regular_series(messages: DataFrame, topics: DataFrame, window: int = 512, rank: int = 4, lags: int = 4) -> DataFrame:
    """The regular half-second series of every source: ``flight, topic_id, slot, status, vals``.

    ``status`` is ``observed`` (``vals`` is the slot's first usable reading, exactly), ``filled`` (from the
    factorisation) or ``unsupported`` (no basis to fill from: ``vals`` is null). IMU values are gyro and accel, pose
    values x, y, z. A silence longer than 10 s is a stop of the recorder: the series ends there and starts anew. Empty
    tables give an empty result; repeated deliveries count once.
    """
    return fill_cells(slot_readings(messages, topics), window, rank, lags)


def fill_cells(cells: DataFrame, window: int = 512, rank: int = 4, lags: int = 4) -> DataFrame:
    """The series of ``slot_readings``; see ``regular_series``."""
    halo = MAX_GAP_NS // SLOT_NS + 1
    bucket = F.floor(F.col("slot") / window)
    at = F.col("slot") - bucket * window
    near = F.array(bucket, F.when(at < halo, bucket - 1), F.when(at >= window - lags, bucket + 1))
    placed = cells.withColumn("bucket", F.explode(F.filter(near, lambda b: b.isNotNull())))

    def fill(key: tuple, g: pa.Table) -> pa.Table:
        start = int(key[1].as_py()) * window
        g = g.sort_by([("topic_id", "ascending"), ("slot", "ascending")]).combine_chunks()
        topic, slot = g["topic_id"].to_numpy(), g["slot"].to_numpy() - start
        kind, vals = g["kind"].to_numpy(), g["vals"].combine_chunks().flatten().to_numpy().reshape(-1, 6)
        sources, row = np.unique(topic, return_inverse=True)
        first, last = g["first_ts"].to_numpy(), g["last_ts"].to_numpy()
        same = np.zeros(len(g), bool)
        same[:-1] = (topic[1:] == topic[:-1]) & (first[1:] - last[:-1] <= MAX_GAP_NS)
        own = (slot >= 0) & (slot < window)
        gap = np.where(same & own, np.r_[slot[1:], 0] - slot - 1, 0).clip(min=0)
        at = np.repeat(np.arange(len(g)), gap)
        inside = slot[at] + 1 + np.arange(len(at)) - np.repeat(np.cumsum(gap) - gap, gap)
        width = np.where(kind == 0, 6, 3)
        wide, whole = np.full((len(at), 6), np.nan), np.zeros(len(at), bool)
        if len(at):
            x = np.full((len(sources), 6, lags + window + halo), np.nan)
            x[row, :, slot + lags] = vals
            done, good = complete_series(x, lags, rank)
            wide = done[row[at], :, inside + lags]
            whole = (good[row[at], :, inside + lags] | (np.arange(6) >= width[at][:, None])).all(axis=1)
        seen = int(own.sum())
        wide = np.concatenate([vals[own], wide])
        keep = np.where(np.r_[np.ones(seen, bool), whole], np.r_[width[own], width[at]], 0)
        flat = pa.array(wide[np.arange(6) < keep[:, None]])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep)].astype(np.int32)), flat, mask=pa.array(keep == 0))
        status = np.r_[np.zeros(seen, np.int8), np.where(whole, 1, 2).astype(np.int8)]
        named = pa.DictionaryArray.from_arrays(pa.array(status), pa.array(["observed", "filled", "unsupported"])).cast(pa.string())
        return pa.table(
            {
                "flight": pa.array([key[0].as_py()] * len(keep), pa.string()),
                "topic_id": pa.array(sources[np.r_[row[own], row[at]]].astype(np.int32)),
                "slot": pa.array((np.r_[slot[own], inside] + start).astype(np.int64)),
                "status": named,
                "vals": lists,
            }
        )

    return placed.groupBy("flight", "bucket").applyInArrow(fill, "flight string, topic_id int, slot long, status string, vals array<double>")


def missing_slots(series: DataFrame) -> DataFrame:
    """The slots of a regular series that held no usable reading."""
    return series.where("status <> 'observed'").select("flight", "topic_id", "slot")


def fill_errors(cells: DataFrame, every: int = 15) -> DataFrame:
    """How well the factorisation fills: ``kind, hidden, filled, error, mean_error``.

    One reading in ``every``, drawn by hash, is hidden and filled; ``error`` is the root mean square of the difference in
    standard deviations of its source's channel, ``mean_error`` that of putting the channel's mean there instead.
    """
    hide = F.pmod(F.xxhash64("flight", "topic_id", "slot"), F.lit(every)) == 0
    key = ["flight", "topic_id"]
    values = cells.select(*key, "kind", "slot", F.posexplode("vals").alias("channel", "x")).where("not isnan(x)")
    usual = values.where(~hide).groupBy(*key, "channel").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    hidden = values.where(hide)
    filled = fill_cells(cells.where(~hide)).where("status = 'filled'").select(*key, "slot", F.posexplode("vals").alias("channel", "y"))
    j = hidden.join(usual.where("s > 0"), [*key, "channel"]).join(filled, [*key, "slot", "channel"], "left")
    rms = lambda c: F.sqrt(F.avg(F.when(F.col("y").isNotNull(), ((F.col("x") - F.col(c)) / F.col("s")) ** 2)))
    return j.groupBy(F.when(F.col("kind") == 0, "imu").otherwise("pose").alias("kind")).agg(F.count("*").alias("hidden"), F.count("y").alias("filled"), rms("y").alias("error"), rms("m").alias("mean_error"))
