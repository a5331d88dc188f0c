"""Pairing records of two tables by nearest time per entity.

Both tables are put into one stream of rows keyed by entity and bucket of time, repartitioned by that key and sorted
within the partitions; a merge iterator then walks each partition once, keeping for every left row only the right rows
next to it. Right rows within the tolerance of a bucket's edge are also given to the neighbouring bucket, so an entity
with a third of all rows is many buckets spread over many tasks, and no task holds more than one batch plus the left
rows still within the tolerance of the last time seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = "left_id long, right_id long, gap long"


def _merge(tolerance: int):
    """The iterator over sorted batches; between batches it keeps only what lies within twice the tolerance of the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pd.DataFrame | None = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = b.to_pandas() if kept is None else pd.concat([kept, b.to_pandas()], ignore_index=True)
            group = (rows["entity"].ne(rows["entity"].shift()) | rows["bucket"].ne(rows["bucket"].shift())).cumsum().to_numpy()
            t = rows["t"].to_numpy()
            # what is before this time, or in a bucket that is over, has met every right row that could be its nearest
            open_ = (group == group[-1]) & (t >= t[-1] - tolerance)
            yield from _pairs(rows, group, ~open_, tolerance)
            kept = rows[open_ | ((group == group[-1]) & (t >= t[-1] - 2 * tolerance) & rows["right"].to_numpy())]
        if kept is not None and len(kept):
            yield from _pairs(kept, np.zeros(len(kept), np.int64), np.ones(len(kept), bool), tolerance)

    return run


def _pairs(rows: pd.DataFrame, group: np.ndarray, settled: np.ndarray, tolerance: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the settled left rows; rows are sorted by entity, bucket, time, right rows first, topic and id."""
    n, t, right, topic = len(rows), rows["t"].to_numpy(), rows["right"].to_numpy(), rows["topic"].to_numpy()
    again = np.zeros(n, bool)  # a left row of a topic that has had this time, a right row of a time that is taken
    again[1:] = (group[1:] == group[:-1]) & (t[1:] == t[:-1]) & (right[1:] == right[:-1]) & (right[1:] | (topic[1:] == topic[:-1]))
    at, target = np.arange(n), right & ~again
    before = np.maximum.accumulate(np.where(target, at, -1))
    after = np.minimum.accumulate(np.where(target, at, n)[::-1])[::-1]
    left = np.flatnonzero(~right & ~again & settled)
    a, z = before[left], after[left]
    far = np.iinfo(np.int64).max
    gap_a = np.where((a >= 0) & (group[a] == group[left]), t[left] - t[a], far)
    z_in = np.minimum(z, n - 1)
    gap_z = np.where((z < n) & (group[z_in] == group[left]), t[z_in] - t[left], far)
    pick, gap = np.where(gap_a <= gap_z, a, z_in), np.minimum(gap_a, gap_z)
    good = gap <= tolerance
    if good.any():
        ids = rows["id"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids[left[good]]), pa.array(ids[pick[good]]), pa.array(gap[good])], names=["left_id", "right_id", "gap"])


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: int, bucket: int | None = None) -> DataFrame:
    """Pair every left row with the right row of its entity that is nearest in time: ``left_id, right_id, gap``.

    Both sides need ``id`` (long), ``entity`` (string), ``topic`` (int) and ``t`` (long); other columns are ignored.
    Rows with a null id, entity or time are left out. Of one topic's rows with equal times only that with the smallest
    id counts. At equal distance the earlier right row is taken; of right rows of several topics at one time, that of
    the smallest topic. A left row with no right row within ``tolerance`` has no pair. Empty sides give no pairs.
    """
    side = lambda df, right: df.select("entity", "t", "topic", "id", F.lit(right).alias("right"))
    return nearest_of_sides(side(left, False).unionByName(side(right, True)), tolerance, bucket)


def nearest_of_sides(rows: DataFrame, tolerance: int, bucket: int | None = None) -> DataFrame:
    """The same of rows of both sides in one table, read once: ``right`` says which side a row is on; null, neither."""
    width = bucket or max(400 * tolerance, 4)
    offset = F.pmod("t", F.lit(width))
    b = F.expr(f"(t - pmod(t, {width}L)) div {width}L")  # whole numbers: nanoseconds don't fit a double
    edges = F.when(F.col("right"), F.array(F.when(offset <= tolerance, b - 1), F.when(offset >= width - tolerance, b + 1))).otherwise(F.array())
    at = F.filter(F.concat(F.array(b), edges), lambda x: x.isNotNull())
    rows = rows.where("id is not null and entity is not null and t is not null and right is not null")
    rows = rows.select("entity", F.explode(at).alias("bucket"), "t", F.coalesce("topic", F.lit(-1)).alias("topic"), "id", "right")
    return rows.repartition("entity", "bucket").sortWithinPartitions("entity", "bucket", "t", F.desc("right"), "topic", "id").mapInArrow(_merge(tolerance), _OUT)
