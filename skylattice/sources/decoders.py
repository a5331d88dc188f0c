"""Recorded messages as typed tables: payloads are decoded in Arrow batches, JSON by Spark itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions import cdr
from skylattice.functions.images import laplacian_variance

HEALTH = "k long, t double, score double, spread double, neff double, coverage double, alt double, vio string, state string, note string"


def of_topic(messages: DataFrame, topics: DataFrame, ending: str) -> DataFrame:
    """Messages of the topics whose name ends so; the topic's filter comes before any payload is touched."""
    t = topics.where(F.col("name").endswith(ending)).select("flight", F.col("id").alias("topic_id")).distinct()
    return messages.join(t, ["flight", "topic_id"])


def _decode(df: DataFrame, columns: list[str], read: Callable[[pa.Array], list[pa.Array]], extra: str) -> DataFrame:
    names = [x.split()[0] for x in extra.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + read(b.column("data")), names=columns + names)

    types = dict(df.dtypes)
    return df.select(*columns, "data").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in columns) + ", " + extra)


def _doubles(v: np.ndarray, ok: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.where(ok, v[:, k], np.nan), mask=~ok) for k in range(v.shape[1])]


def imu(messages: DataFrame, topics: DataFrame) -> DataFrame:
    """Inertial samples: ``msg_id, flight, timestamp, stamp, gx..az, ok``; values are null where the payload is unusable."""

    def read(col: pa.Array) -> list[pa.Array]:
        v, ok = cdr.imu_vectors(col)
        stamp, seen = cdr.header_stamp(col)
        return [pa.array(stamp, mask=~seen), *_doubles(v, ok), pa.array(ok)]

    return _decode(of_topic(messages, topics, "/imu0"), ["msg_id", "flight", "timestamp"], read, "stamp double, gx double, gy double, gz double, ax double, ay double, az double, ok boolean")


def poses(messages: DataFrame, topics: DataFrame) -> DataFrame:
    """Poses: ``msg_id, flight, timestamp, stamp, x, y, z, qx, qy, qz, qw, ok``. A quaternion of zeros means no attitude."""

    def read(col: pa.Array) -> list[pa.Array]:
        v, ok = cdr.pose_vectors(col)
        stamp, seen = cdr.header_stamp(col)
        return [pa.array(stamp, mask=~seen), *_doubles(v, ok), pa.array(ok)]

    return _decode(of_topic(messages, topics, "/local_position/pose"), ["msg_id", "flight", "timestamp"], read, "stamp double, x double, y double, z double, qx double, qy double, qz double, qw double, ok boolean")


def frames(messages: DataFrame, topics: DataFrame) -> DataFrame:
    """Camera frames with their size and patch statistics: ``height, width, mean, std, sharpness, error``."""

    def read(col: pa.Array) -> list[pa.Array]:
        rows = []
        for blob in col.to_pylist():
            try:
                f = cdr.image_fields(blob)
                px = np.frombuffer(f["pixels"], np.uint8).reshape(f["height"], f["width"]).astype(float)
                rows.append((f["height"], f["width"], px.mean(), px.std(), laplacian_variance(px), None))
            except Exception as e:  # a broken payload becomes a row that says so
                rows.append((None, None, None, None, None, type(e).__name__))
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string())
        return [pa.array([r[k] for r in rows], kinds[k]) for k in range(6)]

    return _decode(of_topic(messages, topics, "/cam0/image_raw"), ["msg_id", "flight", "timestamp"], read, "height int, width int, mean double, std double, sharpness double, error string")


def health(messages: DataFrame, topics: DataFrame) -> DataFrame:
    """Health snapshots: the payload is a length and JSON text. What isn't JSON gives nulls."""
    m = of_topic(messages, topics, "/health").where("data is not null and octet_length(data) > 8")
    text = F.rtrim(F.expr("try_to_binary(hex(substring(data, 9)), 'hex')").cast("string"), F.lit("\x00"))
    return m.select("msg_id", "flight", "timestamp", F.from_json(text, HEALTH).alias("h")).select("msg_id", "flight", "timestamp", "h.*")
