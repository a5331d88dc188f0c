"""Controller logs in the ULog format: self-describing, so any topic can be read by its fields' names.

A file is a header, then records of (size, kind, body). ``F`` names a message's fields and their types, ``A`` gives a
logged topic its number, ``D`` is one message of it. Files are decoded side by side, one a task, as they can't be divided.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions import rotation
from skylattice.operators import sequence as seq

MAGIC = b"ULog\x01\x12\x35"
#: The format's basic types.
TYPES = {"int8_t": "i1", "uint8_t": "u1", "int16_t": "<i2", "uint16_t": "<u2", "int32_t": "<i4", "uint32_t": "<u4", "int64_t": "<i8", "uint64_t": "<u8", "float": "<f4", "double": "<f8", "bool": "?", "char": "S1"}
_FIELD = re.compile(r"(\w+)(?:\[(\d+)\])? (\w+)")


def records(blob: bytes) -> Iterator[tuple[str, int, int]]:
    """(kind, begin, end) of each record; a record cut short ends the log, and what isn't a log has none."""
    at = 16 if blob[:7] == MAGIC else len(blob)
    while at + 3 <= len(blob):
        size = int.from_bytes(blob[at : at + 2], "little")
        if at + 3 + size > len(blob):
            return
        yield chr(blob[at + 2]), at + 3, at + 3 + size
        at += 3 + size


def _dtype(name: str, formats: dict[str, str]) -> list[tuple]:
    out = []
    for part in filter(None, formats[name].split(";")):
        if m := _FIELD.fullmatch(part.strip()):
            kind = TYPES[m[1]] if m[1] in TYPES else _dtype(m[1], formats)
            out.append((m[3], kind, (int(m[2]),)) if m[2] else (m[3], kind))
    return out


def decode(blob: bytes, topic: str, fields: tuple[str, ...]) -> pd.DataFrame:
    """Messages of one topic: ``instance, t_us`` and the fields (``q[0]`` is the first of an array) as doubles, in order of the log.

    A field the topic doesn't have is NaN throughout. Trailing padding that a logger leaves out is read as nothing.
    """
    formats: dict[str, str] = {}
    wanted: dict[int, int] = {}
    bodies: dict[int, list[bytes]] = {}
    order: list[int] = []
    for kind, a, b in records(blob):
        if kind == "F":
            name, _, text = blob[a:b].decode("utf-8", "replace").partition(":")
            formats[name] = text
        elif kind == "A" and b - a > 3 and blob[a + 3 : b].decode("utf-8", "replace") == topic:
            wanted[int.from_bytes(blob[a + 1 : a + 3], "little")] = blob[a]
        elif kind == "D" and (k := int.from_bytes(blob[a : a + 2], "little")) in wanted:
            bodies.setdefault(k, []).append(blob[a + 2 : b])
            order.append(k)
    frames = []
    for k, rows in bodies.items():
        kind = np.dtype(_dtype(topic, formats))
        whole = [r[: kind.itemsize].ljust(kind.itemsize, b"\0") for r in rows]
        m = np.frombuffer(b"".join(whole), kind)
        columns = {"instance": np.full(len(m), wanted[k], np.int32), "t_us": m["timestamp"].astype(np.int64)}
        for f in fields:
            name, _, index = f.rstrip("]").partition("[")
            v = m[name].astype(float) if name in kind.names else np.full(len(m), np.nan)
            columns[f] = v[:, int(index)] if index and v.ndim == 2 else v
        frames.append(pd.DataFrame(columns, index=np.flatnonzero(np.asarray(order) == k)))
    return pd.concat(frames).sort_index() if frames else pd.DataFrame({"instance": np.zeros(0, np.int32), "t_us": np.zeros(0, np.int64), **{f: np.zeros(0) for f in fields}})


def read_topic(spark: SparkSession, path: str, topic: str, fields: tuple[str, ...]) -> DataFrame:
    """One topic of all ``.ulg`` files below a path: ``path, instance, t`` (seconds) and the fields as doubles.

    Files without the topic have no rows, nor have those that are no log. NaN, and a field the topic lacks, is null. An element ``q[0]`` becomes column ``q_0``.
    """
    names = [f.replace("[", "_").rstrip("]") for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, blob in zip(b["path"], b["content"]):
                m = decode(bytes(blob), topic, fields)
                yield pd.DataFrame({"path": p, "instance": m["instance"].to_numpy(), "t": m["t_us"].to_numpy() / 1e6, **{n: m[f].to_numpy() for n, f in zip(names, fields)}})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ulg").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, instance int, t double" + "".join(f", `{n}` double" for n in names))


def attitude(spark: SparkSession, path: str) -> DataFrame:
    """Attitudes of the first instance: ``path, t, yaw`` (north-east-down heading, unwrapped) and gravity ``gx, gy, gz`` in
    the body's axes (forward, right, down)."""
    a = read_topic(spark, path, "vehicle_attitude", tuple(f"q[{k}]" for k in range(4))).where("instance = 0 and q_0 is not null")
    w, x, y, z = (F.col(f"q_{k}") for k in range(4))  # the scalar part first
    r = rotation.quat_matrix((x, y, z, w))
    rows = a.select("path", "t", rotation.quat_yaw((x, y, z, w)).alias("value"), *[r[2][k].alias(n) for k, n in enumerate(("gx", "gy", "gz"))])
    return seq.unwrap(rows, ["path"]).select("path", "t", F.col("unwrapped").alias("yaw"), "gx", "gy", "gz")


def altitude(spark: SparkSession, path: str) -> DataFrame:
    """Heights above the start: ``path, t, alt``; only finite ones."""
    z = read_topic(spark, path, "vehicle_local_position", ("z",)).where("instance = 0 and not isnan(z) and abs(z) < double('inf')")
    return z.select("path", "t", (-F.col("z")).alias("alt"))


def motion(spark: SparkSession, path: str) -> DataFrame:
    """Heights and velocities where all are finite: ``path, t, alt, v_east, v_north``."""
    fields = ("z", "vx", "vy")
    known = " and ".join(f"not isnan({c}) and abs({c}) < double('inf')" for c in fields)
    m = read_topic(spark, path, "vehicle_local_position", fields).where(f"instance = 0 and {known}")
    return m.select("path", "t", (-F.col("z")).alias("alt"), F.col("vy").alias("v_east"), F.col("vx").alias("v_north"))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """Satellite fixes of at least three dimensions: ``path, t, lat, lon``."""
    g = read_topic(spark, path, "vehicle_gps_position", ("fix_type", "latitude_deg", "longitude_deg")).where("instance = 0 and fix_type >= 3")
    return g.select("path", "t", F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon"))
