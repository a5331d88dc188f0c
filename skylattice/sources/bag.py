"""Recordings in SQLite (``topics``, ``messages``) as a Spark data source, and raw flight-controller logs."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class _Range(InputPartition):
    path: str
    low: int
    high: int


class BagSource(DataSource):
    """``spark.read.format("bagdb3").option("topic", ...).load(path)``: rows ``ts_ns, topic, data``.

    Options: ``topic`` (exact name; an unknown one raises), ``rows`` (rows of a partition, default 100,000),
    ``payload`` (``false`` leaves the data column null and unread).
    """

    @classmethod
    def name(cls) -> str:
        """The format's name."""
        return "bagdb3"

    def schema(self) -> str:
        """The fixed schema."""
        return "ts_ns long, topic string, data binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        """The reader."""
        return _BagReader(dict(self.options))


class _BagReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.topic = options["path"].removeprefix("file://"), options.get("topic")
        self.rows, self.payload = int(options.get("rows", 100_000)), options.get("payload", "true") != "false"

    def _open(self, path: str) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open(self.path) as c:
            if self.topic and not c.execute("SELECT count(*) FROM topics WHERE name = ?", (self.topic,)).fetchone()[0]:
                raise KeyError(f"no topic {self.topic!r}")
            low, high = c.execute("SELECT min(rowid), max(rowid) FROM messages").fetchone()
        if low is None:
            return []
        return [_Range(self.path, a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]

    def read(self, part: _Range) -> Iterator[tuple]:
        with self._open(part.path) as c:
            names = dict(c.execute("SELECT id, name FROM topics"))
            ids = [k for k, v in names.items() if self.topic in (None, v)]
            data = "data" if self.payload else "NULL"
            marks = ",".join("?" * len(ids))
            for topic, ts, blob in c.execute(f"SELECT topic_id, timestamp, {data} FROM messages WHERE rowid BETWEEN ? AND ? AND topic_id IN ({marks})", (part.low, part.high, *ids)):
                yield ts, names[topic], blob


def read_bag(spark: SparkSession, path: str, topic: str | None = None, payload: bool = True) -> DataFrame:
    """Messages of a recording, in parallel ranges of rows."""
    spark.dataSource.register(BagSource)
    r = spark.read.format("bagdb3").option("payload", str(payload).lower())
    return (r.option("topic", topic) if topic else r).load(path)


def walk_ulog(blob: bytes) -> Iterator[tuple[int, float, bytes]]:
    """(message id, seconds of the boot clock, payload) of each data record of a raw log; a cut record ends it."""
    at = 16
    while at + 3 <= len(blob):
        size = int.from_bytes(blob[at : at + 2], "little")
        if at + 3 + size > len(blob):
            return
        if blob[at + 2] == 0x44 and size >= 10:
            body = at + 3
            yield int.from_bytes(blob[body : body + 2], "little"), int.from_bytes(blob[body + 2 : body + 10], "little") / 1e6, blob[body + 10 : body + size]
        at += 3 + size


def read_ulogs(spark: SparkSession, path: str) -> DataFrame:
    """Raw logs below a path, one row per data record: ``path, msg_id, t, payload``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, blob in zip(b["path"], b["content"]):
                rows = list(walk_ulog(bytes(blob)))
                yield pd.DataFrame({"path": p, "msg_id": np.array([r[0] for r in rows], np.int32), "t": [r[1] for r in rows], "payload": [r[2] for r in rows]})

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, "path string, msg_id int, t double, payload binary")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files below a path by six suffixes: ``path, rel, length`` in order of name at the sink."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,jpg,jpeg,tif,tiff,bmp}").load(path)
    return f.select("path", "length", "modificationTime")
