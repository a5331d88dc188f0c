"""MCAP recordings as a Spark data source, parsed from the public container format.

A file is a sequence of records (one byte of kind, eight of length); messages lie in chunks that may be compressed. The
driver only skips from record to record to find the chunks; executors read and open them. zstd needs ``zstandard``,
lz4 the ``lz4`` package; a missing one raises when such a chunk is met.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the container: magic bytes and kinds of record.
MAGIC = b"\x89MCAP0\r\n"
FOOTER, CHANNEL, MESSAGE, CHUNK, DATA_END = 0x02, 0x04, 0x05, 0x06, 0x0F


def _text(b: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", b, at)[0]
    return b[at + 4 : at + 4 + n].decode(), at + 4 + n


def _records(b: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 9 <= len(b):
        kind, size = b[at], struct.unpack_from("<Q", b, at + 1)[0]
        if at + 9 + size > len(b):
            return
        yield kind, b[at + 9 : at + 9 + size]
        at += 9 + size


def _channel(b: bytes) -> tuple[int, str]:
    return struct.unpack_from("<H", b)[0], _text(b, 4)[0]


def _chunk(b: bytes) -> bytes:
    name, at = _text(b, 28)
    size = struct.unpack_from("<Q", b, at)[0]
    data = b[at + 8 : at + 8 + size]
    if name == "":
        return data
    if name == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=struct.unpack_from("<Q", b, 16)[0])
    if name == "lz4":
        import lz4.frame

        return lz4.frame.decompress(data)
    raise ValueError(f"unknown compression {name!r}")


def layout(path: str) -> tuple[list[tuple[int, int]], dict[int, str]]:
    """(offset and length of each top-level record that holds messages, channels named outside chunks)."""
    spans: list[tuple[int, int]] = []
    channels: dict[int, str] = {}
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        if f.read(8) != MAGIC:
            raise ValueError(f"{path} is no MCAP file")
        while f.tell() + 9 <= size:
            at = f.tell()
            kind, n = struct.unpack("<BQ", f.read(9))
            if at + 9 + n > size:
                break  # a recording cut short
            if kind in (CHUNK, MESSAGE):
                spans.append((at, 9 + n))
            if kind == CHANNEL:
                channels |= dict([_channel(f.read(n))])
            f.seek(at + 9 + n)
    return spans, channels


@dataclass
class _Spans(InputPartition):
    path: str
    spans: list[tuple[int, int]]
    channels: dict[int, str] = field(default_factory=dict)


class McapSource(DataSource):
    """``spark.read.format("mcap").option("topic", ...).load(path)``: rows ``ts_ns, topic, data``."""

    @classmethod
    def name(cls) -> str:
        """The format's name."""
        return "mcap"

    def schema(self) -> str:
        """The fixed schema."""
        return "ts_ns long, topic string, data binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        """The reader."""
        return _McapReader(dict(self.options))


class _McapReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.topic, self.each = options["path"].removeprefix("file://"), options.get("topic"), int(options.get("chunks", 16))

    def partitions(self) -> list[InputPartition]:
        spans, channels = layout(self.path)
        if not channels:  # none is named outside the chunks: look into them
            for kind, body in self._open(spans):
                if kind == CHANNEL:
                    channels |= dict([_channel(body)])
        if self.topic and self.topic not in channels.values():
            raise KeyError(f"no topic {self.topic!r}")
        return [_Spans(self.path, spans[i : i + self.each], channels) for i in range(0, len(spans), self.each)]

    def _open(self, spans: list[tuple[int, int]]) -> Iterator[tuple[int, bytes]]:
        with open(self.path, "rb") as f:
            for at, n in spans:
                f.seek(at)
                for kind, body in _records(f.read(n)):
                    yield from _records(_chunk(body)) if kind == CHUNK else [(kind, body)]

    def read(self, part: _Spans) -> Iterator[tuple]:
        names = dict(part.channels)
        for kind, body in self._open(part.spans):
            if kind == CHANNEL:
                names |= dict([_channel(body)])
            elif kind == MESSAGE:
                channel, _, logged, _ = struct.unpack_from("<HIQQ", body)
                topic = names.get(channel)
                if self.topic in (None, topic):
                    yield logged, topic, body[22:]


def read_mcap(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """Messages of a recording, in parallel groups of chunks."""
    spark.dataSource.register(McapSource)
    r = spark.read.format("mcap")
    return (r.option("topic", topic) if topic else r).load(path)
