"""Writers: replay logs, the clustered patch bank, mosaics of tiles. All commit atomically through Spark's committer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_replay_log(rows: DataFrame, path: str) -> None:
    """Replay rows by run, in order of frame."""
    rows.repartition("run_id").sortWithinPartitions("run_id", "k").write.mode("overwrite").partitionBy("run_id").parquet(path)


def write_bank(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Patches clustered by area and node, compressed with zstd; hot areas spread over files by range of node."""
    spread = rows.repartitionByRange(files, "area", "node") if files else rows.repartitionByRange("area", "node")
    spread.sortWithinPartitions("area", "node", "layer_file").write.mode("overwrite").option("compression", "zstd").parquet(path)


def mosaics(tiles: DataFrame, size: int, block: int = 8) -> DataFrame:
    """Stitched blocks of ``block`` x ``block`` tiles: ``z, bx, by, missing, pixels``.

    ``tiles`` has ``z, x, y, pixels`` (``size`` x ``size`` bytes); of repeated tiles the first in order of bytes is
    taken, missing ones are black and counted. A block is bounded, so no task grows with the map.
    """

    def stitch(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        z, bx, by = key
        canvas = np.zeros((block * size, block * size), np.uint8)
        one = g.sort_values(["x", "y", "pixels"]).drop_duplicates(["x", "y"])
        for x, y, px in zip(one["x"], one["y"], one["pixels"]):
            r, c = (y - by * block) * size, (x - bx * block) * size
            canvas[r : r + size, c : c + size] = np.frombuffer(px, np.uint8).reshape(size, size)
        return pd.DataFrame({"z": [z], "bx": [bx], "by": [by], "missing": [block * block - len(one)], "pixels": [canvas.tobytes()]})

    t = tiles.where("pixels is not null").select("z", "x", "y", "pixels", F.floor(F.col("x") / block).alias("bx"), F.floor(F.col("y") / block).alias("by"))
    return t.groupBy("z", "bx", "by").applyInPandas(stitch, "z int, bx long, by long, missing int, pixels binary")
