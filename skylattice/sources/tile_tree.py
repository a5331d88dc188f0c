"""Tile trees: folders of raster files named by zoom, column and row."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.operators.tile_paths import tile_of

#: A stream forgets files older than a week against the newest it saw; tiles may arrive with any time of change.
EVER = "36500d"


def tile_files(spark: SparkSession, root: str, scheme: str = "xyz", stream: bool = False, max_bytes_per_batch: int = 1 << 30) -> DataFrame:
    """Every file below ``root``: ``file_id, rel_path, scheme, n_bytes, data, mtime``.

    ``rel_path`` is the path below ``root``, ``file_id`` a 64-bit hash of it. Unless ``data`` is selected only names,
    sizes and times are listed. With ``stream`` new files are discovered as they come, whatever their time of change.
    An empty folder has no rows. Files of no bytes have none either: Spark's file sources pass over them.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = unquote(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath()).rstrip("/")
    if stream:
        reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxBytesPerTrigger", max_bytes_per_batch).option("maxFileAge", EVER)
    else:
        reader = spark.read.format("binaryFile")
    files = reader.option("recursiveFileLookup", "true").load(root)
    plain = F.coalesce(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), F.col("path"))
    rel = F.expr("substring(p, locate(base, p) + length(base) + 1)")
    named = files.withColumns({"p": plain, "base": F.lit(base)}).withColumn("rel_path", rel)
    return named.select(F.xxhash64("rel_path").alias("file_id"), "rel_path", F.lit(scheme).alias("scheme"), F.col("length").alias("n_bytes"), F.col("content").alias("data"), F.col("modificationTime").alias("mtime"))


def tile_index(files: DataFrame) -> DataFrame:
    """The tiles that files name: ``file_id, rel_path, z, x, y`` (counted from the north), ``tile_id`` and bounds.

    Files whose path names no tile are left out. Data aren't read.
    """
    t = tile_of(F.col("rel_path"), F.col("scheme"))
    rows = files.select("file_id", "rel_path", t.alias("t")).where("t is not null").select("file_id", "rel_path", "t.*")
    b = geo.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    return rows.select(
        "*",
        F.concat_ws("/", "z", "x", "y").alias("tile_id"),
        *[b[k].alias(n) for k, n in (("top_lat", "top_left_lat"), ("left_lon", "top_left_lon"), ("bottom_lat", "bottom_right_lat"), ("right_lon", "bottom_right_lon"))],
    )
