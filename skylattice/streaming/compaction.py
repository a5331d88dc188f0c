"""Consolidation of many small files by a checkpointed streaming compactor.

The source is read as a stream: its checkpoint remembers what has been discovered, so each file is read once, whatever
its time of change. Every micro-batch writes under its own identifier (``members/batch=N``, ``records/batch=N``,
``index/strip=S/batch=N``), replacing what an earlier try of the same batch left there; a batch that is retried after
the loss of an executor or driver never duplicates. A record already held by an earlier batch isn't written again:
earlier keys are read from the index alone, so a retry sees the same ones.

Scale: the index is cut into strips of longitude per zoom, of which a batch reads only those it touches (their number is
bounded by 64 a zoom), and the size of a batch follows the cores, so 100 TB are tens of batches and no batch reads the
keys of the whole store. A batch reads its source once. No state is held in memory; to the driver come strips and sums.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skylattice.operators.tile_paths import tile_of
from skylattice.sources.tile_tree import EVER, tile_files

KEY = ["z", "x", "y", "digest"]
_MEMBER = "file_id long, z int, x long, y long, digest string, size long"
_RECORD = "z int, x long, y long, digest string, file_id long, size long, data binary"
_INDEX = "z int, x long, y long, digest string, strip long, batch long"


def _strip() -> Column:
    """Number of the strip a tile lies in: its zoom and the first six binary digits of its column."""
    return F.col("z").cast("long") * 64 + F.least(F.lit(63), F.floor(F.col("x") / F.pow(F.lit(2.0), F.greatest(F.col("z") - 6, F.lit(0)))).cast("long"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _put_batch(batch: DataFrame, batch_id: int, out: str, target_bytes: int) -> None:
    spark = batch.sparkSession
    t = tile_of(F.col("rel_path"), F.col("scheme"))
    rows = batch.select("file_id", t.alias("t"), "data").where("t is not null and data is not null and file_id is not null")
    rows = rows.select("file_id", "t.z", "t.x", "t.y", F.sha2("data", 256).alias("digest"), F.length("data").cast("long").alias("size"), "data").persist(StorageLevel.DISK_ONLY)
    try:
        members = f"{out}/members/batch={batch_id}"
        rows.select("file_id", *KEY, "size").write.mode("overwrite").parquet(members)
        firsts = spark.read.parquet(members).groupBy(*KEY).agg(F.min("file_id").alias("file_id"), F.min("size").alias("size")).withColumn("strip", _strip())
        if batch_id > 0:
            touched = [r[0] for r in spark.read.parquet(members).select(_strip()).distinct().collect()]  # at most 64 a zoom
            paths = [p for s in touched if _exists(spark, p := f"{out}/index/strip={s}")]
            if paths:
                held = spark.read.schema(_INDEX).option("basePath", f"{out}/index").parquet(*paths)
                firsts = firsts.join(held.where(F.col("batch") < batch_id).select(*KEY), KEY, "left_anti")
        keys = f"{out}/firsts/batch={batch_id}"
        firsts.write.mode("overwrite").parquet(keys)
        firsts = spark.read.parquet(keys)
        total = firsts.agg(F.sum("size")).first()[0] or 0
        files = max(1, math.ceil(total / target_bytes))
        # file_id may itself be repeated: the key is matched too, and one row kept
        one = rows.join(firsts.select("file_id", *KEY), ["file_id", *KEY]).groupBy(*KEY, "file_id", "size").agg(F.first("data").alias("data"))
        one.repartitionByRange(files, "z", "x", "y").sortWithinPartitions("z", "x", "y").write.mode("overwrite").parquet(f"{out}/records/batch={batch_id}")
        index = firsts.select(*KEY, "strip", F.lit(batch_id).cast("long").alias("batch")).repartition("strip")
        index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strip", "batch").parquet(f"{out}/index")
    finally:
        rows.unpersist()


def compact_stream(rows: DataFrame, out: str, target_bytes: int = 128 << 20) -> tuple[DataFrame, DataFrame]:
    """Consolidate a stream of ``file_id, rel_path, scheme, data`` into the store below ``out``; see ``compact_tiles``."""
    spark = rows.sparkSession
    query = rows.writeStream.foreachBatch(lambda b, n: _put_batch(b, n, out, target_bytes)).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not _exists(spark, f"{out}/records"):  # nothing was ever discovered
        return spark.createDataFrame([], _RECORD), spark.createDataFrame([], _MEMBER)
    return spark.read.schema(_RECORD).parquet(f"{out}/records").drop("batch"), spark.read.schema(_MEMBER).parquet(f"{out}/members").drop("batch")


def batch_bytes(spark: SparkSession) -> int:
    """Bytes of source a batch may take where nothing is said: one gigabyte a core."""
    return spark.sparkContext.defaultParallelism << 30


def compact_tiles(spark: SparkSession, source: str, out: str, target_bytes: int = 128 << 20, max_bytes_per_batch: int | None = None, schema: StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """Consolidate the tile files recorded in the Parquet tables below ``source`` into few well-sized files below ``out``.

    Processes what is available now and ends; called again with the same ``out`` it takes up only what is new. Returns
    (records, members): ``records`` holds every distinct tile record once (``z, x, y, digest, file_id, size, data``,
    ``file_id`` being the smallest of the batch that brought it), ``members`` has the record key of every file. Files
    whose path names no tile or whose data are null hold no record and are left out; empty files are records. Extra
    columns are ignored. An empty source gives two empty tables.
    """
    schema = schema or spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes_per_batch or batch_bytes(spark)).option("maxFileAge", EVER)
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():  # a stream reads a folder
        stream, source = stream.option("pathGlobFilter", path.getName()), path.getParent().toString()
    return compact_stream(stream.parquet(source).select("file_id", "rel_path", "scheme", "data"), out, target_bytes)


def compact_tile_tree(spark: SparkSession, root: str, out: str, scheme: str = "xyz", target_bytes: int = 128 << 20, max_bytes_per_batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The same of a folder of tile files ``z/x/y.png`` itself; ``file_id`` is a hash of a file's path below ``root``. Files of no bytes
    aren't seen and hold no record."""
    files = tile_files(spark, root, scheme, stream=True, max_bytes_per_batch=max_bytes_per_batch or batch_bytes(spark))
    return compact_stream(files.select("file_id", "rel_path", "scheme", "data"), out, target_bytes)


def copies(members: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs ``file_a < file_b`` of files whose record is one and the same in the store. The pairs are the result asked
    for: all are given."""
    held = members.join(records.select(*KEY), KEY)
    return held.select(F.col("file_id").alias("file_a"), *KEY).join(held.select(F.col("file_id").alias("file_b"), *KEY), KEY).where("file_a < file_b").select("file_a", "file_b")
