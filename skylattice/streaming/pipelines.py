"""Structured Streaming forms: windowed counts, interval joins, sessions, newest-first back-pressure, split recording.

Every pipeline runs what is available and ends, keeps its checkpoint and output in the shared folder, and writes by
batch identifier, so a retried batch replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.session import shared_dir


def table_stream(spark: SparkSession, path: str, most_files: int = 64) -> DataFrame:
    """A table's folder (or single file) as a stream."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", most_files)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return stream.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return stream.parquet(path)


def run_available(stream: DataFrame, purpose: str, mode: str = "append", shape: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what is available; the rows it put out. In mode ``complete`` the last batch is the result."""
    spark = stream.sparkSession
    out = shared_dir(spark, purpose)

    def put(batch: DataFrame, n: int) -> None:
        target = f"{out}/rows" if mode == "complete" else f"{out}/rows/batch={n}"
        (shape(batch) if shape else batch).write.mode("overwrite").parquet(target)

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    res = spark.read.parquet(f"{out}/rows")
    return res.drop("batch") if "batch" in res.columns else res


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as a timestamp with zone (UTC wall clock), which watermarks need."""
    return df.withColumn(column, F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")))


def windowed_counts(stream: DataFrame, keys: list[str], length: str, late: str = "1 day") -> DataFrame:
    """Counts and means per tumbling window, later rows than the watermark dropped."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), *keys)
    return w.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.unix_seconds("w.start").alias("start"), *keys, "n", "mean")


def interval_join(left: DataFrame, right: DataFrame, seconds: int, late: str = "2 days") -> DataFrame:
    """Rows of two streams of the same ``run`` no farther apart than so many seconds; state is bounded by watermarks."""
    a = left.withWatermark("ts", late).select(F.col("run"), F.col("ts").alias("ts_a"), F.col("event_id").alias("id_a"))
    b = right.withWatermark("ts", late).select(F.col("run").alias("run_b"), F.col("ts").alias("ts_b"), F.col("event_id").alias("id_b"))
    near = F.expr(f"ts_b between ts_a - interval {seconds} seconds and ts_a + interval {seconds} seconds")
    return a.join(b, (F.col("run") == F.col("run_b")) & near).select("run", "id_a", "id_b")


def newest_per_trigger(batch: DataFrame, key: str, keep: int, order: str = "ts") -> DataFrame:
    """Back-pressure that drops the oldest: of a trigger's rows the ``keep`` newest of each key go on."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("event_id"))
    return batch.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def split_recorders(spark: SparkSession, path: str, large: F.Column, out: str) -> tuple[str, str]:
    """Two independent recorders of one source, rows of large payloads apart from the rest; the two folders."""
    for name, cond in (("large", large), ("small", ~large)):
        q = table_stream(spark, path).where(cond).writeStream.format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{out}/checkpoint-{name}").trigger(availableNow=True)
        q.start().awaitTermination()
    return f"{out}/large", f"{out}/small"
