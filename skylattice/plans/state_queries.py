"""Queries of decoding, state machines and streams."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions import rotation
from skylattice.operators.images import ground_patches
from skylattice.operators.temporal import bracket_join, nearest
from skylattice.plans.common import E, events, r6
from skylattice.session import load_table
from skylattice.sources import decoders
from skylattice.streaming.machine import Rule, run_batch, run_stream
from skylattice.streaming.pipelines import event_time, interval_join, newest_per_trigger, run_available, table_stream, windowed_counts

DAY = 86400.0
#: A tracker that is lost after two days of low readings and found again after one of high ones.
TRACKER = (Rule("tracking", "low", DAY, "lost"), Rule("lost", "high", 0.0, "recovering"), Rule("recovering", "low", 0.0, "lost"), Rule("recovering", "high", DAY, "tracking"), Rule("lost", "timeout", 10 * DAY, "searching"), Rule("searching", "high", 0.0, "recovering"))


def _messages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return load_table(spark, d, "messages"), load_table(spark, d, "topics")


def decode_imu(spark: SparkSession, d: str) -> DataFrame:
    """Inertial samples from payloads."""
    return decoders.imu(*_messages(spark, d))


def decode_pose(spark: SparkSession, d: str) -> DataFrame:
    """Poses from payloads."""
    return decoders.poses(*_messages(spark, d))


def decode_frames(spark: SparkSession, d: str) -> DataFrame:
    """Camera frames and their statistics."""
    return decoders.frames(*_messages(spark, d))


def decode_health(spark: SparkSession, d: str) -> DataFrame:
    """Health snapshots."""
    return decoders.health(*_messages(spark, d))


def camera_patches(spark: SparkSession, d: str) -> DataFrame:
    """The ground under each camera frame, at the height and tilt of the nearest pose within 150 ms."""
    m, t = _messages(spark, d)
    timed = "timestamp is not null and timestamp <> 0"
    frames = decoders.of_topic(m, t, "/cam0/image_raw").where(timed)
    poses = decoders.poses(m, t).where(f"ok and {timed}").select("flight", (F.col("timestamp") / 1e9).alias("t"), "z", "qx", "qy", "qz", "qw")
    at = bracket_join(frames.select("msg_id", "flight", (F.col("timestamp") / 1e9).alias("t")), poses, ["flight"], ["z", "qx", "qy", "qz", "qw"], 600.0)
    p = at.select("msg_id", nearest(tolerance=0.15).alias("p")).where("p is not null").groupBy("msg_id").agg(F.first("p").alias("p"))
    roll, pitch = rotation.camera_tilt(tuple(F.col(f"p.{c}") for c in ("qx", "qy", "qz", "qw")))
    placed = frames.select("msg_id", "data").join(p.select("msg_id", F.col("p.z").alias("altitude"), (roll - math.pi * F.signum(roll)).alias("roll"), pitch.alias("pitch")), "msg_id")
    out = ground_patches(placed, size_m=24.0)
    return out.select("msg_id", "coverage", r6("centre_x").alias("centre_x"), r6("centre_y").alias("centre_y"), "shifted", F.octet_length("patch").alias("pixels"), F.sha2("patch", 256).alias("digest"), "error")


def topic_rates(spark: SparkSession, d: str) -> DataFrame:
    """Messages, span and mean rate of each topic, without payloads."""
    m, t = _messages(spark, d)
    g = m.where("timestamp is not null and timestamp <> 0").groupBy("flight", "topic_id").agg(F.count("*").alias("n"), (F.max("timestamp") - F.min("timestamp")).alias("span"))
    j = t.select("flight", F.col("id").alias("topic_id"), "name").join(g, ["flight", "topic_id"], "left")
    return j.select("flight", "name", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("span") > 0, r6((F.col("n") - 1) / (F.col("span") / 1e9))).alias("rate"))


def _conditions(e: DataFrame) -> DataFrame:
    return e.select("run", "t", (F.col("value") < 50).alias("low"), (F.col("value") >= 50).alias("high"))


def tracker_machine_batch(spark: SparkSession, d: str) -> DataFrame:
    """States of a tracker over a batch."""
    return run_batch(_conditions(events(spark, d)), ["run"], TRACKER, "tracking")


def tracker_machine_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same over a stream."""
    e = table_stream(spark, f"{d}/events.parquet").select(F.col("user_id").alias("run"), (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6).alias("t"), "value")
    return run_available(run_stream(_conditions(e), ["run"], TRACKER, "tracking"), "machine")


def _stream(spark: SparkSession, d: str, *types: str) -> DataFrame:
    e = event_time(table_stream(spark, f"{d}/events.parquet"))
    return (e.where(F.col("event_type").isin(*types)) if types else e).withColumn("run", F.col("user_id"))


def health_stream(spark: SparkSession, d: str) -> DataFrame:
    """Counts and means per six hours and event type, from a stream."""
    out = run_available(windowed_counts(_stream(spark, d), ["event_type"], "6 hours"), "windows", "complete")
    return out.select("start", "event_type", "n", r6("mean").alias("mean"))


def interval_join_stream(spark: SparkSession, d: str) -> DataFrame:
    """Clicks and views of one user within an hour of each other, from two streams."""
    return run_available(interval_join(_stream(spark, d, "click"), _stream(spark, d, "view"), 3600), "interval")


def drop_oldest_stream(spark: SparkSession, d: str) -> DataFrame:
    """The four newest errors of each user in a trigger."""
    s = _stream(spark, d, "error").select("event_id", "run", "ts")
    return run_available(s, "newest", shape=lambda b: newest_per_trigger(b, "run", 4)).select("event_id", "run")


QUERIES = {
    f.__name__: f
    for f in (decode_imu, decode_pose, decode_frames, decode_health, camera_patches, topic_rates, tracker_machine_batch, tracker_machine_stream, health_stream, interval_join_stream, drop_oldest_stream)
}
ORACLES = {
    "topic_rates": """WITH g AS (SELECT flight, topic_id, count(*) AS n, max("timestamp") - min("timestamp") AS span FROM messages WHERE "timestamp" IS NOT NULL AND "timestamp" <> 0 GROUP BY ALL)
SELECT t.flight, t.name, coalesce(n, 0) AS n, CASE WHEN span > 0 THEN round((n - 1) / (span / 1e9), 6) END AS rate FROM topics t LEFT JOIN g ON t.flight = g.flight AND t.id = g.topic_id""",
    "health_stream": f"WITH {E} SELECT CAST(floor(t / 21600) * 21600 AS BIGINT) AS start, topic AS event_type, count(*) AS n, round(avg(value), 6) AS mean FROM e GROUP BY ALL",
    "interval_join_stream": f"WITH {E} SELECT a.run, a.event_id AS id_a, b.event_id AS id_b FROM e a JOIN e b ON a.run = b.run AND abs(a.t - b.t) <= 3600 WHERE a.topic = 'click' AND b.topic = 'view'",
    "drop_oldest_stream": f"WITH {E} SELECT event_id, run FROM e WHERE topic = 'error' QUALIFY row_number() OVER (PARTITION BY run ORDER BY t DESC, event_id DESC) <= 4",
}
