"""What the query modules share: test tables in the roles of recordings, and rounding for comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.session import load_table

MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def r6(c: Column | str, places: int = 6) -> Column:
    """Rounded as the oracles round."""
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def events(spark: SparkSession, d: str, *types: str) -> DataFrame:
    """``events`` as a log: ``event_id, run, t`` (seconds), ``value`` (and ``topic`` if more than one type is asked for)."""
    e = load_table(spark, d, "events")
    if types:
        e = e.where(F.col("event_type").isin(*types))
    out = [F.col("event_id"), F.col("user_id").alias("run"), (F.expr(MICROS) / 1e6).alias("t"), F.col("value")]
    return e.select(*out, *([F.col("event_type").alias("topic")] if len(types) != 1 else []))


#: The same for the oracles.
E = "e AS (SELECT event_id, user_id AS run, epoch_us(ts) / 1e6 AS t, value, event_type AS topic FROM events)"


def uniform(key: str) -> str:
    """SQL of a uniform number in [0, 1) drawn from a string expression (Spark)."""
    return f"conv(substr(md5({key}), 1, 8), 16, 10) / 4294967296.0D"


def uniform_duck(key: str) -> str:
    """The same in DuckDB."""
    return f"CAST(concat('0x', substr(md5({key}), 1, 8)) AS BIGINT) / 4294967296.0"
