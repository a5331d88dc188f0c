"""Queries of the data-preparation operators that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skylattice.operators.grid_fill import fill_errors, missing_slots, regular_series, slot_readings
from skylattice.operators.outliers import flag_implausible
from skylattice.session import load_table, shared_dir
from skylattice.streaming.compaction import compact_tiles, copies


def p1_series(spark: SparkSession, d: str) -> DataFrame:
    """Every source as a regular half-second series."""
    return regular_series(load_table(spark, d, "messages"), load_table(spark, d, "topics"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The series' slots that held no usable reading."""
    return missing_slots(p1_series(spark, d))


def p1_fill_errors(spark: SparkSession, d: str) -> DataFrame:
    """How far hidden readings are filled off, against their source's mean."""
    return fill_errors(slot_readings(load_table(spark, d, "messages"), load_table(spark, d, "topics")))


def p2_flags(spark: SparkSession, d: str) -> DataFrame:
    """Implausible values and why."""
    return flag_implausible(load_table(spark, d, "vehicle_global_position"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Implausible values."""
    return p2_flags(spark, d).select("row_id", "field").distinct()


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """The consolidated store: every distinct tile record once, with the number of its bytes."""
    records, _ = compact_tiles(spark, f"{d}/tiles.parquet", shared_dir(spark, "compact"))
    return records.select("z", "x", "y", "digest", "file_id", "size")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of files that hold one and the same record."""
    records, members = compact_tiles(spark, f"{d}/tiles.parquet", shared_dir(spark, "compact"))
    return copies(members, records)


_TILES = r"""
WITH plain AS (
  SELECT file_id, data, lower(trim(coalesce(scheme, ''))) AS scheme,
         trim(replace(regexp_replace(rel_path, '%2[fF]', '/', 'g'), '\', '/')) AS p
  FROM tiles
), parts AS (
  SELECT *, string_split(regexp_replace(regexp_replace(regexp_replace(p, '(^|/)(\./)+', '\1', 'g'), '/+', '/', 'g'), '[^/]+/\.\./', '', 'g'), '/') AS s FROM plain
), named AS (
  SELECT file_id, data, scheme, s[-3] AS z, s[-2] AS x, regexp_extract(s[-1], '^([0-9]+)\.(png|jpg|jpeg)$', 1, 'i') AS y FROM parts
), tile AS (
  SELECT file_id, data, CAST(z AS INTEGER) AS z, CAST(x AS BIGINT) AS x,
         CASE WHEN scheme = 'tms' THEN (CAST(1 AS BIGINT) << CAST(z AS INTEGER)) - 1 - CAST(y AS BIGINT) ELSE CAST(y AS BIGINT) END AS y
  FROM named
  WHERE regexp_matches(z, '^[0-9]+$') AND regexp_matches(x, '^[0-9]+$') AND y <> '' AND data IS NOT NULL
)
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_series, p1_fill_errors, p2_found, p2_flags, p4_found, p4_records)}
ORACLES = {
    "p4_found": _TILES + "SELECT a.file_id AS file_a, b.file_id AS file_b FROM tile a JOIN tile b ON a.z = b.z AND a.x = b.x AND a.y = b.y AND a.data = b.data AND a.file_id < b.file_id",
    "p4_records": _TILES + "SELECT z, x, y, sha256(data) AS digest, min(file_id) AS file_id, CAST(octet_length(any_value(data)) AS BIGINT) AS size FROM tile GROUP BY z, x, y, sha256(data)",
}
