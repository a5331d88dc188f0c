"""Queries of the operators for language-model training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.encoding import encode_corpus
from skylattice.llm.nearest_time import nearest_of_sides
from skylattice.llm.packing import pack, token_sizes
from skylattice.llm.sentences import split_sentences
from skylattice.llm.splits import assign_splits, leaking_areas
from skylattice.session import load_table

TOLERANCE_NS = 150_000_000


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Areas whose group of related records has bank rows in more than one split."""
    return leaking_areas(load_table(spark, d, "bank_meta"), load_table(spark, d, "real_pairs"))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every record with a split."""
    return assign_splits(*(load_table(spark, d, t) for t in ("bank_meta", "real_pairs", "split_targets")))


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each split's share of the records, wanted and got, and how many of its groups have records in another split."""
    groups = p3_splits(spark, d).groupBy("component").agg(F.count("*").alias("n"), F.min("split").alias("split"), (F.min("split") != F.max("split")).alias("torn"))
    got = groups.groupBy("split").agg(F.sum("n").alias("n"), F.count_if("torn").alias("torn"))
    everything = got.agg(F.sum("n").alias("all"))
    wanted = load_table(spark, d, "split_targets").where("split is not null and share > 0")
    total = wanted.agg(F.sum("share").alias("whole"))
    j = wanted.join(got, "split", "left").join(F.broadcast(everything)).join(F.broadcast(total))  # one row each
    return j.select("split", F.round(F.col("share") / F.col("whole"), 6).alias("wanted"), F.round(F.coalesce(F.col("n"), F.lit(0)) / F.col("all"), 6).alias("got"), F.coalesce("torn", F.lit(0)).alias("torn"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every camera frame with the nearest pose of its flight and their distance in time."""
    right = F.when(F.col("name").endswith("/cam0/image_raw"), False).when(F.col("name").endswith("/local_position/pose"), True)
    topics = load_table(spark, d, "topics").select("flight", F.col("id").alias("topic_id"), right.alias("right")).where("right is not null").distinct()
    rows = load_table(spark, d, "messages").select("msg_id", "flight", "topic_id", "timestamp").where("timestamp is not null and timestamp <> 0")
    sides = rows.join(topics, ["flight", "topic_id"]).select(F.col("msg_id").alias("id"), F.col("flight").alias("entity"), F.col("topic_id").alias("topic"), F.col("timestamp").alias("t"), "right")
    return nearest_of_sides(sides, TOLERANCE_NS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The pairs, the smaller id first."""
    return p5_pairs(spark, d).select(F.least("left_id", "right_id").alias("msg_a"), F.greatest("left_id", "right_id").alias("msg_b"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(load_table(spark, d, "documents"))


def p6_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The same with the place of every pre-token."""
    return encode_corpus(load_table(spark, d, "documents"), offsets=True)


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every document in containers of each capacity."""
    return pack(token_sizes(load_table(spark, d, "documents")), load_table(spark, d, "pack_classes"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units of every document."""
    return split_sentences(load_table(spark, d, "documents"))


def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The same with their text."""
    return split_sentences(load_table(spark, d, "documents"), with_text=True)


_P5 = """
WITH rows AS (
  SELECT m.flight, m.topic_id, m."timestamp" AS t, min(m.msg_id) AS id, t.name
  FROM messages m JOIN topics t ON m.flight = t.flight AND m.topic_id = t.id
  WHERE m."timestamp" IS NOT NULL AND m."timestamp" <> 0 AND (t.name LIKE '%/cam0/image_raw' OR t.name LIKE '%/local_position/pose')
  GROUP BY ALL
), f AS (SELECT * FROM rows WHERE name LIKE '%/cam0/image_raw'), p AS (SELECT * FROM rows WHERE name LIKE '%/local_position/pose'),
a AS (SELECT f.id, f.t, f.flight, p.id AS pid, p.t AS pt FROM f ASOF LEFT JOIN p ON f.flight = p.flight AND f.t >= p.t),
z AS (SELECT a.*, p.id AS zid, p.t AS zt FROM a ASOF LEFT JOIN p ON a.flight = p.flight AND a.t <= p.t),
b AS (SELECT id, CASE WHEN zt IS NULL OR t - pt <= zt - t THEN pid ELSE zid END AS other, CASE WHEN zt IS NULL OR t - pt <= zt - t THEN t - pt ELSE zt - t END AS gap FROM z)
SELECT {columns} FROM b WHERE gap <= 150000000
"""

QUERIES = {f.__name__: f for f in (p3_found, p3_splits, p3_shares, p5_found, p5_pairs, p6_ids, p6_offsets, p7_pack, p8_found, p8_sentences)}
ORACLES = {
    "p5_found": _P5.format(columns="least(id, other) AS msg_a, greatest(id, other) AS msg_b"),
    "p5_pairs": _P5.format(columns="id AS left_id, other AS right_id, gap"),
}
