"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from skylattice.plans.state_queries import QUERIES
from skylattice.streaming.pipelines import split_recorders


def test_machine_over_a_stream_equals_the_batch(spark, data):
    rows = [sorted(map(tuple, QUERIES[n](spark, data).collect())) for n in ("tracker_machine_batch", "tracker_machine_stream")]
    assert rows[0] == rows[1] and rows[0]


def test_split_recorders(spark, data, tmp_path):
    a, b = split_recorders(spark, f"{data}/messages.parquet", F.coalesce(F.length("data"), F.lit(0)) > 100, f"file://{tmp_path}/rec")
    total = spark.read.parquet(f"{data}/messages.parquet").count()
    assert spark.read.parquet(a).count() + spark.read.parquet(b).count() == total
    assert spark.read.parquet(b).where("length(data) > 100").count() == 0
