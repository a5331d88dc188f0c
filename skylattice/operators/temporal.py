"""Temporal joins: as-of, bracketing and interpolating, without range joins.

Both sides are tagged, put together and sorted once inside (key, bucket of time); the rows just before and after each
left row come from one pass in each direction. What lies beyond a bucket's edges comes from one row per bucket, carried
along each key. A key with a third of all rows is many buckets; only its buckets' summaries, not its rows, ever meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators.sequence import bucket_width

def bracket_join(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], width: float | None = None, t: str = "t") -> DataFrame:
    """Left rows with ``prev`` (last right row at or before ``t``) and ``next`` (first at or after), structs of ``t`` and ``values``.

    Rows of either side with a null time are treated as absent on the right and come without neighbours on the left.
    At equal right times the row whose values are least in order is taken. Column names of the two sides may clash;
    left columns called ``prev`` or ``next`` are replaced.
    """
    columns = [c for c in left.columns if c not in ("prev", "next")]
    r = right.where(F.col(t).isNotNull()).groupBy(*keys, t).agg(F.min(F.struct(*values)).alias("v"))
    r = r.select(*keys, F.col(t).alias("_t"), F.struct(F.col(t).alias("t"), *[F.col("v")[c].alias(c) for c in values]).alias("_r"), F.lit(None).alias("_l"), F.lit(0).alias("_side"))
    el = left.select(*keys, F.col(t).alias("_t"), F.lit(None).alias("_r"), F.struct(*columns).alias("_l"), F.lit(1).alias("_side"))
    if width is None:
        width = bucket_width(left.select(*keys, F.col(t).alias("t")).unionByName(right.select(*keys, F.col(t).alias("t"))), keys)
    rows = el.unionByName(r).withColumn("_b", F.floor(F.col("_t") / width))
    up = Window.partitionBy(*keys, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "_b").orderBy(F.desc("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("_p", F.last("_r", ignorenulls=True).over(up)).withColumn("_n", F.last("_r", ignorenulls=True).over(down)).where("_side = 1")
    edges = rows.groupBy(*keys, "_b").agg(F.min_by("_r", F.when(F.col("_side") == 0, F.col("_t"))).alias("_first"), F.max_by("_r", F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.withColumn("_cp", F.last("_last", ignorenulls=True).over(earlier)).withColumn("_cn", F.last("_first", ignorenulls=True).over(later)).select(*keys, "_b", "_cp", "_cn")
    joined = near.join(carried, [*keys, "_b"], "left")
    timed = lambda c: F.when(F.col("_t").isNotNull(), c)
    return joined.select("_l.*", timed(F.coalesce("_p", "_cp")).alias("prev"), timed(F.coalesce("_n", "_cn")).alias("next"))


def age(side: str, t: str = "t") -> Column:
    """Distance in time to the neighbour, null if there is none."""
    return F.abs(F.col(t) - F.col(side)["t"])


def nearest(t: str = "t", tolerance: float | None = None) -> Column:
    """The nearer neighbour, the earlier one at equal distance; null beyond the tolerance."""
    pick = F.when(F.col("prev").isNull(), F.col("next")).when(F.col("next").isNull() | (age("prev", t) <= age("next", t)), F.col("prev")).otherwise(F.col("next"))
    return pick if tolerance is None else F.when(F.abs(F.col(t) - pick["t"]) <= tolerance, pick)


def forward_clamped() -> Column:
    """The first right row at or after, or the last one of all."""
    return F.coalesce(F.col("next"), F.col("prev"))


def lerp(value: str, t: str = "t", max_age: float | None = None) -> Column:
    """Linear interpolation between the neighbours.

    Beyond either end the end value holds. With ``max_age`` the nearer neighbour must be no older than that. A null or
    NaN value on either side gives null; equal stamps give the earlier value.
    """
    p, n = F.col("prev"), F.col("next")
    lo, hi = F.coalesce(p, n), F.coalesce(n, p)
    clean = lambda c: F.when(~F.isnan(c), c)
    a, b = clean(lo[value]), clean(hi[value])
    span = hi["t"] - lo["t"]
    f = F.when(span > 0, F.least(F.greatest((F.col(t) - lo["t"]) / span, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    out = a + f * (b - a)
    if max_age is None:
        return out
    best = F.least(F.coalesce(age("prev", t), F.lit(float("inf"))), F.coalesce(age("next", t), F.lit(float("inf"))))
    return F.when(best <= max_age, out)


def two_stage(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], offset: Column, tolerance: float, width: float | None = None) -> DataFrame:
    """Nearest within the tolerance by raw stamps, else by stamps moved by ``offset`` (if that isn't zero): ``match``, ``stage``."""
    first = bracket_join(left, right, keys, values, width).withColumn("m1", nearest(tolerance=tolerance)).drop("prev", "next")
    moved = first.withColumn("t_raw", F.col("t")).withColumn("t", F.col("t") + offset)
    second = bracket_join(moved, right, keys, values, width).withColumn("m2", nearest(tolerance=tolerance)).drop("prev", "next")
    again = F.abs(F.col("t") - F.col("t_raw")) > 1e-6
    return second.select(
        *[F.col("t_raw").alias("t") if c == "t" else F.col(c) for c in left.columns],
        F.coalesce("m1", F.when(again, F.col("m2"))).alias("match"),
        F.when(F.col("m1").isNotNull(), 1).when(again & F.col("m2").isNotNull(), 2).alias("stage"),
    )


def velocity_pairs(samples: DataFrame, keys: list[str], reach: float, low: float, high: float, value: str = "value") -> DataFrame:
    """Each sample with the oldest one within ``reach`` before it, if their distance lies in [low, high]: ``dt, rate``."""
    from skylattice.operators.sequence import rolling

    out = rolling(samples, keys, reach, {"_o": lambda w: F.first(F.struct("t", value)).over(w)}).withColumn("dt", F.col("t") - F.col("_o.t"))
    return out.where(F.col("dt").between(low, high)).withColumn("rate", (F.col(value) - F.col(f"_o.{value}")) / F.col("dt")).drop("_o")


def clock_offset(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Difference of the two clocks' first stamps per key: ``offset``."""
    return a.groupBy(*keys).agg(F.min("t").alias("_a")).join(b.groupBy(*keys).agg(F.min("t").alias("_b")), keys).select(*keys, (F.col("_a") - F.col("_b")).alias("offset"))
