"""The particle filter's steps as relational operators; a particle set is a table ``run, pid, x, y, yaw, scale, w``.

Random draws are hashes of (seed, stage, run, particle), so a retried task draws the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: str, *parts: Column) -> Column:
    """Uniform in [0, 1) from the hash of the parts."""
    text = F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def normal(seed: str, *parts: Column) -> Column:
    """Standard normal from two such numbers."""
    u1 = F.greatest(uniform(seed + "a", *parts), F.lit(1e-12))
    return F.sqrt(-2.0 * F.ln(u1)) * F.cos(2 * math.pi * uniform(seed + "b", *parts))


def initial(runs: DataFrame, n: int, std: tuple[float, float, float, float], seed: str = "init") -> DataFrame:
    """``n`` particles about each run's ``x, y, yaw, scale``, scale held within 0.7 to 1.3."""
    p = runs.withColumn("pid", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draw = lambda c, s: F.col(c) + s * normal(f"{seed}:{c}", F.col("run"), F.col("pid"))
    scale = F.least(F.greatest(draw("scale", std[3]), F.lit(0.7)), F.lit(1.3))
    return p.select("run", "pid", draw("x", std[0]).alias("x"), draw("y", std[1]).alias("y"), draw("yaw", std[2]).alias("yaw"), scale.alias("scale"), F.lit(1.0 / n).alias("w"))


def softmax(df: DataFrame, keys: list[str], score: str, temperature: float, name: str = "w", prior: str | None = None) -> DataFrame:
    """Adds weights ``exp((score - max) / T)`` scaled to sum 1 per key, times the ``prior`` weights if named."""
    top = df.groupBy(*keys).agg(F.max(score).alias("_m"))
    e = df.join(top, keys).withColumn("_e", F.exp((F.col(score) - F.col("_m")) / temperature) * (F.col(prior) if prior else F.lit(1.0)))
    total = e.groupBy(*keys).agg(F.sum("_e").alias("_t"))
    return e.join(total, keys).withColumn(name, F.col("_e") / F.col("_t")).drop("_m", "_e", "_t")


def estimate(p: DataFrame) -> DataFrame:
    """Per run: weighted ``x, y, scale``, circular ``yaw``, radial ``spread`` and effective sample size ``neff``.

    One aggregation: the spread follows from first and second moments about the run's own first particle.
    """
    ref = p.groupBy("run").agg(F.min(F.struct("pid", "x", "y")).alias("o")).select("run", F.col("o.x").alias("_ox"), F.col("o.y").alias("_oy"))
    q = p.join(ref, "run").withColumn("_x", F.col("x") - F.col("_ox")).withColumn("_y", F.col("y") - F.col("_oy"))
    s = lambda e: F.sum(F.col("w") * e)
    a = q.groupBy("run", "_ox", "_oy").agg(s(F.col("_x")).alias("mx"), s(F.col("_y")).alias("my"), s(F.col("_x") ** 2 + F.col("_y") ** 2).alias("m2"), s(F.sin("yaw")).alias("sn"), s(F.cos("yaw")).alias("cs"), s(F.col("scale")).alias("scale"), F.sum("w").alias("sw"), F.sum(F.col("w") ** 2).alias("ww"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("m2") - (2 - F.col("sw")) * (F.col("mx") ** 2 + F.col("my") ** 2)))
    return a.select("run", (F.col("_ox") * F.col("sw") + F.col("mx")).alias("x"), (F.col("_oy") * F.col("sw") + F.col("my")).alias("y"), F.atan2("sn", "cs").alias("yaw"), "scale", spread.alias("spread"), (1.0 / F.col("ww")).alias("neff"))


def predict(p: DataFrame, dx: Column, dy: Column, dyaw: Column, noise: tuple[float, float, float], seed: str = "predict") -> DataFrame:
    """Body motion turned by each particle's own heading, with noise."""
    key = (F.col("run"), F.col("pid"))
    x = F.col("x") + dx * F.cos("yaw") - dy * F.sin("yaw") + noise[0] * normal(f"{seed}:x", *key)
    y = F.col("y") + dx * F.sin("yaw") + dy * F.cos("yaw") + noise[1] * normal(f"{seed}:y", *key)
    return p.select("run", "pid", x.alias("x"), y.alias("y"), (F.col("yaw") + dyaw + noise[2] * normal(f"{seed}:yaw", *key)).alias("yaw"), "scale", "w")


def resample(p: DataFrame, share: float = 0.3, seed: str = "resample") -> DataFrame:
    """Systematic resampling of the runs whose effective sample size is below ``share`` of their particles.

    A particle's copies are the sampling points in its stretch of the cumulative weights, counted by arithmetic: no join
    of points with weights. Weights become equal; other runs are passed on as they are. A run's particles are bounded.
    """
    w = Window.partitionBy("run").orderBy("pid")
    whole = Window.partitionBy("run")
    q = p.withColumn("_n", F.count("*").over(whole)).withColumn("_ess", 1.0 / F.sum(F.col("w") ** 2).over(whole)).withColumn("_hi", F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.col("pid") == F.max("pid").over(whole)
    q = q.withColumn("_last", last).withColumn("_lo", F.coalesce(F.lag("_hi").over(w), F.lit(0.0))).withColumn("_hi", F.when(F.col("_last"), F.lit(1.0)).otherwise(F.col("_hi")))
    u = uniform(seed, F.col("run"))
    a, b = F.floor(F.col("_lo") * F.col("_n") - u) + 1, F.floor(F.col("_hi") * F.col("_n") - u)
    a, b = F.greatest(a, F.lit(0)), F.least(b, F.col("_n") - 1)
    poor = F.col("_ess") < share * F.col("_n")
    slots = F.when(poor, F.when(a <= b, F.sequence(a, b))).otherwise(F.array(F.col("pid").cast("long")))
    return q.withColumn("_s", F.explode(slots)).select("run", F.col("_s").alias("pid"), "x", "y", "yaw", "scale", F.when(poor, 1.0 / F.col("_n")).otherwise(F.col("w")).alias("w"))


def roughen(p: DataFrame, std: tuple[float, float, float, float], decay: float, seed: str = "roughen") -> DataFrame:
    """Jitter, scaled by ``decay``."""
    key = (F.col("run"), F.col("pid"))
    j = lambda c, s: F.col(c) + decay * s * normal(f"{seed}:{c}", *key)
    return p.select("run", "pid", j("x", std[0]).alias("x"), j("y", std[1]).alias("y"), j("yaw", std[2]).alias("yaw"), F.least(F.greatest(j("scale", std[3]), F.lit(0.7)), F.lit(1.3)).alias("scale"), "w")


def step(p: DataFrame, scores: DataFrame | None, motion: tuple[Column, Column, Column], noise: tuple[float, float, float], temperature: float, share: float, jitter: tuple[float, float, float, float], decay: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """One filter step: predict, weigh, estimate, resample, roughen. Returns (particles, estimate).

    ``scores`` has ``run, pid, score`` of the moved particles; without it the weights stay (a gated frame), and nothing
    is resampled.
    """
    moved = predict(p, *motion, noise, seed + ":p")
    if scores is None:
        return moved, estimate(moved)
    weighed = softmax(moved.join(scores, ["run", "pid"]).withColumnRenamed("w", "_w"), ["run"], "score", temperature, "w", "_w").drop("_w", "score")
    return roughen(resample(weighed, share, seed + ":r"), jitter, decay, seed + ":j"), estimate(weighed)
