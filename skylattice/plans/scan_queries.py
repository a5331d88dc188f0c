"""Queries of scoring, peaks and the particle filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.operators import particles as pf
from skylattice.operators import peaks as pk
from skylattice.operators import scoring
from skylattice.operators import sequence as seq
from skylattice.plans.common import E, events, r6, uniform_duck
from skylattice.session import load_table


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return scoring.score_pairs(v.where("id % 50 = 0").select("id", "vec"), v, ["label"])


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all cells as a grid of 25 columns for each of the stated queries, ``query_id`` being its key."""
    return _scores(spark, d).select("query_id", F.floor(F.col("row_id") / 25).cast("int").alias("i"), F.pmod("row_id", F.lit(25)).cast("int").alias("j"), F.round("score", 9).alias("score"))


def similarity_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to every fiftieth."""
    v = _vectors(spark, d)
    return scoring.search(v.where("id % 50 = 0"), v, 10).select("query_id", "row_id", r6("score").alias("score"), "rank")


def embedding_distance(spark: SparkSession, d: str) -> DataFrame:
    """Mean distance of every fiftieth vector from those of its own label and of others."""
    s = scoring.score_pairs(*(x for x in (_vectors(spark, d).where("id % 50 = 0").select("id", "vec"), _vectors(spark, d))), ["label"], scorer=_l2)
    own = _vectors(spark, d).select(F.col("id").alias("query_id"), F.col("label").alias("own"))
    j = s.join(own, "query_id").where("query_id <> row_id")
    return j.groupBy("query_id").agg(r6(F.avg(F.when(F.col("label") == F.col("own"), F.col("score"))), 5).alias("same"), r6(F.avg(F.when(F.col("label") != F.col("own"), F.col("score"))), 5).alias("other"))


def _l2(q, rows):  # noqa: ANN001, ANN202
    import numpy as np

    return np.sqrt(np.maximum(0.0, (rows**2).sum(1)[:, None] - 2 * rows @ q.T + (q**2).sum(1)[None, :]))


def best_per_yaw(spark: SparkSession, d: str) -> DataFrame:
    """The best cell of each heading for every query; the first at equal scores."""
    s = _scores(spark, d).withColumn("yaw", F.pmod("row_id", F.lit(8)).cast("int"))
    b = s.groupBy("query_id", "yaw").agg(F.max_by(F.struct("row_id", "score"), F.struct("score", -F.col("row_id"))).alias("b"))
    return b.select("query_id", "yaw", "b.row_id", r6("b.score").alias("score"))


def _peaks(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    return s.select("query_id", F.round("score", 9).alias("score"), (F.floor(F.col("row_id") / 25) * 40.0).alias("x"), (F.pmod("row_id", F.lit(25)) * 40.0).alias("y"), (F.pmod(F.col("row_id") * 7, F.lit(360))).cast("double").alias("yaw"))


def _suppressed(spark: SparkSession, d: str, k: int, same: pk.Duplicate) -> DataFrame:
    out = pk.suppress(_peaks(spark, d), ["query_id"], k, same)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), r6("score").alias("score"), "x", "y", "yaw")


def nms_peaks_100m(spark: SparkSession, d: str) -> DataFrame:
    """Eight peaks more than 100 m apart."""
    return _suppressed(spark, d, 8, pk.within(100.0, "x", "y"))


def nms_peaks_yaw(spark: SparkSession, d: str) -> DataFrame:
    """Three peaks, the same only if near in place and heading."""
    return _suppressed(spark, d, 3, pk.within_and_yaw(80.0, 30.0))


def nms_peaks_1m(spark: SparkSession, d: str) -> DataFrame:
    """Three peaks more than a metre apart."""
    return _suppressed(spark, d, 3, pk.within(1.0, "x", "y"))


def grid_local_maxima(spark: SparkSession, d: str) -> DataFrame:
    """Cells no lower than their neighbours, in the scan of each stated query."""
    return pk.local_maxima(_grid(spark, d), ["query_id"]).select("query_id", "i", "j", r6("score").alias("score"))


def multi_frame_median_grid(spark: SparkSession, d: str) -> DataFrame:
    """Per coarse cell the median over frames of the best score over headings."""
    s = _scores(spark, d).withColumn("cell", F.floor(F.col("row_id") / 25).cast("int"))
    best = s.groupBy("cell", "query_id").agg(F.max("score").alias("s"))
    return best.groupBy("cell").agg(r6(F.percentile("s", F.lit(0.5))).alias("median"))


def bilinear_grid(spark: SparkSession, d: str) -> DataFrame:
    """Scores between cells of each stated query's whole grid, held at the edges; the points are spread over its rows and a cell beyond."""
    g = _grid(spark, d)
    extent = g.groupBy("query_id").agg(F.max(F.struct("i", "j")).alias("m")).select("query_id", (F.col("m.i") + 1).alias("rows"), F.col("m.j").alias("last"))
    e = events(spark, d, "click").crossJoin(F.broadcast(extent))  # one row a stated query
    p = e.select("event_id", "query_id", (F.pmod("value", F.col("rows") + 2.0) - 1).alias("r"), (F.pmod(F.col("value") * 3, F.lit(27.0)) - 1).alias("c"), "rows", "last")
    return pk.bilinear(g, p, ["query_id"], F.col("rows"), 25, F.col("last")).select("query_id", "event_id", r6("value").alias("value"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    own = _vectors(spark, d).select(F.col("id").alias("query_id"), F.col("label").alias("own"))
    return _scores(spark, d).join(own, "query_id").where("query_id <> row_id").withColumn("kind", F.when(F.col("label") == F.col("own"), "truth").when(F.abs(F.col("label") - F.col("own")) == 1, "near").otherwise("far"))


def truth_vs_false_gate(spark: SparkSession, d: str) -> DataFrame:
    """Best score at the true place against those elsewhere: win rates, margin and its low end."""
    b = _judged(spark, d).groupBy("query_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("score"))).alias(k) for k in ("truth", "near", "far")])
    m = b.withColumn("margin", F.col("truth") - F.greatest("near", "far"))
    return m.agg(
        F.count("*").alias("frames"),
        r6(F.avg((F.col("margin") > 0).cast("double"))).alias("win"),
        r6(F.avg(F.when(F.col("truth") > 0.5, (F.col("margin") > 0).cast("double")))).alias("win_given_hit"),
        r6(F.percentile("margin", F.lit(0.5))).alias("margin_median"),
        r6(F.percentile("truth", F.lit(0.1))).alias("truth_p10"),
    )


def cross_flight_gate(spark: SparkSession, d: str) -> DataFrame:
    """The same per label, with whether the label passes."""
    b = _judged(spark, d).groupBy("own", "query_id").agg(F.max(F.when(F.col("kind") == "truth", F.col("score"))).alias("truth"), F.max(F.when(F.col("kind") != "truth", F.col("score"))).alias("false"))
    g = b.groupBy("own").agg(F.count("*").alias("frames"), F.percentile("truth", F.lit(0.5)).alias("t"), F.avg((F.col("truth") > F.col("false")).cast("double")).alias("win"))
    return g.select("own", "frames", r6("t").alias("truth_median"), r6("win").alias("win"), ((F.col("t") > 0.5) & (F.col("win") >= 0.5)).alias("passed"))


def profile_groups(spark: SparkSession, d: str) -> DataFrame:
    """Means of overlapping groups: all, hits, misses, misses recovered elsewhere."""
    b = _judged(spark, d).groupBy("query_id").agg(F.max(F.when(F.col("kind") == "truth", F.col("score"))).alias("truth"), F.max(F.when(F.col("kind") != "truth", F.col("score"))).alias("false"))
    hit = F.col("truth") > F.col("false")
    groups = F.filter(F.array(F.lit("all"), F.when(hit, "hit"), F.when(~hit, "miss"), F.when(~hit & (F.col("truth") > 0.5), "recovered")), lambda x: x.isNotNull())
    return b.withColumn("grp", F.explode(groups)).groupBy("grp").agg(F.count("*").alias("n"), r6(F.avg("truth")).alias("truth"), r6(F.avg("false")).alias("false_score"))


def bce_rank_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Cross-entropy, ranking accuracy and mean scores of true and false pairs."""
    j = _judged(spark, d).withColumn("y", F.col("kind") == "truth")
    eps = 1e-7
    p = F.least(F.greatest("score", F.lit(eps)), F.lit(1 - eps))
    loss = F.when(F.col("y"), -F.ln(p)).otherwise(-F.ln(1 - p))
    per = j.groupBy("query_id").agg(F.avg(F.when(F.col("y"), F.col("score"))).alias("pos"), F.avg(F.when(~F.col("y"), F.col("score"))).alias("neg"))
    a = j.agg(r6(F.avg(loss)).alias("bce"), r6(F.avg(F.when(F.col("y"), F.col("score")))).alias("mean_pos"), r6(F.avg(F.when(~F.col("y"), F.col("score")))).alias("mean_neg"))
    return a.join(F.broadcast(per.agg(r6(F.avg((F.col("pos") > F.col("neg")).cast("double"))).alias("accuracy"))))  # one row each


def black_patch_gate(spark: SparkSession, d: str) -> DataFrame:
    """Scores with black patches set to 0, to -1, or left, by scan policy."""
    e = events(spark, d, "click")
    black = F.col("value") < 5
    return e.select("event_id", F.when(black, 0.0).otherwise(F.col("value")).alias("particles"), F.when(black, -1.0).otherwise(F.col("value")).alias("steered"), F.col("value").alias("coarse"), (F.col("value") < 88).alias("motion_only"))


def rotation_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Two-stage search of each vector's heading: steps of 2 degrees, then half degrees about the best, both inside the row."""
    s = _vectors(spark, d).select("id", F.pmod(F.col("id") * 37, F.lit(720)).cast("double").alias("true2"))
    # the best score, the smallest angle at equal scores
    best = lambda angles: F.array_max(F.transform(angles, lambda a: F.struct(F.round(F.cos(F.radians(a - F.col("true2") / 2)), 9).alias("s"), (-a).alias("n"))))
    coarse = s.withColumn("a0", -best(F.transform(F.sequence(F.lit(0), F.lit(358), F.lit(2)), lambda i: i.cast("double")))["n"])
    fine = coarse.withColumn("b", best(F.transform(F.sequence(F.lit(-8), F.lit(8)), lambda i: F.col("a0") + i * 0.5)))
    return fine.select("id", r6(-F.col("b.n")).alias("angle"), r6("b.s").alias("score"))


def consensus_motion(spark: SparkSession, d: str) -> DataFrame:
    """Motion agreed on by the last seven frames: resultant over mean length at least 0.6 from four frames on."""
    e = events(spark, d, "view").withColumn("dx", F.cos(F.col("value") / 30) * 5).withColumn("dy", F.sin(F.col("value") / 30) * 5)
    agree = lambda w: F.sqrt(F.avg("dx").over(w) ** 2 + F.avg("dy").over(w) ** 2) / F.avg(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)).over(w)
    med = lambda c: lambda w: F.percentile(c, F.lit(0.5)).over(w)
    # the last seven rows are the last six units of the row's index
    out = seq.rolling(seq.index_in_order(e, ["run"]), ["run"], 6, {"n": lambda w: F.count("*").over(w), "agree": lambda w: F.round(agree(w), 9), "mx": med("dx"), "my": med("dy")}, on="k", width=1024)
    return out.where("n >= 4 and agree >= 0.6").select("event_id", r6("agree").alias("agree"), r6("mx").alias("dx"), r6("my").alias("dy"))


def linspace_frames(spark: SparkSession, d: str) -> DataFrame:
    """At most nine frames of each run, evenly spaced, both ends included."""
    e = seq.index_in_order(events(spark, d, "click"), ["run"])
    e = e.join(e.groupBy("run").agg(F.count("*").alias("n")), "run")
    marks = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.bround(i * (F.col("n") - 1) / 8.0).cast("long"))
    return e.where(F.array_contains(marks, F.col("k").cast("long"))).select("event_id", "run")


def alignment_vote(spark: SparkSession, d: str) -> DataFrame:
    """The displacement most matches agree on within 2 px, and the mean of those that do; per run of bounded matches."""
    e = events(spark, d, "view").select("run", "event_id", (F.pmod(F.col("value"), F.lit(20.0))).alias("dx"), F.pmod(F.col("value") * 3, F.lit(20.0)).alias("dy"))
    cell = lambda c: F.floor(F.col(c) / 2.0)
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    base = e.withColumn("o", F.explode(around)).select("run", F.col("event_id").alias("e0"), F.col("dx").alias("x0"), F.col("dy").alias("y0"), (cell("dx") + F.col("o.a")).alias("ci"), (cell("dy") + F.col("o.b")).alias("cj"))
    j = base.join(e.withColumn("ci", cell("dx")).withColumn("cj", cell("dy")), ["run", "ci", "cj"]).where("(dx - x0) * (dx - x0) + (dy - y0) * (dy - y0) < 4")
    votes = j.groupBy("run", "e0").agg(F.count("*").alias("n"), F.avg("dx").alias("mx"), F.avg("dy").alias("my"))
    b = votes.groupBy("run").agg(F.max_by(F.struct("n", "mx", "my"), F.struct("n", -F.col("e0"))).alias("b"))
    return b.select("run", F.col("b.n").alias("inliers"), r6("b.mx").alias("dx"), r6("b.my").alias("dy"))


def _particles(spark: SparkSession, d: str) -> DataFrame:
    """Particles of the scans of all stated queries: a run is a query and a label, scores are the likelihoods."""
    return _placed(_scores(spark, d).select(F.struct("query_id", "label").alias("run"), F.col("row_id").alias("pid"), "score"))


def _placed(s: DataFrame) -> DataFrame:
    u = lambda k: pf.uniform(k, F.col("run"), F.col("pid"))
    return s.select("run", "pid", "score", (u("x") * 200 - 100).alias("x"), (u("y") * 200 - 100).alias("y"), (u("yaw") * 6 - 3).alias("yaw"), (0.8 + u("s") * 0.4).alias("scale"))


def _weighed(spark: SparkSession, d: str) -> DataFrame:
    return pf.softmax(_particles(spark, d), ["run"], "score", 0.05)


def softmax_weights(spark: SparkSession, d: str) -> DataFrame:
    """Likelihoods as weights."""
    return _weighed(spark, d).select("run.query_id", "run.label", "pid", r6("w", 9).alias("w"))


def ess_by_run(spark: SparkSession, d: str) -> DataFrame:
    """Effective sample sizes."""
    return pf.estimate(_weighed(spark, d)).select("run.query_id", "run.label", r6("neff").alias("neff"))


def weighted_pose(spark: SparkSession, d: str) -> DataFrame:
    """Weighted positions, headings and spreads."""
    return pf.estimate(_weighed(spark, d)).select("run.query_id", "run.label", *[r6(c).alias(c) for c in ("x", "y", "yaw", "scale", "spread")])


def systematic_resample(spark: SparkSession, d: str) -> DataFrame:
    """Particles drawn in proportion to their weights."""
    return pf.resample(_weighed(spark, d), 1.1).select("run.query_id", "run.label", "pid", r6("x").alias("x"), r6("w", 9).alias("w"))


def predict_step(spark: SparkSession, d: str) -> DataFrame:
    """Particles moved by a body motion, without noise."""
    p = pf.predict(_weighed(spark, d), F.lit(4.0), F.lit(-1.0), F.lit(0.1), (0.0, 0.0, 0.0))
    return p.select("run.query_id", "run.label", "pid", r6("x").alias("x"), r6("y").alias("y"), r6("yaw").alias("yaw"))


def roughen_step(spark: SparkSession, d: str) -> DataFrame:
    """Particles jittered by hashed normals."""
    p = pf.roughen(_weighed(spark, d), (2.0, 2.0, 0.05, 0.01), 0.5)
    return p.select("run.query_id", "run.label", "pid", r6("x").alias("x"), r6("scale").alias("scale"))


def particle_init(spark: SparkSession, d: str) -> DataFrame:
    """A hundred particles about each label's point."""
    runs = _vectors(spark, d).select(F.col("label").alias("run")).distinct().select("run", (F.col("run") * 10.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("yaw"), F.lit(1.0).alias("scale"))
    return pf.initial(runs, 100, (25.0, 25.0, 0.3, 0.03)).select("run", "pid", r6("x").alias("x"), r6("w").alias("w"))


def mixture_init(spark: SparkSession, d: str) -> DataFrame:
    """Particles shared out evenly among the peaks of a scan."""
    p = pk.suppress(_peaks(spark, d), ["query_id"], 4, pk.within(100.0, "x", "y")).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    q = p.withColumn("m", F.explode(F.sequence(F.lit(0), F.floor(F.lit(100) / F.col("n")).cast("int") - 1))).withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("query_id")))
    return q.groupBy("query_id", "rank").agg(F.count("*").alias("n"), r6(F.sum("w")).alias("w"), F.min("x").alias("x"), F.min("y").alias("y")).withColumn("rank", F.col("rank").cast("int"))


def refined_union(spark: SparkSession, d: str) -> DataFrame:
    """The first two peaks moved to their refined place, with the rest as they were."""
    p = pk.suppress(_peaks(spark, d), ["query_id"], 6, pk.within(100.0, "x", "y"))
    fine = p.where("rank < 2").select("query_id", "rank", (F.col("x") + 8.0).alias("x"), "y", F.lit("refined").alias("kind"))
    rest = p.where("rank >= 2").select("query_id", "rank", "x", "y", F.lit("nominee").alias("kind"))
    return fine.unionByName(rest).withColumn("rank", F.col("rank").cast("int"))


def dr_filter_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Peaks that dead reckoning allows, unless it would block them all."""
    p = pk.suppress(_peaks(spark, d), ["query_id"], 6, pk.within(100.0, "x", "y")).withColumn("ok", F.hypot(F.col("x") - 400.0, F.col("y") - 500.0) <= 300.0)
    g = p.withColumn("passed", F.max(F.col("ok").cast("int")).over(Window.partitionBy("query_id")))
    return g.select("query_id", F.col("rank").cast("int").alias("rank"), "ok", (F.col("passed") == 0).alias("blocked"))


def filter_step_once(spark: SparkSession, d: str) -> DataFrame:
    """A whole step of the filter without noise: the estimate before resampling."""
    p = _particles(spark, d).withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("run")))
    zero = (0.0, 0.0, 0.0)
    _, est = pf.step(p.drop("score"), p.select("run", "pid", "score"), (F.lit(4.0), F.lit(-1.0), F.lit(0.1)), zero, 0.05, 0.3, (2.0, 2.0, 0.05, 0.01), 1.0, "s")
    return est.select("run.query_id", "run.label", *[r6(c).alias(c) for c in ("x", "y", "yaw", "scale", "spread", "neff")])


def waypoint_progress(spark: SparkSession, d: str) -> DataFrame:
    """How many waypoints each run has reached in order, several at a time allowed."""
    e = events(spark, d, "view").withColumn("reached", F.floor(F.col("value") / 25))
    return seq.running_max(e, ["run"], "reached", "wp").select("event_id", F.col("wp").cast("int").alias("wp"))


def _dot(a: str, b: str) -> str:
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


_SC = f"""s AS (SELECT q.vec_id AS query_id, q.label AS own, r.vec_id AS row_id, r.label, 1.0 / (1.0 + exp(-5.0 * {_dot('q.embedding', 'r.embedding')})) AS score
FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0)"""
_GRID = f"{_SC}, g AS (SELECT query_id, CAST(row_id // 25 AS INTEGER) AS i, CAST(row_id % 25 AS INTEGER) AS j, round(score, 9) AS score FROM s)"
_J = f"{_SC}, j AS (SELECT *, CASE WHEN label = own THEN 'truth' WHEN abs(label - own) = 1 THEN 'near' ELSE 'far' END AS kind FROM s WHERE query_id <> row_id)"
_PEAKS = f"{_SC}, p AS (SELECT query_id, {{'score': round(score, 9), 'x': (row_id // 25) * 40.0::DOUBLE, 'y': (row_id % 25) * 40.0::DOUBLE, 'yaw': CAST((row_id * 7) % 360 AS DOUBLE)}} AS p FROM s), l AS (SELECT query_id, list_sort(list(p), 'DESC') AS a FROM p GROUP BY query_id)"


def _nms(k: int, same: str) -> str:
    return f"""{_PEAKS}, k AS (SELECT query_id, list_reduce(list_transform(a, lambda e: [e]), lambda kept, e: CASE WHEN len(kept) < {k} AND len(list_filter(kept, lambda o: {same})) = 0 THEN list_concat(kept, e) ELSE kept END) AS a FROM l),
u AS (SELECT query_id, unnest(generate_series(1, len(a))) AS i, a FROM k), n AS (SELECT query_id, CAST(i - 1 AS INTEGER) AS rank, a[i].score AS score, a[i].x AS x, a[i].y AS y, a[i].yaw AS yaw FROM u)"""


_APART = "(o.x - e[1].x) * (o.x - e[1].x) + (o.y - e[1].y) * (o.y - e[1].y) <= {0}"
_TURN = "abs((o.yaw - e[1].yaw + 180.0) - 360.0 * floor((o.yaw - e[1].yaw + 180.0) / 360.0) - 180.0) <= 30.0"
#: A run as Spark writes a struct of query and label.
_RUN = "concat('{', query_id, ', ', label, '}')"
_U = {k: uniform_duck(f"concat_ws(':', '{k}', {_RUN}, row_id)") for k in ("x", "y", "yaw", "s")}
_PART = f"{_SC}, p AS (SELECT {_RUN} AS run, row_id AS pid, score, {_U['x']} * 200 - 100 AS x, {_U['y']} * 200 - 100 AS y, {_U['yaw']} * 6 - 3 AS yaw, 0.8 + {_U['s']} * 0.4 AS scale FROM s)"
_WEIGH = f"{_PART}, v AS (SELECT *, exp((score - max(score) OVER (PARTITION BY run)) / 0.05) AS e FROM p), w AS (SELECT *, e / sum(e) OVER (PARTITION BY run) AS w FROM v)"
_EST = """m AS (SELECT run, sum(w * x) AS x, sum(w * y) AS y, atan2(sum(w * sin(yaw)), sum(w * cos(yaw))) AS yaw, sum(w * scale) AS scale, 1 / sum(w * w) AS neff FROM w GROUP BY run),
t AS (SELECT m.*, d.spread FROM m JOIN (SELECT w.run, sqrt(sum(w.w * ((w.x - m.x) * (w.x - m.x) + (w.y - m.y) * (w.y - m.y)))) AS spread FROM w JOIN m ON w.run = m.run GROUP BY w.run) d ON m.run = d.run)"""


def _norm(seed: str, parts: str) -> str:
    return f"sqrt(-2.0 * ln(greatest({uniform_duck(f'concat_ws({chr(39)}:{chr(39)}, {chr(39)}{seed}a{chr(39)}, {parts})')}, 1e-12))) * cos(2 * pi() * {uniform_duck(f'concat_ws({chr(39)}:{chr(39)}, {chr(39)}{seed}b{chr(39)}, {parts})')})"


def _by_run(sql: str) -> str:
    """The query's rows with the run's parts instead of the run."""
    return f"SELECT CAST(regexp_extract(run, '([0-9]+),', 1) AS BIGINT) AS query_id, CAST(regexp_extract(run, ', ([0-9]+)', 1) AS INTEGER) AS label, * EXCLUDE (run) FROM ({sql})"


_UR = uniform_duck("concat_ws(':', 'resample', run)")
QUERIES = {
    f.__name__: f
    for f in (
        similarity_topk, embedding_distance, best_per_yaw, nms_peaks_100m, nms_peaks_yaw, nms_peaks_1m, grid_local_maxima, multi_frame_median_grid, bilinear_grid,
        truth_vs_false_gate, cross_flight_gate, profile_groups, bce_rank_accuracy, black_patch_gate, rotation_sweep, consensus_motion, linspace_frames, alignment_vote,
        softmax_weights, ess_by_run, weighted_pose, systematic_resample, predict_step, roughen_step, particle_init, mixture_init, refined_union, dr_filter_peaks,
        filter_step_once, waypoint_progress,
    )
}
ORACLES = {
    "similarity_topk": f"""WITH s AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, {_dot('q.embedding', 'r.embedding')} AS score FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0)
SELECT query_id, row_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""",
    "embedding_distance": """WITH s AS (SELECT q.vec_id AS query_id, q.label AS own, r.label, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS dist FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, round(avg(CASE WHEN label = own THEN dist END), 5) AS same, round(avg(CASE WHEN label <> own THEN dist END), 5) AS other FROM s GROUP BY query_id""",
    "best_per_yaw": f"WITH {_SC} SELECT query_id, CAST(row_id % 8 AS INTEGER) AS yaw, row_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id, row_id % 8 ORDER BY score DESC, row_id) = 1",
    "nms_peaks_100m": f"WITH {_nms(8, _APART.format(10000))} SELECT query_id, rank, round(score, 6) AS score, x, y, yaw FROM n",
    "nms_peaks_yaw": f"WITH {_nms(3, _APART.format(6400) + ' AND ' + _TURN)} SELECT query_id, rank, round(score, 6) AS score, x, y, yaw FROM n",
    "nms_peaks_1m": f"WITH {_nms(3, _APART.format(1))} SELECT query_id, rank, round(score, 6) AS score, x, y, yaw FROM n",
    "grid_local_maxima": f"WITH {_GRID}, m AS (SELECT a.i, a.j, any_value(a.score) AS score, max(b.score) AS best, a.query_id FROM g a JOIN g b ON a.query_id = b.query_id AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY a.query_id, a.i, a.j) SELECT query_id, i, j, round(score, 6) AS score FROM m WHERE score = best",
    "multi_frame_median_grid": f"WITH {_SC}, b AS (SELECT CAST(row_id // 25 AS INTEGER) AS cell, query_id, max(score) AS s FROM s GROUP BY ALL) SELECT cell, round(quantile_cont(s, 0.5), 6) AS median FROM b GROUP BY cell",
    "bilinear_grid": f"""WITH {E}, {_GRID}, x AS (SELECT query_id, max(i) AS top, arg_max(j, i * 25 + j) AS tail FROM g GROUP BY query_id),
p AS (SELECT event_id, query_id, top, tail, value - (top + 3.0) * floor(value / (top + 3.0)) - 1 AS r, value * 3 - 27.0 * floor(value * 3 / 27.0) - 1 AS c FROM e, x WHERE topic = 'click'),
f AS (SELECT *, CAST(least(greatest(floor(r), 0), top) AS INTEGER) AS r0, CAST(least(greatest(floor(c), 0), 24) AS INTEGER) AS c0 FROM p), h AS (SELECT *, least(greatest(r - r0, 0.0), 1.0) AS fr, least(greatest(c - c0, 0.0), 1.0) AS fc, least(r0 + 1, top) AS r1, least(c0 + 1, 24) AS c1 FROM f),
k AS (SELECT *, CASE WHEN r0 = top THEN least(c0, tail) ELSE c0 END AS a0, CASE WHEN r0 = top THEN least(c1, tail) ELSE c1 END AS a1, CASE WHEN r1 = top THEN least(c0, tail) ELSE c0 END AS b0, CASE WHEN r1 = top THEN least(c1, tail) ELSE c1 END AS b1 FROM h)
SELECT k.query_id, event_id, round(a.score * (1 - fr) * (1 - fc) + b.score * (1 - fr) * fc + u.score * fr * (1 - fc) + v.score * fr * fc, 6) AS value FROM k JOIN g a ON a.query_id = k.query_id AND a.i = r0 AND a.j = a0
JOIN g b ON b.query_id = k.query_id AND b.i = r0 AND b.j = a1 JOIN g u ON u.query_id = k.query_id AND u.i = r1 AND u.j = b0 JOIN g v ON v.query_id = k.query_id AND v.i = r1 AND v.j = b1""",
    "truth_vs_false_gate": f"""WITH {_J}, b AS (SELECT query_id, max(CASE WHEN kind = 'truth' THEN score END) AS truth, max(CASE WHEN kind = 'near' THEN score END) AS near, max(CASE WHEN kind = 'far' THEN score END) AS far FROM j GROUP BY query_id), m AS (SELECT *, truth - greatest(near, far) AS margin FROM b)
SELECT count(*) AS frames, round(avg(CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END), 6) AS win, round(avg(CASE WHEN truth > 0.5 THEN CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END END), 6) AS win_given_hit, round(quantile_cont(margin, 0.5), 6) AS margin_median, round(quantile_cont(truth, 0.1), 6) AS truth_p10 FROM m""",
    "cross_flight_gate": f"""WITH {_J}, b AS (SELECT own, query_id, max(CASE WHEN kind = 'truth' THEN score END) AS t, max(CASE WHEN kind <> 'truth' THEN score END) AS f FROM j GROUP BY ALL), g AS (SELECT own, count(*) AS frames, quantile_cont(t, 0.5) AS t, avg(CASE WHEN t > f THEN 1.0 ELSE 0.0 END) AS win FROM b GROUP BY own)
SELECT own, frames, round(t, 6) AS truth_median, round(win, 6) AS win, t > 0.5 AND win >= 0.5 AS passed FROM g""",
    "profile_groups": f"""WITH {_J}, b AS (SELECT query_id, max(CASE WHEN kind = 'truth' THEN score END) AS t, max(CASE WHEN kind <> 'truth' THEN score END) AS f FROM j GROUP BY query_id),
u AS (SELECT 'all' AS grp, * FROM b UNION ALL SELECT 'hit', * FROM b WHERE t > f UNION ALL SELECT 'miss', * FROM b WHERE NOT t > f UNION ALL SELECT 'recovered', * FROM b WHERE NOT t > f AND t > 0.5)
SELECT grp, count(*) AS n, round(avg(t), 6) AS truth, round(avg(f), 6) AS false_score FROM u GROUP BY grp""",
    "bce_rank_accuracy": f"""WITH {_J}, l AS (SELECT query_id, kind = 'truth' AS y, score, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM j), a AS (SELECT round(avg(CASE WHEN y THEN -ln(p) ELSE -ln(1 - p) END), 6) AS bce, round(avg(CASE WHEN y THEN score END), 6) AS mean_pos, round(avg(CASE WHEN NOT y THEN score END), 6) AS mean_neg FROM l),
q AS (SELECT avg(CASE WHEN y THEN score END) AS a, avg(CASE WHEN NOT y THEN score END) AS b FROM l GROUP BY query_id) SELECT a.*, round((SELECT avg(CASE WHEN a > b THEN 1.0 ELSE 0.0 END) FROM q), 6) AS accuracy FROM a""",
    "black_patch_gate": f"WITH {E} SELECT event_id, CASE WHEN value < 5 THEN 0.0::DOUBLE ELSE value END AS particles, CASE WHEN value < 5 THEN -1.0::DOUBLE ELSE value END AS steered, value AS coarse, value < 88 AS motion_only FROM e WHERE topic = 'click'",
    "rotation_sweep": """WITH v AS (SELECT vec_id AS id, CAST((vec_id * 37) % 720 AS DOUBLE) AS t2 FROM embeddings), c AS (SELECT id, t2, CAST(g.a AS DOUBLE) AS a0, round(cos(radians(g.a - t2 / 2)), 9) AS sc FROM v, generate_series(0, 358, 2) AS g(a) QUALIFY row_number() OVER (PARTITION BY id ORDER BY sc DESC, a0) = 1),
f AS (SELECT id, a0 + h.k * 0.5::DOUBLE AS ang, round(cos(radians(a0 + h.k * 0.5::DOUBLE - t2 / 2)), 9) AS sc FROM c, generate_series(-8, 8) AS h(k)) SELECT id, round(ang, 6) AS angle, round(sc, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY sc DESC, ang) = 1""",
    "consensus_motion": f"""WITH {E}, v AS (SELECT *, cos(value / 30) * 5 AS dx, sin(value / 30) * 5 AS dy FROM e WHERE topic = 'view'), w AS (SELECT event_id, count(*) OVER w AS n, round(sqrt(pow(avg(dx) OVER w, 2) + pow(avg(dy) OVER w, 2)) / avg(sqrt(dx * dx + dy * dy)) OVER w, 9) AS agree, quantile_cont(dx, 0.5) OVER w AS mx, quantile_cont(dy, 0.5) OVER w AS my FROM v WINDOW w AS (PARTITION BY run ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT event_id, round(agree, 6) AS agree, round(mx, 6) AS dx, round(my, 6) AS dy FROM w WHERE n >= 4 AND agree >= 0.6""",
    "linspace_frames": f"""WITH {E}, f AS (SELECT event_id, run, row_number() OVER (PARTITION BY run ORDER BY t, event_id) - 1 AS k, count(*) OVER (PARTITION BY run) AS n FROM e WHERE topic = 'click')
SELECT event_id, run FROM f WHERE list_contains(list_transform(generate_series(0, 8), lambda i: CAST(round_even(i * (n - 1) / 8.0, 0) AS BIGINT)), k)""",
    "alignment_vote": f"""WITH {E}, m AS (SELECT run, event_id, value - 20.0 * floor(value / 20.0) AS dx, value * 3 - 20.0 * floor(value * 3 / 20.0) AS dy FROM e WHERE topic = 'view'), v AS (SELECT a.run, a.event_id, count(*) AS n, avg(b.dx) AS mx, avg(b.dy) AS my FROM m a JOIN m b ON a.run = b.run AND (a.dx - b.dx) * (a.dx - b.dx) + (a.dy - b.dy) * (a.dy - b.dy) < 4 GROUP BY ALL)
SELECT run, n AS inliers, round(mx, 6) AS dx, round(my, 6) AS dy FROM v QUALIFY row_number() OVER (PARTITION BY run ORDER BY n DESC, event_id) = 1""",
    "softmax_weights": _by_run(f"WITH {_WEIGH} SELECT run, pid, round(w, 9) AS w FROM w"),
    "ess_by_run": _by_run(f"WITH {_WEIGH} SELECT run, round(1 / sum(w * w), 6) AS neff FROM w GROUP BY run"),
    "weighted_pose": _by_run(f"WITH {_WEIGH}, {_EST} SELECT run, round(x, 6) AS x, round(y, 6) AS y, round(yaw, 6) AS yaw, round(scale, 6) AS scale, round(spread, 6) AS spread FROM t"),
    "systematic_resample": _by_run(f"""WITH {_WEIGH}, c AS (SELECT *, count(*) OVER (PARTITION BY run) AS n, CASE WHEN pid = max(pid) OVER (PARTITION BY run) THEN 1.0 ELSE sum(w) OVER (PARTITION BY run ORDER BY pid) END AS hi FROM w), h AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY run ORDER BY pid), 0.0) AS lo FROM c),
g AS (SELECT DISTINCT run, n, unnest(generate_series(0, n - 1)) AS i, {_UR} AS u FROM h) SELECT g.run, g.i AS pid, round(h.x, 6) AS x, round(1.0 / g.n, 9) AS w FROM g JOIN h ON g.run = h.run AND (g.i + g.u) / g.n > h.lo AND (g.i + g.u) / g.n <= h.hi"""),
    "predict_step": _by_run(f"WITH {_PART} SELECT run, pid, round(x + 4.0 * cos(yaw) + sin(yaw), 6) AS x, round(y + 4.0 * sin(yaw) - cos(yaw), 6) AS y, round(yaw + 0.1, 6) AS yaw FROM p"),
    "roughen_step": _by_run(f"WITH {_PART} SELECT run, pid, round(x + 0.5 * 2.0 * {_norm('roughen:x', 'run, pid')}, 6) AS x, round(least(greatest(scale + 0.5 * 0.01 * {_norm('roughen:scale', 'run, pid')}, 0.7), 1.3), 6) AS scale FROM p"),
    "particle_init": f"WITH r AS (SELECT DISTINCT label AS run FROM embeddings), p AS (SELECT run, CAST(pid AS INTEGER) AS pid FROM r, generate_series(0, 99) AS g(pid)) SELECT run, pid, round(run * 10.0 + 25.0 * {_norm('init:x', 'run, pid')}, 6) AS x, 0.01::DOUBLE AS w FROM p",
    "mixture_init": f"WITH {_nms(4, _APART.format(10000))}, c AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM n) SELECT query_id, rank, 100 // n AS n, round((100 // n) / (n * (100 // n)), 6) AS w, x, y FROM c",
    "refined_union": f"WITH {_nms(6, _APART.format(10000))} SELECT query_id, rank, x + CASE WHEN rank < 2 THEN 8.0 ELSE 0.0 END AS x, y, CASE WHEN rank < 2 THEN 'refined' ELSE 'nominee' END AS kind FROM n",
    "dr_filter_peaks": f"WITH {_nms(6, _APART.format(10000))}, o AS (SELECT *, sqrt((x - 400.0) * (x - 400.0) + (y - 500.0) * (y - 500.0)) <= 300.0 AS ok FROM n) SELECT query_id, rank, ok, NOT bool_or(ok) OVER (PARTITION BY query_id) AS blocked FROM o",
    "filter_step_once": _by_run(f"""WITH {_PART}, q AS (SELECT run, pid, score, x + 4.0 * cos(yaw) + sin(yaw) AS x, y + 4.0 * sin(yaw) - cos(yaw) AS y, yaw + 0.1 AS yaw, scale FROM p), v AS (SELECT *, exp((score - max(score) OVER (PARTITION BY run)) / 0.05) AS e FROM q), w AS (SELECT *, e / sum(e) OVER (PARTITION BY run) AS w FROM v), {_EST}
SELECT run, round(x, 6) AS x, round(y, 6) AS y, round(yaw, 6) AS yaw, round(scale, 6) AS scale, round(spread, 6) AS spread, round(neff, 6) AS neff FROM t"""),
    "waypoint_progress": f"WITH {E} SELECT event_id, CAST(max(floor(value / 25)) OVER (PARTITION BY run ORDER BY t) AS INTEGER) AS wp FROM e WHERE topic = 'view'",
}
