"""Similarity of feature vectors: a pluggable scorer over blocks, and exact search.

Both sides are packed into blocks of a few thousand vectors, one row each, where they lie; every block of rows meets
every block of the stated queries, on the executors, and a task multiplies two blocks and keeps what the caller wants of
the product. The queries' blocks are sent to all tasks only while they are known to be few; beyond that Spark pairs the
blocks by partitions. Nothing is collected and no rows are paired by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048
#: Most stated queries that are sent to every task: at 1,000 numbers a vector these are 400 MB.
MOST_SENT = 50_000


def logistic_score(queries: np.ndarray, rows: np.ndarray, scale: float = 5.0) -> np.ndarray:
    """The default scorer: logistic of the scaled dot product, shape (rows, queries)."""
    return 1.0 / (1.0 + np.exp(-scale * (rows @ queries.T)))


def _packed(df: DataFrame, extra: list[str], name: str, block: int) -> DataFrame:
    """One row for each ``block`` vectors: ``{name}_ids``, ``{name}_vecs`` (their numbers in one binary), and the extra columns as arrays."""
    types = dict(df.dtypes)
    schema = f"{name}_ids array<long>, {name}_vecs binary" + "".join(f", {name}_{c} array<{types[c]}>" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, block):
                part = b.slice(lo, block)
                n = part.num_rows
                one = lambda v, n=n: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), v)
                numbers = part.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                columns = [one(part.column(0)), pa.array([numbers.tobytes()], pa.binary()), *(one(part.column(2 + k)) for k in range(len(extra)))]
                yield pa.RecordBatch.from_arrays(columns, names=[f"{name}_ids", f"{name}_vecs", *(f"{name}_{c}" for c in extra)])

    return df.where("id is not null and vec is not null and size(vec) > 0").select("id", "vec", *extra).mapInArrow(run, schema)


def _met(queries: DataFrame, rows: DataFrame, extra: list[str], block: int, most_sent: int) -> DataFrame:
    """Blocks of rows beside blocks of queries."""
    stated = queries.where("vec is not null").select("id", "vec")
    few = stated.limit(most_sent + 1).count() <= most_sent
    parts = _packed(stated.coalesce(1) if few else stated, [], "q", block)
    return _packed(rows, extra, "r", block).crossJoin(F.broadcast(parts) if few else parts)


def _matrices(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    q, r = np.asarray(row["q_ids"]), np.asarray(row["r_ids"])
    return q, np.frombuffer(row["q_vecs"]).reshape(len(q), -1), r, np.frombuffer(row["r_vecs"]).reshape(len(r), -1)


def score_pairs(queries: DataFrame, rows: DataFrame, extra: list[str], scorer: Callable[[np.ndarray, np.ndarray], np.ndarray] = logistic_score, block: int = BLOCK, most_sent: int = MOST_SENT) -> DataFrame:
    """Scores of every row against the stated queries: ``query_id, row_id, score`` and the rows' ``extra`` columns.

    Both sides have ``id`` and ``vec``; rows with a null id or vector are left out. Queries are those stated by the caller.
    """
    types = dict(rows.dtypes)
    schema = "query_id long, row_id long, score double" + "".join(f", {c} {types[c]}" for c in extra)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                q, v, r, m = _matrices(row)
                res = {"query_id": np.tile(q, len(r)), "row_id": np.repeat(r, len(q)), "score": scorer(v, m).ravel()}
                yield pd.DataFrame(res | {c: np.repeat(np.asarray(row[f"r_{c}"]), len(q)) for c in extra})

    return _met(queries, rows, extra, block, most_sent).mapInPandas(run, schema)


def search(queries: DataFrame, rows: DataFrame, k: int, block: int = BLOCK, most_sent: int = MOST_SENT) -> DataFrame:
    """The ``k`` rows most similar to each stated query by dot product: ``query_id, row_id, score, rank``; ties by id.

    Every pair of blocks keeps ``k`` candidates a query, so what is shuffled doesn't grow with the number of rows times
    that of queries.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                q, v, r, m = _matrices(row)
                s = v @ m.T
                order = np.lexsort((np.broadcast_to(r, s.shape), -s), axis=1)[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(q, order.shape[1]), "row_id": r[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

    out = _met(queries, rows, [], block, most_sent).mapInPandas(run, "query_id long, row_id long, score double")
    # the best k of arrays already cut to k: Spark's group limit cuts them again before the shuffle
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
