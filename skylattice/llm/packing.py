"""Filling containers of fixed capacity by vector bin packing.

An item has three sizes: tokens, segments (one) and loss-bearing tokens. A container has a limit on each. The container
in hand takes, of all items that still fit it, the one whose sizes have the largest dot product with the room left, each
dimension counted as a share of its limit. The product is scaled down for large items, so that the direction counts as
well: what the container has most of is used up first, short and long, asking and answering texts are mixed and none of
the limits is met early. When none fits, the next
container is opened. Items of equal sizes are interchangeable, so the search runs over different sizes, not items.

Scale: items are dealt by hash into groups of bounded size, each packed on its own; every group leaves at most one
container part-filled for want of items. No item is ever divided unless it alone exceeds a limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.encoding import FOLDER, encode_texts, merger, portions, read_ranks, spread
from skylattice.session import ensure_checkpoint_dir


def prompt_length(text: str) -> int:
    """Code points of the part that asks: the first block of a text of several blocks. A text of one block has none."""
    at = text.find("\n\n")
    return at + 2 if 0 <= at and text[at:].strip() and text[:at].strip() else 0


def token_sizes(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """``doc_id, tokens, prompt``: tokens of each whole text, and how many of them come before the loss-bearing part.

    A null text counts as empty; null ids and repeated rows are kept.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = merger(name, folder, ranks.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in portions(texts):
                _, tokens, offset, per_slice, slices_per_text = encode_texts(texts[lo:hi], merge)
                doc = np.repeat(np.arange(hi - lo), slices_per_text)
                asks = np.array([prompt_length(t) for t in texts[lo:hi]], np.int64)
                prompt = np.bincount(doc, weights=per_slice * (offset < asks[doc]), minlength=hi - lo).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(tokens.astype(np.int64)), pa.array(prompt)], names=["doc_id", "tokens", "prompt"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, tokens long, prompt long")


def cut(tokens: np.ndarray, prompt: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, tokens, loss-bearing tokens) of all parts in order: one of each item that fits, else the fewest there can be."""
    parts = np.maximum(1, -(-tokens // capacity))
    item = np.repeat(np.arange(len(tokens)), parts)
    start = (np.arange(len(item)) - np.repeat(np.cumsum(parts) - parts, parts)) * capacity
    end = np.minimum(start + capacity, tokens[item])
    return item, start, end - start, np.maximum(0, end - np.maximum(start, prompt[item]))


def fill(tokens: np.ndarray, loss: np.ndarray, capacity: int, segment_limit: int, loss_limit: int, balance: float = 0.75) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, what closed each container), by the dot-product rule. No item may exceed ``capacity``.

    An item of more loss-bearing tokens than their limit is never divided for that: it counts as the whole limit. What
    closed a container is the limit that the items left don't fit, or ``items`` if there were none. With ``balance`` 0 the
    products count as they are and long items go first, which leaves short ones that meet the segment limit at the end;
    with 1 only the direction counts and the last room is filled badly.
    """
    loss = np.minimum(loss, loss_limit)
    order = np.lexsort((loss, tokens))[::-1]
    t, w = tokens[order], loss[order]
    if not len(t):
        return np.zeros(0, np.int64), np.zeros(0, "U8")
    new = np.r_[True, (t[1:] != t[:-1]) | (w[1:] != w[:-1])]
    first = np.flatnonzero(new)
    size_t, size_w, count = t[first].astype(float), w[first].astype(float), np.diff(np.r_[first, len(t)])
    taken = np.zeros(len(first), np.int64)
    out, closed = np.empty(len(t), np.int64), []
    box, room, room_s, room_w, rest = 0, float(capacity), segment_limit, float(loss_limit), len(t)
    shares = np.stack([size_t / capacity, np.full(len(first), 1.0 / segment_limit), size_w / loss_limit])
    # one row a dimension, scaled; the last is far below any product where a size is used up
    rows = np.ascontiguousarray(np.vstack([shares / (shares**2).sum(axis=0) ** (balance / 2), np.zeros(len(first))]))
    used_up, gone = -1e9, 0
    while rest:
        lo = int(np.searchsorted(-size_t, -room))  # sizes run down; those before are too large
        k, best = lo, used_up
        if room_s and lo < len(size_t):
            score = np.array([room / capacity, room_s / segment_limit, room_w / loss_limit, 1.0]) @ rows[:, lo:]
            score[size_w[lo:] > room_w] = used_up
            k = lo + int(score.argmax())
            best = score[k - lo]
        if best > used_up / 2:
            out[first[k] + taken[k]] = box
            taken[k] += 1
            if taken[k] == count[k]:
                rows[3, k], gone = used_up, gone + 1
            room, room_s, room_w, rest = room - size_t[k], room_s - 1, room_w - size_w[k], rest - 1
            if rest and gone > 0.3 * len(first):  # forget sizes that are used up
                alive, gone = rows[3] == 0, 0
                size_t, size_w, count, first, taken, rows = size_t[alive], size_w[alive], count[alive], first[alive], taken[alive], np.ascontiguousarray(rows[:, alive])
        else:
            closed.append("tokens" if not (rows[3, lo:] == 0).any() else "segments" if not room_s else "loss")
            box, room, room_s, room_w = box + 1, float(capacity), segment_limit, float(loss_limit)
    closed.append("items" if room > 0 and room_s and room_w > 0 else "tokens" if room <= 0 else "segments" if not room_s else "loss")
    res = np.empty(len(t), np.int64)
    res[order] = out
    return res, np.array(closed)


def limits(capacity: int, items: int, tokens: int, loss: int, segment_slack: float, loss_slack: float) -> tuple[int, int]:
    """(segments, loss-bearing tokens) a container of so many tokens may hold: what a full one holds on average, and so much more."""
    if tokens <= 0:
        return max(1, capacity), max(1, capacity)
    return max(1, math.ceil(segment_slack * capacity * items / tokens)), max(1, min(capacity, math.ceil(loss_slack * capacity * loss / tokens)))


def pack(sizes: DataFrame, classes: DataFrame, group_items: int = 8000, segment_slack: float = 1.5, loss_slack: float = 1.1) -> DataFrame:
    """Every item in a container of each class: ``pack_class, container, doc_id, part, start_token, tokens, loss_tokens,
    closed_by``.

    ``sizes`` has ``doc_id, tokens, prompt``; ``classes`` has ``pack_class, capacity_tokens`` and is a short list whose
    length doesn't grow with the data. Limits of a container: ``capacity_tokens`` tokens, and as many segments and
    loss-bearing tokens as a full container of this corpus holds on average, times ``segment_slack`` and ``loss_slack``.
    An item of more tokens than the capacity is cut into as few parts as can be; parts that fill a container stand alone.
    No item is divided for its loss-bearing tokens: one that exceeds their limit alone uses it up. Items of no tokens
    take a segment. ``closed_by`` says what kept a container from taking more: ``tokens``, ``segments``, ``loss``, or
    ``items`` where none were left in its group. Container numbers are unique within a class. Repeated rows are items of
    their own; empty input, no rows. Sizes are written to the shared folder once, as they are read twice.
    """
    ensure_checkpoint_dir(sizes.sparkSession)
    capacities = {r["pack_class"]: int(r["capacity_tokens"]) for r in classes.where("pack_class is not null and capacity_tokens > 0").select("pack_class", "capacity_tokens").collect()}
    sizes = sizes.select("doc_id", "tokens", "prompt").checkpoint()
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    loss_of = F.greatest(F.col("tokens") - F.col("prompt"), F.lit(0))
    parts_of = [some(F.greatest(F.lit(1), F.ceil(F.col("tokens") / c))) for _, c in sorted(capacities.items())]
    n, tokens, loss, *parts = sizes.agg(F.count("*"), some("tokens"), some(loss_of), *parts_of).first()
    bounds = {k: limits(c, m, tokens, loss, segment_slack, loss_slack) for (k, c), m in zip(sorted(capacities.items()), parts)}
    groups = max(1, math.ceil(n / group_items))
    names = F.array(*[F.lit(n) for n in sorted(capacities)]) if capacities else F.array().cast("array<string>")
    # equal ids (repeated rows, nulls) must not crowd one group: the sizes are hashed in as well
    dealt = sizes.withColumn("group", F.pmod(F.xxhash64("doc_id", "tokens", "prompt", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())), F.lit(groups)).cast("long")).withColumn("pack_class", F.explode(names))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        capacity = capacities[key[0]]
        g = g.sort_values(["doc_id", "tokens", "prompt"], ignore_index=True)
        item, start, n_tokens, n_loss = cut(g["tokens"].to_numpy(), g["prompt"].to_numpy(), capacity)
        box, closed = fill(n_tokens, n_loss, capacity, *bounds[key[0]])
        return pd.DataFrame(
            {
                "pack_class": key[0], "container": int(key[1]) * (1 << 32) + box, "doc_id": g["doc_id"].to_numpy()[item], "part": start // capacity,
                "start_token": start, "tokens": n_tokens, "loss_tokens": n_loss, "closed_by": closed[box],
            }
        )

    # packing is slow for its few bytes: a fixed number of parts, or AQE would join them into one or two tasks
    spark = sizes.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    dealt = dealt.repartition(min(most, max(1, groups * len(capacities))), "pack_class", "group")
    schema = "pack_class string, container long, doc_id long, part long, start_token long, tokens long, loss_tokens long, closed_by string"
    return dealt.groupBy("pack_class", "group").applyInPandas(run, schema)
