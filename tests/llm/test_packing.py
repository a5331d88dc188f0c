"""Containers: limits kept, nothing lost or divided without need, little room left."""

import math

import numpy as np
import pandas as pd
import pytest

from skylattice.llm.packing import cut, fill, limits, pack, prompt_length, token_sizes

SCHEMA = "doc_id long, tokens long, prompt long, container string, part int"
CLASSES = [("s", 100), ("m", 1000)]


def packed(spark, items, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in items], SCHEMA)
    return pack(df, spark.createDataFrame(CLASSES, "pack_class string, capacity_tokens int"), **kw).toPandas()


def test_all_items_whole_and_within_limits(spark):
    rng = np.random.default_rng(1)
    items = [(i, int(t), int(t * p)) for i, (t, p) in enumerate(zip(rng.integers(0, 180, 3000), rng.random(3000)))]
    items += items[:50] + [(None, 5, 0), (None, 5, 0), (9999, 2500, 30)]
    out = packed(spark, items, group_items=700)
    want = pd.DataFrame(items, columns=["doc_id", "tokens", "prompt"])
    loss = (want.tokens - want.prompt).clip(lower=0).sum()
    for name, cap in CLASSES:
        x = out[out.pack_class == name]
        segments, loss_limit = limits(cap, len(x), want.tokens.sum(), loss, 1.5, 1.1)
        g = x.groupby("container").agg(t=("tokens", "sum"), n=("tokens", "size"), w=("loss_tokens", lambda v: np.minimum(v, loss_limit).sum()), why=("closed_by", "nunique"))
        assert g.t.max() <= cap and g.n.max() <= segments and g.w.max() <= loss_limit < cap and (g.why == 1).all()
        assert x.tokens.sum() == want.tokens.sum() and x.loss_tokens.sum() == loss
        assert (x.part == 0).sum() == len(items)
        whole = want[want.tokens <= cap].doc_id
        assert (x[x.doc_id.isin(whole.dropna())].part == 0).all()


def test_each_limit_binds(spark):
    rng = np.random.default_rng(2)
    tokens = np.minimum(rng.lognormal(3.0, 1.4, 6000).astype(int) + 1, 400)
    asked = np.where(rng.random(6000) < 0.4, rng.random(6000) * 0.9, 0.0)  # four in ten have a prompt
    out = packed(spark, [(i, int(t), int(t * p)) for i, (t, p) in enumerate(zip(tokens, asked))])
    for name, cap in CLASSES:
        x = out[out.pack_class == name]
        assert {"tokens", "segments", "loss"} <= set(x.closed_by) <= {"tokens", "segments", "loss", "items"}


@pytest.mark.parametrize("slack, room", [(100.0, 1.02), (1.5, 1.05)])
def test_little_room_is_left(spark, slack, room):
    rng = np.random.default_rng(2)
    items = [(i, int(t), 0) for i, t in enumerate(np.minimum(rng.lognormal(3.2, 0.9, 4000).astype(int) + 1, 100))]
    out = packed(spark, items, segment_slack=slack)
    for name, cap in CLASSES:
        x = out[out.pack_class == name]
        assert x.container.nunique() <= room * math.ceil(x.tokens.sum() / cap) + 1


def by_size(tokens, loss, capacity, segments, loss_limit):
    """Best fit by size: always the largest item that fits all limits."""
    left, boxes = sorted(zip(tokens.tolist(), np.minimum(loss, loss_limit).tolist()), reverse=True), 0
    while left:
        boxes, room, seg, w, rest = boxes + 1, capacity, segments, loss_limit, []
        for t, v in left:
            if t <= room and seg and v <= w:
                room, seg, w = room - t, seg - 1, w - v
            else:
                rest.append((t, v))
        left = rest
    return boxes


def test_the_dot_product_beats_best_fit_by_size():
    rng = np.random.default_rng(3)
    tokens = np.minimum(rng.lognormal(4.5, 1.0, 3000).astype(int) + 1, 1000)
    loss = np.where(rng.random(3000) < 0.4, tokens // 3, tokens)
    segments, loss_limit = limits(1000, 3000, tokens.sum(), loss.sum(), 1.5, 1.1)
    box, _ = fill(tokens, loss, 1000, segments, loss_limit)
    assert box.max() + 1 < 0.95 * by_size(tokens, loss, 1000, segments, loss_limit)


def test_cut():
    item, start, n, loss = cut(np.array([0, 100, 101, 350]), np.array([0, 0, 50, 120]), 100)
    got = list(zip(item.tolist(), start.tolist(), n.tolist(), loss.tolist()))
    assert got == [(0, 0, 0, 0), (1, 0, 100, 100), (2, 0, 100, 50), (2, 100, 1, 1), (3, 0, 100, 0), (3, 100, 100, 80), (3, 200, 100, 100), (3, 300, 50, 50)]


def test_fill_prefers_what_fills():
    sizes = np.array([60, 50, 40, 30, 20])
    box, _ = fill(sizes, np.zeros(5, int), 100, 10, 100, balance=0)
    assert box.max() == 1 and sorted(np.bincount(box, weights=sizes)) == [100, 100]
    assert len(fill(np.array([], int), np.array([], int), 10, 1, 10)[0]) == 0
    box, why = fill(np.zeros(20, int), np.zeros(20, int), 10, 6, 10)
    assert box.max() == 3 and why.tolist() == ["segments"] * 3 + ["items"]
    box, why = fill(np.full(4, 50), np.full(4, 50), 100, 9, 60)  # more than half the loss limit each, but whole
    assert box.max() == 3 and why.tolist() == ["loss"] * 3 + ["items"]
    box, why = fill(np.array([90, 10, 10]), np.array([90, 0, 10]), 100, 9, 60)  # more than the loss limit: it uses that up
    assert box.tolist() == [0, 0, 1]


def test_limits():
    assert limits(1000, 20, 2000, 1000, 1.5, 1.1) == (15, 550)
    assert limits(1000, 20, 2000, 2000, 1.5, 1.1) == (15, 1000)
    assert limits(10, 5, 0, 0, 1.5, 1.1) == (10, 10)


def test_prompt_length():
    assert [prompt_length(t) for t in ("", "one block", "Q?\n\nA.", "\n\nA", "A\n\n ")] == [0, 0, 4, 0, 0]


def test_sizes(spark):
    from skylattice.llm.encoding import PairMerger, encode_texts, read_ranks

    texts = ["Heading\n\nBody of text.", "", None, "word " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.tokens, r.prompt) for r in token_sizes(df).collect()}
    n = [len(encode_texts([t or ""], PairMerger(read_ranks()))[0]) for t in texts]
    assert [got[i][0] for i in range(4)] == n
    assert got[0][1] == 4 and got[3][1] == 0  # "Head" "ing" and the two line breaks
    assert token_sizes(df.limit(0)).count() == 0


@pytest.mark.parametrize("classes", [[], [(None, 5), ("z", 0)]])
def test_no_classes(spark, classes):
    df = spark.createDataFrame([(1, 5, 0, "x", 1)], SCHEMA)
    assert pack(df, spark.createDataFrame(classes, "pack_class string, capacity_tokens int")).count() == 0
