"""Related records stay together; shares are met; components equal a union-find."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skylattice.llm.splits import assign_splits, balance, components, difference, flight_key, hand_out, leaking_areas, split_label

BANK = "bank_row long, area int, node int, split string, component string, label string"
PAIR = "pair_id long, flight string, area int, component string, weight int"


def union(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    e = [(f"n{a:04d}", f"n{b:04d}") for a, b in rng.integers(0, 400, (330, 2))]
    e += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(120)]  # a long path
    e += [("hub", f"h{i}") for i in range(200)]
    df = spark.createDataFrame([*e, (None, "x"), ("y", None), ("z", "z")], "u string, v string")
    got = {r.node: r.component for r in components(df).collect()}
    want = {k: v for k, v in union([x for x in e if x[0] != x[1]]).items()}
    assert got == want


def test_labels_and_tags(spark):
    tags = ["bag_0007_20270724_023051", " bag_0007_20270724_023051 ", "BAG_0007_20270724_023051", "bag_7_20270724_023051", "bag-0007-20270724-023051", "bag_0007_2027-07-24_02-30-51",
            "Bag 0007 20270724 023051", "/rec/bags/bag_0007_20270724_023051/bag_0007_20270724_023051_0.db3", "./x/bag_0007_20270724_023051_debug", "bag_0007_20270724_023051/"]
    other = ["bag_0070_20270724_023051", "bag_0007_20270724_023052", "bag_0007_20270725_023051"]
    df = spark.createDataFrame([(t,) for t in [*tags, *other, "", "  ", None, "Other"]], "t string")
    got = [r.k for r in df.select(flight_key(F.col("t")).alias("k")).collect()]
    assert len(set(got[:10])) == 1 and len(set(got[:13])) == 4 and got[13:] == [None, None, None, "other"]
    labels = spark.createDataFrame([(x,) for x in ["trn", " train", "VAL", "validation", "testing", None, "?"]], "x string").select(split_label(F.col("x")).alias("y"))
    assert [r.y for r in labels.collect()] == ["train", "train", "val", "val", "test", None, None]


def test_differencing_balances_and_keeps_places_apart():
    w = np.random.default_rng(0).pareto(1.5, 4000) + 0.1
    at = difference([np.array([x]) for x in w], 50)
    sums = np.bincount([a[0] for a in at], weights=w, minlength=50)
    assert sums.max() < max(1.02 * w.sum() / 50, w.max() + 1e-9) or sums.max() - sums.min() <= w.max()
    tuples = [np.sort(np.random.default_rng(k).random(50))[::-1] for k in range(40)]
    at = difference(tuples, 50)
    assert all(sorted(a) == list(range(50)) for a in at)
    total = np.zeros(50)
    for t, a in zip(tuples, at):
        total[a] += t
    assert total.max() - total.min() < 0.5
    assert difference([], 5) == []


def test_hand_out_whole_bins():
    got = pd.Series(hand_out(np.ones(100), {"train": 0.8, "val": 0.1, "test": 0.1})).value_counts()
    assert got.to_dict() == {"train": 80, "val": 10, "test": 10}


def test_balance_in_many_chunks(spark):
    rng = np.random.default_rng(4)
    w = spark.createDataFrame([(f"c{i}", float(x)) for i, x in enumerate(rng.integers(1, 300, 3000))], "component string, weight double")
    out = balance(w, {"train": 0.8, "val": 0.1, "test": 0.1}, bins=50, chunk_items=100, fan=4).join(w, "component").toPandas()
    assert len(out) == 3000 and out.component.is_unique and out.bin.nunique() == 50
    share = out.groupby("split").weight.sum() / out.weight.sum()
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["val"] - 0.1) < 0.01


def tables(spark, n=400):
    rng = np.random.default_rng(9)
    bank = [(i, int(a) if a % 11 else None, 0, str(rng.choice(["train", "Val ", "TEST"])) if a % 7 else "train", "x", "y") for i, a in enumerate(rng.integers(0, 60, n))]
    pairs = [(i, f"bag_{f:04d}_20270724_02{f % 60:02d}51" if f % 9 else None, int(a) if a % 5 else None, "x", 3) for i, (f, a) in enumerate(zip(rng.integers(0, 80, n), rng.integers(0, 70, n)))]
    bank, pairs = bank + bank[:20], pairs + pairs[:20]
    return spark.createDataFrame(bank, BANK), spark.createDataFrame(pairs, PAIR), bank, pairs


def test_splits_and_leaks(spark):
    b, p, bank, pairs = tables(spark)
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split string, share double")
    out = assign_splits(b, p, targets, bins=20).toPandas()
    assert len(out) == len(bank) + len(pairs) and out.split.notna().all()
    assert out.dropna(subset=["area"]).groupby("area").split.nunique().max() == 1
    assert out.dropna(subset=["flight"]).groupby("flight").split.nunique().max() == 1
    groups = union([(f"a{a}", f"f{f}") for _, f, a, _, _ in pairs if f and a is not None])
    seen = {}
    for _, a, _, s, _, _ in bank:
        if a is not None and s:
            seen.setdefault(groups.get(f"a{a}", f"a{a}"), set()).add(s.strip().lower()[:2])
    want = {a for _, a, _, _, _, _ in bank if a is not None and len(seen.get(groups.get(f"a{a}", f"a{a}"), ())) > 1}
    got = [r.area for r in leaking_areas(b, p).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_empty(spark):
    b, p = spark.createDataFrame([], BANK), spark.createDataFrame([], PAIR)
    assert leaking_areas(b, p).count() == 0
    targets = spark.createDataFrame([("train", 1.0)], "split string, share double")
    assert assign_splits(b, p, targets).count() == 0
