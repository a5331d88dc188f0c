"""Implausible readings: planted cases are found whole, natural motion and dirt are left alone."""

import numpy as np

from skylattice.functions.lifting import decompose, details
from skylattice.operators.outliers import flag_implausible, spikes

SCHEMA = "row_id long, flight string, t_us long, lat double, lon double, alt float, eph float, block int, field string"


def flight(rng, name, n=2500, hold=1, start=0):
    t = np.cumsum(rng.integers(195_000, 205_000, n)) + start
    t[n // 2 :] += 15_000_000  # a gap with movement
    s = t / 1e6
    lat, lon = 30 + 0.001 * np.sin(s / 60), 100 + 0.001 * np.cos(s / 80)
    lat, lon, alt = (v + rng.normal(0, k, n) for v, k in ((lat, 2e-6), (lon, 2e-6), (300 + 20 * np.sin(s / 50), 0.2)))
    at = np.arange(n) // hold * hold
    return [name, t, lat[at], lon[at], alt[at]]


def rows_of(f, first=0):
    name, t, lat, lon, alt = f
    return [(first + i, name, int(a), float(b), float(c), float(np.float32(x)), 1.0, 5, "x") for i, (a, b, c, x) in enumerate(zip(t, lat, lon, alt))]


def test_planted_cases(spark):
    rng = np.random.default_rng(5)
    want = set()
    rows = []
    for k, hold in enumerate((1, 2, 4)):
        f = flight(rng, f"f{k}", hold=hold)
        base = 10_000 * k
        for at, width in ((100, 1), (400, 3), (900, 8)):
            for col, field, off in ((2, "lat", 0.004), (4, "alt", 60.0)):
                f[col][at : at + width] = f[col][at : at + width] + off
                want |= {(base + i, field) for i in range(at, at + width)}
        f[3][1500:1560] = f[3][1500]
        want |= {(base + i, "lon") for i in range(1501, 1560)}
        f[2][2000], f[4][2100], f[3][2200] = 300.0, np.inf, -181.0
        want |= {(base + 2000, "lat"), (base + 2100, "alt"), (base + 2200, "lon")}
        f[2][700], f[4][701] = np.nan, np.nan
        rows += rows_of(f, base)
        rows.append((base + 9000, *rows_of(f, base)[400][1:]))  # a case delivered twice, and late
        want |= {(base + 9000, "lat"), (base + 9000, "alt")}
    rows += [(77_777, "f0", None, 999.0, 1.0, 1.0, 1.0, 0, ""), (77_778, None, 5, 1.0, 500.0, None, None, None, None), (None, "f0", 50, 1.0, 1.0, 9e9, None, None, None)]
    want |= {(77_777, "lat"), (77_778, "lon"), (None, "alt")}
    rng.shuffle(rows)
    got = flag_implausible(spark.createDataFrame(rows, SCHEMA)).select("row_id", "field").distinct().collect()
    assert {tuple(r) for r in got} == want


def test_cases_across_blocks(spark):
    rng = np.random.default_rng(6)
    f = flight(rng, "f", n=3000)
    edge = int(np.searchsorted(f[1], 60_000_000))
    f[2][edge - 20 : edge + 20] = f[2][edge - 20]
    f[4][edge - 2 : edge + 2] += 50
    got = flag_implausible(spark.createDataFrame(rows_of(f), SCHEMA), block_s=60, halo_s=20).select("row_id", "field").collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == {(i, "lat") for i in range(edge - 19, edge + 20)} | {(i, "alt") for i in range(edge - 2, edge + 2)}


def test_empty_and_short(spark):
    assert flag_implausible(spark.createDataFrame([], SCHEMA)).count() == 0
    two = [(1, "f", 1, 1.0, 1.0, 1.0, 1.0, 0, ""), (2, "f", 2, None, float("nan"), None, None, None, None)]
    assert flag_implausible(spark.createDataFrame(two, SCHEMA)).count() == 0


def test_a_step_is_no_spike():
    t = np.arange(40.0)
    v = np.r_[np.zeros(20), np.full(20, 50.0)] + np.random.default_rng(0).normal(0, 0.1, 40)
    scales = np.full(6, 0.1)
    assert not spikes(t, v, np.ones(40, int), 1, scales, scales, 0.2).any()
    v[10] += 50
    assert np.flatnonzero(spikes(t, v, np.ones(40, int), 1, scales, scales, 0.2)).tolist() == [10]


def test_excursions_of_any_width_and_number():
    """Neither the number of values or seconds of an excursion nor that of excursions is bounded."""
    rng = np.random.default_rng(1)
    for rate in (5, 50):
        t = np.cumsum(rng.uniform(0.9, 1.1, 30000)) / rate
        v = 2 * np.sin(t / 300) + rng.normal(0, 0.1, 30000)
        want = np.zeros(30000, bool)
        for at, width in ((300, 1), (500, 15), (900, 60), (1500, 200), (2600, 700)):
            v[at : at + width] += 40
            want[at : at + width] = True
        for at in range(4000, 4400, 4):  # a hundred, closer to each other than they are wide at coarse levels
            v[at] += 30 + at % 7 * 5
            want[at] = True
        ds = decompose(t, v, 20)
        levels, spans = (np.array([np.nanmedian(np.abs(d)) / 0.6745 for d in x]) for x in (ds, [details(t, v, 2**k)[0] for k in range(len(ds) - 1)]))
        got = spikes(t, v, np.ones(30000, int), 1, np.maximum.accumulate(levels), np.maximum.accumulate(spans), 0.4)
        assert np.array_equal(got, want), (rate, np.flatnonzero(got != want))


def test_decomposition():
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.uniform(0.1, 3, 500))
    assert all(np.nanmax(np.abs(d)) < 1e-9 for d in decompose(t, 3 * t - 7))
    v = np.zeros(500)
    v[200] = 8
    ds = decompose(t, v)
    assert len(ds) == 9 and all(np.isnan(d[[0, -1]]).all() and np.isfinite(d[1:-1]).all() for d in ds)
    assert ds[0][200] == 8 and np.count_nonzero(np.nan_to_num(ds[0])) == 3
    even = np.arange(500.0)
    assert [decompose(even, v)[k][200] for k in (0, 1)] == [8, 6 + 1]  # updated by a quarter of both details of -4; at a distance of two by one of them
    for n in range(4):
        assert len(decompose(t[:n], v[:n])) == (n > 2) * 2
