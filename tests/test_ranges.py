"""Counts in boxes and disks against all pairs."""

import numpy as np
import pytest

from terraloom.operators import ranges


def _some(seed, n, step):
    rng = np.random.default_rng(seed)
    return [np.round(rng.uniform(-60, 60, n) / step) * step for _ in range(2)]


@pytest.mark.parametrize("seed,n,step", [(0, 400, 0.1), (1, 900, 3.0), (2, 1, 1.0), (3, 0, 1.0), (4, 257, 0.7)])
@pytest.mark.parametrize("rule", [ranges.between, ranges.reach])
def test_counts_in_boxes_are_those_of_all_pairs(seed, n, step, rule):
    (px, py), (cx, cy), sizes = _some(seed, n, step), _some(seed + 100, 300, step), (3.0, 6.3, 12.0)
    weights = np.random.default_rng(seed).integers(0, 2, (n, 3)).astype(np.int32)
    got = ranges.sums_in_boxes(px, py, weights, cx, cy, sizes, rule)
    dx, dy = px - cx[:, None], py - cy[:, None]
    for i, s in enumerate(sizes):
        inside = np.ones(dx.shape, bool)
        for p, c, d in ((px, cx[:, None], dx), (py, cy[:, None], dy)):
            h = max(sizes) if rule is ranges.reach else s
            inside &= (p >= c - h) & (p <= c + h) & ((np.abs(d) <= s) if rule is ranges.reach else True)
        assert (got[:, 3 * i : 3 * i + 3] == inside.astype(np.int64) @ weights).all()


def test_boxes_across_tiles_and_places_named_twice(spark):
    from pyspark.sql import functions as F

    (px, py), (cx, cy) = _some(5, 500, 0.5), _some(6, 80, 0.5)
    points = spark.createDataFrame([*zip(px.tolist(), py.tolist()), (None, 1.0), (float("nan"), 1.0)], "px double, py double")
    ids = [i // 2 for i in range(80)]
    places = spark.createDataFrame([*zip(ids, cx.tolist(), cy.tolist()), (99, None, 2.0)], "loc_id long, cx double, cy double")
    got = {r.loc_id: r.n_0 for r in ranges.counts_in_boxes(points, places, (2.5,), {"n": F.lit(True)}).collect()}
    inside = ((np.abs(px - cx[:, None]) <= 2.5) & (np.abs(py - cy[:, None]) <= 2.5)).sum(1)
    for i in range(40):
        assert got.get(i, 0) == inside[2 * i] + inside[2 * i + 1]
    assert not got.get(99)


@pytest.mark.parametrize("seed,n,spread", [(0, 700, 4.0), (1, 3000, 6.0), (2, 1, 1.0), (3, 0, 1.0), (4, 2000, 1.0)])
def test_sums_in_disks_and_sectors_are_those_of_all_pairs(seed, n, spread):
    from terraloom.operators import disks

    rng, radius = np.random.default_rng(seed), 6378137.0
    lat, lon, alat, alon = (np.round(mid + rng.uniform(-spread, spread, m), 2) for m, mid in ((n, 50.0), (n, 7.0), (150, 50.0), (150, 7.0)))
    px, py, cx, cy = np.radians(lon) * radius, np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)) * radius, np.radians(alon) * radius, np.log(np.tan(np.pi / 4 + np.radians(alat) / 2)) * radius
    weights = rng.integers(0, 9, (n, 2)).astype(np.int64)
    dx, dy = px - cx[:, None], py - cy[:, None]
    d = np.sqrt(dx * dx + dy * dy)
    a, b, dl = np.radians(alat)[:, None], np.radians(lat), np.radians(lon - alon[:, None])
    bearing = np.degrees(np.arctan2(np.sin(dl) * np.cos(b), np.cos(a) * np.sin(b) - np.sin(a) * np.cos(b) * np.cos(dl)))
    sector = ((bearing + 45) % 360 // 90).astype(int)
    limits = ((25_000.0, True), (50_000.0, False), (200_000.0, False))
    plain = disks.sums_in_disks(px, py, weights, cx, cy, limits)
    cut = disks.sums_in_disks(px, py, weights, cx, cy, limits, (lat, lon), (alat, alon))
    for i, (r, open_) in enumerate(limits):
        inside = (d < r) if open_ else (d <= r)
        assert (plain[:, i, 0] == inside.astype(np.int64) @ weights).all()
        for s in range(4):
            assert (cut[:, i, s] == (inside & (sector == s)).astype(np.int64) @ weights).all()
