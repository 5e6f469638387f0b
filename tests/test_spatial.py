from __future__ import annotations

import random

import numpy as np

from kerbstone.operators import spatial
from kerbstone.operators.spatial import RTree, containing_regions, near_samples


def brute(rows, radius):
    known = {r[0]: r for r in rows if r[0] is not None and r[2] is not None and r[3] is not None and r[2] == r[2] and r[3] == r[3] and (r[2], r[3]) != (0, 0)}
    q = [r for r in known.values() if r[1] == "query"]
    d = [r for r in known.values() if r[1] == "database"]
    return {(min(a[0], b[0]), max(a[0], b[0])) for a in q for b in d if (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= radius**2}


def check(spark, rows, radius=5.0):
    df = spark.createDataFrame(rows, "sample_id long, side string, northing double, easting double, id string")
    got = [tuple(r) for r in near_samples(df, radius).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, radius)
    return got


def cloud(n, width, seed, hot=0.0):
    r = random.Random(seed)
    spot = (5e6 + width / 2, 2.5e5 + width / 2)
    at = lambda: (spot[0], spot[1]) if r.random() < hot else (5e6 + r.randrange(int(width * 128)) / 128, 2.5e5 + r.randrange(int(width * 128)) / 128)
    return [(i, r.choice(["query", "database"]), *at(), None) for i in range(n)]


def test_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(spatial.near_pairs, "__defaults__", (40,))
    assert check(spark, cloud(1500, 300, 1))


def test_hot_place_is_salted(spark, monkeypatch):
    monkeypatch.setattr(spatial.near_pairs, "__defaults__", (30,))
    assert len(check(spark, cloud(600, 400, 2, hot=0.4))) > 10_000


def test_dirty_rows(spark):
    n = float("nan")
    rows = [(1, "query", 10.0, 10.0, "a"), (2, "database", 13.0, 14.0, "b"), (3, "database", 13.0, 14.0078125, None), (4, "database", 0.0, 0.0, None), (5, "query", 0.0, 3.0, None), (6, "database", 0.0, 0.5, None), (7, "query", n, 10.0, None), (8, "query", 10.0, None, None), (9, None, 10.0, 10.0, None), (10, "other", 10.0, 10.0, None), (None, "query", 10.0, 10.0, None)]
    assert sorted(check(spark, [*rows, rows[0], rows[1]])) == [(1, 2), (5, 6)]


def test_empty_and_single(spark):
    assert check(spark, []) == []
    assert check(spark, [(1, "query", 1.0, 1.0, None)]) == []


def test_sample_smaller_than_the_points(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SAMPLE_POINTS", 200)
    monkeypatch.setattr(spatial.near_pairs, "__defaults__", (50,))
    assert check(spark, cloud(3000, 500, 3))


def test_rtree_equals_brute_force():
    r = np.random.default_rng(5)
    for n in (1, 16, 17, 300):
        x1, y1 = r.uniform(0, 50, n), r.uniform(0, 50, n)
        x2, y2 = x1 + r.uniform(0, 3, n), y1 + r.uniform(0, 3, n)
        a, b = r.uniform(0, 50, 40), r.uniform(0, 50, 40)
        got = set(zip(*(v.tolist() for v in RTree(x1, y1, x2, y2).probe(a, b, a + 2, b + 2)), strict=True))
        assert got == {(i, k) for i in range(40) for k in range(n) if x1[k] <= a[i] + 2 and x2[k] >= a[i] and y1[k] <= b[i] + 2 and y2[k] >= b[i]}


def contains(ring, x, y):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def test_regions(spark):
    r = random.Random(9)
    points = [(i, float(r.randrange(400)), float(r.randrange(400))) for i in range(1500)]
    regions = []
    for k in range(25):
        x, y, n = r.randrange(-30, 400), r.randrange(-30, 400), r.choice([3, 4, 7])
        regions.append((k, [[float(x + r.randrange(120)), float(y + r.randrange(120))] for _ in range(n)]))
    regions.append((90, [[-1e6, -1e6], [1e6, -1e6], [1e6, 1e6], [-1e6, 1e6]]))
    regions.append((91, [[100.0, 100.0], [200.0, 100.0], [200.0, 200.0], [100.0, 200.0]]))
    dirty = [(91, None), (92, [[0.0, 0.0], [1.0, 1.0]]), (None, regions[-1][1]), (93, [[0.0, 0.0], [1.0, None], [2.0, 2.0]])]
    p = spark.createDataFrame([*points, points[0], (None, 1.0, 1.0), (7777, None, 1.0), (7778, float("nan"), 1.0)], "id long, x double, y double")
    g = spark.createDataFrame([*regions, *dirty], "region_id long, ring array<array<double>>")
    want = {(i, k) for i, x, y in points for k, ring in regions if contains(ring, x, y)}
    for leaf in (30, 10_000):
        got = [tuple(row) for row in containing_regions(p, g, leaf).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert containing_regions(p.limit(0), g).count() == containing_regions(p, g.limit(0)).count() == 0
